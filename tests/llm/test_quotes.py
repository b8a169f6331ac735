"""Quotation linking by hand and against a walk in plain Python."""

import random
import re

from proofweave.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Own lines, originals and branches, message by message."""
    convs = {}
    for c, t, _, text in rows:
        convs.setdefault(c, {})[t] = text
    out = {}
    for c, texts in convs.items():
        said, branch, last = {}, None, None
        for t in sorted(texts):
            for line in texts[t].split("\n"):
                if not line.startswith(">") and line.strip():
                    said.setdefault(" ".join(line.lower().split()), t)
        for t in sorted(texts):
            found, quoted, linked = [], 0, 0
            for line in texts[t].split("\n"):
                m = re.match(r"(>(?: ?>)*) ?(.*)", line)
                if m and m.group(2).strip():
                    quoted += 1
                    o = said.get(" ".join(m.group(2).lower().split()))
                    if o is not None and o < t:
                        linked += 1
                        if m.group(1).count(">") == 1:
                            found.append(o)
            if found:
                branch = (t, max(found))
            own = "\n".join(x for x in texts[t].split("\n") if not x.startswith(">")).strip()
            out[c, t] = (own, max(found) if found else last, branch and branch[0], branch and branch[1], quoted, linked)
            last = t
    return out


def test_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 4)
    rng = random.Random(8)
    rows = []
    for c in range(6):
        lines = []
        for t in sorted(rng.sample(range(40), 15)):
            text = [f"Line {rng.randrange(30)} of  talk"]
            for _ in range(rng.randrange(3)):
                if lines:
                    text.append("> " * rng.choice([1, 1, 2]) + rng.choice(lines).upper())
            if rng.random() < 0.2:
                text.append("> nobody said this")
            lines.append(text[0])
            rows.append((c, t, "user", "\n".join(text)))
    got = {(r[0], r[1]): tuple(r)[3:] for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
    assert any(v[2] is not None for v in got.values())
    key = lambda kv: (kv[0][0], kv[1][3] is not None, kv[1][3], kv[1][2], kv[0][1])
    at = {k: i for i, (k, _) in enumerate(sorted(got.items(), key=lambda kv: tuple(-1 if x is None else x for x in key(kv))))}
    for (c, t), v in got.items():
        assert v[1] is None or at[c, v[1]] < at[c, t]


def test_intro_lines_and_nesting(spark):
    rows = [
        (1, 0, "a", "Shall we meet?"),
        (1, 1, "b", "Ann wrote:\n> Shall we meet?\nYes, at noon"),
        (1, 2, "c", "Bob wrote:\n>> shall we  MEET?\n> Yes, at noon\nFine. She wrote:"),
    ]
    got = {r["turn"]: r for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[t]["content"] for t in range(3)] == ["Shall we meet?", "Yes, at noon", "Fine. She wrote:"]
    assert [got[t]["reply_to"] for t in range(3)] == [None, 0, 1]
    assert (got[2]["n_quoted"], got[2]["n_linked"]) == (2, 2)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "> x"), (1, None, "u", "x"), (2, 0, None, None), (2, 0, None, None), (2, 5, "u", ""), (2, 7, "u", "> > >\n>")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as lines", "2 as block", "3 as branch")
    got = Q.reply_order(frame).collect()
    assert len(got) == len(rows)
    assert {r["turn"]: r["reply_to"] for r in got if r["conv_id"] == 2} == {0: None, 5: 0, 7: 5}
    assert all(r["reply_to"] is None for r in got if r["conv_id"] is None or r["turn"] is None)
    assert Q.reply_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rewrapped_passage(spark):
    rows = [
        (1, 0, "a", "Thanks,\nsee you"),
        (1, 1, "b", "The long paragraph of this message was wrapped\nat one width and goes on. Thanks,\nBob"),
        (1, 2, "c", "Something else"),
        (1, 3, "d", "> the long paragraph of this\n> message was wrapped at one width\n> and goes on.\n> Thanks,\n>\n> nobody said\n> this passage\nAgreed"),
    ]
    got = {r["turn"]: r for r in Q.reply_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[t]["reply_to"] for t in range(4)] == [None, 0, 1, 1]
    assert (got[3]["n_quoted"], got[3]["n_linked"], got[3]["anchor_turn"], got[3]["content"]) == (6, 4, 1, "Agreed")
