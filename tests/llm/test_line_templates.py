"""Line templates on planted lines."""

import random

from proofweave.llm import line_templates as L
from tests.llm.conftest import LONG, ODD


def test_variable_fields_and_recurrence(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        own = " ".join(f"w{rng.randrange(10**6)}x" for _ in range(3)) + " only here " + rng.choice("abc") * (i + 1)
        lines = [own, f"job {i} done in {rng.randrange(99)} ms"]
        lines.append(f"Please read the {rng.choice('pqrstuvwxyz')}{'y' * i} terms before use")
        if i < 9:
            lines.append("too few documents have this line")
        lines += ["", "Home", "job done"]
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r for r in L.drop_recurring_lines(spark.createDataFrame(rows, LONG)).collect()}
    for i, text in rows:
        kept = got[i]["text"].split("\n")
        want = [x for x in text.split("\n") if not x.startswith(("job ", "Please")) or x == "job done"]
        assert kept == want
        assert got[i]["n_lines"] == len(text.split("\n")) and got[i]["n_dropped"] == 2


def test_repeats_in_one_document_do_not_count(spark):
    rows = [(1, "\n".join(["the same line again here"] * 50)), (2, "x")]
    assert {r["n_dropped"] for r in L.drop_recurring_lines(spark.createDataFrame(rows, LONG)).collect()} == {0}


def test_long_lines_recur_from_two_documents(spark):
    long = [" ".join(f"{c}{'x' * (i % 7)}y{'z' * (i // 7)}" for i in range(50)) for c in "abc"]
    rows = [(1, f"one\n{long[0]}"), (2, f"two\n\t{long[0].replace(' ', '  ')} \nend"), (3, f"{long[1]}\n{long[1]}")]
    rows += [(4, f"{long[2]} 7"), (5, f"{long[2]} 8x"), (6, " ".join(long[1].split()[:49])), (7, " ".join(long[1].split()[:49]))]
    got = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(spark.createDataFrame(rows, LONG)).collect()}
    assert got == dict(rows) | {1: "one", 2: "two\nend", 4: "", 5: ""}


def test_many_leaves_and_blanks(spark, monkeypatch):
    """The shuffled join of leaves, and masks against a plain version."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        tokens = [rng.choice(["ab", "4x", "x4", "é", "a.b", "9", "y"]) for _ in range(8)]
        rows.append((i, rng.choice([" ", "\t", " \f "]).join(tokens) + "\r\n \nthe lines end  with this\x0b" + str(i)))
    frame = spark.createDataFrame(rows, LONG)
    masked = frame.select("doc_id", L._masked_lines(L.F.col("text")).alias("m")).collect()
    import re

    for (_, text), (_, got) in zip(rows, masked):
        want = []
        for line in text.split("\n"):
            parts = [t for t in re.split("[ \t\r\f\x0b]+", line) if t]
            want.append(" ".join("<*>" if re.search("[0-9]", t) else t for t in parts))
        assert got == want
    plain = sorted(map(tuple, L.drop_recurring_lines(frame).collect()))
    monkeypatch.setattr(L, "BROADCAST_LEAVES", 0)
    assert sorted(map(tuple, L.drop_recurring_lines(frame).collect())) == plain


def test_odd_rows(spark, odd, none):
    out = L.drop_recurring_lines(odd)
    assert out.columns == odd.columns + ["n_lines", "n_dropped"]
    rows = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert rows == sorted(((k, t or "") for k, t in ODD), key=str)
    assert L.drop_recurring_lines(none).count() == 0
    many = spark.createDataFrame([(None, "null ids share this line") for _ in range(20)], LONG)
    assert {r["n_dropped"] for r in L.drop_recurring_lines(many).collect()} == {0}  # one text, one document
    clash = spark.createDataFrame([(1, "a", 7)], LONG + ", n_lines int")
    assert L.drop_recurring_lines(clash).columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
