import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofweave.functions.identity import compact_key, full_key
from proofweave.operators import fusion, lexical, rerank, scope, sizing, vector
from proofweave.operators.lexical_lists import scaled
from proofweave.operators.sizing import DROP_SHUFFLES, materialize
from proofweave.registry import bindings


def model_covers(spots, terms):
    """All minimal intervals, by trying every pair of ends."""
    found = []
    for start, _ in spots:
        for end, _ in spots:
            inside = [(p, t) for p, t in spots if start <= p <= end]
            if {t for _, t in inside} == set(terms):
                found.append((start, end, len(inside)))
    minimal = [
        s for s in found
        if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in found)
    ]
    return sum(1 / (2 + end - start - n) for start, end, n in minimal)


def test_cover_density_matches_brute_force(spark):
    rng = random.Random(5)
    cases = []
    for n in range(150):
        terms = ["a", "b", "c", "d"][: rng.randint(1, 4)]
        spots = sorted(rng.sample(range(1, 40), rng.randint(len(terms), 12)))
        names = terms + [rng.choice(terms) for _ in range(len(spots) - len(terms))]
        rng.shuffle(names)
        cases.append((n, terms, list(zip(spots, names, strict=True))))
    frame = spark.createDataFrame(
        cases, "n int, terms array<string>, occurrences array<struct<pos:int,term:string>>"
    )
    score = lexical._term_density(F.col("occurrences"), F.col("terms"))
    got = {r.n: r.s for r in frame.select("n", score.alias("s")).collect()}
    for n, terms, spots in cases:
        assert got[n] == pytest.approx(model_covers(spots, terms))


def test_lexical_needs_every_term_and_respects_scope(spark):
    chunks = spark.createDataFrame(
        [
            ("c1", "t", ["g"], "alpha beta gamma", "Title"),
            ("c2", "t", ["h"], "alpha beta", "Title"),
            ("c3", "u", ["g"], "alpha beta", "Title"),
            ("c4", "t", ["g"], "alpha", "About beta"),
            ("c5", "t", ["g"], "alpha only", "Title"),
        ],
        "chunk_id string, enterprise_id string, principals array<string>, content string, title string",
    )
    asked = spark.createDataFrame(
        [("q", "full", "t", ["g"], "The alpha of BETA"), ("none", "full", "t", ["g"], "the of")],
        "question_id string, form string, enterprise_id string, principals array<string>, query_text string",
    )
    rows = lexical.lexical_top(asked, lexical.index_chunks(chunks)).orderBy("lex_rank").collect()
    assert [(r.question_id, r.chunk_id) for r in rows] == [("q", "c1"), ("q", "c4")]


CHUNK = "chunk_id string, enterprise_id string, principals array<string>, content string, title string"
ATTEMPT = "question_id string, form string, enterprise_id string, principals array<string>, query_text string"


def test_lexical_words_keep_accents_and_scripts(spark):
    chunks = spark.createDataFrame(
        [
            ("c1", "t", ["g"], "Los NIÑOS de la montaña", "t"),
            ("c2", "t", ["g"], "los ni os de la monta a", "t"),
            ("c3", "t", ["g"], "правила хранения", "t"),
        ],
        CHUNK,
    )
    asked = spark.createDataFrame(
        [("a", "full", "t", ["g"], "niños montaña"), ("b", "full", "t", ["g"], "Правила?"),
         ("c", "full", "t", ["g"], "ni os")],
        ATTEMPT,
    )
    rows = lexical.lexical_top(asked, lexical.index_chunks(chunks)).collect()
    assert {(r.question_id, r.chunk_id) for r in rows} == {("a", "c1"), ("b", "c3"), ("c", "c2")}


def test_other_forms_of_a_word_match(spark):
    chunks = spark.createDataFrame(
        [
            ("c1", "t", ["g"], "The vendor retains policy records", "Retention"),
            ("c2", "t", ["g"], "retained by a retaining policy", "t"),
            ("c3", "t", ["h"], "retain policies", "t"),
            ("c4", "t", ["g"], "policing retainers", "t"),
            ("c5", "t", ["g"], "", ""),
        ],
        CHUNK,
    )
    asked = spark.createDataFrame(
        [("a", "full", "t", ["g"], "Retained policies"), ("b", "full", "t", ["g"], "policy policies"),
         ("c", "full", "t", ["g"], "the of")],
        ATTEMPT,
    )
    index = lexical.index_chunks(chunks)
    plain = lexical.lexical_top(asked, index).collect()
    assert plain == []
    rows = lexical.lexical_top(asked, lexical.stem_index(index), stem=True).collect()
    assert {(r.question_id, r.chunk_id): r.score for r in rows} == {
        ("a", "c1"): 1.0, ("a", "c2"): 1.0, ("b", "c1"): 1.0, ("b", "c2"): 1.0}
    stems = lexical.stem_index(index).filter("chunk_id = 'c2'").first()
    assert stems.terms == ["retain", "polici", "t"][:2]
    assert [(i.pos, i.term) for i in stems.lexemes][:3] == [(1, "retain"), (4, "retain"), (5, "polici")]


def test_access_is_decided_before_positions_are_read(spark):
    """In the optimised plan, the access test lies below the join that brings positions."""
    chunks = spark.createDataFrame([("c", "t", ["g"], "alpha beta", "t")], CHUNK)
    asked = spark.createDataFrame([("q", "full", "t", ["g"], "alpha beta")], ATTEMPT)
    index = lexical.index_chunks(chunks)
    lines = (
        lexical.lexical_matches(asked, index)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    )
    def depth(part):
        return [len(line) - len(line.lstrip(" :+-")) for line in lines if part in line]

    assert min(depth("arrays_overlap")) > min(depth("Join Inner"))


def test_access_with_thousands_of_principals(spark):
    rng = random.Random(3)
    stored = [(f"c{n:05}", "t", [f"user:{n}", f"team:{n % 700}"], [1.0, n / 10_000]) for n in range(10_000)]
    asked = [(f"q{n}", "t", [f"user:{rng.randrange(10_000)}", f"team:{n}"], [1.0, 0.0]) for n in range(20)]
    columns = "enterprise_id string, principals array<string>, embedding array<float>"
    rows = vector.vector_top(
        spark.createDataFrame(asked, f"question_id string, {columns}"),
        spark.createDataFrame(stored, f"chunk_id string, {columns}"),
        50,
        2,
    ).collect()
    got = {q[0]: set() for q in asked}
    for row in rows:
        got[row.question_id].add(row.chunk_id)
    for name, _, principals, _ in asked:
        assert got[name] == {c[0] for c in stored if set(c[2]) & set(principals)}


def test_vector_ranking_is_exact_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUESTIONS_PER_BLOCK", 3)
    monkeypatch.setattr(vector, "CHUNKS_PER_BLOCK", 5)
    rng = np.random.default_rng(1)
    groups = ["g", "h"]
    made = [
        (f"c{n:02}", "t" if n % 3 else "u", [groups[n % 2]], rng.normal(size=8).tolist())
        for n in range(60)
    ]
    made.append(("none", "t", ["g"], None))
    asked = [(f"q{n}", "t", ["g"] if n % 2 else groups, rng.normal(size=8).tolist()) for n in range(8)]
    columns = "enterprise_id string, principals array<string>, embedding array<float>"
    chunks = spark.createDataFrame(made, f"chunk_id string, {columns}")
    questions = spark.createDataFrame(asked, f"question_id string, {columns}")
    got = {}
    for row in vector.vector_top(questions, chunks, 20, 8).orderBy("vec_rank").collect():
        got.setdefault(row.question_id, []).append(row.chunk_id)

    def cos(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    for name, tenant, principals, vec in asked:
        allowed = [m for m in made if m[1] == tenant and m[3] and set(m[2]) & set(principals)]
        best = sorted(allowed, key=lambda m: (-round(cos(vec, m[3]), 8), m[0]))[:20]
        assert got[name] == [m[0] for m in best]


def test_wrong_vector_size_is_an_error(spark):
    rows = [("x", "t", ["g"], [1.0, 2.0])]
    columns = "enterprise_id string, principals array<string>, embedding array<float>"
    chunks = spark.createDataFrame(rows, f"chunk_id string, {columns}")
    questions = spark.createDataFrame(rows, f"question_id string, {columns}")
    with pytest.raises(Exception, match="embedding dimension must be 8"):
        vector.vector_top(questions, chunks, 20, 8).collect()


def ranked(spark, start, name):
    rows = [("q", "full", f"c{n:03}", n - start + 1) for n in range(start, start + 100)]
    return spark.createDataFrame(rows, f"question_id string, form string, chunk_id string, {name} int")


def test_fusion_keeps_the_best_forty(spark):
    tried = spark.createDataFrame([("q", "full")], "question_id string, form string")
    lists = ranked(spark, 0, "lex_rank"), ranked(spark, 50, "vec_rank"), tried
    rows = fusion.fuse(*lists).orderBy("fused_rank").collect()
    assert len(rows) == 40 and rows[0].chunk_id == "c050"
    assert rows[0].rrf_score == pytest.approx(1 / 111 + 1 / 61)
    for bad in ({"top_k": 200}, {"top_k": 29}, {"rank_constant": 0}):
        with pytest.raises(ValueError):
            fusion.fuse(*lists, **bad)


def test_settled_questions_drop_their_retry(spark):
    tried = spark.createDataFrame(
        [(q, f) for q in ("hit", "miss") for f in ("full", "focused")],
        "question_id string, form string",
    )
    by_terms = spark.createDataFrame(
        [("hit", "full", "a", 1), ("hit", "focused", "b", 1), ("miss", "focused", "b", 1)],
        "question_id string, form string, chunk_id string, lex_rank int",
    )
    by_vector = spark.createDataFrame(
        [("hit", "a", 1), ("miss", "c", 1)], "question_id string, chunk_id string, vec_rank int"
    )
    rows = fusion.fuse(by_terms, by_vector, tried, skip_settled=True).collect()
    assert {(r.question_id, r.form, r.chunk_id) for r in rows} == {
        ("hit", "full", "a"),
        ("miss", "full", "c"),
        ("miss", "focused", "b"),
        ("miss", "focused", "c"),
    }


def test_confidence_fallback(spark):
    rows = [
        ("passes", "full", "a", 1, 1, 0.7),
        ("passes", "full", "b", 2, None, 0.5),
        ("weak", "full", "a", 1, None, 0.3),
        ("weak", "full", "b", 2, 1, 0.4),
        ("vector-only", "full", "a", 1, None, 0.4),
    ]
    scored = spark.createDataFrame(
        rows,
        "question_id string, form string, chunk_id string, fused_rank int, lex_rank int, support_score double",
    )
    kept = {(r.question_id, r.chunk_id) for r in rerank.confident(scored).collect()}
    assert kept == {("passes", "a"), ("weak", "b")}


def test_scope_validation_and_leaks(spark):
    asked = spark.createDataFrame(
        [
            ("a", "t", "me", [" g ", "g", "h"]),
            ("b", "t", " ", ["g"]),
            ("c", "t", "me", []),
            ("d", "t", "me", ["g", "  "]),
        ],
        "question_id string, enterprise_id string, actor_id string, principals array<string>",
    )
    usable, rejected = scope.validated_scopes(asked)
    assert [(r.question_id, r.principals) for r in usable.collect()] == [("a", ["g", "h"])]
    assert {r.question_id for r in rejected.collect()} == {"b", "c", "d"}
    chunks = spark.createDataFrame(
        [("x", "t", ["g"]), ("y", "t", ["k"]), ("z", "u", ["g"])],
        "chunk_id string, enterprise_id string, principals array<string>",
    )
    shown = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("a", "lost")], "question_id string, chunk_id string")
    leaks = scope.leaked_rows(shown, usable, chunks).collect()
    assert {r.chunk_id for r in leaks} == {"y", "z", "lost"}


def test_vector_lists_of_repeated_questions_are_one_list(spark, monkeypatch):
    monkeypatch.setattr(vector, "CHUNKS_PER_BLOCK", 4)
    rng = np.random.default_rng(2)
    columns = "enterprise_id string, principals array<string>, embedding array<double>"
    made = [(f"c{n % 25:02}", "tu"[n % 2], ["g"], np.round(rng.normal(size=9), 1).tolist()) for n in range(40)]
    made.append(("zero", "t", ["g"], [0.0] * 9))
    asked = [(f"q{n % 4}", "tu"[n % 2 if n < 4 else 0], ["g"], rng.normal(size=9).tolist()) for n in range(6)]
    got = {}
    rows = vector.vector_top(
        spark.createDataFrame(asked, f"question_id string, {columns}"),
        spark.createDataFrame(made, f"chunk_id string, {columns}"), 20, 9,
    )
    for row in rows.orderBy("vec_rank").collect():
        got.setdefault(row.question_id, []).append((row.chunk_id, row.score))
    for name in {a[0] for a in asked}:
        scored = []
        for _, tenant, _, vec in (a for a in asked if a[0] == name):
            for chunk, owner, _, held in made:
                if owner == tenant and any(held):
                    a, b = np.array(vec), np.array(held)
                    scored.append((chunk, round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 8)))
        assert got[name] == sorted(scored, key=lambda s: (-s[1], s[0]))[:20]


def test_vector_lists_are_whole_in_their_group(spark):
    """Chunks move once for a block of questions; no list of candidates is shuffled after."""
    columns = "enterprise_id string, principals array<string>, embedding array<float>"
    rows = [(f"r{n}", "t", ["g"], [1.0, float(n)]) for n in range(3000)]
    questions = spark.createDataFrame(rows, f"question_id string, {columns}")
    chunks = spark.createDataFrame(rows, f"chunk_id string, {columns}")
    top = vector.vector_top(questions, chunks, 5, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    ranking = plan.index("FlatMapGroupsInArrow")
    assert "Exchange" not in plan[:ranking] and "Window" not in plan
    assert top.count() == 15_000
    zeros = np.zeros((1, 1024), np.float32)
    zeros[0, ::100] = 1.5
    (packed,) = vector._packed(zeros)
    assert len(packed) == 1024 // 8 + 11 * 4


def test_terms_nobody_asks_for_are_not_shuffled(spark):
    words = " ".join(f"w{n}" for n in range(200))
    chunks = spark.createDataFrame([("c", "t", ["g"], words, "alpha"), ("d", "u", ["g"], words, "beta")], CHUNK)
    index = lexical.index_chunks(chunks)
    asked = spark.createDataFrame([("t", "w7"), ("t", "alpha"), ("u", "none")], "enterprise_id string, term string")
    assert {(r.enterprise_id, r.term) for r in lexical._wanted(lexical.postings(index), asked).collect()} == {
        ("t", "w7"), ("t", "alpha")}
    assert {(r.term, r.chunk_count) for r in lexical.term_counts(index, asked).collect()} == {("w7", 1), ("alpha", 1)}
    spots = lexical._occurrences(F.col("written"), F.col("places"), F.array(F.lit("w7"), F.lit("alpha")))
    row = index.filter("chunk_id = 'c'").select(*lexical._written_out(F.col("lexemes"))).select(spots.alias("s")).first()
    assert [(s.pos, s.term) for s in row.s] == [(8, "w7"), (201, "alpha")]


def test_best_matches_without_a_row_for_each_pair(spark, monkeypatch):
    """Lists of blocks and small slices equal the ranked matches; no list is shuffled after its group."""
    monkeypatch.setattr(lexical, "ASKS_PER_BLOCK", 7)
    monkeypatch.setattr(lexical, "ATTEMPTS_PER_BLOCK", 40)
    rng = random.Random(11)
    words = [f"w{n}" for n in range(12)]
    groups = ["g", "h", "i"]

    def text(most):
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))

    chunks = spark.createDataFrame(
        [(f"c{n:03}", rng.choice("tu"), rng.sample(groups, rng.randint(0, 2)), text(40), text(3)) for n in range(300)], CHUNK
    )
    texts = [text(5) for _ in range(40)]
    asked = spark.createDataFrame(
        [(f"q{n}", form, rng.choice("tu"), rng.sample(groups, rng.randint(1, 2)), rng.choice(texts))
         for n in range(80) for form in ("full", "focused")], ATTEMPT,
    )
    index = lexical.index_chunks(chunks)
    want = lexical.top_ranked(lexical.lexical_matches(asked, index), 9, "lex_rank")
    top = lexical.lexical_top(asked, index, 9)
    columns = ("question_id", "form", "chunk_id", "score", "lex_rank")
    got = sorted(tuple(r) for r in top.select(*columns).collect())
    assert len(got) > 500 and got == sorted(tuple(r) for r in want.select(*columns).collect())
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Window" not in plan


def test_best_matches_of_keys_that_repeat(spark):
    chunks = spark.createDataFrame([("c", "t", ["g"], "alpha", "t"), ("c", "t", ["g"], "alpha", "t")], CHUNK)
    asked = spark.createDataFrame([("q", "full", "t", ["g"], "alpha")], ATTEMPT)
    index = lexical.index_chunks(chunks)
    assert [r.lex_rank for r in lexical.lexical_top(asked, index, 3).collect()] == [1, 2, 3]


def test_scores_round_halves_up():
    scores = np.array([1 / 512, 1 / 2560, 0.1 + 0.2, 3.0, 1 / 3])
    assert scaled(scores, 8).tolist() == [195313, 39063, 30000000, 300000000, 33333333]


def test_compact_keys_read_back_and_halve_digests(spark):
    keys = ["", "a", "ab", "AB", "abc", "0f" * 32, "0F" * 32, "ab\n", "\x00ab", "é", "01", "\x01", None]
    frame = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("c", compact_key(F.col("k")))
    rows = frame.select("k", F.length("c").alias("n"), "c", full_key(F.col("c")).alias("back")).collect()
    assert [r.back for r in rows] == keys
    assert len({bytes(r.c) for r in rows if r.k is not None}) == len(keys) - 1
    assert next(r.n for r in rows if r.k == "0f" * 32) == 33


def test_candidates_move_with_compact_ids_and_written_tokens(spark):
    ids = {n: f"{n:02x}" * 32 for n in range(3)}
    tried = spark.createDataFrame(
        [("q", "full", "alpha beta"), ("e", "full", "")], "question_id string, form string, query_text string"
    )
    by_terms = spark.createDataFrame(
        [("q", "full", ids[0], 1), ("e", "full", ids[0], 1)],
        "question_id string, form string, chunk_id string, lex_rank int",
    )
    by_vector = spark.createDataFrame(
        [("q", ids[n], n + 1) for n in range(3)], "question_id string, chunk_id string, vec_rank int"
    )
    chunks = spark.createDataFrame(
        [(ids[0], "alphabet beta", "Beta"), (ids[1], "beta, alpha", "alph"), (ids[2], "", "")],
        "chunk_id string, content string, title string",
    ).withColumns(
        {"source_authority": F.lit(0.5), "extraction_quality": F.lit(0.5), "published_at": F.lit(None).cast("timestamp")}
    )
    fused = fusion.fuse(by_terms, by_vector, tried)
    scored = rerank.score_candidates(fused, tried, chunks)
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert "unhex" in plan  # ids are bytes in every exchange
    found = {(r.question_id, r.chunk_id): r.rerank_score - r.rrf_score for r in scored.collect()}
    assert found == {
        ("q", ids[0]): pytest.approx(0.7),
        ("q", ids[1]): pytest.approx(1.0 - 1 / 62),  # the score ends at 1
        ("q", ids[2]): pytest.approx(0.0),
        ("e", ids[0]): pytest.approx(0.0),
    }


def test_texts_meet_labels_and_active_versions_without_a_shuffle(spark, tmp_path):
    documents = [(n, f"Title {n}. Body of text {n}.", "en", f"src{n % 2}", 20) for n in range(6)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = bindings.active_corpus_chunks(spark, str(tmp_path))
        plan = shown._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        got = {(r.doc_id, r.version_label) for r in shown.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {(n, "v2" if n in (1, 2) else "v1") for n in range(6)}


def test_vector_rows_that_cannot_place_end_before_the_fusion(spark):
    by_terms = spark.createDataFrame(
        [("q1", "full", "c" * 64, 1), ("q2", "focused", "d" * 64, 1)],
        "question_id string, form string, chunk_id string, lex_rank int",
    )
    by_vector = spark.createDataFrame(
        [("q1", c * 64, rank) for rank, c in enumerate("abcd", 1)] + [("q3", c * 64, r) for r, c in enumerate("abc", 1)],
        "question_id string, chunk_id string, vec_rank int",
    )
    left = fusion.placeable(by_vector, by_terms, 2)
    assert left.columns == by_vector.columns
    # Behind the second place only the chunk that the question's own lexical list has.
    assert sorted((r.question_id, r.chunk_id[0], r.vec_rank) for r in left.collect()) == [
        ("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q3", "a", 1), ("q3", "b", 2)
    ]


def test_written_tables_leave_no_shuffle_files(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(DROP_SHUFFLES, None)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert materialize(counted, "counted").count() == 7
    until = time.time() + 10
    left = {f for f in shuffles() - before if f.endswith(".data")}
    while len(left) > 1 and time.time() < until:  # files go in the background; the count has one
        time.sleep(0.1)
        left = {f for f in shuffles() - before if f.endswith(".data")}
    assert len({f.split("_")[1] for f in left}) <= 1
    assert spark.conf.get(DROP_SHUFFLES, None) == setting
    assert counted.count() == 7


def test_equal_asks_share_a_list_and_a_set_meets_its_chunks(monkeypatch):
    """Blocks of one group: sparse and filled vectors, common and rare principal sets, against brute force."""
    monkeypatch.setattr(vector, "ASKS_OF_SET", 4)
    rng = np.random.default_rng(4)
    kind = np.dtype("float32")

    def made(number, filled):
        rows = np.zeros((number, 64), kind)
        for row in rows:
            row[rng.choice(64, filled, replace=False)] = np.round(rng.normal(size=filled), 1)
        return rows

    asked = np.concatenate([made(12, 3), made(6, 40), np.zeros((1, 64), kind)])
    asked = np.concatenate([asked, asked[:5]])
    stored = np.concatenate([made(90, 20), np.zeros((1, 64), kind), made(40, 2)])
    stored[60:75] = stored[:15]  # equal scores
    asked_sets = [["g"], ["h"], ["g", "h"]] * 8
    asked_sets = [["rare"] if n == 7 else asked_sets[n % 3] for n in range(len(asked) - 5)] + [asked_sets[n % 3] for n in range(5)]
    owned_sets = [[["g"], ["h"], ["k"], ["rare", "g"]][n % 4] for n in range(len(stored))]

    def batch(rows, sets, is_chunk, letter):
        names = [f"{letter}{n:03}" for n in range(len(rows))]
        columns = {
            "is_chunk": pa.array([is_chunk] * len(rows)), "row_id": pa.array(names),
            "principals": pa.array(sets, pa.list_(pa.string())), "vector": pa.array(vector._packed(rows), pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    batches = [batch(asked, asked_sets, False, "q"), batch(stored, owned_sets, True, "c")]
    asks = vector._Asks(pa.Table.from_batches(batches[:1]), 64, kind)
    assert len(asks.size) == len(asked) - 5
    assert any(only >= 0 for _, only in asks.segments) and any(only < 0 for _, only in asks.segments)
    assert asks.is_dense.any() and not asks.is_dense.all()
    found = pa.Table.from_batches(vector._block_top(10, 64, (kind, kind), 16)(iter(batches))).to_pylist()
    got = {}
    for row in found:
        got.setdefault(row["question_id"], []).append((row["vec_rank"], row["chunk_id"], row["score"]))
    for n, vec in enumerate(asked.astype(float)):
        scored = []
        for m, held in enumerate(stored.astype(float)):
            if set(asked_sets[n]) & set(owned_sets[m]) and vec.any() and held.any():
                scored.append((f"c{m:03}", round(float(vec @ held / np.sqrt((vec @ vec) * (held @ held))), 8)))
        best = sorted(scored, key=lambda s: (-s[1], s[0]))[:10]
        mine = sorted(got.get(f"q{n:03}", []))
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert [c for _, c, _ in mine] == [c for c, _ in best]
        assert [s for _, _, s in mine] == pytest.approx([s for _, s in best], abs=2e-8)


def test_token_numbers_are_exact(spark):
    """Leading zeros, eleven and twelve characters, odd tokens of a caller: recall as of the sets of texts."""
    contents = [["007", "zzzzzzzzzzz", "a" * 12, "b"], [], None, ["7", "x-y", "0"], ["a" * 11, "a" * 13]]
    queries = [["7", "07", "007"], ["zzzzzzzzzzz", "zzzzzzzzzzy"], ["a" * 12, "a" * 13, "b", "q"], ["0", "00"], []]
    rows = [(q, c) for q in queries for c in contents]
    frame = spark.createDataFrame(rows, "q array<string>, c array<string>")
    query, content = rerank.coded(F.col("q"), plain=True), rerank.coded(F.col("c"))
    told = frame.select("q", "c", rerank.token_recall(query, content).alias("r"), rerank.title_boost(query, content).alias("b"))
    for row in told.collect():
        found = None if row.c is None else set(row.q) & set(row.c)
        if not row.q:
            assert row.r == 0.0
        elif found is None:
            assert row.r is None
        else:
            assert row.r == pytest.approx(len(found) / len(row.q))
        assert row.b == (0.2 if found else 0.0)


def test_large_tenants_meet_their_blocks_in_slices(spark, monkeypatch):
    """Not more than two copies of the chunks at once; lists are the same as of one pass."""
    assert sizing.blocks_at_once([(30, 5_000_000), (2, 10_000_000)]) == 2
    assert sizing.blocks_at_once([(30, 10_000_000), (1, 90_000_000)]) == 11
    assert sizing.blocks_at_once([(30, 50), (2, 100)]) == 30 and sizing.blocks_at_once([]) == 1
    rng = random.Random(12)
    words = [f"w{n}" for n in range(9)]
    chunks = spark.createDataFrame(
        [(f"c{n:03}", "t" if n % 4 else "u", ["g"], " ".join(rng.choices(words, k=9)), "x") for n in range(80)], CHUNK
    )
    asked = spark.createDataFrame([(f"q{n}", "full", "tu"[n % 2], ["g"], rng.choice(words)) for n in range(40)], ATTEMPT)
    index = lexical.index_chunks(chunks)
    vectors = chunks.select("chunk_id", "enterprise_id", "principals", F.array(*[F.length("content") * F.lit(1.0), F.lit(1.0)]).alias("embedding"))
    vectors = vectors.withColumn("embedding", F.transform("embedding", lambda x: x + F.ascii(F.substring("chunk_id", 4, 1))))
    wanted = asked.select("question_id", "enterprise_id", "principals", F.array(F.ascii("query_text") * 1.0, F.ascii(F.substring("query_text", 2, 1)) * 1.0).alias("embedding"))

    def lists():
        by_terms = lexical.lexical_top(asked, index, 5)
        by_vector = vector.vector_top(wanted, vectors, 5, 2)
        return [sorted(tuple(r) for r in f.select(*sorted(f.columns)).collect()) for f in (by_terms, by_vector)]

    whole = lists()
    monkeypatch.setattr(lexical, "ASKS_PER_BLOCK", 2)
    monkeypatch.setattr(vector, "ASKS_PER_BLOCK", 2)
    monkeypatch.setattr(sizing, "COPIES_AT_ONCE", 1)
    plan = lexical.lexical_top(asked, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
    assert lists() == whole and len(whole[0]) > 100 and len(whole[1]) > 100


def test_vector_size_is_checked_where_nobody_asks(spark):
    columns = "enterprise_id string, principals array<string>, embedding array<float>"
    chunks = spark.createDataFrame([("x", "t", ["g"], [1.0, 2.0]), ("y", "u", ["g"], [1.0])], f"chunk_id string, {columns}")
    questions = spark.createDataFrame([("q", "t", ["g"], [1.0, 0.0])], f"question_id string, {columns}")
    with pytest.raises(Exception, match="embedding dimension must be 2"):
        vector.vector_top(questions, chunks, 20, 2).collect()
