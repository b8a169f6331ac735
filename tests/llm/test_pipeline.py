"""The pipeline against the same steps in plain Python."""

import importlib
import re

import pytest
from tokenizers import Tokenizer

from proofweave.llm import toxicity
from proofweave.llm.common import table
from proofweave.llm.queries import tokenizer_path
from tests.llm.test_decontaminate import plain as leaks
from tests.llm.conftest import LONG
from tests.llm.test_near_copies import plain as near_roots

corpus_pipeline = importlib.import_module("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
        seen.append(docs)
    return seen


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_each_stage(spark, stages):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in source.collect()}
    model = toxicity.fit(source, table(spark, SF, "labels", "doc_id", "toxic"))
    left = [d for d in sorted(rows) if model.score(rows[d]) < 0.5]
    assert ids(stages[0]) == left
    groups = {}
    for d in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[d]), []).append(d)
    left = sorted(min(g, key=lambda d: (-len(rows[d]), d)) for g in groups.values())
    assert ids(stages[1]) == left
    roots = near_roots([(d, rows[d]) for d in left])
    left = [d for i, d in enumerate(left) if roots[i] == i]
    assert ids(stages[2]) == left
    items = [tuple(r) for r in table(spark, SF, "benchmark", "item_id", "text").collect()]
    held = {d for d, *_ in leaks([(d, rows[d]) for d in left], items)}
    left = [d for d in left if d not in held]
    assert ids(stages[3]) == left
    assert all(s.columns == source.columns for s in stages[:-1])
    coder, placed = Tokenizer.from_file(tokenizer_path()), {}
    for r in stages[4].collect():
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["length"]
    assert placed == {d: len(coder.encode(rows[d], add_special_tokens=False).ids) + 1 for d in left}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    keys = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, stages[-1].select(*keys).collect()))


def test_odd_rows_and_no_rows(spark, tmp_path):
    """Nulls, empty, long, equal and repeated rows, and columns that stages use themselves."""
    rows = [
        (1, None), (2, ""), (3, " \n"), (None, "no id at all, but words"), (None, None), (4, "one two three"),
        (4, "one two three"), (5, "one  two three"), (6, "word " * 5000), (7, "é ü 漢字 " * 40), (8, "\x00 | \t"),
    ]
    docs = spark.createDataFrame(rows, LONG)
    for name in ("_gone", "key", "set", "id", "fp", "row", "digest", "_score", "length"):
        docs = docs.selectExpr("*", f"'{name}' as {name}")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema) if name != "packing" else out
        seen.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    # Of equal texts the longest original stays: 3 of the blank ones, 5 for its second blank.
    kept = sorted([3, 5, 6, 7, 8, None], key=str)
    assert seen[0] == sorted((k for k, _ in rows), key=str)
    assert seen[1] == seen[2] == seen[3] == kept
    assert set(seen[4]) == set(kept) and seen[4].count(6) == 2
    none = spark.createDataFrame([], LONG)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
