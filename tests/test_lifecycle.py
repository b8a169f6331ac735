import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fixture_corpus import ONE, RETENTION, RETENTION_VERSIONS, requests
from proofweave.operators import definitions, evaluation, retention, versions
from proofweave.plans import ingestion
from proofweave.sources import tables as T
from proofweave.sources.dated import DatedTable
from proofweave.sources.keyed import KeyedTable, latest
from proofweave.sources.tables import TableLayout
from proofweave.sources.text_files import read_text_files
from proofweave.streaming import ingest as streaming


def test_interrupted_batch_stays_invisible_and_a_rerun_converges(spark, tmp_path, monkeypatch):
    layout = TableLayout(str(tmp_path / "tables"))
    write = TableLayout.write_batch

    def failing(self, frame, name, batch_id):
        if name == T.ACTIVATIONS and batch_id == 1:
            raise RuntimeError("injected failure")
        write(self, frame, name, batch_id)

    ingestion.ingest_batch(requests(spark).filter("activation_seq = 0"), layout, 0)
    monkeypatch.setattr(TableLayout, "write_batch", failing)
    with pytest.raises(RuntimeError):
        ingestion.ingest_batch(requests(spark), layout, 1)
    assert {r.version_label for r in layout.active_chunks(spark).collect()} == {"1.3"}
    partial = {r.chunk_id for r in layout.read(spark, T.CHUNKS).collect()}

    monkeypatch.setattr(TableLayout, "write_batch", write)
    ingestion.ingest_batch(requests(spark), layout, 1)
    shown = layout.active_chunks(spark).collect()
    assert len(shown) == 6 and len({r.chunk_id for r in shown}) == 6
    assert {r.version_label for r in shown if r.title == RETENTION} == {"1.4"}
    assert {r.chunk_id for r in layout.read(spark, T.CHUNKS).collect()} == partial

    # Ingesting the older version again brings it back.
    ingestion.ingest_batch(requests(spark).filter("activation_seq = 0"), layout, 2)
    shown = layout.active_chunks(spark).filter(F.col("title") == RETENTION).collect()
    assert [r.version_label for r in shown] == ["1.3"]


def test_stream_takes_each_request_once_and_keeps_bad_ones_aside(spark, tmp_path):
    source = tmp_path / "requests"
    bad = list(RETENTION_VERSIONS[0])
    bad[8] = "   "
    frame = requests(spark, [tuple(bad)]).drop("activation_seq")
    frame.coalesce(1).write.json(str(source))
    frame.coalesce(1).write.mode("append").json(str(source))
    layout = TableLayout(str(tmp_path / "tables"))
    stream = streaming.request_stream(spark, str(source), max_files=1)
    streaming.run_to_completion(
        streaming.start_ingestion(stream, layout, str(tmp_path / "checkpoint"))
    )
    assert layout.active_chunks(spark).count() == 6
    assert layout.read(spark, T.ACTIVATIONS).count() == 7
    rejected = layout.read(spark, T.REJECTED).collect()
    assert len(rejected) == 2 and all("blank content" in r.reason for r in rejected)


def test_document_sharing_a_source_is_reported(spark):
    other = list(RETENTION_VERSIONS[0])
    other[1] = "10000000-0000-0000-0000-0000000000ff"
    shared = ingestion.shared_sources(ingestion.identify(requests(spark, [tuple(other)])))
    assert [(r.enterprise_id, r.documents) for r in shared.collect()] == [(ONE, 2)]


def test_any_split_of_a_sequence_gives_one_result(spark, tmp_path):
    """1.3, 1.4 and 1.3 again: the repeat is no second job, wherever batches end."""
    both = {r.version_label: r for r in requests(spark).filter(F.col("title") == RETENTION).collect()}
    schema = requests(spark).schema
    sequence = [{**both[label].asDict(), "activation_seq": i} for i, label in enumerate(("1.3", "1.4", "1.3", "1.4", "1.3"))]
    shown = []
    for i, cuts in enumerate(([5], [1, 1, 1, 1, 1], [2, 3], [1, 4])):
        layout, at = TableLayout(str(tmp_path / str(i))), 0
        for batch_id, size in enumerate(cuts):
            batch = [tuple(r[n] for n in schema.names) for r in sequence[at : at + size]]
            ingestion.ingest_batch(spark.createDataFrame(batch, schema), layout, batch_id, skip_known_jobs=True)
            at += size
        active = {r.version_label for r in layout.active_chunks(spark).collect()}
        jobs = sorted((r.status, r.attempts) for r in layout.keyed(T.JOBS).read(spark).collect())
        status = {r.version_label: r.status for r in layout.registered_versions(spark).collect()}
        shown.append((active, jobs, status))
    assert shown == [({"1.4"}, [("completed", 1)] * 2, {"1.3": "superseded", "1.4": "active"})] * 4


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), 8)
    newest = latest(("k",), "n")

    def rows(*values):
        return spark.createDataFrame(values, "k string, n long, v string")

    assert table.read(spark) is None and table.held(rows(("a", 0, "x"))) is None
    table.merge(rows(*((c, 0, "old") for c in "abcdefgh"), (None, 0, "none")), 0, newest)
    before = table._folders(spark)
    table.merge(rows(("a", 1, "new"), ("z", 1, "new")), 1, newest)
    assert sum(before.get(b) != f for b, f in table._folders(spark).items()) <= 2
    table.merge(rows(("a", 1, "again")), 1, newest)  # a repeat replaces its merge
    got = {r.k: r.v for r in table.read(spark).collect()}
    assert got == {None: "none", **dict.fromkeys("bcdefgh", "old"), "a": "again"}
    table.merge(rows(), 2, newest)
    assert table.read(spark).count() == 9


def test_promotion_gates(spark):
    rows = [
        ("pass", 0, 0.93, 0.99, 0.97, 0.005, 0.96),
        ("leak", 1, 1.0, 1.0, 1.0, 0.0, 1.0),
        ("weak", 0, 0.5, 0.5, 0.5, 0.5, 0.5),
        ("bad", 0, 1.5, 1.0, 1.0, 0.0, 1.0),
    ]
    frame = spark.createDataFrame(rows, "run_id string, scope_leak_count long, " + ", ".join(f"{n} double" for n in evaluation.RATES))
    got = {r.run_id: r for r in evaluation.promotion_gates(frame).collect()}
    assert got["pass"].is_eligible and got["pass"].failed_gates == []
    assert not got["leak"].is_eligible and got["leak"].failed_gates == ["scope-isolation"]
    assert len(got["weak"].failed_gates) == 5
    assert got["bad"].reason and not got["bad"].is_eligible


def test_run_metrics(spark):
    answered = spark.createDataFrame(
        [
            ("a", "r", "t", ["g"], "rag", "sufficient", 2, [(["C1"],), ([],)], [("c1", "alpha"), ("c2", "gone")]),
            ("b", "r", "t", ["g"], "rag", "insufficient", 0, None, None),
            ("c", "r", "t", ["g"], "rag", "sufficient", 0, None, None),
        ],
        "question_id string, run_id string, enterprise_id string, principals array<string>, route string,"
        "evidence_status string, n_retrieved long, claims array<struct<citation_ids:array<string>>>,"
        "citations array<struct<chunk_id:string,exact_span:string>>",
    )
    retrieved = spark.createDataFrame(
        [("a", "c1", 1), ("a", "c2", 2)], "question_id string, chunk_id string, result_rank int"
    )
    chunks = spark.createDataFrame(
        [("c1", "d1", "t", ["g"], "alpha beta"), ("c2", "d2", "t", ["h"], "other")],
        "chunk_id string, document_id string, enterprise_id string, principals array<string>, content string",
    )
    gold = spark.createDataFrame(
        [("r", "a", "d1"), ("r", "b", "d1")], "run_id string, question_id string, document_id string"
    )
    proposed = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "question_id string")
    row = evaluation.run_metrics(answered, retrieved, chunks, gold, proposed, proposed.limit(1)).first()
    assert row.scope_leak_count == 1 and row.recall_at_10 == 0.5 and row.citation_precision == 0.5
    assert row.citation_completeness == 0.5 and row.unsupported_claim_rate == 0.75
    assert row.abstention_recall == 0.5
    judged = evaluation.promotion_gates(spark.createDataFrame([row])).first()
    assert len(judged.failed_gates) == 6 and not judged.is_eligible


def test_graph_definitions(spark):
    every = ["authorization", "provenance", "audit", "claim-validation"]
    names = ["ok", "cycle", "self", "loose", "twice", "lacking", "none", "topk"]
    made = spark.createDataFrame([(n, n, 60 if n == "topk" else 40) for n in names], "definition_id string, name string, rerank_top_k int")
    nodes = [(d, n, every) for d in names if d != "none" for n in ("a", "b", "c")]
    nodes = [(d, n, [] if d == "lacking" and n else c) for d, n, c in nodes] + [("twice", "a", every)]
    def fields(type_="t", version="1", given="rows", made="rows"):
        return type_, version, given, made

    nodes = [(*n, *fields()) for n in nodes]
    odd = {"long_id": ("n" * 81, every, *fields()), "long_type": ("a", every, *fields("t" * 121)),
           "no_version": ("a", every, *fields(version=None)), "no_input": ("a", every, *fields(given="")),
           "unknown": ("a", [*every, "telemetry"], *fields()), "no_target": ("a", every, *fields()),
           "widest": ("n" * 80, every, *fields("t" * 120, "v" * 80))}
    nodes += [(d, *n) for d, n in odd.items()]
    made = made.union(spark.createDataFrame([(d, d, 40) for d in odd] + [("", "", 40)], made.schema))
    node_frame = spark.createDataFrame(
        nodes, "definition_id string, node_id string, capabilities array<string>, component_type string,"
        " component_version string, input_schema string, output_schema string")
    edges = [(d, "a", "b") for d in names if d != "none"] + [
        ("ok", "b", "c"), ("cycle", "b", "c"), ("cycle", "c", "b"), ("self", "c", "c"), ("loose", "b", "z"),
        ("no_target", "a", "")]
    edge_frame = spark.createDataFrame(edges, "definition_id string, source_node_id string, target_node_id string")
    got = {r.definition_id: r.problem for r in definitions.validate_definitions(made, node_frame, edge_frame).collect()}
    assert got["ok"] is None and got["widest"] is None
    assert "cycle" in got["cycle"] and "cycle" in got["self"]
    assert "no node" in got["loose"] and "repeats" in got["twice"]
    assert got["lacking"].endswith("audit, authorization, claim-validation, provenance")
    assert got["none"] == "no nodes" and "rerankTopK" in got["topk"] and "name" in got[""]
    for name, field in [("long_id", "node_id"), ("long_type", "component_type"), ("no_version", "component_version"),
                        ("no_input", "input_schema"), ("unknown", "capability"), ("no_target", "target_node_id")]:
        assert field in got[name]


def test_cycles_against_walks():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randint(1, 7)
        edges = [(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randint(0, 8))]
        reached = set(edges)
        for _ in range(size):
            reached |= {(a, d) for a, b in reached for c, d in edges if b == c}
        assert definitions.has_cycle([a for a, _ in edges], [b for _, b in edges]) == any(a == b for a, b in reached)
    chain = range(100_000)
    assert not definitions.has_cycle(chain, range(1, 100_001))
    assert definitions.has_cycle(chain, [*range(1, 100_000), 0])


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Zeile eins\nÄ", encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" \n", encoding="utf-8")
    (tmp_path / "broken.txt").write_bytes(b"\xff\xfe\xfa")
    good, bad = read_text_files(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["Zeile eins\nÄ"]
    assert sorted(r.reason for r in bad.collect()) == ["failed to read text document", "parsed document cannot be empty"]


def test_metadata_survives_json(spark, tmp_path):
    requests(spark).drop("activation_seq").coalesce(1).write.json(str(tmp_path / "r"))
    line = json.loads(next((tmp_path / "r").glob("*.json")).read_text().splitlines()[0])
    assert line["metadata"] == {"fixture": "true"}


def test_stored_traces_rewrite_only_days_with_work(spark, tmp_path):
    def at(day, hour=0):
        return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)

    schema = (
        "trace_id string, raw_query string, raw_response string, payload struct<model_inputs: string>, "
        "raw_content_expires_at timestamp, expires_at timestamp"
    )
    rows = [
        ("a", "q a", "r", ("m",), at(2), at(10, 3)), ("b", "q b", "r", ("m",), at(9), at(10, 9)),
        ("c", "q c", "r", ("m",), at(9), at(20)), ("d", "q d", "r", ("m",), None, None),
    ]
    traces = DatedTable(str(tmp_path / "trace"), ("trace_id",))
    audit = DatedTable(str(tmp_path / "audit"), ("audit_id",))
    assert retention.redact_stored(spark, traces, at(5), 0) == 0
    traces.merge(spark.createDataFrame(rows, schema), 0, latest(traces.keys, "raw_query"))
    pointers = [("x" + r[0], r[0], at(25)) for r in rows] + [("xe", None, at(26))]
    facts = spark.createDataFrame(pointers, "audit_id string, trace_memory_id string, expires_at timestamp")
    audit.merge(facts, 0, latest(audit.keys, "expires_at"))
    before = traces._folders(spark)

    assert [retention.redact_stored(spark, traces, at(5), n) for n in (1, 2)] == [1, 0]
    after = traces._folders(spark)
    assert len(before) == 3 and sum(before[b] != after[b] for b in before) == 1
    shown = {r.trace_id: (r.raw_query, r.raw_response, r.payload.model_inputs) for r in traces.read(spark).collect()}
    assert shown.pop("a") == ("[expired]", None, None)
    assert shown == {k: (f"q {k}", "r", "m") for k in "bcd"}

    # The tenth day keeps the trace that expires later on it; then it leaves the table.
    assert [retention.purge_stored(spark, traces, audit, at(10, 3), n) for n in (3, 4)] == [2, 0]
    assert sorted(r.trace_id for r in traces.read(spark).collect()) == ["b", "c", "d"]
    assert retention.purge_stored(spark, traces, audit, at(11), 5) == 2
    assert set(traces._folders(spark)) == set(before) - {min(b for b in before if b > 0)}
    left = {r.audit_id: r.trace_memory_id for r in audit.read(spark).collect()}
    assert left == {"xa": None, "xb": None, "xc": "c", "xd": "d", "xe": None}
