"""Registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofweave.functions import identity as ids
from proofweave.functions.embedding import with_embedding
from proofweave import constants as K
from proofweave.functions import stems, text as tx
from proofweave.operators import (
    answers,
    chunking,
    definitions,
    evaluation,
    lexical,
    rerank,
    retention,
    routing,
    scope,
    traces,
    vector,
    versions,
)
from proofweave.operators.sizing import materialize, spread
from proofweave.plans import ingestion, retrieval
from proofweave.registry import bindings as B
from proofweave.session import ensure_checkpoint_dir
from proofweave.sources import requests as requests_source
from proofweave.sources.dated import DatedTable
from proofweave.sources.keyed import latest
from proofweave.sources.questions import question_problems
from proofweave.sources.tables import DOCUMENTS, ENTERPRISES, JOBS, VERSIONS, TableLayout
from proofweave.sources.text_files import read_text_files
from proofweave.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(*names: str) -> dict[str, F.Column]:
    return {name: F.round(name, 6) for name in names}


@query
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = B.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    documents = spread(documents, "doc_id")
    return chunking.normalize_documents(documents).select(
        "doc_id",
        B.tenant_uuid(F.col("source")).alias("enterprise_id"),
        "normalized",
        F.length("normalized").cast("long").alias("n_normalized"),
    )


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(B.identified_editions(spark, sf_dir)).select(
        "document_id",
        "version_label",
        "ordinal",
        "start_offset",
        "end_offset",
        "locator",
        "content",
    )


@query
def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_versions(B.document_versions(spark, sf_dir)).select(
        "document_id", "version_label", "version_hash", "chunk_id", "chunker_config_hash"
    )


@query
def version_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.identified_editions(spark, sf_dir).select(
        "document_id",
        "version_label",
        "version_hash",
        "version_id",
        ids.source_fingerprint(F.col("source_uri")).alias("source_fingerprint"),
    )


@query
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = B.corpus_chunks(spark, sf_dir).select("chunk_id", "content")

    def value(at):
        return F.get("embedding", at).cast("double")

    # Sums run over the places that are not zero: a text fills few of them.
    filled = F.filter(F.sequence(F.lit(0), F.size("embedding") - 1), lambda at: value(at) != 0)

    def folded(item):
        return F.aggregate("filled", F.lit(0.0), lambda acc, at: acc + item(at))

    return with_embedding(chunks, "content").withColumn("filled", filled).select(
        "chunk_id",
        F.size("filled").cast("long").alias("n_nonzero"),
        F.round(folded(lambda at: F.abs(value(at))), 5).alias("abs_sum"),
        F.round(folded(value), 5).alias("value_sum"),
        F.round(folded(lambda at: value(at) * (at % 32)), 4).alias("weighted_sum"),
    )


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks, in one of three groups; every vector is stored, in one of four."""

    def vectors(name: str, groups: int) -> DataFrame:
        number = F.col("vec_id").cast("string")
        group = F.concat(F.lit("group:"), (F.col("vec_id") % groups).cast("string"))
        return B.table(spark, sf_dir, "embeddings").select(
            F.concat(F.lit("vec-"), number).alias(name),
            F.col("label").cast("string").alias("enterprise_id"),
            F.array(group, F.concat(F.lit("owner:"), number)).alias("principals"),
            "embedding",
        )

    number = {n: F.substring(n, 5, 20).cast("long") for n in ("question_id", "chunk_id")}
    asked, stored = vectors("question_id", 3), vectors("chunk_id", 4)
    return vector.vector_top(asked, stored, dimension=64).withColumns(number)


@query
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = B.corpus(spark, sf_dir)
    tried = retrieval.attempts(B.corrected_questions(spark, sf_dir))
    return lexical.lexical_top(tried, index)


@query
def lexical_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions find other forms of their words: 'retained' finds 'retains'."""
    _, index = B.corpus(spark, sf_dir)
    tried = retrieval.attempts(B.corrected_questions(spark, sf_dir))
    return lexical.lexical_top(tried, lexical.stem_index(index), stem=True)


@query
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every word of the documents."""
    words = B.table(spark, sf_dir, "documents").select(F.explode(tx.search_words(F.col("text"))).alias("term"))
    return stems.stemmed(words.distinct())


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks, index = B.corpus(spark, sf_dir)
    asked = materialize(B.embedded_questions(spark, sf_dir), "questions")
    tried = retrieval.attempts(asked)
    return retrieval.candidates(tried, asked, chunks, index), tried, chunks


@query
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[0].withColumns(rounded("rrf_score"))


@query
def rerank_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        rerank.score_candidates(*_fused(spark, sf_dir))
        .select(
            "question_id",
            "form",
            "chunk_id",
            "fused_rank",
            "rerank_score",
            "source_score",
            "support_score",
        )
        .withColumns(rounded("rerank_score", "source_score", "support_score"))
    )


@query
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rerank.score_candidates(*_fused(spark, sf_dir))
    return rerank.confident(scored).select(
        "question_id",
        "form",
        "chunk_id",
        "result_rank",
        F.round("support_score", 6).alias("support_score"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = B.corpus(spark, sf_dir)
    return retrieval.retrieve(B.embedded_questions(spark, sf_dir), chunks, index)


@query
def focused_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    retried = evidence(spark, sf_dir).filter(F.col("form") == lexical.FOCUSED)
    return retried.select(
        "question_id",
        "chunk_id",
        "result_rank",
        F.round("support_score", 6).alias("support_score"),
    )


@query
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        evidence(spark, sf_dir)
        .select(
            "question_id",
            "form",
            "chunk_id",
            "title",
            "version_label",
            "locator",
            "content",
            "rrf_score",
            "rerank_score",
            "source_score",
            "support_score",
            "result_rank",
        )
        .withColumns(rounded("rrf_score", "rerank_score", "source_score", "support_score"))
    )


# --- routing and answers -----------------------------------------------------
@query
def spelling_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrected = routing.correct(B.routing_questions(spark, sf_dir))
    return corrected.filter(F.col("corrected_query").isNotNull()).select(
        "question_id", "query_text", "corrected_query"
    )


def _routed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(routing.correct(B.routing_questions(spark, sf_dir)))


@query
def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed_all(spark, sf_dir).select(
        "question_id",
        "route",
        "function_name",
        F.size("numbers").alias("n_numbers"),
        "start_date",
        "end_date",
    )


@query
def compute_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered, _ = answers.compute_answers(_routed_all(spark, sf_dir))
    return answered.select(
        "question_id",
        "function_name",
        F.round("value", 6).alias("value"),
        "answer",
        "evidence_status",
        "confidence",
    )


def _cited_chunks() -> F.Column:
    cited = F.array_join(F.transform("citations", lambda c: c["chunk_id"]), ",")
    return F.nullif(cited, F.lit("")).alias("cited_chunks")


@query
def retrieve_then_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered, _ = B.evidence(spark, sf_dir)
    return answered.filter(F.col("route") == routing.RETRIEVE_THEN_COMPUTE).select(
        "question_id",
        "function_name",
        "n_values",
        "value",
        "evidence_status",
        "answer",
        _cited_chunks(),
    )


@query
def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.evidence_blocks(B.evidence(spark, sf_dir)[1])


@query
def validate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrieved = B.evidence(spark, sf_dir)[1]
    return answers.validate_claims(retrieved, B.mixed_claims(retrieved))


@query
def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered, _ = B.evidence(spark, sf_dir)
    return answered.select(
        "question_id",
        "route",
        "evidence_status",
        "answer",
        F.size(F.coalesce("claims", F.array())).alias("n_claims"),
        _cited_chunks(),
    )


@query
def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions, their line items as evidence: every outcome occurs."""
    asked, lines, proposed = B.line_evidence(spark, sf_dir)
    routed = routing.route(routing.correct(asked))
    validated = answers.validate_claims(lines, proposed)
    return answers.assemble(routed, lines, validated).select(
        "question_id",
        "route",
        "evidence_status",
        "answer",
        F.size(F.coalesce("claims", F.array())).alias("n_claims"),
        _cited_chunks(),
    )


# --- ingestion and lifecycle ---------------------------------------------------
@query
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = B.ingest_requests(spark, sf_dir).withColumn(
        "problems", requests_source.request_problems()
    )
    valid = F.size("problems") == 0
    published = F.unix_micros(tx.iso_timestamp(F.col("published_at")))
    return checked.select(
        "document_id",
        valid.alias("is_valid"),
        F.array_join("problems", "; ").alias("reason"),
        F.when(valid, published).alias("published_micros"),
    )


def _identified_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = requests_source.split_valid(B.ingest_requests(spark, sf_dir))
    return ingestion.identify(accepted)


@query
def ingest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    identified = _identified_requests(spark, sf_dir)
    chunks = chunking.with_chunk_identity(chunking.split_documents(identified))
    return ingestion.ingest_results(identified, chunks).select(
        "document_id",
        "version_id",
        "version_hash",
        "chunk_count",
        F.array_join("chunk_ids", ",").alias("chunk_ids"),
        F.array_join("metadata_keys", ",").alias("metadata_keys"),
        "status",
    )


@query
def activate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some second editions lost chunks, and some first editions came back."""
    editions = materialize(
        B.identified_editions(spark, sf_dir).select(
            "enterprise_id", "document_id", "version_id", "version_hash", "version_label",
            "source_authority", "extraction_quality", "normalized",
        ),
        "editions",
    )
    wanted = chunking.with_chunk_identity(chunking.split_documents(editions))
    lost = (F.col("version_label") == "v2") & (F.col("source_authority") < 0.8) & (F.col("ordinal") >= 2)
    other = ids.ChunkerConfig(size=700, overlap=100)
    leftovers = chunking.with_chunk_identity(chunking.split_documents(editions, other), other)
    key = ["version_id", "chunk_id"]
    stored = wanted.filter(~lost).select(*key).unionByName(leftovers.select(*key))
    reconciled = versions.reconcile_chunks(stored, wanted.select(*key))
    complete = versions.completeness(reconciled, chunking.expected_counts(editions))
    first_try = B.activation_requests(editions)
    came_back = (F.col("version_label") == "v1") & (F.col("extraction_quality") < 0.9)
    rollback = B.activation_requests(editions.filter(came_back)).withColumn(
        "activation_seq", F.lit(3)
    )
    return versions.activate(first_try.unionByName(rollback), complete).join(
        complete.select("version_id", "stored_chunks", "expected_chunks"), "version_id"
    )


def _written_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Editions, and the keys and access of their chunks: each text is normalised and cut once."""
    editions = materialize(B.identified_editions(spark, sf_dir), "editions")
    chunks = chunking.with_chunk_identity(chunking.split_documents(editions))
    keys = ("enterprise_id", "version_id", "version_label", "chunk_id", "principals")
    return editions, materialize(chunks.select(*keys), "chunk-keys")


@query
def tenant_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants holding a toxic document leave, with everything below them."""
    editions, chunks = _written_chunks(spark, sf_dir)
    tenants = editions.groupBy("enterprise_id").agg(
        F.min("extraction_quality").alias("worst_quality")
    )
    staying = tenants.filter(F.col("worst_quality") >= 0.9)
    kept_versions = versions.purge_children(staying, editions, "enterprise_id")
    kept_chunks = versions.purge_children(kept_versions, chunks, "version_id")
    acl = scope.acl_rows(chunks)
    return versions.purge_children(kept_chunks, acl, "chunk_id")


# --- access ----------------------------------------------------------------------
@query
def acl_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    editions, chunks = _written_chunks(spark, sf_dir)
    status = versions.activate(
        B.activation_requests(editions),
        editions.select("version_id", F.lit(True).alias("is_complete")),
    )
    known = editions.drop("principals", "normalized").join(
        status.select("version_id", "status"), "version_id"
    )
    shown = scope.active_chunks(chunks.drop("version_label"), known)
    usable, _ = scope.validated_scopes(B.questions(spark, sf_dir))
    scopes = usable.select(
        F.concat_ws("|", "enterprise_id", F.array_join("principals", ",")).alias("scope_id"),
        "enterprise_id",
        "principals",
    ).distinct()
    return scope.authorized_chunks(scopes, shown, scope.acl_rows(shown)).select(
        "scope_id", "chunk_id", "version_label"
    )


@query
def acl_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks = _written_chunks(spark, sf_dir)
    current = scope.acl_rows(chunks)
    again = chunks.filter(F.col("version_label") == "v2").withColumn(
        "principals",
        F.concat("principals", F.array(F.lit(" role:auditor "), F.lit("role:auditor"))),
    )
    return scope.replace_acl(current, again)


# --- traces, audit, retention ------------------------------------------------------
def _stamped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a creation time that differs between questions."""
    answered, _ = B.evidence(spark, sf_dir)
    age = F.make_dt_interval(secs=F.length("query_text"))
    return answered.withColumn("created_at", F.lit(K.AS_OF) - age)


def _stamp(name: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_rows(_stamped_answers(spark, sf_dir), B.evidence(spark, sf_dir)[1])


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = {"generator": K.GENERATOR_MODEL, "embedding": K.EMBEDDING_MODEL}
    return traces.audit_rows(_stamped_answers(spark, sf_dir), models, K.PIPELINE_VERSION)


@query
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.array_join(F.transform("payload.stage_events", lambda e: e["detail"]), "|")
    return _traces(spark, sf_dir).select(
        "trace_id",
        "enterprise_id",
        "actor_id",
        "raw_query",
        "raw_response",
        F.col("payload.route").alias("route"),
        details.alias("details"),
        F.size(F.coalesce("payload.retrieved_chunks", F.array())).alias("n_chunks"),
        _stamp("created_at"),
        _stamp("raw_content_expires_at"),
        _stamp("expires_at"),
    )


@query
def latest_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = traces.trace_summaries(_traces(spark, sf_dir), _audit(spark, sf_dir))
    return traces.latest_traces(summaries).withColumn("created_at", _stamp("created_at"))


@query
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace asked for by its tenant, or by another one, which finds nothing."""
    stored = _traces(spark, sf_dir)
    own = F.length("raw_query") % 2 == 0
    asked = stored.select(
        F.when(own, F.col("enterprise_id"))
        .otherwise(B.tenant_uuid(F.lit("src-elsewhere")))
        .alias("enterprise_id"),
        "trace_id",
    )
    found = traces.look_up(asked, stored, _audit(spark, sf_dir))
    return found.select(
        "trace_id",
        "enterprise_id",
        "route",
        "raw_query",
        "corrected_query",
        "answer",
        F.size("citations").alias("n_citations"),
        F.array_join(F.transform("stage_events", lambda e: e["stage"]), "|").alias("stages"),
        "outcome",
    )


@query
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).withColumns(
        {"created_at": _stamp("created_at"), "expires_at": _stamp("expires_at")}
    )


@query
def stage_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.replay_stages(_traces(spark, sf_dir))


REDACTED_AT = dt.datetime(2024, 2, 15, tzinfo=dt.timezone.utc)
PURGED_AT = dt.datetime(2024, 4, 15, tzinfo=dt.timezone.utc)


@query
def redact_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.redact(B.event_traces(spark, sf_dir), REDACTED_AT).select(
        "trace_id",
        "raw_query",
        "raw_response",
        F.col("payload.evidence_status").alias("evidence_status"),
        F.col("payload.model_inputs.raw_query").alias("model_input"),
        F.element_at("payload.retrieved_text", 1).alias("first_text"),
        "was_redacted",
    )


@query
def purge_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows after the purge: all of them, some without a pointer."""
    all_traces = B.event_traces(spark, sf_dir)
    audit = all_traces.select(
        F.col("trace_id").alias("trace_memory_id"),
        ids.trace_identifier_hash(F.col("trace_id")).alias("trace_identifier_hash"),
        "enterprise_id",
        F.col("payload.evidence_status").alias("outcome"),
    )
    return retention.unlink_audit(audit, retention.purge(all_traces, PURGED_AT))


STORED_REDACTED_AT = dt.datetime(2024, 2, 24, tzinfo=dt.timezone.utc)


@query
def stored_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows with their traces, both stored in two batches, then redacted and purged twice."""
    root = f"{ensure_checkpoint_dir(spark)}/proofweave/traces-{uuid.uuid4().hex}"
    stored = DatedTable(f"{root}/trace", ("trace_id",))
    audit = DatedTable(f"{root}/audit", ("trace_identifier_hash",))
    made = B.event_traces(spark, sf_dir)
    early = F.col("created_at") < F.lit(dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc))
    for number, batch in enumerate((made.filter(early), made.filter(~early))):
        stored.merge(batch, number, latest(stored.keys, "created_at"))
        facts = batch.select(
            ids.trace_identifier_hash(F.col("trace_id")).alias("trace_identifier_hash"),
            F.col("trace_id").alias("trace_memory_id"),
            F.col("payload.evidence_status").alias("outcome"),
            (F.col("created_at") + F.make_dt_interval(days=F.lit(K.AUDIT_DAYS))).alias("expires_at"),
        )
        audit.merge(facts, number, latest(audit.keys, "expires_at"))
    for number in (2, 4):
        retention.redact_stored(spark, stored, STORED_REDACTED_AT, number)
        retention.purge_stored(spark, stored, audit, PURGED_AT, number + 1)
    shown = stored.read(spark).select(
        F.col("trace_id").alias("trace_memory_id"), "raw_query", "raw_response",
        F.col("payload.model_inputs.raw_query").alias("model_input"),
    )
    return audit.read(spark).drop("expires_at").join(shown, "trace_memory_id", "left")


# --- evaluation ----------------------------------------------------------------------
def _tenant_runs(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """One evaluation run per tenant over the known-item questions, judged by ``chunks``."""
    answered, retrieved = B.evidence(spark, sf_dir)
    answered = answered.withColumn("run_id", F.col("enterprise_id"))
    known = answered.filter(F.col("question_id").rlike("^(title|values)-"))
    gold = known.select(
        "run_id",
        "question_id",
        ids.uuid_from_text(F.regexp_replace("question_id", "^[a-z]+-", "doc:")).alias("document_id"),
    )
    proposed = B.mixed_claims(retrieved)
    accepted = answers.validate_claims(retrieved, proposed)
    metrics = evaluation.run_metrics(answered, retrieved, chunks, gold, proposed, accepted)
    judged = evaluation.promotion_gates(metrics)
    return judged.withColumns(rounded(*evaluation.RATES)).withColumn(
        "failed_gates", F.array_join("failed_gates", ",")
    )


@query
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tenant_runs(spark, sf_dir, B.corpus(spark, sf_dir)[0])


@query
def stale_evidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs after revised documents changed in wording and access."""
    chunks = B.corpus(spark, sf_dir)[0].select(
        "chunk_id", "document_id", "enterprise_id", "principals", "content", "version_label"
    )
    revised = F.col("version_label") == "v2"
    changed = chunks.withColumns({
        "content": F.when(revised, F.upper("content")).otherwise(F.col("content")),
        "principals": F.when(revised, F.array(F.lit("role:auditor"))).otherwise(F.col("principals")),
    })
    return _tenant_runs(spark, sf_dir, changed)


# --- definitions -----------------------------------------------------------------------
@query
def definition_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = definitions.validate_definitions(*B.graph_definitions(spark, sf_dir))
    return problems.withColumn("missing", F.array_join("missing", ","))


@query
def definition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.definition_hashes(*B.graph_definitions(spark, sf_dir))


# --- files and streams --------------------------------------------------------------------
@query
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a text file by Spark and read back whole."""
    path = f"{ensure_checkpoint_dir(spark)}/proofweave/texts-{uuid.uuid4().hex}"
    documents = spread(B.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    documents.write.partitionBy("doc_id").text(path)
    parsed, _ = read_text_files(spark, path)
    number = F.regexp_extract("source_uri", "doc_id=([0-9]+)", 1).cast("long")
    return parsed.select(
        number.alias("doc_id"),
        tx.normalize_content(F.col("text")).alias("normalized"),
        "parser_name",
        "parser_version",
    )


def _streamed(
    spark: SparkSession, *requests: DataFrame, max_files: int = 10, embedder=None, compression: str = "none"
) -> TableLayout:
    """Tables after streaming ``requests`` as files, each frame written after the one before."""
    root = f"{ensure_checkpoint_dir(spark)}/proofweave/stream-{uuid.uuid4().hex}"
    layout = TableLayout(f"{root}/tables")
    for frame in requests:
        frame.write.mode("append").option("compression", compression).json(f"{root}/requests")
    stream = streaming.request_stream(spark, f"{root}/requests", max_files=max_files)
    streaming.run_to_completion(
        streaming.start_ingestion(stream, layout, f"{root}/stream-checkpoint", embedder)
    )
    return layout


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents streamed as request files, in micro-batches, with repeats."""
    requests = B.ingest_requests(spark, sf_dir)
    layout = _streamed(spark, requests, requests)
    return (
        layout.active_chunks(spark)
        .groupBy("document_id", "version_id")
        .agg(F.count(F.lit(1)).alias("chunk_count"), F.min("chunk_id").alias("least_chunk_id"))
    )


@query
def stream_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two editions of each document in one stream: the later request is active."""
    requests = B.ingest_requests(spark, sf_dir)
    swapped = F.length("content") % 2 == 1
    editions = requests.withColumn("version_label", F.explode(F.array(F.lit("1.3"), F.lit("1.4"))))
    newer = (F.col("version_label") == "1.4") != swapped
    layout = _streamed(
        spark, editions.withColumn("activation_seq", F.when(newer, 2).otherwise(1).cast("long"))
    )
    written = layout.read(spark, VERSIONS).select("batch_id", "version_id", "version_label")
    active = layout.active_versions(spark)
    return (
        active.join(written, ["batch_id", "version_id"])
        .select("document_id", "version_label")
        .distinct()
    )


@query
def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two editions of each document, then the first again: no second job, in one micro-batch or three."""
    requests = B.ingest_requests(spark, sf_dir)
    swapped = F.length("content") % 2 == 1
    parts = []
    for seq, (odd, even) in enumerate((("1.4", "1.3"), ("1.3", "1.4"), ("1.4", "1.3"))):
        labelled = requests.withColumn("version_label", F.when(swapped, odd).otherwise(even))
        parts.append(labelled.withColumn("activation_seq", F.lit(seq + 1).cast("long")))
    out = None
    for split, frames in (("one", [parts[0].unionByName(parts[1]).unionByName(parts[2])]), ("three", parts)):
        # As many files a frame as a micro-batch takes, so that it ends where the frame does.
        files = spark.sparkContext.defaultParallelism
        dealt = (f.repartition(files) for f in frames)
        layout = _streamed(spark, *dealt, max_files=files, compression="gzip")
        jobs = layout.keyed(JOBS).read(spark).filter("status = 'completed'").groupBy("document_id").agg(
            F.count("*").alias("jobs"), F.sum("attempts").alias("attempts")
        )
        shown = layout.registered_versions(spark).filter("status = 'active'").select("document_id", "version_label")
        rows = shown.join(jobs, "document_id").select(F.lit(split).alias("split"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _three_batches(spark: SparkSession, sf_dir: str) -> TableLayout:
    """All requests; even ones again with another title and authority; every third as ``v2``."""
    root = f"{ensure_checkpoint_dir(spark)}/proofweave/batches-{uuid.uuid4().hex}"
    layout = TableLayout(root)
    requests = B.ingest_requests(spark, sf_dir)

    def retitled(rows: DataFrame, ending: str) -> DataFrame:
        title = F.when(F.length("title").between(1, 200), F.concat("title", F.lit(ending))).otherwise(F.col("title"))
        return rows.withColumns(
            {"title": title, "metadata": F.map_concat("metadata", F.create_map(F.lit("note"), F.lit(ending.strip())))}
        )

    even = retitled(requests.filter(F.length("content") % 2 == 0), " again").withColumn(
        "source_authority", F.when(F.col("source_authority") <= 1, F.lit(0.5)).otherwise(F.col("source_authority"))
    )
    third = retitled(requests.filter(F.length("content") % 3 == 0), " anew").withColumn("version_label", F.lit("v2"))
    for batch_id, batch in enumerate((requests, even, third)):
        ingestion.ingest_batch(batch, layout, batch_id, skip_known_jobs=True)
    return layout


@query
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after three batches: the last title and metadata of each."""
    layout = _three_batches(spark, sf_dir)
    documents, tenants = (layout.keyed(name).read(spark) for name in (DOCUMENTS, ENTERPRISES))
    return documents.join(tenants, "enterprise_id").select(
        "enterprise_id", "document_id", "title", "source_uri",
        "source_fingerprint",
        F.coalesce(F.col("metadata")["note"], F.lit("")).alias("note"),
        F.size("metadata").cast("long").alias("metadata_size"),
        F.col("first_batch").cast("long").alias("tenant_since"),
    )


@query
def version_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions after three batches: scores refreshed, active ones still active unless replaced."""
    return _three_batches(spark, sf_dir).registered_versions(spark).select(
        "document_id", "version_label", "status", F.round("source_authority", 6).alias("source_authority"),
        F.unix_micros("published_at").alias("published_micros"), F.col("batch_id").cast("long").alias("refreshed_in"),
    )


@query
def request_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose vectors came out wrong, twice; every third was sent again and succeeded."""
    root = f"{ensure_checkpoint_dir(spark)}/proofweave/attempts-{uuid.uuid4().hex}"
    layout = TableLayout(root)
    requests = B.ingest_requests(spark, sf_dir)

    def short(content):
        return F.array(F.lit(0.0).cast("float"), F.length(content).cast("float"))

    ingestion.ingest_batch(requests.unionByName(requests), layout, 0, short, skip_known_jobs=True)
    again = requests.filter(F.length("content") % 3 == 0)
    ingestion.ingest_batch(again, layout, 1, skip_known_jobs=True)
    jobs = layout.keyed(JOBS).read(spark)
    return jobs.select("document_id", "status", F.col("attempts").cast("long").alias("attempts"), "last_error")


@query
def validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asked question with the rules that it violates."""
    reason = question_problems(F.col("query_text"))
    return B.asked_questions(spark, sf_dir).select(
        "question_id", (reason == "").alias("is_valid"), reason.alias("reason")
    )
