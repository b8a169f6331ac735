"""The engine's logical tables, bound to the given star-schema and text tables.

A binding renames, joins and derives; it never drops rows to make work small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx
from proofweave.functions.embedding import with_embedding
from proofweave.functions.identity import uuid_from_text
from proofweave.operators import chunking, lexical, routing, versions
from proofweave.operators.rerank import with_token_sets
from proofweave.operators.sizing import broadcast_if_small, materialize, spread
from proofweave.sources.questions import split_questions
from proofweave.operators.traces import days_later
from proofweave.plans.answering import answer_questions

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
PUBLISHED_DAYS = 900
REVISION_DELAY_DAYS = 30
TENANTS = 20
# Labels, and ids of active versions, up to which they are broadcast: some 20 and 100 bytes each.
BROADCAST_LABELS = 2_000_000
BROADCAST_VERSIONS = 1_000_000

_built: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
_evidence: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, broadcast if few, so that whole texts need not be shuffled to meet them."""
    return broadcast_if_small(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), BROADCAST_LABELS)


def tenant_uuid(source: Column) -> Column:
    return uuid_from_text(source)


def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ``v1``; every labelled document again as ``v2``."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id").join(
        labels(spark, sf_dir), "doc_id", "left"
    )
    published = F.lit(EPOCH) + F.make_dt_interval(days=F.col("doc_id") % PUBLISHED_DAYS)
    editions = F.array(
        F.struct(F.lit("v1").alias("label"), F.lit("").alias("addition"), F.lit(0).alias("delay")),
        F.when(
            F.col("quality").isNotNull(),
            F.struct(
                F.lit("v2").alias("label"),
                F.lit("\nRevised.").alias("addition"),
                F.lit(REVISION_DELAY_DAYS).alias("delay"),
            ),
        ),
    )
    return (
        documents.withColumn("edition", F.explode(F.array_compact(editions)))
        .select(
            "doc_id",
            tenant_uuid(F.col("source")).alias("enterprise_id"),
            uuid_from_text(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias(
                "document_id"
            ),
            title_of(F.col("text")).alias("title"),
            F.concat(F.lit("corpus://documents/"), F.col("doc_id").cast("string")).alias(
                "source_uri"
            ),
            F.col("edition.label").alias("version_label"),
            F.concat("text", "edition.addition").alias("text"),
            (published + F.make_dt_interval(days=F.col("edition.delay"))).alias("published_at"),
            F.coalesce(F.lit(0.70) + F.col("quality") * 0.25, F.lit(K.DEFAULT_AUTHORITY)).alias(
                "source_authority"
            ),
            F.coalesce(F.lit(0.9) - F.col("toxic") * 0.3, F.lit(K.DEFAULT_QUALITY)).alias(
                "extraction_quality"
            ),
            document_principals().alias("principals"),
        )
    )


def title_of(text: Column) -> Column:
    """The whole first sentence."""
    return F.regexp_extract(text, r"\A[^.\n]*", 0)


def document_principals() -> Column:
    language_group = F.concat(F.lit("group:"), F.col("lang"))
    return F.when(
        F.col("quality") == 1, F.array(language_group, F.lit("role:builder"))
    ).otherwise(F.array(language_group))


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embedded chunks of active versions, and their search index.

    Built once per session and folder as written tables: ingestion happens once,
    questions are asked many times.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        chunks = with_token_sets(with_embedding(active_corpus_chunks(spark, sf_dir), "content"))
        stored = materialize(chunks, "chunks")
        _built[key] = (stored, materialize(lexical.index_chunks(stored), "index"))
    return _built[key]


def identified_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised document versions with their identifiers."""
    return chunking.with_version_identity(
        chunking.normalize_documents(document_versions(spark, sf_dir))
    ).drop("text")


def activation_requests(editions: DataFrame) -> DataFrame:
    """Editions are activated in label order."""
    return editions.select(
        "enterprise_id",
        "document_id",
        "version_id",
        F.regexp_replace("version_label", "v", "").cast("int").alias("activation_seq"),
    )


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every edition, as each is embedded when it is taken in."""
    return chunking.with_chunk_identity(chunking.split_documents(identified_editions(spark, sf_dir)))


def active_corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the version each document currently shows."""
    editions = identified_editions(spark, sf_dir)
    active = versions.latest_activation(activation_requests(editions)).select("version_id")
    active = broadcast_if_small(materialize(active, "active"), BROADCAST_VERSIONS)
    shown = editions.join(active, "version_id", "left_semi")
    return chunking.with_chunk_identity(chunking.split_documents(shown))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked questions within the bounds of a question."""
    return split_questions(asked_questions(spark, sf_dir))[0]


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, plus one known-item question per document.

    A labelled document is asked for by its title; any other is asked for the
    sum or mean of the values in it.
    """
    turns = (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(
            F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("question_id"),
            tenant_uuid(
                F.concat(F.lit("src"), (F.col("conv_id") % TENANTS).cast("string"))
            ).alias("enterprise_id"),
            F.concat(F.lit("user-"), F.col("conv_id").cast("string")).alias("actor_id"),
            F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("group:en"), F.lit("role:builder")))
            .otherwise(F.array(F.lit("group:en")))
            .alias("principals"),
            F.col("text").alias("query_text"),
        )
    )
    documents = table(spark, sf_dir, "documents").join(
        labels(spark, sf_dir), "doc_id", "left"
    )
    title = title_of(F.col("text"))
    wanted = F.when(F.col("lang") == "en", "total").otherwise("average")
    numeric = F.concat(title, F.lit(": what is the "), wanted, F.lit(" of the values?"))
    labelled = F.col("quality").isNotNull()
    known_items = documents.select(
        F.concat_ws("-", F.when(labelled, "title").otherwise("values"), "doc_id").alias(
            "question_id"
        ),
        tenant_uuid(F.col("source")).alias("enterprise_id"),
        F.concat(F.lit("reader-"), F.col("lang")).alias("actor_id"),
        F.array(F.concat(F.lit("group:"), F.col("lang"))).alias("principals"),
        F.when(labelled, title).otherwise(numeric).alias("query_text"),
    )
    return turns.unionByName(known_items)


def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to retrieve for: vectors of the asked text, terms of the corrected one."""
    return corrected(with_embedding(questions(spark, sf_dir), "query_text"))


def corrected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected(questions(spark, sf_dir))


def corrected(asked: DataFrame) -> DataFrame:
    return routing.correct(asked).withColumn("query_text", F.col("effective_text"))


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Routed questions and their written evidence, once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _evidence:
        chunks, index = corpus(spark, sf_dir)
        _evidence[key] = answer_questions(
            questions(spark, sf_dir), chunks, index, claims_for=mixed_claims
        )
    return _evidence[key]


def mixed_claims(retrieved: DataFrame) -> DataFrame:
    """Proposals of every kind: verbatim, padded, altered, misattributed, blank.

    A quarter of the questions get no verbatim proposal, and a quarter none.
    """
    line = tx.first_line(F.col("content"))
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), chunk.alias("cited"), text.alias("text"))
            for kind, chunk, text in (
                (0, F.col("chunk_id"), F.concat(F.lit("  "), line, F.lit(" "))),
                (1, F.col("chunk_id"), F.upper(line)),
                (2, F.sha2(F.col("chunk_id"), 256), line),
                (3, F.col("chunk_id"), F.lit("   ")),
            )
        ]
    )
    share = F.conv(F.substring(F.md5("question_id"), 1, 2), 16, 10).cast("int") % 4
    offered = F.filter(kinds, lambda k: (share < 2) | ((share == 2) & (k["kind"] > 0)))
    leading = retrieved.filter(F.col("result_rank") <= K.CITED_CHUNKS)
    return leading.withColumn("claim", F.explode(offered)).select(
        "question_id",
        ((F.col("result_rank") - 1) * 4 + F.col("claim.kind") + 1).alias("pos"),
        F.col("claim.cited").alias("chunk_id"),
        F.col("claim.text").alias("text"),
    )


def line_evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as questions, line items as their evidence, and proposed claims.

    Returned lines state no number; a quarter of the orders asks for a total,
    and for another quarter the leading line is proposed as a claim.
    """
    named = F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"))
    place = Window.partitionBy("l_orderkey").orderBy(
        F.desc("support_score"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    stated = F.concat(
        F.lit("Quantity "), F.col("l_quantity").cast("int").cast("string"),
        F.lit(" of part "), F.col("l_partkey").cast("string"), F.lit("."),
    )
    lines = (
        table(spark, sf_dir, "lineitem")
        .withColumn("support_score", F.round(F.lit(0.58) + F.col("l_discount") + F.col("l_tax"), 4))
        .withColumn("result_rank", F.row_number().over(place))
        .select(
            named.alias("question_id"),
            F.concat_ws("-", "l_orderkey", "result_rank").alias("chunk_id"),
            F.lit("Lines").alias("title"),
            F.lit("v1").alias("version_label"),
            F.lit("row").alias("locator"),
            F.when(F.col("l_returnflag") == "R", "The part came back.").otherwise(stated).alias("content"),
            "support_score",
            "result_rank",
            F.col("l_orderkey").alias("order"),
        )
    )
    asked = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("question_id"),
        F.when(F.col("o_orderkey") % 4 == 1, "What is the total of the values?")
        .otherwise("Which parts were ordered?")
        .alias("query_text"),
    )
    proposed = lines.filter((F.col("order") % 4 == 2) & (F.col("result_rank") == 1)).select(
        "question_id", F.lit(1).alias("pos"), "chunk_id", F.col("content").alias("text")
    )
    return asked, lines.drop("order"), proposed


def compute_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery times of orders, and sums or means over event values."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("shipped")
    )

    def day(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd")

    delivery = spread(table(spark, sf_dir, "orders"), "o_orderkey").join(
        shipped, F.col("o_orderkey") == F.col("l_orderkey")
    ).select(
        F.concat_ws("-", F.lit("order"), "o_orderkey").alias("question_id"),
        F.concat(
            F.lit("How many days between "), day("o_orderdate"), F.lit(" and "), day("shipped"), F.lit("?")
        ).alias("query_text"),
    )
    word = F.when(F.col("event_type").isin("purchase", "click"), "total").otherwise("average")
    amounts = spread(table(spark, sf_dir, "events"), "event_id").select(
        F.concat_ws("-", F.lit("event"), "event_id").alias("question_id"),
        F.format_string(
            "What is the %s of %.2f and -%s?",
            word,
            F.col("value"),
            F.get_json_object("props", "$.k"),
        ).alias("query_text"),
    )
    return delivery.unionByName(amounts)


def routing_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).select("question_id", "query_text")
    return asked.unionByName(compute_questions(spark, sf_dir))


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ingest requests; some break a bound."""
    documents = spread(table(spark, sf_dir, "documents"), "doc_id").join(
        labels(spark, sf_dir), "doc_id", "left"
    )
    group = F.concat(F.lit("group:"), F.col("lang"))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    published = F.lit(EPOCH) + F.make_dt_interval(days=F.col("doc_id") % PUBLISHED_DAYS)
    return documents.select(
        tenant_uuid(F.col("source")).alias("enterprise_id"),
        uuid_from_text(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("document_id"),
        F.regexp_extract("text", r"\A[^.\n]*", 0).alias("title"),
        F.concat(F.lit("corpus://documents/"), F.col("doc_id").cast("string")).alias("source_uri"),
        F.lit("v1").alias("version_label"),
        F.col("text").alias("content"),
        F.when(toxic, F.array().cast("array<string>")).otherwise(
            F.array(group, F.concat(F.lit(" "), group))
        ).alias("principals"),
        (F.length("text") % 9000 + 64).alias("chunk_size"),
        (F.length("text") % 2500).alias("chunk_overlap"),
        F.coalesce(F.lit(0.70) + F.col("quality") * 0.35, F.lit(K.DEFAULT_AUTHORITY)).alias(
            "source_authority"
        ),
        F.lit(K.DEFAULT_QUALITY).alias("extraction_quality"),
        F.when(F.col("lang") == "es", "soon")
        .otherwise(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("published_at"),
        F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias(
            "metadata"
        ),
    )


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of past questions."""
    payload = F.struct(
        F.lit("rag").alias("route"),
        F.col("event_type").alias("evidence_status"),
        F.struct(F.col("props").alias("raw_query")).alias("model_inputs"),
        F.array("props").alias("retrieved_text"),
    )
    return table(spark, sf_dir, "events").select(
        uuid_from_text(F.concat(F.lit("event:"), F.col("event_id").cast("string"))).alias("trace_id"),
        uuid_from_text(F.concat(F.lit("tenant:"), (F.col("user_id") % 10).cast("string"))).alias(
            "enterprise_id"
        ),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_id"),
        F.concat_ws(" ", "event_type", "props").alias("raw_query"),
        F.format_string("%.2f", F.col("value")).alias("raw_response"),
        payload.alias("payload"),
        F.col("ts").alias("created_at"),
        days_later("ts", K.RAW_CONTENT_DAYS).alias("raw_content_expires_at"),
        days_later("ts", K.TRACE_DAYS).alias("expires_at"),
    )


def graph_definitions(
    spark: SparkSession, sf_dir: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as component graphs: line items are nodes, linked in line order.

    Nodes are numbered by place, in every eighth order by line number, which
    repeats. Some parts and suppliers break a bound each.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    placed = lines.withColumn("position", F.row_number().over(in_order)).withColumn(
        "number", F.when(F.col("l_orderkey") % 8 == 0, F.col("l_linenumber")).otherwise(F.col("position"))
    )
    numbered = placed.withColumns(
        {"following": F.lead("number").over(in_order), "opening": F.first("number").over(in_order)}
    )

    def node(number: Column) -> Column:
        return F.concat(F.lit("n"), number.cast("string"))

    def every(column: str, count: int) -> Column:
        return F.col(column) % count == 0

    by_flag = F.when(F.col("l_returnflag") == "A", "authorization").when(
        F.col("l_returnflag") == "N", "provenance"
    ).otherwise("audit")
    by_status = (
        F.when(every("l_suppkey", 97), "telemetry")
        .when(F.col("l_linestatus") == "O", "claim-validation")
        .otherwise("retrieval")
    )
    mandatory = F.array(*[F.lit(name) for name in K.MANDATORY_CAPABILITIES])
    nodes = numbered.select(
        F.col("l_orderkey").alias("definition_id"),
        node(F.col("number")).alias("node_id"),
        "position",
        F.concat(
            F.lit("part-"), F.col("l_partkey").cast("string"),
            F.when(every("l_partkey", 107), F.lit("x" * 120)).otherwise(""),
        ).alias("component_type"),
        F.when(every("l_partkey", 101), "").otherwise("1.0.0").alias("component_version"),
        F.when((F.col("l_orderkey") % 4 == 1) & (F.col("position") == 1), mandatory)
        .otherwise(F.array(by_flag, by_status)).alias("capabilities"),
        F.when(F.col("l_discount") > 0.02, F.create_map(
            F.lit("flag"), F.col("l_returnflag"),
            F.lit("at"), F.col("l_suppkey").cast("string"),
        )).alias("config"),
        F.lit("rows").alias("input_schema"),
        F.when(every("l_partkey", 103), "").otherwise("rows").alias("output_schema"),
    )
    target = (
        F.when(every("l_partkey", 109), "")
        .when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), node(F.col("opening")))
        .when((F.col("l_tax") > 0.075) & (F.col("l_discount") < 0.025), F.lit("n0"))
        .when(F.col("following") != F.col("number"), node(F.col("following")))
    )
    edges = numbered.select(
        F.col("l_orderkey").alias("definition_id"),
        node(F.col("number")).alias("source_node_id"),
        target.alias("target_node_id"),
        "position",
    ).filter(F.col("target_node_id").isNotNull())
    definitions = orders.select(
        F.col("o_orderkey").alias("definition_id"),
        F.concat(
            F.lit("order "), F.col("o_orderkey").cast("string"),
            F.when(every("o_custkey", 53), F.lit("x" * 160)).otherwise(""),
        ).alias("name"),
        (F.col("o_custkey") % 25 + 28).cast("int").alias("rerank_top_k"),
    )
    return definitions, nodes, edges
