"""Registered queries of this subpackage, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from proofweave.llm import (
    decontaminate,
    exact_dedup,
    hard_negatives,
    language,
    line_templates,
    link_trust,
    packing,
    personal_data,
    quality,
    quotes,
    repetition,
    simhash,
    toxicity,
)
from proofweave.llm.common import table, whole


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, which every worker has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: ~s["disguised"])
    return found.withColumn("base", base).select(
        "doc_id",
        *(
            F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}")
            for k in personal_data.KINDS
        ),
        F.sha2(personal_data.listed(F.col("base")), 256).alias("base_sha256"),
        personal_data.listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_disguised"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.toxicity(docs, toxicity.fit(docs, labels))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return line_templates.drop_recurring_lines(docs).select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(
        table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicate_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return link_trust.verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(
        table(spark, sf_dir, "pages", "page_id", "url", "html"),
        table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"),
    )
    return found.select(
        "doc_id", "item_id", "window_start", F.round("similarity", 9).alias("similarity")
    )


def op10_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path()
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = repetition.periodic_runs(docs.select("doc_id", _wrapped("doc_id", "text").alias("text")))
    # Of equally long runs array_max takes the one that negation puts first.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.expr("(1000 * best.length) div (-best.col3)").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _wrapped(doc_id: str, text: str) -> Column:
    """The text; where crc32(doc_id) ends in 0, its tail repeats with a period that crc32 sets."""
    words = F.filter(F.split(whole(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    digest = F.crc32(F.col(doc_id).cast("string"))
    asked = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), F.floor(digest / 10).alias("g"))
    said = F.transform(
        F.array(asked),
        lambda s: F.transform(
            F.sequence(F.lit(0).cast("long"), s["n"] - 1),
            lambda i: F.when(i < s["g"] % s["n"], F.get(s["w"], i.cast("int"))).otherwise(
                F.get(
                    s["w"],
                    (
                        s["g"] % s["n"]
                        + (i - s["g"] % s["n"])
                        % (1 + F.floor((s["n"] - s["g"] % s["n"]) / (3 + s["g"] % 8)))
                    ).cast("int"),
                )
            ),
        ),
    )[0]
    return F.when((digest % 10 == 0) & (F.size(words) > 0), F.array_join(said, " ")).otherwise(whole(text))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )
    return hard_negatives.hard_negatives(hard_negatives.usable(rows), F.col("vec_id") % 50 == 0)


def op13_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quality.described(table(spark, sf_dir, "documents", "doc_id", "text"))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.quality(vectors, quality.fit(vectors, labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_line_templates": op4_line_templates,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_link_trust": op7_link_trust,
    "op8_language_fusion": op8_language_fusion,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_bestfit_packing": op10_bestfit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_discriminant": op13_quality_discriminant,
}

ORACLE: dict[str, str] = {
    "op12_hard_negatives": r"""
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS u
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   list_inner_product(a.u, b.u)::BIGINT AS score
            FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, id, score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        ranked AS (
            SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score,
                   s.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
            FROM positives p JOIN scores s USING (anchor_id)
            WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 3""",
    "op6_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY content) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(content) AS text_sha256
        FROM texts
        WINDOW w AS (PARTITION BY content ORDER BY points DESC, doc_id)""",
    "op9_benchmark_decontamination": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words
            FROM documents),
        items AS (
            SELECT item_id, words, len(words) AS n, least(len(words), 5) AS k
            FROM (SELECT item_id,
                         regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words
                  FROM benchmark)
            WHERE len(words) > 0),
        item_shingles AS (
            SELECT item_id, k, unnest(list_transform(range(0, n - k + 1),
                   lambda x: array_to_string(words[x + 1:x + k], ' '))) AS s
            FROM items),
        kinds AS (SELECT DISTINCT k FROM items),
        doc_shingles AS (
            SELECT doc_id, k, unnest(range(0, len(words) - k + 1)) AS pos,
                   unnest(list_transform(range(0, len(words) - k + 1),
                   lambda x: array_to_string(words[x + 1:x + k], ' '))) AS s
            FROM docs, kinds WHERE len(words) >= k),
        pairs AS (
            SELECT DISTINCT doc_id, item_id FROM doc_shingles JOIN item_shingles USING (k, s)),
        windows AS (
            SELECT doc_id, item_id, i.k, i.n, least(i.n, len(d.words)) AS size,
                   unnest(range(0, greatest(0, len(d.words) - i.n) + 1)) AS st
            FROM pairs JOIN docs d USING (doc_id) JOIN items i USING (item_id)),
        held AS (
            SELECT w.doc_id, w.item_id, w.st, w.size - w.k + 1 AS a, w.n - w.k + 1 AS b, d.s, count(*) AS c
            FROM windows w JOIN doc_shingles d
              ON d.doc_id = w.doc_id AND d.k = w.k AND d.pos BETWEEN w.st AND w.st + w.size - w.k
            GROUP BY ALL),
        wanted AS (SELECT item_id, s, count(*) AS c FROM item_shingles GROUP BY ALL),
        scored AS (
            SELECT doc_id, item_id, st, a, b, sum(least(held.c, wanted.c)) AS shared
            FROM held JOIN wanted USING (item_id, s) GROUP BY ALL),
        alike AS (
            SELECT doc_id, item_id, st, shared::DOUBLE / (a + b - shared)::DOUBLE AS sim FROM scored)
        SELECT doc_id, item_id, st::INT AS window_start, round(sim, 9) AS similarity
        FROM alike WHERE sim >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, st) = 1""",
    "op7_link_trust": link_trust.oracle_sql(),
    "op4_line_templates": r"""
        WITH lines AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        masked AS (
            SELECT doc_id, lines, list_transform(lines, lambda l: list_transform(
                       list_filter(regexp_split_to_array(l, '[ \t\r\f\x0B]+'), lambda t: t <> ''),
                       lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END)) AS toks
            FROM lines),
        leafed AS (
            SELECT DISTINCT doc_id, toks, len(toks) AS n, toks[1:3] AS lead
            FROM (SELECT doc_id, unnest(toks) AS toks FROM masked) WHERE len(toks) >= 4),
        tokens AS (
            SELECT n, lead, toks, doc_id, unnest(range(1, n + 1)) AS pos, unnest(toks) AS tok FROM leafed),
        support AS (
            SELECT n, lead, pos, tok FROM tokens WHERE tok <> '<*>'
            GROUP BY ALL HAVING count(*) >= 10),
        templates AS (
            SELECT doc_id, toks, list(coalesce(s.tok, '<*>') ORDER BY pos) AS template, count(s.tok) AS fixed
            FROM tokens LEFT JOIN support s USING (n, lead, pos, tok) GROUP BY doc_id, toks, n),
        often AS (
            SELECT template FROM templates WHERE fixed * 2 >= len(template)
            GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
        gone AS (
            SELECT toks FROM templates JOIN often USING (template) WHERE fixed * 2 >= len(template)
            UNION
            SELECT toks FROM leafed WHERE n >= 50 GROUP BY toks HAVING count(*) >= 2),
        flagged AS (
            SELECT doc_id, i, line, toks IN (SELECT toks FROM gone) AS drop
            FROM (SELECT doc_id, unnest(lines) AS line, unnest(toks) AS toks, unnest(range(len(lines))) AS i
                  FROM masked))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop), '')) AS text_sha256
        FROM flagged GROUP BY doc_id""",
    "op5_quotation_linking": r"""
        WITH raw AS (
            SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations),
        parsed AS (
            SELECT conv_id, turn, role, i, len(regexp_replace(regexp_extract(line, '^[ \t]*>(?:[ \t]{0,3}>)*[ \t]*'), '[^>]', '', 'g')) AS level,
                   regexp_replace(line, '^[ \t]*>(?:[ \t]{0,3}>)*[ \t]*', '') AS body
            FROM (SELECT conv_id, turn, role, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM raw)),
        lines AS (
            SELECT *, trim(regexp_replace(lower(body), '[ \t\r]+', ' ', 'g')) AS norm,
                   coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) > 0
                   AND regexp_matches(body, '(?:wrote|a écrit|schrieb|escribió)[ ]?:[ \t]*$') AS intro
            FROM parsed),
        originals AS (
            SELECT conv_id, norm, min(turn) AS original FROM lines WHERE level = 0 AND norm <> '' GROUP BY ALL),
        links AS (
            SELECT conv_id, turn, count(*) AS n_quoted, count(o) AS n_linked, max(o) FILTER (level = 1) AS answers
            FROM (SELECT l.conv_id, turn, level, CASE WHEN original < turn THEN original END AS o
                  FROM lines l LEFT JOIN originals USING (conv_id, norm) WHERE level > 0 AND norm <> '')
            GROUP BY ALL),
        own AS (
            SELECT conv_id, turn, role, trim(coalesce(string_agg(body, chr(10) ORDER BY i)
                   FILTER (level = 0 AND NOT intro), '')) AS content
            FROM lines GROUP BY ALL),
        placed AS (
            SELECT *, coalesce(answers, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn)) AS reply_to,
                   max(CASE WHEN answers IS NOT NULL THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS branch_turn
            FROM own LEFT JOIN links USING (conv_id, turn))
        SELECT p.conv_id, p.turn, p.role, p.content, p.reply_to, p.branch_turn, s.answers AS anchor_turn,
               coalesce(p.n_quoted, 0) AS n_quoted, coalesce(p.n_linked, 0) AS n_linked
        FROM placed p LEFT JOIN links s ON s.conv_id = p.conv_id AND s.turn = p.branch_turn""",
}
