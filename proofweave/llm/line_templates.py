"""Recurring lines by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line falls to the leaf of its token count and its
leading tokens. In a leaf, tokens with digits and tokens that too few documents
have at that place become variable fields. Lines whose template recurs across
documents are dropped, and so are long lines that recur as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave.llm.common import fresh, meet, whole
from proofweave.operators.sizing import materialize

#: Documents that must share a template, and that must share a token at a place.
MIN_DOCS = 10
#: Tokens a line needs to be dropped, and the depth of the tree below the count.
MIN_TOKENS, LEADING = 4, 3
FIELD = "<*>"
#: A line of so many tokens recurs as it stands, from so many documents on.
LONG_TOKENS, LITERAL_DOCS = 50, 2
#: Leaves that are broadcast, 16 bytes each; more are joined by shuffling.
BROADCAST_LEAVES = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _masked_lines(text: Column) -> Column:
    """The lines' tokens, those with digits generalised, joined by one blank.

    Works on the whole text at once: blanks, then tokens, then the ends of lines.
    """
    # A lambda's variable is evaluated once, and most texts need none of the three rewrites.
    def once(value: Column, rewrite) -> Column:
        return F.transform(F.array(value), rewrite)[0]

    blank = once(text, lambda t: F.when(t.rlike(r"[\t\r\f\x0b]"), F.translate(t, "\t\r\f\x0b", "    ")).otherwise(t))
    single = once(blank, lambda t: F.when(F.instr(t, "  ") > 0, F.regexp_replace(t, " {2,}+", " ")).otherwise(t))
    # Anchored at a token's start and possessive, so linear in tokens of any length.
    digits = r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+"
    generalised = once(single, lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, digits, FIELD)).otherwise(t))
    return F.transform(_lines(generalised), lambda line: F.trim(line))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, line): masked lines of each document (key, text) that recur.

    ``key`` is the doc_id as text, or a hash of the text where it is null; null
    texts have no lines. Rows of one key count as one document.
    """
    if min_docs < LITERAL_DOCS:
        raise ValueError(f"min_docs must be {LITERAL_DOCS} or more")
    lines = docs.select("key", F.explode(F.array_distinct(_masked_lines(F.col("text")))).alias("line"))
    count = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.select("key", "line", count.alias("tokens")).filter(F.col("tokens") >= MIN_TOKENS)
    lines = lines.withColumn("leaf", F.xxhash64("tokens", F.substring_index("line", " ", LEADING)))
    leaves = materialize(
        lines.groupBy("leaf", "tokens").agg(F.count("*").alias("n"))
        .filter((F.col("n") >= min_docs) | (F.col("tokens") >= LONG_TOKENS) & (F.col("n") >= LITERAL_DOCS))
        .select("leaf", "n"),
        "leaves",
    )
    if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        held = lines.join(F.broadcast(leaves.select("leaf")), "leaf", "left_semi")
    else:
        held = meet(lines, leaves, "leaf", "n", leaves.agg(F.sum("n")).first()[0]).drop("n")
    held = materialize(held.distinct(), "lines")
    distinct = materialize(held.groupBy("leaf", "tokens", "line").agg(F.count("*").alias("n")), "distinct")
    often = distinct.groupBy("leaf").agg(F.sum("n").alias("leaf_n")).filter(F.col("leaf_n") >= min_docs)
    parts = (
        distinct.join(often, "leaf", "left_semi")
        .select("leaf", "line", "n", F.posexplode(F.split("line", " ")).alias("pos", "token"))
        .filter(F.col("token") != FIELD)
    )
    common = parts.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("support")).filter(F.col("support") >= min_docs)
    template = F.array_sort(F.collect_list(F.struct("pos", "token")))
    templates = (
        parts.join(common, ["leaf", "pos", "token"], "left_semi")
        .groupBy("leaf", "line").agg(template.alias("template"), F.first("n").alias("n"))
        .filter(F.size("template") * 2 >= F.size(F.split("line", " ")))
    )
    # Lines of one leaf with the same fixed tokens at the same places share a template.
    shared = templates.withColumn("template", F.concat_ws(":", "leaf", F.to_json("template")))
    shared = materialize(shared.select("leaf", "line", "n", "template"), "templates")
    recurring = _in_documents(shared, held, min_docs)
    literal = distinct.filter((F.col("tokens") >= LONG_TOKENS) & (F.col("n") >= LITERAL_DOCS)).select("leaf", "line")
    gone = materialize(recurring.union(literal).distinct(), "recurring")
    return held.join(gone, ["leaf", "line"], "left_semi").select("key", "line")


def _in_documents(shared: DataFrame, held: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, line) whose template ``min_docs`` documents have.

    The lines' documents, summed, bound a template's from above, so only
    templates of several lines that pass the bound have to be counted by key.
    """
    bounds = shared.groupBy("template").agg(F.sum("n").alias("most"), F.max("n").alias("least")).filter(F.col("most") >= min_docs)
    sure = bounds.filter(F.col("least") >= min_docs).select("template")
    asked = shared.join(bounds.filter(F.col("least") < min_docs).select("template"), "template", "left_semi")
    counted = (
        held.join(asked.select("leaf", "line", "template"), ["leaf", "line"])
        .select("template", "key").distinct()
        .groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("template")
    )
    return shared.join(sure.union(counted), "template", "left_semi").select("leaf", "line")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines cut out of text, plus n_lines and n_dropped.

    A line goes if ``min_docs`` documents share its template, or if it has
    LONG_TOKENS tokens or more and LITERAL_DOCS documents have them all. Lines
    of fewer than MIN_TOKENS tokens and blank lines always stay. Null
    texts count as empty. A document counts once for a line, however often it
    repeats it; rows that repeat a doc_id are one document; rows without doc_id
    are one document per text. No rows give no rows. If ``docs`` has columns of
    the added names, the added ones get underscores.
    """
    names = {n: fresh(docs, n) for n in ("_key", "_gone", "_lines", "_kept", "_marked")}
    key, gone, lines, kept, marked = names.values()
    own = docs.withColumn(
        key, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(whole("text"))))
    )
    found = recurring_lines(own.select(F.col(key).alias("key"), whole("text").alias("text")), min_docs)
    per_doc = found.groupBy(F.col("key").alias(key)).agg(F.collect_set("line").alias(gone))
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    return (
        own.join(per_doc, key, "left")
        .withColumn(lines, _lines(whole("text")))
        .withColumn(marked, F.when(F.col(gone).isNotNull(), _masked_lines(whole("text"))))
        .withColumn(
            kept,
            F.expr(
                f"if(`{gone}` is null, `{lines}`, transform(filter(zip_with(`{lines}`, `{marked}`,"
                f" (l, m) -> struct(l, m)), x -> not array_contains(`{gone}`, x.m)), x -> x.l))"
            ),
        )
        .withColumns({
            n_lines: F.size(lines),
            n_dropped: F.size(lines) - F.size(kept),
            "text": F.array_join(kept, "\n"),
        })
        .select(*docs.columns, n_lines, n_dropped)
    )
