"""Conversations without quotes, in reply order, in DataFrame operations only.

Quoted lines are parsed by their nesting. Consecutive ones of one level are a
passage; passages are normalised over line breaks, hashed, and joined to the
earliest message of the conversation that says all their words in a row. Lines
of passages that nobody says whole are joined one by one. A message
replies to the latest original among its outermost quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from proofweave.llm.common import whole

#: Turns that one window task orders, so a conversation of any length is split.
BLOCK = 1024
_MARK = r"^[ \t]*>(?:[ \t]{0,3}>)*[ \t]*"
#: Ends of the line that introduces a quote, in four languages.
_INTRO = r"(?:wrote|a écrit|schrieb|escribió)[ ]?:[ \t]*$"


def _parsed(messages: DataFrame) -> DataFrame:
    """Messages with their lines as structs (level, text, hash)."""
    level = f"length(regexp_replace(regexp_extract(l, '{_MARK}', 0), '[^>]', ''))"
    body = f"regexp_replace(l, '{_MARK}', '')"
    norm = "trim(regexp_replace(lower(body), '[ \\\\t\\\\r]+', ' '))"
    return (
        messages.withColumn("raw", F.split(whole("text"), "\n", -1))
        .withColumn("lines", F.expr(f"transform(raw, l -> struct({level} as level, {body} as body))".replace("\\t", "\\\\t")))
        .withColumn("lines", F.expr(f"transform(lines, x -> struct(x.level, x.body, md5({norm.replace('body', 'x.body')}) as hash, {norm.replace('body', 'x.body')} <> '' as said))"))
        .withColumn("message", F.xxhash64("text"))  # tells rows of one turn apart
        .drop("raw", "text")
    )


def _spans(words: str, size: str) -> str:
    """SQL for the hashes of every ``size`` words in a row."""
    return f"transform(sequence(0, size({words}) - {size}), i -> md5(concat_ws(' ', slice({words}, i + 1, {size}))))"


def _passages(own: DataFrame) -> DataFrame:
    """(conv_id, turn, message, at, whole): lines, by index, of passages of two or more
    lines, and the earliest turn that says the passage itself, however wrapped.
    """
    kept = own.filter("conv_id is not null and turn is not null").withColumn(
        "told", F.expr("transform(lines, (x, i) -> struct(i as at, x.level as level, x.said as said, "
                       "trim(regexp_replace(lower(x.body), '[ \\\\t\\\\r]+', ' ')) as norm))")
    )
    # A passage is [first, level, lines, words]; a line of another level or a blank one ends it.
    grown = F.expr("""aggregate(told, cast(array() as array<struct<level: int, lines: array<int>, norm: string, open: boolean>>),
        (held, x) -> if(x.said and size(held) > 0 and element_at(held, -1).level = x.level and element_at(held, -1).open,
            concat(slice(held, 1, size(held) - 1), array(struct(x.level as level,
                concat(element_at(held, -1).lines, array(x.at)) as lines,
                concat(element_at(held, -1).norm, ' ', x.norm) as norm, true as open))),
            if(size(held) > 0 and not element_at(held, -1).open and not x.said, held,
               concat(held, array(struct(x.level as level, array(x.at) as lines, x.norm as norm, x.said as open))))))""")
    asked = (
        kept.filter("exists(lines, x -> x.level > 0)").select("conv_id", "turn", "message", F.explode(grown).alias("p"))
        .filter("p.level > 0 and p.open and size(p.lines) > 1")
        .select("conv_id", "turn", "message", "p.lines", F.md5("p.norm").alias("hash"), F.size(F.split("p.norm", " ")).alias("size"))
    )
    sizes = asked.select("conv_id", "size").distinct()
    said = kept.select(
        "conv_id", F.col("turn").alias("t"),
        F.split(F.expr("array_join(transform(filter(told, x -> x.level = 0 and x.said), x -> x.norm), ' ')"), " ").alias("words"),
    )
    spans = (
        said.join(sizes, "conv_id").filter("size(words) >= size")
        .select("conv_id", "t", "size", F.explode(F.expr(_spans("words", "size"))).alias("hash"))
        .groupBy("conv_id", "size", "hash").agg(F.min("t").alias("whole"))
    )
    return (
        asked.join(spans, ["conv_id", "size", "hash"]).filter("whole < turn")
        .select("conv_id", "turn", "message", F.explode("lines").alias("at"), "whole")
        .groupBy("conv_id", "turn", "message", "at").agg(F.min("whole").alias("whole"))
    )


def reply_order(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, reply_to, branch_turn, anchor_turn, n_quoted,
    n_linked): a row per row of ``messages`` (conv_id, turn, role, text).

    content is the message without quotes and the lines that introduce them.
    reply_to is the turn it answers: the latest original of its outermost
    quotes, else the turn before. A message whose quotes are linked starts a
    branch that lasts to the next such message; branch_turn is its turn and
    anchor_turn the one it answers (null for the first branch). Sorted by
    conv_id, anchor_turn, branch_turn (nulls first) and turn, every branch is
    whole and follows the message it answers.

    A passage of several quoted lines that one message says whole, however it
    wraps them, is linked to the earliest such message; else each line to the
    earliest message with that line. n_quoted and n_linked count lines.
    Quotes without an original are removed but not linked. Null texts count as
    empty. Rows with a null conv_id or turn are never linked. Rows that repeat a
    turn share its links. No rows give no rows; other columns are not read.
    """
    own = _parsed(messages.select("conv_id", "turn", "role", "text"))
    lines = own.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", "message", F.posexplode("lines").alias("at", "l")
    ).filter("l.said")
    quoted = lines.filter("l.level > 0").select("conv_id", "turn", "message", "at", "l.level", "l.hash")
    originals = lines.filter("l.level = 0").groupBy("conv_id", F.col("l.hash").alias("hash")).agg(F.min("turn").alias("original"))
    links = (
        quoted.join(originals, ["conv_id", "hash"], "left")
        .join(_passages(own), ["conv_id", "turn", "message", "at"], "left")
        .withColumn("original", F.coalesce("whole", F.when(F.col("original") < F.col("turn"), F.col("original"))))
        .groupBy("conv_id", "turn")
        .agg(
            F.count("*").alias("n_quoted"),
            F.count("original").alias("n_linked"),
            F.max(F.when(F.col("level") == 1, F.col("original"))).alias("answers"),
        )
    )
    turns = own.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    nodes = turns.join(links, ["conv_id", "turn"], "left").withColumn("block", F.floor(F.col("turn") / BLOCK))
    start = F.when(F.col("answers").isNotNull(), F.struct("turn", "answers"))
    blocks = nodes.groupBy("conv_id", "block").agg(F.max("turn").alias("last"), F.max(start).alias("start"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "block", F.max("last").over(before).alias("last"), F.max("start").over(before).alias("start")
    )
    inside = W.partitionBy("conv_id", "block").orderBy("turn")
    placed = (
        nodes.withColumn("prev", F.lag("turn").over(inside))
        .withColumn("branch", F.max(start).over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(blocks, ["conv_id", "block"])
        .select(
            F.col("conv_id").alias("c"), F.col("turn").alias("t"),
            F.coalesce("answers", "prev", "last").alias("reply_to"),
            F.coalesce("branch", "start").alias("branch"),
            F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
    )
    intro = f"lines[i].body rlike '{_INTRO}'".replace("\\t", "\\\\t")
    content = F.expr(
        f"""array_join(transform(filter(transform(lines, (x, i) -> struct(x.body as body,
            x.level = 0 and not (coalesce(get(lines, i + 1).level, 0) > 0 and {intro}) as own)),
            y -> y.own), y -> y.body), '\n')"""
    )
    out = own.select("conv_id", "turn", "role", F.trim(content).alias("content"))
    return out.join(placed, (out["conv_id"] == placed["c"]) & (out["turn"] == placed["t"]), "left").select(
        "conv_id", "turn", "role", "content", "reply_to",
        F.col("branch.turn").alias("branch_turn"),
        F.col("branch.answers").alias("anchor_turn"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
