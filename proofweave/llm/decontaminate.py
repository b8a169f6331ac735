"""Benchmark passages in documents, in DataFrame operations only.

A window has as many words as the benchmark item it is compared with. An exact
join of shingles finds every window that could pass; all of these are verified
by the exact similarity of their shingle multisets. SimHash only adds the
reported distance: no radius of fingerprints keeps every such window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave.llm.common import fresh, whole
from proofweave.operators.sizing import broadcast_if_small, materialize

#: A shingle has so many words; shorter items are one shingle.
SHINGLE = 5
#: Least similarity of a passage.
SIMILARITY = 0.8
#: Reach of ``_within_radius``. At similarity 0.8 two fingerprints differ in 9.7
#: of 64 bits on average, but in more than 19 for some, mostly short, passages.
RADIUS = 19
#: Bit offsets and widths of the blocks; within the radius one block differs in
#: at most RADIUS // 5 = 3 bits.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _shingles(words: str, k: str) -> Column:
    """String shingles of ``k`` words, repeats included."""
    return F.expr(
        f"transform(sequence(0, size({words}) - {k}), i -> concat_ws(' ', slice({words}, i + 1, {k})))"
    )


def _fingerprint(shingles: str) -> Column:
    hashed = f"transform({shingles}, s -> xxhash64(s))"
    return F.expr(
        f"""aggregate(array({hashed}), 0L, (whole, h) -> aggregate(sequence(0, 63), 0L, (bits, b) ->
            bits | if(2 * aggregate(h, 0, (n, x) -> n + cast(shiftright(x, b) & 1L as int)) > size(h),
                      shiftleft(1L, b), 0L)))"""
    )


def _block(fp: str, at: int, width: int) -> str:
    return f"shiftrightunsigned({fp}, {at}) & {(1 << width) - 1}L"


def _neighbours(at: int, width: int) -> str:
    masks = f"filter(sequence(0L, {(1 << width) - 1}L), m -> bit_count(m) <= {RADIUS // len(BLOCKS)})"
    return f"transform({masks}, m -> m ^ ({_block('fp', at, width)}))"


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per distinct item with words: item, item_id, size, k, shingles, fp."""
    words = benchmark.select("item_id", words_of(whole("text")).alias("words")).filter("size(words) > 0")
    sized = words.distinct().select(
        F.xxhash64("item_id", "words").alias("item"),
        "item_id",
        F.size("words").alias("size"),
        F.least(F.size("words"), F.lit(SHINGLE)).alias("k"),
        "words",
    )
    full = sized.withColumn("shingles", _shingles("words", "k")).drop("words")
    return full.withColumn("fp", _fingerprint("shingles"))


def _hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item, start): where each shared shingle would put the item's first word."""
    wanted = items.select("item", "k", F.posexplode("shingles").alias("off", "shingle")).select(
        "item", "k", "off", F.xxhash64("shingle").alias("h")
    )
    wanted = broadcast_if_small(wanted, 2_000_000)
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most SHINGLE rows
    found = None
    for k in sizes:
        joined = "concat_ws(' ', " + ", ".join(f"words[i + {j}]" for j in range(k)) + ")"
        hashes = F.expr(f"transform(sequence(0, size(words) - {k}), i -> xxhash64({joined}))")
        mine = texts.filter(F.size("words") >= k).select("row", F.posexplode(hashes).alias("pos", "h"))
        hit = mine.join(wanted.filter(F.col("k") == k), "h").select("row", "item", "pos", (F.col("pos") - F.col("off")).alias("start"))
        found = hit if found is None else found.unionByName(hit)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, window_start, similarity, distance): one row for each
    document and item with a window of similarity SIMILARITY or more.

    The best window is reported, the earliest of equals; window_start counts
    words. Words are runs of letters and digits, so case, punctuation and line
    breaks do not matter. A document shorter than the item is one window. Items
    of fewer than five words are one shingle; items and documents without words
    (null texts too) match nothing. Rows that repeat a doc_id or item_id are
    compared each, and the best is reported. Null ids are reported as such. No
    documents or items give no rows. Other columns are not read.

    What is skipped cannot pass: a document without enough of an item's
    shingles, and windows that no start implied by a shared shingle is near.
    Before the first implied start of a run a window has no shared shingle, so
    one that passes begins at most (1 - s) / (1 + s) of its shingles earlier.
    """
    items = materialize(_items(benchmark), "items")
    if items.isEmpty():
        return docs.select("doc_id").limit(0).select(
            "doc_id",
            *(F.lit(None).cast(kind).alias(name) for name, kind in (
                (("item_id", benchmark.schema["item_id"].dataType), ("window_start", "int"), ("similarity", "double"), ("distance", "int"))
            )),
        )
    texts = docs.select(
        F.xxhash64("doc_id", "text").alias("row"), "doc_id", words_of(whole("text")).alias("words")
    )
    facts = items.select("item", "item_id", "size", "k", F.size("shingles").alias("n"))
    pairs = (
        _hits(texts, items)
        .groupBy("row", "item")
        .agg(F.count_distinct("pos").alias("shared"), F.collect_set("start").alias("starts"))
        .join(broadcast_if_small(facts, 200_000), "item")
        .filter(F.col("shared") >= F.ceil(F.lit(SIMILARITY) * F.col("n") - 1e-9))
        .select("row", "item", "item_id", "size", "k", F.sort_array("starts").alias("starts"))
    )
    pairs = materialize(pairs, "pairs")
    back = f"cast(ceil((size - k + 1) * {(1 - SIMILARITY) / (1 + SIMILARITY)!r}) as int)"
    placed = texts.join(pairs, "row").select(
        "doc_id", "item", "item_id", "size", "k", "words",
        F.expr(f"""array_distinct(transform(flatten(transform(starts, (s, i) -> sequence(
            if(i > 0 and s - starts[i - 1] <= 2 * size, s, s - {back}),
            if(i + 1 < size(starts) and starts[i + 1] - s <= 2 * size, starts[i + 1] - 1, s)))),
            s -> greatest(0, least(s, size(words) - size))))""").alias("at"),
    )
    windows = placed.select(
        "doc_id", "item", "item_id", "k", F.explode("at").alias("start"), "words", "size"
    ).select(
        "doc_id", "item", "item_id", "k", "start",
        F.expr("slice(words, start + 1, size)").alias("window"),
    ).filter("size(window) >= k")
    windows = materialize(windows.withColumn("shingles", _shingles("window", "k")).drop("window"), "windows")
    own = items.select("item", F.col("shingles").alias("theirs"), F.col("fp").alias("other"))
    most = F.expr("size(filter(shingles, y -> array_contains(theirs, y)))")  # repeats beyond theirs count too
    checked = (
        windows.join(broadcast_if_small(own, 20_000), "item")
        .filter(most >= SIMILARITY * (F.size("theirs") + F.size("shingles") - most) - 1e-9)
        .withColumn("shared", F.expr("""aggregate(array_distinct(theirs), 0, (n, x) -> n + least(
            size(filter(theirs, y -> y = x)), size(filter(shingles, y -> y = x))))"""))
        .withColumn(
            "similarity",
            F.col("shared") / (F.size("theirs") + F.size("shingles") - F.col("shared")),
        )
        .filter(F.col("similarity") >= SIMILARITY)
        .withColumn("fp", _fingerprint("shingles"))
        .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))))
    )
    best = checked.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("rank"), (-F.col("distance")).alias("off"))).alias("b")
    )
    return best.select(
        "doc_id",
        "item_id",
        (-F.col("b.rank")).alias("window_start"),
        F.col("b.similarity").alias("similarity"),
        (-F.col("b.off")).alias("distance"),
    )


def _within_radius(fps: DataFrame, items: DataFrame) -> DataFrame:
    """(fp, item, distance) of all pairs at RADIUS or fewer bits.

    A search by fingerprint alone; ``contaminated`` does without it.
    """
    index = items.select(
        "item", F.col("fp").alias("other"),
        F.explode(F.array(*(
            F.struct(F.lit(i).alias("block"), F.expr(_neighbours(*b)).alias("values"))
            for i, b in enumerate(BLOCKS)
        ))).alias("e"),
    ).select("item", "other", "e.block", F.explode("e.values").alias("value"))
    probes = fps.select(
        "fp",
        F.explode(F.array(*(
            F.struct(F.lit(i).alias("block"), F.expr(_block("fp", *b)).alias("value"))
            for i, b in enumerate(BLOCKS)
        ))).alias("e"),
    ).select("fp", "e.block", "e.value")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    return (
        probes.join(index, ["block", "value"])
        .filter(distance <= RADIUS)
        .select("fp", "item", distance.alias("distance"))
        .distinct()
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without documents that hold a benchmark passage, all columns kept.

    Rows without doc_id stay, since no match can name them.
    """
    key = fresh(docs, "_leak")
    leaks = contaminated(docs, benchmark).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks[key], "left_anti")
