"""All-term lexical matching ranked by cover density.

A question matches a chunk only when every one of its terms occurs in the
chunk's content or title. Joining on every term would produce rows in
proportion to the most frequent words, so each question is joined on its
rarest term only; the remaining terms are then checked inside the row. The
result is exact, and a frequent word costs nothing unless a question holds
nothing rarer.

``lexical_matches`` has a row for every match, whose number grows with questions
times chunks. ``lexical_top`` has none: blocks of questions meet the chunks as a
stream and keep their best ones (see ``lexical_lists``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from proofweave import constants as K
from proofweave.functions import stems, text as tx
from proofweave.operators.lexical_lists import block_lists
from proofweave.operators.scope import may_see
from proofweave.operators.sizing import broadcast_if_small, in_slices, materialize

SCORE_DECIMALS = 8
# Words with another stem up to which they are broadcast: some 40 bytes each.
VOCABULARY_ROWS = 1_000_000
# Asked (tenant, term) keys up to which they are broadcast: 8 bytes each.
ASKED_TERMS = 4_000_000
# A group holds its asks and their lists, and the attempts that ask the same.
ASKS_PER_BLOCK = 16_384
ATTEMPTS_PER_BLOCK = 1_000_000
MAX_BROADCAST_TENANTS = 200_000
# A question may be tried in several forms (whole text, focused terms).
ATTEMPT = ("question_id", "form")
FULL, FOCUSED = "full", "focused"


def _is_kept(term: Column) -> Column:
    return ~term.isin(*K.ENGLISH_STOP_WORDS)


def query_terms(text: Column) -> Column:
    """Distinct search terms of a question text."""
    return F.filter(F.array_distinct(tx.search_words(text)), _is_kept)


def _positioned(text: Column, offset: Column) -> Column:
    numbered = F.transform(
        tx.search_words(text),
        lambda token, at: F.struct((offset + at + 1).alias("pos"), token.alias("term")),
    )
    return F.filter(numbered, lambda item: _is_kept(item["term"]))


def lexemes(content: Column, title: Column) -> Column:
    """Search terms with positions; title positions follow the content's."""
    def joined(body: Column) -> Column:
        last = F.coalesce(F.try_element_at(body, F.lit(-1))["pos"], F.lit(0))
        return tx.let(last, lambda shift: F.concat(body, _positioned(title, shift)))

    return tx.let(_positioned(content, F.lit(0)), joined)


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Search index rows: one per chunk with its terms, positions and access.

    ``terms`` repeats the distinct terms without positions, so that building
    postings reads that column alone.
    """
    placed = chunks.select(
        "chunk_id",
        "enterprise_id",
        "principals",
        lexemes(F.col("content"), F.col("title")).alias("lexemes"),
    )
    distinct = F.array_distinct(F.transform("lexemes", lambda item: item["term"]))
    return placed.withColumn("terms", distinct)


def _with_forms(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``forms``: a map from those of their terms that have another stem.

    Stems are made once per distinct word and joined to the distinct terms of a
    row; positions take no part in that join.
    """
    held = rows.select(*key, F.explode("terms").alias("term"))
    words = materialize(stems.stemmed(held.select("term").distinct()).filter("stem <> term"), "stems")
    words = broadcast_if_small(words, VOCABULARY_ROWS)
    entries = F.collect_list(F.struct("term", "stem"))
    forms = held.join(words, "term").groupBy(*key).agg(F.map_from_entries(entries).alias("forms"))
    return rows.join(forms, list(key), "left")


def _stem_of(term: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("forms"), term), term)


def stem_index(index: DataFrame) -> DataFrame:
    """Index rows with English stems as terms, at the positions of their words."""
    placed = F.transform(
        "lexemes", lambda item: F.struct(item["pos"].alias("pos"), _stem_of(item["term"]).alias("term"))
    )
    return _with_forms(index, ("chunk_id",)).select(
        "chunk_id",
        "enterprise_id",
        "principals",
        placed.alias("lexemes"),
        F.array_distinct(F.transform("terms", _stem_of)).alias("terms"),
    )


def postings(index: DataFrame) -> DataFrame:
    """Distinct (tenant, term, chunk) rows, with who may see the chunk."""
    return index.select(
        "enterprise_id", "chunk_id", "principals", F.explode("terms").alias("term")
    )


def _wanted(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``held`` whose tenant and term may be in ``asked``.

    Most terms of a corpus are asked for by nobody; their rows end here instead
    of in a shuffle. Keys are hashes, so a join on tenant and term must follow.
    """
    key = F.xxhash64("enterprise_id", "term").alias("key")
    keys = asked.select(key).distinct()
    if keys.limit(ASKED_TERMS + 1).count() > ASKED_TERMS:
        return held
    return held.withColumn("key", key).join(F.broadcast(keys), "key", "left_semi").drop("key")


def term_counts(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Chunks per tenant and asked term. Counted before the shuffle, so that a
    frequent term costs its task one row per input partition."""
    held = index.select("enterprise_id", F.explode("terms").alias("term"))
    return (
        _wanted(held, asked)
        .groupBy("enterprise_id", "term")
        .agg(F.count(F.lit(1)).alias("chunk_count"))
    )


def covers(occurrences: Column, terms: Column) -> Column:
    """Score: sum over minimal covers of 1 / (1 + foreign positions inside).

    For each occurrence taken as a right end, the widest start that still
    encloses every term is the minimum over terms of the last position at or
    before it. Each distinct start gives one minimal cover, closed by the first
    right end that reaches it.
    """
    spots_by_term = F.transform(
        terms,
        lambda term: F.transform(
            F.filter(occurrences, lambda item: item["term"] == term), lambda item: item["pos"]
        ),
    )

    def widest_start(by_term: Column, end: Column) -> Column:
        return F.array_min(
            F.transform(
                by_term,
                lambda spots: F.coalesce(
                    F.array_max(F.filter(spots, lambda spot: spot <= end)), F.lit(-1)
                ),
            )
        )

    def spans(by_term: Column) -> Column:
        reached = F.transform(
            occurrences,
            lambda item: F.struct(
                widest_start(by_term, item["pos"]).alias("start"), item["pos"].alias("end")
            ),
        )
        return F.filter(reached, lambda span: span["start"] > 0)

    def minimal(ends: Column) -> Column:
        return F.filter(
            ends, lambda span, at: (at == 0) | (span["start"] > F.get(ends, at - 1)["start"])
        )

    def weight(span: Column) -> Column:
        inside = F.filter(
            occurrences, lambda item: item["pos"].between(span["start"], span["end"])
        )
        return F.lit(1.0) / (F.lit(2) + span["end"] - span["start"] - F.size(inside))

    ends = tx.let(spots_by_term, spans)
    return F.aggregate(tx.let(ends, minimal), F.lit(0.0), lambda acc, span: acc + weight(span))


def _term_density(occurrences: Column, terms: Column) -> Column:
    """Cover density, with the two common cases solved without a search.

    One term: every occurrence is a cover of its own. Each term once: the only
    cover runs from the first occurrence to the last.
    """
    found = F.size(occurrences)
    spread = F.element_at(occurrences, -1)["pos"] - F.element_at(occurrences, 1)["pos"]
    return (
        F.when(F.size(terms) == 1, found.cast("double"))
        .when(found == F.size(terms), F.lit(1.0) / (F.lit(2) + spread - found))
        .otherwise(covers(occurrences, terms))
    )


def _anchored(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Questions with their rarest term.

    A question holding a term that no chunk of the tenant holds cannot match
    and drops out here.
    """
    wanted = questions.select("enterprise_id", *ATTEMPT, F.explode("terms").alias("term"))
    rarest = (
        wanted.join(term_counts(index, wanted), ["enterprise_id", "term"], "left")
        .groupBy(*ATTEMPT)
        .agg(
            F.min(F.struct("chunk_count", "term")).alias("anchor"),
            F.count_if(F.col("chunk_count").isNull()).alias("unknown_terms"),
        )
        .filter(F.col("unknown_terms") == 0)
    )
    return questions.join(
        rarest.select(*ATTEMPT, F.col("anchor.term").alias("term")), list(ATTEMPT)
    )


def _written_out(lexemes: Column) -> tuple[Column, Column]:
    """Lexemes as one text of terms and an array of positions: a quarter of the bytes in a shuffle."""
    terms = F.array_join(F.transform(lexemes, lambda item: item["term"]), " ")
    return terms.alias("written"), F.transform(lexemes, lambda item: item["pos"]).alias("places")


def _occurrences(written: Column, places: Column, terms: Column) -> Column:
    """Lexemes whose term is among ``terms``, from their written form."""
    lexemes = F.transform(
        F.split(written, " "), lambda term, at: F.struct(F.get(places, at).alias("pos"), term.alias("term"))
    )
    return F.filter(lexemes, lambda item: F.array_contains(terms, item["term"]))


def _asked(questions: DataFrame, index: DataFrame, stem: bool) -> DataFrame:
    """Attempts that can match: their principals, terms and rarest term."""
    asked = questions.select(
        *ATTEMPT, "enterprise_id", "principals", query_terms(F.col("query_text")).alias("terms")
    ).filter(F.size("terms") > 0)
    if stem:
        asked = _with_forms(asked, ATTEMPT).withColumn(
            "terms", F.array_distinct(F.transform("terms", _stem_of))
        ).drop("forms")
    asked = materialize(asked, "asked")
    return materialize(_anchored(asked, index), "anchored")


def lexical_matches(questions: DataFrame, index: DataFrame, stem: bool = False) -> DataFrame:
    """Every authorised (attempt, chunk) pair that matches all terms, scored.

    ``questions`` needs question_id, form, enterprise_id, principals, query_text.
    With ``stem`` the index comes from ``stem_index``, and questions match it by
    the stems of their terms.
    """
    anchored = _asked(questions, index, stem).withColumnRenamed("principals", "asked_principals")

    # One tenant's frequent term can hold a large share of the postings. The
    # join is a plain equi join followed by another shuffle, so adaptive skew
    # handling splits such a partition at run time. Access is decided on the
    # posting: rows that may not be seen never meet content or positions.
    candidates = (
        anchored.join(_wanted(postings(index), anchored), ["enterprise_id", "term"])
        .filter(may_see(F.col("asked_principals"), F.col("principals")))
        .select(*ATTEMPT, "chunk_id", "terms")
    )
    indexed = index.select("chunk_id", *_written_out(F.col("lexemes")))
    found = (
        candidates.join(indexed, "chunk_id")
        .filter(F.size(F.array_except("terms", F.split("written", " "))) == 0)
        .select(
            *ATTEMPT,
            "chunk_id",
            "terms",
            _occurrences(F.col("written"), F.col("places"), F.col("terms")).alias("occurrences"),
        )
    )
    return found.select(
        *ATTEMPT,
        "chunk_id",
        F.round(_term_density(F.col("occurrences"), F.col("terms")), SCORE_DECIMALS).alias("score"),
    )


def top_ranked(
    scored: DataFrame, limit: int, rank_name: str, key: tuple[str, ...] = ATTEMPT
) -> DataFrame:
    """Best ``limit`` rows per key, ties broken by chunk id."""
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn(rank_name, F.row_number().over(order)).filter(
        F.col(rank_name) <= limit
    )


def _repeats(rows: DataFrame, *key: str) -> bool:
    return not rows.groupBy(*key).count().filter("count > 1").isEmpty()


def lexical_top(
    questions: DataFrame, index: DataFrame, limit: int = K.CANDIDATE_LIMIT, stem: bool = False
) -> DataFrame:
    """question_id, form, chunk_id, score, lex_rank.

    No match is shuffled: an attempt's list is whole in its group. The chunks of
    a tenant move once for each block of its distinct asks. Keys that repeat
    give one list of all their matches, which only ``lexical_matches`` has.
    """
    if _repeats(questions, *ATTEMPT) or _repeats(index, "chunk_id"):
        return top_ranked(lexical_matches(questions, index, stem), limit, "lex_rank")
    written = F.array_join(F.concat(F.array("term"), F.array_remove("terms", F.col("term"))), " ")
    asked = _asked(questions, index, stem).select(
        "enterprise_id", F.col("question_id").alias("row_id"), "form", "principals", written.alias("written")
    )
    ask = F.xxhash64("written", F.array_sort("principals"))
    counted = asked.groupBy("enterprise_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_distinct(ask).alias("asks")
    )
    blocks = broadcast_if_small(
        materialize(
            counted.select(
                "enterprise_id",
                F.ceil(F.col("asks") / ASKS_PER_BLOCK).alias("ask_blocks"),
                F.ceil(F.col("attempts") / ATTEMPTS_PER_BLOCK).alias("parts"),
            ).withColumn("blocks", F.col("ask_blocks") * F.col("parts")),
            "blocks",
        ),
        MAX_BROADCAST_TENANTS,
    )
    block = F.pmod(ask, F.col("ask_blocks")) + F.col("ask_blocks") * F.pmod(F.xxhash64("row_id"), F.col("parts"))
    columns = ("row_id", "form", "principals", "written", "places")
    keys = ["enterprise_id", "block"]
    asked = asked.withColumn("places", F.lit(None).cast("array<int>")).join(blocks, "enterprise_id")
    indexed = index.filter("chunk_id is not null and lexemes is not null").join(blocks, "enterprise_id")

    def rows_of(numbers: Column) -> tuple[DataFrame, DataFrame]:
        asking = asked.select("enterprise_id", block.alias("block"), F.lit(False).alias("is_chunk"), *columns, "blocks")
        # Written out once, by the tenants that take part, and copied after that.
        written = indexed.filter(numbers.isNotNull()).select(
            "enterprise_id",
            numbers.alias("numbers"),
            F.col("chunk_id").alias("row_id"),
            F.lit(None).cast("string").alias("form"),
            "principals",
            *_written_out(F.col("lexemes")),
        )
        owned = written.select("enterprise_id", F.explode("numbers").alias("block"), F.lit(True).alias("is_chunk"), *columns)
        return asking.filter(F.array_contains(numbers, F.col("block"))).drop("blocks"), owned

    def run(asking: DataFrame, owned: DataFrame) -> DataFrame:
        return (
            asking.unionByName(owned)
            .repartition(*keys)
            .sortWithinPartitions(*keys, "is_chunk", "row_id")
            .groupBy(*keys)
            .applyInArrow(
                block_lists(limit, SCORE_DECIMALS),
                "question_id string, form string, chunk_id string, score double, lex_rank int",
            )
        )

    return in_slices(blocks, index, rows_of, run, "lexical-slice")
