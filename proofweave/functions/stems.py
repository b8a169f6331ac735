"""English word forms: the published Porter2 algorithm over a vocabulary.

Meant for the distinct words, so that its cost follows the vocabulary and not
the text. R1 and R2 are kept as the lengths before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave import constants as K
from proofweave.functions import text as tx


def _cut(word: Column, count: int) -> Column:
    return F.left(word, F.length(word) - count)


def _region(word: Column) -> Column:
    """Length up to the first consonant after a vowel; the whole length without one."""
    head = F.regexp_extract(word, K.STEM_REGION, 0)
    return F.when(head == "", F.length(word)).otherwise(F.length(head))


def _by_rules(word: Column, rules: tuple, r1: Column, r2: Column) -> Column:
    """The longest suffix decides; where its condition fails the word stays."""
    out = word
    for suffix, new, region, before in sorted(rules, key=lambda rule: len(rule[0])):
        allowed = F.length(word) - len(suffix) >= (r1 if region == 1 else r2)
        if before:
            allowed &= word.rlike(f"[{before}]{suffix}$")
        changed = F.concat(_cut(word, len(suffix)), F.lit(new))
        out = F.when(word.endswith(suffix), F.when(allowed, changed).otherwise(word)).otherwise(out)
    return out


def _plurals(word: Column) -> Column:
    """Step 1a."""
    return (
        F.when(word.endswith("sses"), _cut(word, 2))
        .when(word.rlike("ie[ds]$"), F.when(F.length(word) > 4, _cut(word, 2)).otherwise(_cut(word, 1)))
        .when(word.rlike("[us]s$"), word)
        .when(word.rlike(f"{K.STEM_VOWEL}.+s$"), _cut(word, 1))
        .otherwise(word)
    )


def _verb_stem(word: Column) -> Column:
    """What stands before -ed, -edly, -ing, -ingly; null if that has no vowel."""
    before = F.regexp_extract(word, K.STEM_VERB, 1)
    return F.when(before.rlike(K.STEM_VOWEL) & ~word.rlike("eed(ly)?$"), before)


def _verbs(word: Column, before: Column, r1: Column) -> Column:
    """Step 1b."""
    agreed = F.regexp_extract(word, "eed(ly)?$", 0)
    repaired = (
        F.when(before.rlike("(at|bl|iz)$"), F.concat(before, F.lit("e")))
        .when(before.rlike(K.STEM_DOUBLE), _cut(before, 1))
        .when((F.length(before) == r1) & before.rlike(K.STEM_SHORT), F.concat(before, F.lit("e")))
        .otherwise(before)
    )
    shortened = F.concat(F.left(word, F.length(word) - F.length(agreed)), F.lit("ee"))
    return (
        F.when((agreed != "") & (F.length(word) - F.length(agreed) >= r1), shortened)
        .when(before.isNotNull(), repaired)
        .otherwise(word)
    )


def _last(word: Column, r1: Column, r2: Column) -> Column:
    """Step 5, and consonant y as a plain letter again."""
    rest = F.length(word) - 1
    loose = word.endswith("e") & ((rest >= r2) | ((rest >= r1) & ~_cut(word, 1).rlike(K.STEM_SHORT)))
    double = word.endswith("ll") & (rest >= r2)
    return F.replace(F.when(loose | double, _cut(word, 1)).otherwise(word), F.lit("Y"), F.lit("y"))


def _after_plurals(word: Column, r1: Column, r2: Column) -> Column:
    """Steps 1b to 5."""
    stem = tx.let(_verb_stem(word), lambda before: _verbs(word, before, r1))
    stem = tx.let(stem, lambda w: F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i"))
    stem = tx.let(stem, lambda w: _by_rules(w, K.STEM_STEP_2, r1, r2))
    stem = tx.let(stem, lambda w: _by_rules(w, K.STEM_STEP_3, r1, r2))
    stem = tx.let(stem, lambda w: _by_rules(w, K.STEM_STEP_4, r1, r2))
    return tx.let(stem, lambda w: _last(w, r1, r2))


def _in_regions(word: Column) -> Column:
    """All steps, given consonant y in capitals."""
    def placed(r1: Column) -> Column:
        second = r1 + _region(F.substr(word, r1 + 1))
        return tx.let(second, lambda r2: tx.let(_plurals(word), lambda w: finished(w, r1, r2)))

    def finished(singular: Column, r1: Column, r2: Column) -> Column:
        complete = singular.isin(*K.STEM_COMPLETE)
        return F.when(complete, singular).otherwise(_after_plurals(singular, r1, r2))

    prefix = F.nullif(F.length(F.regexp_extract(word, K.STEM_PREFIX, 0)), F.lit(0))
    return tx.let(F.coalesce(prefix, _region(word)), placed)


def stemmed(words: DataFrame) -> DataFrame:
    """``words`` (term, distinct) with stem.

    Only lower-case words of a-z with three letters or more have another stem
    than themselves; nulls stay null. Steps pass their result on as variables,
    which the optimiser never copies into later steps or pushed filters.
    """
    term = F.col("term")
    known = F.create_map(*[F.lit(part) for pair in K.STEM_EXCEPTIONS for part in pair])
    marked = F.regexp_replace(term, "(^|[aeiouy])y", "$1Y")
    ruled = F.coalesce(F.try_element_at(known, term), tx.let(marked, _in_regions))
    return words.withColumn("stem", F.when(term.rlike("^[a-z]{3,}$"), ruled).otherwise(term))
