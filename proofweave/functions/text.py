"""Text normalisation, tokens, numbers and timestamps as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from proofweave import constants as K

# The Unicode characters that end a line, those trimmed from line
# ends, and all of them together.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
INLINE_SPACE = r"\t \x1F\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
ANY_SPACE = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029" + INLINE_SPACE
RARE_SPACE = r"[\r\x0B\x0C\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Without it an expression mentioned inside a lambda is evaluated again for
    every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every Unicode whitespace character from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    """True for null or whitespace-only text."""
    return text.isNull() | (strip(text) == "")


def normalize_content(text: Column) -> Column:
    """Normalise whitespace but keep paragraph breaks; blank text becomes ''.

    Text without rare whitespace, nearly all of it, needs only literal replaces;
    both branches give the same result on such text.
    """
    squeezed = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    plain = F.replace(
        F.replace(squeezed, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")
    )
    lines = F.regexp_replace(text, LINE_BREAK, "\n")
    collapsed = F.regexp_replace(lines, r"[ \t]+", " ")
    full = F.regexp_replace(collapsed, rf"[{INLINE_SPACE}]*\n[{INLINE_SPACE}]*", "\n")
    trimmed = F.when(text.rlike(RARE_SPACE), full).otherwise(plain)
    return F.regexp_replace(strip(trimmed), r"\n{3,}", "\n\n")


def split_words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(text, rf"[{ANY_SPACE}]+"), lambda word: word != "")


def tokenize(text: Column) -> Column:
    """Lower-case alphanumeric ASCII runs, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(K.TOKEN_PATTERN), F.lit(0))


def search_words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(K.WORD_PATTERN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def extract_numbers(text: Column) -> Column:
    """Signed decimal literals as strings, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(K.NUMBER_PATTERN), F.lit(0))


def focused_query(text: Column) -> Column:
    """The first long, non-noise tokens; null when that adds nothing."""
    kept = F.filter(
        tokenize(text),
        lambda token: ~token.isin(*K.NOISE_WORDS) & (F.length(token) >= K.MIN_FOCUS_LENGTH),
    )
    focused = F.array_join(F.slice(kept, 1, K.FOCUS_TERMS), " ")
    return F.when((F.size(kept) > 0) & (focused != F.lower(text)), focused)


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


def iso_timestamp(text: Column) -> Column:
    """Parse ISO-8601 text ('Z' allowed) to an instant; null when malformed."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text))


def iso_format(instant: Column) -> Column:
    """UTC ISO-8601 with '+00:00'; microseconds only when they are not zero."""
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(instant, ".SSSSSS")
    return F.concat(whole, F.when(micros == ".000000", "").otherwise(micros), F.lit("+00:00"))
