"""Language of web pages by Bayesian fusion of evidence.

Text likelihoods (character trigrams) are combined with the language that the
markup declares, with the address, and with a prior for the host. Priors are
smoothed down a hierarchy, from all pages to suffix, domain and host, over
counts made by grouped aggregation.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from proofweave.llm.common import attach, whole
from proofweave.llm.link_trust import with_address
from proofweave.operators.sizing import materialize

#: Documents a fit uses at most, chosen by a hash of doc_id; hashed trigrams.
MAX_ROWS, BUCKETS = 20_000, 4096
#: Trigrams of a page count as this many independent ones at most.
INDEPENDENT = 60
#: How often markup, path and suffix tell the truth.
DECLARED, IN_PATH, BY_SUFFIX = 0.85, 0.75, 0.7
#: Pages that the level above counts as in each step of the hierarchy.
STRENGTH = 5.0
# National suffixes with one prevailing language.
SUFFIXES = {
    "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es",
    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "uk": "en", "us": "en", "au": "en",
    "ie": "en", "nz": "en", "ru": "ru", "jp": "ja", "cn": "zh", "se": "sv", "dk": "da", "fi": "fi",
}
_HIDDEN = re.compile(r"<(?:(script|style)\b|!--)", re.I)
_END = {"script": re.compile("</script[^<>]*>?", re.I), "style": re.compile("</style[^<>]*>?", re.I), "": re.compile("-->")}
_TAG = re.compile(r"<[^<>]*>")
_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def visible(html: str) -> str:
    """Text outside scripts, styles, comments and tags; open ones last to the end."""
    parts, at = [], 0
    while found := _HIDDEN.search(html, at):
        parts.append(html[at : found.start()])
        end = _END[(found.group(1) or "").lower()].search(html, found.end())
        at = end.end() if end else len(html)
    parts.append(html[at:])
    return _TAG.sub(" ", " ".join(parts))


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed trigrams that have a letter in the middle."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    codes = np.where((codes >= 0x10000) | _LETTER[np.minimum(codes, 0xFFFF)], codes, 32)
    codes = np.concatenate(([32], codes, [32]))
    mixed = (codes[:-2] * 40503 + codes[1:-1] * 9973 + codes[2:] * 31) % BUCKETS
    return np.bincount(mixed[codes[1:-1] != 32], minlength=BUCKETS)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities [language, trigram].

    ``docs`` has doc_id, text, lang; rows without lang are not used. The driver
    gets BUCKETS counts a language.
    """
    known = docs.filter("lang is not null").select("doc_id", "lang")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    rows = docs.select("doc_id", "lang", whole("text").alias("_text")).join(F.broadcast(picked), ["doc_id", "lang"])

    def count(batches):
        held = {}
        for frame in batches:
            for lang, text in zip(frame["lang"], frame["_text"]):
                held[lang] = held.get(lang, 0) + trigrams(text)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "at": at, "n": n[at]})

    counts = rows.select("lang", "_text").mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found = counts.collect()
    langs = sorted({r["lang"] for r in found})
    table = np.full((len(langs), BUCKETS), 0.5)
    index = {lang: i for i, lang in enumerate(langs)}
    for r in found:
        table[index[r["lang"]], r["at"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _says(value: Column, lang: str, langs: list[str], truth: float) -> Column:
    """Log-likelihood of a statement if ``lang`` is right; 0 if it says nothing."""
    other = (1 - truth) / max(len(langs) - 1, 1)
    return F.when(~F.coalesce(value.isin(langs), F.lit(False)), 0.0).when(value == lang, float(np.log(truth))).otherwise(float(np.log(other)))


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared), a row per row of ``pages``.

    ``docs`` (doc_id, text, lang) teaches the text model; without any, lang is
    null. Null urls have an empty host, which is a host like any other; null
    html has no text and no declared language. Declared languages count by
    their first part (en-GB is en); unknown ones say nothing. Ties go to the
    first language in the alphabet. Rows that repeat a page_id are judged each.
    No rows give no rows. Other columns are not read.
    """
    langs, table = fit(docs)
    if not langs:
        return pages.select("page_id", *(F.lit(None).cast(t).alias(n) for n, t in (
            ("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"))))

    @F.pandas_udf("array<double>")
    def likelihood(html: pd.Series) -> pd.Series:
        out = []
        for value in html:
            counts = trigrams(visible(value))
            n = counts.sum()
            out.append((table @ counts) * min(1.0, INDEPENDENT / max(n, 1)))
        return pd.Series(out, dtype=object)

    declared = F.lower(F.regexp_extract(whole("html"), r"(?is)<html\b[^<>]{0,999}?\blang\s{0,9}=\s{0,9}[\"']?([a-z]{2,3})", 1))
    read = with_address(pages.select("page_id", "url", "html")).select(
        "page_id", "host",
        F.regexp_extract("path", "^/([a-z]{2})(?:/|$)", 1).alias("in_path"),
        declared.alias("declared"), likelihood(whole("html")).alias("text"),
    )
    read = materialize(read.withColumns({
        "suffix": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
    }), "evidence")
    by_suffix = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))[F.col("suffix")]
    own = [
        F.col("text")[i] + _says(F.col("declared"), lang, langs, DECLARED)
        + _says(F.col("in_path"), lang, langs, IN_PATH) + _says(by_suffix, lang, langs, BY_SUFFIX)
        for i, lang in enumerate(langs)
    ]
    judged = read.select("page_id", "host", "domain", "suffix", "declared", F.col("text"), F.array(*own).alias("own"))
    best = F.array_position("own", F.array_max("own")).cast("int") - 1
    priors = host_priors(judged.select("host", "domain", "suffix", best.alias("lang")), len(langs))
    rows = judged.select("page_id", "host", "declared", "text", "own")
    fused = attach(rows, priors, "host", "n").withColumn(
        "post", F.expr("zip_with(own, prior, (a, b) -> a + ln(b))")
    )
    names = F.array(*(F.lit(lang) for lang in langs))
    top = F.array_max("post")
    return fused.select(
        "page_id",
        F.element_at(names, F.array_position("post", top).cast("int")).alias("lang"),
        F.expr("1 / aggregate(post, 0D, (a, x) -> a + exp(x - array_max(post)))").alias("probability"),
        F.element_at(names, F.array_position("text", F.array_max("text")).cast("int")).alias("text_lang"),
        F.nullif(F.col("declared"), F.lit("")).alias("declared"),
    )


def host_priors(judged: DataFrame, size: int, strength: float = STRENGTH) -> DataFrame:
    """(host, n, prior): smoothed shares of ``size`` languages for each host.

    ``judged`` has host, domain, suffix and the index of the language that a
    page's own evidence favours.
    """
    ones = [F.sum((F.col("lang") == i).cast("double")) for i in range(size)]
    hosts = materialize(
        judged.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.array(*ones).alias("c")), "counts"
    )

    def level(*keys: str) -> DataFrame:
        sums = [F.sum(F.col("c")[i]) for i in range(size)]
        return hosts.groupBy(*keys).agg(F.array(*sums).alias("c"))

    def smoothed(frame: DataFrame, above: str, name: str) -> DataFrame:
        mix = f"zip_with(c, {above}, (x, p) -> (x + {strength} * p) / (aggregate(c, 0D, (a, y) -> a + y) + {strength}))"
        return frame.withColumn(name, F.expr(mix)).drop("c", above)

    everywhere = [c or 0.0 for c in level().first()["c"]]
    even = sum(everywhere) + size
    base = F.array(*(F.lit((c + 1) / even) for c in everywhere))
    suffixes = smoothed(level("suffix").withColumn("base", base), "base", "p1")
    domains = smoothed(level("suffix", "domain").join(suffixes, "suffix"), "p1", "p2")
    found = smoothed(hosts.join(domains, ["suffix", "domain"]), "p2", "prior")
    return materialize(found.select("host", "n", "prior"), "priors")
