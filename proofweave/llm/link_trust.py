"""Allow and block verdicts for addresses, in DataFrame operations only.

Rules decide where they fit. Elsewhere trust flows from allowed hosts along
links (personalised PageRank) and distrust flows from blocked hosts against
them; a host is blocked where distrust exceeds trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofweave.llm.common import ascii_lower, attach, whole
from proofweave.operators.sizing import materialize

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Ranks settle when a round reaches no new host and changes trust and distrust,
#: which sum to at most 1 each, by no more than this.
TOLERANCE, MOST_ROUNDS = 1e-12, 10_000
DAMPING = 0.85
#: Distrust must exceed trust by this factor, so sums in another order agree.
MARGIN = 1 + 1e-9
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Host of a link, also of one that leaves the scheme to the page (//host/).
_LINK = r"""(?i)href[ \t\n\x0b\f\r]*=[ \t\n\x0b\f\r]*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"' \t\n\x0b\f\r<>]+)"""
#: The same for a matcher that backtracks: possessive, so linear.
_POSSESSIVE = _LINK.replace("]*=", "]*+=").replace("]*[", "]*+[").replace("]*:", "]*+:")


def with_address(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path; both empty without ``://``."""
    url = whole("url")
    return pages.withColumns({
        "host": ascii_lower(F.regexp_extract(url, _PARTS, 1)),
        "path": F.regexp_extract(url, _PARTS, 2),
    })


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, out_share, in_share): links between hosts, pre-aggregated.

    Null html has no links; pages without host and links of a host to itself
    are left out; a link that a page repeats counts as often.
    """
    edges = (
        pages.filter("host <> ''")
        .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(whole("html"), F.lit(_POSSESSIVE), F.lit(1))).alias("dst"))
        .select("src", ascii_lower(F.col("dst")).alias("dst"))
        .filter("src <> dst")
        .groupBy("src", "dst").agg(F.count("*").alias("w"))
    )
    edges = materialize(edges, "links")
    out = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    return materialize(
        edges.join(out, "src").join(into, "dst").select(
            "src", "dst", (F.col("w") / F.col("out_w")).alias("out_share"), (F.col("w") / F.col("in_w")).alias("in_share")
        ),
        "shares",
    )


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after ``rounds`` rounds; each is a written table.

    None goes on until the ranks settle: a round that reaches no new host and
    changes at most TOLERANCE in all. Raises after MOST_ROUNDS. A host without
    out-links passes on nothing.

    ``seeds`` has host, trust, distrust; both are scaled to a sum of 1.
    """
    totals = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    t, d = float(totals["t"] or 0) or 1.0, float(totals["d"] or 0) or 1.0
    start = materialize(
        seeds.select("host", (F.col("trust") / t).alias("trust"), (F.col("distrust") / d).alias("distrust")), "seeds"
    )
    now, zero = start, F.lit(0.0)
    reached = None
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        forth = edges.join(now, edges["src"] == now["host"]).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("out_share") * damping).alias("trust"), zero.alias("distrust")
        )
        back = edges.join(now, edges["dst"] == now["host"]).select(
            F.col("src").alias("host"), zero.alias("trust"), (F.col("distrust") * F.col("in_share") * damping).alias("distrust")
        )
        base = start.select(
            "host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust")
        )
        old = now.select("host", F.col("trust").alias("was"), F.col("distrust").alias("was_not"))
        now = materialize(
            forth.unionByName(back).unionByName(base).unionByName(old, allowMissingColumns=True)
            .groupBy("host").agg(
                F.coalesce(F.sum("trust"), zero).alias("trust"), F.coalesce(F.sum("distrust"), zero).alias("distrust"),
                (F.abs(F.coalesce(F.sum("trust"), zero) - F.coalesce(F.sum("was"), zero))
                 + F.abs(F.coalesce(F.sum("distrust"), zero) - F.coalesce(F.sum("was_not"), zero))).alias("change"),
            ),
            "ranks",
        )
        if rounds is None:
            seen = now.agg(F.sum("change"), F.count_if(F.col("trust") > 0), F.count_if(F.col("distrust") > 0)).first()
            if tuple(seen)[1:] == reached and seen[0] <= TOLERANCE or not seen[1] + seen[2]:
                return now.drop("change")
            reached = tuple(seen)[1:]
    if rounds is None:
        raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")
    return now.drop("change")


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row per row of ``pages``.

    A null url, or one without ``://``, has an empty host and path: no rule fits
    and no link reaches it, so it is allowed. Null html has no links. Links of a
    host to itself carry nothing. Rows that repeat a page_id are judged each,
    and each counts as a seed. No rows give no rows. Other columns are not read.
    """
    parsed = with_address(pages.select("page_id", "url", "html"))
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "ruled": ruled})
    hosts = materialize(
        parsed.groupBy("host").agg(
            F.count("*").alias("n"),
            F.sum((F.col("ruled") == "allow").cast("double")).alias("trust"),
            F.sum((F.col("ruled") == "block").cast("double")).alias("distrust"),
        ).fillna(0.0, ["trust", "distrust"]),
        "hosts",
    )
    ranks = propagate(host_edges(parsed), hosts.filter("host <> ''").select("host", "trust", "distrust"), None)
    facts = hosts.select("host", "n").join(ranks, "host", "left").fillna(0.0, ["trust", "distrust"])
    judged = attach(parsed.select("page_id", "host", "path", "rule", "ruled"), materialize(facts, "judged"), "host", "n")
    method = F.when(F.col("distrust") > F.col("trust") * MARGIN, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust"
    )


def oracle_sql(rules=RULES, damping: float = DAMPING) -> str:
    """The verdicts over ``pages`` as one DuckDB statement, iterated until ranks settle."""
    fits = [
        (h + p, v, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))")
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    name = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for n, _, f in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for _, v, f in fits) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    href = _LINK.replace("'", "''")
    return f"""
        WITH RECURSIVE parsed AS (
            SELECT page_id, html, {lower.format(f"regexp_extract(coalesce(url, ''), '{_PARTS}', 1)")} AS host,
                   regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path
            FROM pages),
        ruled AS (SELECT *, {name} AS rule, {ruled} AS ruled FROM parsed),
        edges AS (
            SELECT src, dst, count(*) AS w FROM (
                SELECT host AS src, {lower.format(f"unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1))")} AS dst
                FROM parsed WHERE host <> '')
            WHERE src <> dst GROUP BY ALL),
        shares AS MATERIALIZED (
            SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS out_share,
                   w / sum(w) OVER (PARTITION BY dst) AS in_share
            FROM edges),
        seeds AS (
            SELECT host, count(*) FILTER (ruled = 'allow') AS t, count(*) FILTER (ruled = 'block') AS d
            FROM ruled WHERE host <> '' GROUP BY host),
        base AS MATERIALIZED (
            SELECT host, t / greatest((SELECT sum(t) FROM seeds), 1) AS trust,
                   d / greatest((SELECT sum(d) FROM seeds), 1) AS distrust
            FROM seeds),
        ranks AS (
            SELECT 0 AS step, host, trust, distrust, 1.0::DOUBLE AS moved FROM base
            UNION ALL
            SELECT step, host, trust, distrust, sum(moved) OVER () AS moved FROM (
                SELECT max(step) + 1 AS step, host, sum(t) AS trust, sum(d) AS distrust,
                       abs(sum(t) - sum(was_t)) + abs(sum(d) - sum(was_d))
                       + (sum(was_t) = 0 AND sum(t) > 0)::INT + (sum(was_d) = 0 AND sum(d) > 0)::INT AS moved
                FROM (
                    SELECT step, moved, dst AS host, trust * out_share * {damping} AS t, 0.0::DOUBLE AS d,
                           0.0::DOUBLE AS was_t, 0.0::DOUBLE AS was_d
                    FROM shares JOIN ranks ON src = host
                    UNION ALL
                    SELECT step, moved, src, 0, distrust * in_share * {damping}, 0, 0 FROM shares JOIN ranks ON dst = host
                    UNION ALL
                    SELECT step, moved, host, coalesce(b.trust, 0) * (1 - {damping}), coalesce(b.distrust, 0) * (1 - {damping}),
                           r.trust, r.distrust
                    FROM ranks r LEFT JOIN base b USING (host))
                WHERE moved > {TOLERANCE!r}
                GROUP BY host)),
        settled AS (SELECT * FROM ranks QUALIFY step = max(step) OVER ())
        SELECT page_id, host, path, rule,
               coalesce(ruled, CASE WHEN distrust > trust * {MARGIN!r} THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled LEFT JOIN settled USING (host)"""
