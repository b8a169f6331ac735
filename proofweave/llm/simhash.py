"""Near duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints are computed in vectorised batches. Distinct fingerprints are then
searched for all partners within a radius: correlated bits are grouped into
partitions; per fingerprint, dynamic programming over estimated candidate
counts gives each partition its own threshold, with a sum for which a partner
must agree in at least one partition; the partitions are probed by equality
joins and candidates verified on all bits. Buckets above a size are not paired:
their fingerprints are linked exactly through shared one-bit neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from proofweave.llm.common import attach, whole
from proofweave.llm.graph import components
from proofweave.operators.sizing import materialize

BITS = 64
_P1, _P2, _P3, _P4, _P5 = (
    # The five primes of the XXH64 definition: fixed values.
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)
_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_slices(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for every pair of offsets."""
    padded = np.frombuffer(data + b"\0" * 40, dtype=np.uint8)
    wide = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    half = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded.data, strides=(1,))
    at, size, seed = start.astype(np.int64), end - start, np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed + _P5, dtype=np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            acc = [np.full(len(long), seed + a, dtype=np.uint64) for a in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            p, stripes = at[long].copy(), size[long] // 32
            live = np.arange(len(long))
            while len(live):
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], wide[p[live] + 8 * i])
                p[live] += 32
                stripes[live] -= 1
                live = live[stripes[live] > 0]
            v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                v = (v ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[long], at[long] = v, p
        h += size.astype(np.uint64)
        rest = end - at
        for _ in range(3):
            live = np.flatnonzero(rest >= 8)
            lane = _round(np.zeros(len(live), dtype=np.uint64), wide[at[live]])
            h[live] = _rotl(h[live] ^ lane, 27) * _P1 + _P4
            at[live] += 8
            rest[live] -= 8
        live = np.flatnonzero(rest >= 4)
        h[live] = _rotl(h[live] ^ (half[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[live] += 4
        rest[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(rest > 0)
            h[live] = _rotl(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
            at[live] += 1
            rest[live] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def shingle_spans(texts: list[bytes], words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, owner, start, end, counts): shingle i of ``words`` words is
    data[start[i]:end[i]] and belongs to text owner[i], which has counts of them.
    """
    rows = [t.lower().split() for t in texts]
    data = b" ".join(b" ".join(r) for r in rows if r)
    counts = np.array([len(r) for r in rows], dtype=np.int64)
    ends = np.append(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    shingles = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(rows)), shingles)
    first_word = np.cumsum(counts) - counts
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    begin = first_word[owner] + nth
    finish = begin + np.minimum(counts[owner], words) - 1
    return data, owner, starts[begin], ends[finish], shingles


def fingerprints_of(texts: list[bytes], words: int = 3, block: int = 1 << 18) -> np.ndarray:
    """SimHash of each UTF-8 text, over shingles of ``words`` words.

    Texts are lower-cased in A-Z and split at ASCII white space, which is what
    ``bytes.split`` does. Shingles are hashed and counted ``block`` at a time,
    so memory does not grow with a text beyond its own bytes.
    """
    data, owner, start, end, shingles = shingle_spans(texts, words)
    ones = np.zeros((len(texts), BITS))
    for at in range(0, len(owner), block):
        part = slice(at, at + block)
        h = xxh64_slices(data, start[part], end[part])
        low = owner[part][0]
        local = owner[part] - low
        size = int(local[-1]) + 1
        octets = h.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            seen = np.bincount(local * 256 + octets[:, b], minlength=size * 256).reshape(size, 256)
            ones[low : low + size, 8 * b : 8 * b + 8] += seen @ _BIT_TABLE
    bits = (ones * 2 > shingles[:, None]).astype(np.uint64)
    return (bits << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def majority(hashes: np.ndarray) -> int:
    """SimHash of given 64-bit shingle hashes, as a signed long; none give 0."""
    seen = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        seen += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(seen * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash(text: pd.Series) -> pd.Series:
    """64-bit SimHash of UTF-8 bytes, as a signed long."""
    out, batch, size = [], [], 0
    for value in text:
        batch.append(bytes(value))
        size += len(batch[-1])
        if size > 2_000_000:
            out.append(fingerprints_of(batch))
            batch, size = [], 0
    out.append(fingerprints_of(batch))
    return pd.Series(np.concatenate(out))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of whole texts; null and empty texts have fingerprint 0."""
    return docs.select("doc_id", simhash(whole("text").cast("binary")).alias("fp"))


# --- search among distinct fingerprints -------------------------------------------------


def _unpacked(fps: np.ndarray) -> np.ndarray:
    return ((fps.view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BITS, BITS))
    for frame in batches:
        for at in range(0, len(frame), 65536):
            bits = _unpacked(frame["fp"].to_numpy()[at : at + 65536])
            total += bits.T @ bits
    yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel().astype(np.int64)})


def bit_groups(fps: DataFrame, total: int, parts: int) -> list[list[int]]:
    """``parts`` groups of bits; a group gathers bits that are correlated.

    The driver gets the 64 x 64 counts of bits set together, whatever the data.
    """
    cells = fps.mapInPandas(_pair_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS)
    for row in cells.collect():
        both[row["cell"]] = row["n"]
    both = both.reshape(BITS, BITS) / max(total, 1)
    p = np.diag(both)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    tie = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = list(range(BITS)), []
    for g in range(parts):
        size = len(free) // (parts - g)
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def _taken(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, gathered into a small integer."""
    u, out = fps.view(np.uint64), np.zeros(len(fps), dtype=np.int64)
    for i, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


class Estimator:
    """Expected number of fingerprints within a distance on a partition.

    A partition is cut into blocks of at most ``width`` bits with exact
    histograms (2^width entries each, whatever the data); distances of blocks
    are taken as independent.
    """

    def __init__(self, groups: list[list[int]], total: int, radius: int, width: int = 11):
        self.groups, self.total, self.radius = groups, total, radius
        self.blocks = [
            [g[i::-(-len(g) // width)] for i in range(-(-len(g) // width))] for g in groups
        ]
        self.share: dict[tuple[int, int], np.ndarray] = {}

    def fit(self, fps: DataFrame) -> Estimator:
        blocks = self.blocks

        def histogram(batches):
            held = {}
            for frame in batches:
                values = frame["fp"].to_numpy()
                for g, cut in enumerate(blocks):
                    for b, bits in enumerate(cut):
                        n = np.bincount(_taken(values, bits), minlength=1 << len(bits))
                        held[g, b] = held.get((g, b), 0) + n
            for (g, b), n in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"g": g, "b": b, "v": at, "n": n[at]})

        rows = fps.mapInPandas(histogram, "g int, b int, v int, n long").groupBy("g", "b", "v").agg(F.sum("n").alias("n"))
        counts = {(g, b): np.zeros(1 << len(bits)) for g, cut in enumerate(blocks) for b, bits in enumerate(cut)}
        for r in rows.collect():
            counts[r["g"], r["b"]][r["v"]] = r["n"]
        for key, n in counts.items():
            self.share[key] = self._by_distance(n / max(self.total, 1))
        return self

    def _by_distance(self, p: np.ndarray) -> np.ndarray:
        """Share of rows at each distance 0..radius from each block value."""
        poly = np.zeros((self.radius + 1, len(p)))
        poly[0] = p
        bit = 1
        while bit < len(p):
            flipped = poly[:, np.arange(len(p)) ^ bit]
            poly[1:] = poly[1:] + flipped[:-1]
            bit <<= 1
        return poly

    def candidates(self, fps: np.ndarray) -> np.ndarray:
        """Expected candidates [fingerprint, partition, threshold + 1]; -1 gives 0."""
        out = np.zeros((len(fps), len(self.groups), self.radius + 2))
        for g, cut in enumerate(self.blocks):
            at = None
            for b, bits in enumerate(cut):
                here = self.share[g, b][:, _taken(fps, bits)]
                if at is None:
                    at = here.copy()
                else:
                    at = np.stack([sum(at[j] * here[d - j] for j in range(d + 1)) for d in range(self.radius + 1)])
            out[:, g, 1:] = np.cumsum(at, axis=0).T * self.total
        return out

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """Least-cost thresholds >= -1 with sum radius - partitions + 1, by DP.

        The cost of a threshold is its expected candidates plus its probes.
        """
        cost = self.candidates(fps)
        for g, bits in enumerate(self.groups):
            probes, ring = 0, 1
            for t in range(self.radius + 1):
                probes += ring
                ring = ring * (len(bits) - t) // (t + 1)
                cost[:, g, t + 1] += probes
        n, parts, levels = cost.shape
        budget = self.radius + 1  # thresholds + 1, summed over the partitions
        best = np.full((n, budget + 1), np.inf)
        best[:, 0] = 0
        chosen = np.zeros((parts, n, budget + 1), dtype=np.int8)
        for g in range(parts):
            nxt = np.full_like(best, np.inf)
            for spend in range(levels):
                for have in range(budget + 1 - spend):
                    value = best[:, have] + cost[:, g, spend]
                    better = value < nxt[:, have + spend]
                    nxt[better, have + spend] = value[better]
                    chosen[g, better, have + spend] = spend
            best = nxt
        left, out = np.full(n, budget), np.zeros((n, parts), dtype=np.int64)
        for g in reversed(range(parts)):
            spend = chosen[g, np.arange(n), left].astype(np.int64)
            out[:, g] = spend - 1
            left = left - spend
        return out


def _masks(width: int, t: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``t`` bits set."""
    found, ring = [0], [0]
    for _ in range(t):
        ring = sorted({m | 1 << b for m in ring for b in range(width) if not m >> b & 1})
        found += ring
    return np.array(found, dtype=np.int64)


def near_links(fps: DataFrame, total: int, radius: int = 2, parts: int | None = None, bucket: int = 48) -> DataFrame:
    """(a, b): links that connect every two ``fp`` at ``radius`` or fewer bits.

    ``fps`` has distinct longs. The links have the same components as all
    pairs within the radius. Buckets of up to ``bucket`` fingerprints yield
    verified pairs. Those in larger buckets are linked through one-bit
    neighbours (two fingerprints differ in at most two bits exactly if they
    share one), which needs 65 rows a fingerprint; for a radius other than 2
    all buckets are paired.
    """
    if parts is None:
        # Fewer, wider partitions once three would leave large buckets.
        parts = 3 if total < 1 << 26 else 2
    groups = bit_groups(fps, total, parts)
    estimator = Estimator(groups, total, radius).fit(fps)
    masks = {(g, t): _masks(len(bits), t) for g, bits in enumerate(groups) for t in range(radius + 1)}

    def index(batches):
        for frame in batches:
            values = frame["fp"].to_numpy()
            for g, bits in enumerate(groups):
                yield pd.DataFrame({"part": np.int8(g), "sig": _taken(values, bits), "fp": values})

    def probe(batches):
        for frame in batches:
            for at in range(0, len(frame), 65536):
                values = frame["fp"].to_numpy()[at : at + 65536]
                allowed = estimator.thresholds(values)
                for g, bits in enumerate(groups):
                    for t in range(radius + 1):
                        mine = values[allowed[:, g] == t]
                        if len(mine):
                            sig = _taken(mine, bits)[:, None] ^ masks[g, t][None, :]
                            yield pd.DataFrame(
                                {"part": np.int8(g), "sig": sig.ravel(), "fp": np.repeat(mine, sig.shape[1])}
                            )

    kind = "part byte, sig long, fp long"
    indexed = fps.mapInPandas(index, kind)
    probes = fps.mapInPandas(probe, kind)
    sizes = indexed.groupBy("part", "sig").agg(F.count("*").alias("n"))
    crowded = sizes.filter(F.col("n") > bucket).select("part", "sig")
    paired, stars = indexed, None
    if radius == 2:
        crowded = materialize(crowded, "crowded")
        few = crowded.limit(100_001).count()
        if few:
            if few <= 100_000:
                crowded = F.broadcast(crowded)
            paired = indexed.join(crowded, ["part", "sig"], "left_anti")
            inside = indexed.join(crowded, ["part", "sig"], "left_semi").select("fp")
            asking = probes.join(crowded, ["part", "sig"], "left_semi").select("fp")
            stars = _neighbour_links(inside.union(asking).distinct())
    left, right = probes.alias("p"), paired.alias("i")
    links = (
        left.join(
            right,
            (F.col("p.part") == F.col("i.part"))
            & (F.col("p.sig") == F.col("i.sig"))
            & (F.col("p.fp") != F.col("i.fp"))
            & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= radius),
        )
        .select(F.greatest("p.fp", "i.fp").alias("a"), F.least("p.fp", "i.fp").alias("b"))
        .distinct()
    )
    return links if stars is None else links.union(stars)


def _neighbour_links(fps: DataFrame) -> DataFrame:
    """Links among ``fps`` that differ in at most two bits: each fingerprint
    meets the least one around every one-bit neighbour (at most 65 rows a key)."""

    def around(batches):
        flips = np.append(np.uint64(0), np.uint64(1) << np.arange(BITS, dtype=np.uint64))
        for frame in batches:
            for at in range(0, len(frame), 8192):
                values = frame["fp"].to_numpy()[at : at + 8192]
                near = values.view(np.uint64)[:, None] ^ flips[None, :]
                yield pd.DataFrame({"near": near.ravel().view(np.int64), "fp": np.repeat(values, len(flips))})

    met = fps.mapInPandas(around, "near long, fp long")
    least = met.groupBy("near").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all"))
    return least.select(F.explode("all").alias("a"), "b").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_size), a row per row of ``docs``.

    component_id is the least doc_id reachable over fingerprints at ``radius``
    or fewer bits, through any number of documents. Null texts count as empty
    (fingerprint 0, linked like any other). Null doc_ids belong to a component
    but never name it, unless it has no other; rows that repeat a doc_id each
    count. No rows give no rows. Other columns of ``docs`` are not read.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(
        marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct"
    )
    total = distinct.count()
    roots = components(near_links(distinct.select("fp"), total, radius))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(
        F.min("least").alias("component_id"), F.sum("n").alias("component_size")
    )
    facts = materialize(
        placed.join(named, "root").select("fp", "n", "component_id", "component_size"), "components"
    )
    return attach(marked, facts, "fp", "n").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component_size",
    )

