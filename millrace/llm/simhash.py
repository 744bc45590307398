"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within tau bits of each other must agree, in at least one of m disjoint parts of the bits, up to that
part's own threshold e_i whenever the sum of (e_i + 1) is tau + 1 (a part with e_i = -1 isn't probed at all). So:

1. bits that vary together are grouped into the same part, from their correlations over all fingerprints;
2. thresholds are allotted by dynamic programming on candidate counts, estimated from the sizes of all buckets;
3. every fingerprint owns the bucket of its value in a part and probes those within e_i flipped bits;
4. pairs that meet are verified on all bits.

Equal fingerprints are one vertex, so copies cost nothing. A bucket of more than BUCKET owners isn't paired: each
fingerprint that meets it names its tau / 2 neighbourhood instead (itself and every single-bit flip). Two fingerprints
are within 2 bits exactly if they name a common value, at most 65 fingerprints name the same one, and a star to the
least of them keeps every component. That path is exact and linear in the bucket's size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import keep_winners, settle, small, tidy
from ..operators.components import connected_components

BITS, TAU, SEED, SHINGLE, BUCKET, CHUNK = 64, 2, 42, 3, 64, 1 << 16


def simhash(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text; 0 without words. Long texts are counted in chunks of shingles."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    n = len(words) - k + 1
    if n < 1:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        own = words[i : min(i + CHUNK, n) + k - 1]
        grams = map(b" ".join, zip(*(own[j:] for j in range(k))))
        h = np.fromiter(map(xxh64_intdigest, grams, itertools.repeat(SEED)), np.uint64, len(own) - k + 1)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, tk, fp): fp is the fingerprint as a signed long, tk a hash of the text. A null text has no words."""

    @tidy
    def run(batches):
        for b in small(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.fromiter((simhash(t or b"", k) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], names=["doc_id", "tk", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tk")).mapInArrow(run, "doc_id long, tk long, fp long")


def bit_correlations(fps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """|correlation| of every two bits, and each bit's share of ones, over all fingerprints; 65 x 65 sums are all that reaches the driver."""

    @tidy
    def run(batches):
        total = np.zeros((BITS + 1, BITS + 1), np.int64)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            x = np.hstack([np.unpackbits(v, axis=1, bitorder="little"), np.ones((len(v), 1), np.uint8)]).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "n"])

    sums = np.zeros((BITS + 1) ** 2)
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[r["cell"]] = r["n"]
    sums = sums.reshape(BITS + 1, BITS + 1)
    p = sums[:BITS, BITS] / max(sums[BITS, BITS], 1)
    cov = sums[:BITS, :BITS] / max(sums[BITS, BITS], 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(cov / np.outer(sd, sd)), p


def parts_of(corr: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each grows by the bit that correlates most with what it has."""
    left, parts = set(range(BITS)), []
    for i in range(m):
        size = len(left) // (m - i)
        seed = max(left, key=lambda a: (sum(corr[a][b] for b in left), -a))
        part = [seed]
        left.discard(seed)
        while len(part) < size:
            best = max(left, key=lambda a: (sum(corr[a][b] for b in part), -a))
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def allot(cost: list[list[float]], slots: int) -> tuple[float, list[int]]:
    """Least total cost of e_i >= -1 with the sum of (e_i + 1) equal to slots; cost[i][s] is part i's with s slots."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, e) in best.items():
            for s in range(min(slots - used, len(own) - 1) + 1):
                cand = (c + own[s], [*e, s - 1])
                if used + s not in nxt or cand < nxt[used + s]:
                    nxt[used + s] = cand
        best = nxt
    return best[slots]


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def plan(fps: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the probed parts."""
    corr, p = bit_correlations(fps)
    options = {m: parts_of(corr, m) for m in range(2, tau + 2)}
    flat = [(m, i, bits) for m, ps in options.items() for i, bits in enumerate(ps)]
    keys = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v")) for j, (_, _, bits) in enumerate(flat)]))
    n = F.col("n")
    pairs = F.when(n > BUCKET, n * (BITS + 1)).otherwise(n * (n - 1) / 2)
    met = fps.select(keys.alias("k")).groupBy("k.j", "k.v").agg(F.count("*").cast("double").alias("n"))
    base = {r["j"]: (r["c"], r["n"]) for r in met.groupBy("j").agg(F.sum(pairs).alias("c"), F.sum("n").alias("n")).collect()}
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-6, 1)  # of two fingerprints in a bit
    costs: dict[int, list[list[float]]] = {}
    for j, (m, _, bits) in enumerate(flat):
        c, rows = base.get(j, (0.0, 0.0))
        r = (1 - agree[bits]) / agree[bits]
        e1 = r.sum()
        e2 = (e1 * e1 - (r * r).sum()) / 2
        w = len(bits)
        # A probe costs about as much as a candidate. Candidates within e flips follow from those within none.
        costs.setdefault(m, []).append([0.0, c + rows, c * (1 + e1) + rows * (1 + w), c * (1 + e1 + e2) + rows * (1 + w + w * (w - 1) / 2)][: tau + 2])
    chosen = min((allot(costs[m], tau + 1) + (m,) for m in options), key=lambda x: x[0])
    return [(bits, e) for bits, e in zip(options[chosen[2]], chosen[1], strict=True) if e >= 0]


def _flips(bits: list[int], e: int) -> list[int]:
    return [_mask(list(c)) for d in range(1, e + 1) for c in itertools.combinations(bits, d)]


def _probes(j: int, bits: list[int], e: int) -> list[Column]:
    """Arrays of (j, v, own): the bucket that a fingerprint owns in part j, and those it probes."""
    value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
    flips = F.array(*[F.lit(x) for x in _flips(bits, e)])
    bucket = lambda v, own: F.struct(F.lit(j).alias("j"), v.alias("v"), F.lit(own).alias("own"))
    return [F.array(bucket(value, True)), *([F.transform(flips, lambda x: bucket(value.bitwiseXOR(x), False))] if e else [])]


def near_edges(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b): links between distinct fingerprints fps(fp) that give the components of all links within tau bits."""
    if tau != TAU:
        raise ValueError("the exact path for crowded buckets is built for 2 bits")
    probes = []
    for j, (bits, e) in enumerate(plan(fps, tau)):
        probes += _probes(j, bits, e)
    keyed = fps.select("fp", F.explode(F.concat(*probes)).alias("k")).select("fp", "k.*")
    crowded = settle(keyed.filter("own").groupBy("j", "v").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("j", "v"))
    # Of buckets that can be paired.
    rest = keyed.join(crowded, ["j", "v"], "left_anti")
    a, b = rest.filter("own").alias("a"), rest.alias("b")
    near = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= tau) & F.when(F.col("b.own"), F.col("a.fp") < F.col("b.fp")).otherwise(F.col("a.fp") != F.col("b.fp"))
    paired = a.join(b, (F.col("a.j") == F.col("b.j")) & (F.col("a.v") == F.col("b.v")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    # Of crowded ones.
    hot = keyed.join(crowded, ["j", "v"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_mask([i])) for i in range(BITS)])
    named = hot.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("v"))
    stars = named.groupBy("v").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return paired.unionByName(stars)


def _with_components(docs: DataFrame) -> DataFrame:
    """doc_id, tk (a hash of the text), fp, root (the component's least fingerprint), component_id."""
    rows = settle(fingerprints(docs))
    fps = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(near_edges(fps.select("fp")), "a", "b")
    roots = fps.join(nodes, fps.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    comp = settle(roots.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(comp, "fp").select("doc_id", "tk", "fp", "root", "component_id")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row: component_id is the least doc_id that links of at most 2 bits reach.

    A text without words (null, empty, spaces) has fingerprint 0 and links like any other. A null doc_id is ignored in
    the minimum; component_id is null only in a component without any doc_id. An empty table gives no rows.
    """
    return _with_components(docs).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, the one with the least doc_id (null last), with all columns.

    Of rows that share that doc_id, the one with the least fingerprint stays; of rows that repeat id and text, one.
    """
    rows = _with_components(docs).groupBy("doc_id", "tk", "fp", "root").agg(F.count("*").alias("w_same"))
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("fp"), F.col("tk"))
    won = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "tk", "w_same"), order).alias("w"))
    winners = won.select(F.col("w.doc_id").alias("w_id"), F.col("w.tk").alias("w_key"), F.col("w.w_same").alias("w_same"))
    return keep_winners(docs, F.xxhash64("text"), winners)
