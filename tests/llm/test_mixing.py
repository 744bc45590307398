import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from helpers import SCHEMA, docs
from millrace.llm import mixing as x
from pyspark.sql import functions as F


def targets(sizes, weights=(5, 2, 1)):
    """Targets by their definition: what is above a limit is reshared by weight until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s and s.encode("utf-32-be")))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > 2 * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in free}
        out |= {s: float(2 * sizes[s]) for s in full}
        left = max(0.0, left - sum(out[s] for s in full))
        free = [s for s in free if s not in out]
    return out


def test_targets(spark):
    rnd = random.Random(1)
    cases = [{"b": 100, "a": 1000, None: 100}, {f"s{i}": 10 + i for i in range(30)}, {f"s{i}": rnd.choice([0, 1, 5, 10**6]) for i in range(40)}, {"a": 0}, {}, {"z": 3, "\U0001f600": 50, "\uffff": 7}]
    for sizes in cases:
        got = x.targets(spark.createDataFrame(list(sizes.items()), "source string, s long"))
        assert {r.source: r.target for r in got.collect()} == pytest.approx(targets(sizes), rel=1e-9, abs=1e-9)
    assert {r.source: r.target for r in x.targets(spark.createDataFrame(list(cases[0].items()), "source string, s long")).collect()} == {"a": 1400.0, "b": 200.0, None: 200.0}


def bisect(sizes, target):
    """The multiplier by plain bisection."""
    mean, lo, hi = sum(sizes) / len(sizes), -1e3, 1e3
    for _ in range(200):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if sum(s * min(2, math.exp(min(50, m * s / mean))) for s in sizes) < target else (lo, m)
    return lo, mean


def test_mixture_of_documents(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    got = x.mixture(docs(spark, rows)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    by, taken, target, sizes = Counter(), Counter(), {}, {}
    for r in got:
        by[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        sizes.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    assert target == pytest.approx(targets(by))
    for s, rs in sizes.items():
        assert abs(taken[s] - target[s]) <= 0.02 * target[s], (s, taken[s], target[s])
        if target[s] < 2 * by[s]:
            m, mean = bisect([r["size"] for r in rs], target[s])
            for r in rs:
                assert r.rate == pytest.approx(min(2, math.exp(m * r["size"] / mean)), rel=1e-3)
                assert abs(r.copies - r.rate) <= 1
    again = x.mixture(docs(spark, rows[::-1])).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_edges_and_mix(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "w " * 30_000, "a"), (4, "x y", None), (4, "x y", None), (None, "p q r", "b")] + [(100 + i, "lorem ipsum dolor", "b") for i in range(400)]
    d = docs(spark, rows)
    for c in ("size", "k", "rate", "BOX__", "l"):
        d = d.withColumn(c, F.lit(7))
    got = x.mixture(d)
    assert got.count() == len(rows)
    want = sum(r.copies for r in got.collect())
    out = x.mix(d)
    assert out.columns == d.columns and out.count() == want
    d = d.withColumn("a.dot", F.lit("y"))
    assert x.mix(d).columns == d.columns
    e = spark.createDataFrame([], SCHEMA)
    assert x.mixture(e).count() == 0 and x.mix(e).count() == 0


def test_many_sources_by_joins(spark, monkeypatch):
    """More sources than are broadcast: the same mix. Every third source is one document."""
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(1, 60), f"s{i % 40 if i % 3 else i}") for i in range(900)]
    few = {r.doc_id: r.copies for r in x.mixture(docs(spark, rows)).collect()}
    monkeypatch.setattr(x, "SMALL", 5)
    got = x.mixture(docs(spark, rows)).collect()
    assert {r.doc_id: r.copies for r in got} == few and all(r.taken <= 2 * r["size"] for r in got)


def test_rounding_equals_brute_force(spark):
    """Copies by sorting all keys of a source and tier, the large documents first."""
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.choice([1, 5, 30, 400]), f"s{i % 5}") for i in range(700)]
    d = docs(spark, rows)
    got = {r.doc_id: r for r in x.mixture(d).collect()}
    key = x._key(F.col("doc_id"), F.col("source"), F.col("rate")).alias("key")
    keys = {r.doc_id: r.key for r in x.mixture(d).select("doc_id", key).collect()}
    for source in {r.source for r in got.values()}:
        own = [r for r in got.values() if r.source == source]
        target, size = own[0].target, own[0].source_size
        if target >= 2 * size * (1 - 1e-12):
            assert all(r.copies == 2 for r in own)
            continue
        tier = lambda r: sum(r["size"] <= target * s for s in x.TIERS)
        left = target - sum(r["size"] * math.floor(r.rate) for r in own)
        want = {}
        for t in range(len(x.TIERS) + 1):
            later = sum(math.floor(r["size"] * (r.rate - math.floor(r.rate)) * 1024) for r in own if tier(r) > t) / 1024
            extra, here = left - later, sorted((r for r in own if tier(r) == t), key=lambda r: keys[r.doc_id])
            taken = 0
            for r in here if extra > 0 else ():
                more = taken + r["size"]
                if r.rate >= 2 or taken >= extra or (more >= extra and more - extra >= extra - taken):
                    break
                taken = more
                want[r.doc_id] = 1
            left -= taken
        assert {r.doc_id: r.copies for r in own} == {r.doc_id: math.floor(r.rate) + want.get(r.doc_id, 0) for r in own}
