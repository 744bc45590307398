import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from helpers import SCHEMA, docs
from millrace.llm import simhash as x
from millrace.operators.components import connected_components
from pyspark.sql import functions as F


def brute_fp(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(fps):
    """fps: (doc_id, unsigned fp)."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    v = np.array([f for _, f in fps], np.uint64)
    for k, (i, f) in enumerate(fps):
        d = np.bitwise_count(v[k:] ^ np.uint64(f))
        for j in np.flatnonzero(d <= 2):
            a, b = find(i), find(fps[k + j][0])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in fps}


def test_fingerprints_and_components_equal_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in t] + [(10_000, None), (10_001, ""), (10_002, " \t\x0b"), (10_003, "One"), (10_004, "one two"), (10_005, " x y z w"), (10_006, "w " * 70_000)]
    got = {r.doc_id: r for r in x.near_components(docs(spark, rows)).collect()}
    fps = [(i, brute_fp(s)) for i, s in rows]
    assert {i: r.fp % 2**64 for i, r in got.items()} == dict(fps)
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)


def fp_frame(spark, values):
    return spark.createDataFrame([(int(np.array([v], np.uint64).view(np.int64)[0]),) for v in values], "fp long")


PLANS = {"own": None, "1,0": [(range(32), 1), (range(32, 64), 0)], "0,1": [(range(20), 0), (range(20, 64), 1)], "2": [(range(64), 2)], "0,0,0": [(range(i, 64, 3), 0) for i in range(3)]}


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("kind", ["random", "crowded", "skewed"])
def test_links_lose_nothing(spark, monkeypatch, kind, plan):
    if plan != "own":
        monkeypatch.setattr(x, "plan", lambda *_: [(list(bits), e) for bits, e in PLANS[plan]])
    rnd = random.Random(7)
    vs = {rnd.getrandbits(64) for _ in range(120)}
    if kind == "crowded":  # hundreds within a few bits of each other
        c = rnd.getrandbits(64)
        vs |= {c ^ (1 << a) ^ (1 << b) ^ (1 << d) for a, b, d in (rnd.sample(range(64), 3) for _ in range(600))}
    if kind == "skewed":  # all agree on 40 bits
        vs = {v & (2**24 - 1) for v in (rnd.getrandbits(64) for _ in range(700))}
    vs |= {v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in list(vs)[:60]}
    vs = sorted(vs)
    f = fp_frame(spark, vs)
    nodes = {r.node % 2**64: r.root % 2**64 for r in connected_components(x.near_edges(f), "a", "b").collect()}
    want = brute_components(list(zip(range(len(vs)), vs)))
    groups = {}
    for v in vs:
        groups.setdefault(nodes.get(v, v), set()).add(v)
    brute = {}
    for i, v in enumerate(vs):
        brute.setdefault(want[i], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_allot_finds_the_least_cost():
    assert x.allot([[0, 5, 9], [0, 1, 50]], 3) == (10, [1, 0])
    assert x.allot([[0, 5, 90], [0, 1, 50], [0, 2, 60]], 3) == (8, [0, 0, 0])


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 50)], "a long, b long")
    got = {r.node: r.root for r in connected_components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, **{200 + i: 200 for i in range(1, 50)}}


def test_near_dedup_keeps_one_of_each(spark):
    base = " ".join(f"w{i}" for i in range(300))
    d = docs(spark, [(5, base), (3, base + " x"), (3, base + " x"), (9, "other text here now"), (None, "third text is this"), (None, None)])
    d = d.withColumn("fp", F.lit("mine")).withColumn("tk", F.lit(2))
    out = x.near_dedup(d)
    assert out.columns == d.columns
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == ["3", "9", "None", "None"]
    assert x.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
