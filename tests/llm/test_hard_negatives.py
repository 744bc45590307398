import numpy as np
import pytest
from millrace.llm import hard_negatives as x
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(spark, rows, schema=SCHEMA, **kw):
    d = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in x.mine(d, F.col("vec_id") % 10 == 0, F.col("label"), **kw).collect()]


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """By Python's integers."""
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        key = (label, [int(np.floor(256 * float(np.float32(c)))) for c in v])
        best[i] = min(best.get(i, key), key)
    out = []
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    for a in sorted(i for i in best if i % 10 == 0):
        label, v = best[a]
        scored = sorted((-dot(v, w), j, m) for j, (m, w) in best.items() if j != a)
        for ps, p in [(-s, j) for s, j, m in scored if m == label][:positives]:
            found = [(-s, j) for s, j, m in scored if m != label and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(a, p, r, j, ps, s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def test_equals_brute_force_over_several_blocks_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=70).astype(np.float32)], int(rng.choice([1, 1, 1, 2, 3, 4]))) for i in range(230)]
    monkeypatch.setattr(x, "ROWS", 40)
    monkeypatch.setattr(x, "ANCHORS", 5)
    got = sorted(mined(spark, rows))
    assert got == brute(rows) and len(got) > 300


def test_ties_nulls_repeats_and_lengths(spark):
    same = [(i, [1.0, 2.0], i % 2) for i in range(60)]
    near = [(100 + i, [0.4, 0.9], 2) for i in range(30)]
    odd = [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [float("inf"), 1.0], 1), (204, [1.0, 2.0], None), (None, [1.0, 2.0], 0), (210, [], 1), (211, [1.0], 1), (212, [1.0, 2.0, 3.0], 0), (0, [1.0, 2.0], 0), (20, [5.0, 5.0], 7), (220, [-1.0, -3.0], 0)]
    rows = same + near + odd
    assert sorted(mined(spark, rows)) == brute(rows)
    assert sorted(mined(spark, rows, positives=2, negatives=3, low=10, high=50)) == brute(rows, 2, 3, 10, 50)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []
    assert mined(spark, [(i, [1.0], 0) for i in range(30)]) == []
    assert mined(spark, [(10, [1.0], 0), (11, [0.5], 1)]) == []


def test_large_components_and_clashing_columns(spark):
    rows = [(i, [1e4 + i, -3e4, 7.0], i % 3) for i in range(40)]
    assert sorted(mined(spark, rows)) == brute(rows)
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(10, [1e30], 0), (11, [1.0], 0)])
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "v", "g", "anchor", "rank", "x"):
        d = d.withColumn(c, F.lit("other"))
    d = d.select("*", F.lit(1).alias("meta.url"), F.lit(1).alias("a`b"))
    assert sorted(map(tuple, x.mine(d, F.col("vec_id") % 10 == 0, F.col("label")).collect())) == brute(rows)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 25, 1 << 28):
        a, b = rng.integers(-most, most, (7, 32)), rng.integers(-most, most, (9, 32))
        assert (x.multiply(a, b) == np.array([[sum(int(p) * int(q) for p, q in zip(r, s, strict=True)) for s in b] for r in a])).all()
