import hashlib

from helpers import SCHEMA, docs
from millrace.llm import exact_dedup as x
from pyspark.sql import functions as F


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    return sorted((i, max(g), len(g), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t in rows for g in [groups[fold(t)]])


ROWS = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 200_000), (8, "X" * 200_000), (9, "lone")]


def test_decisions_equal_brute_force(spark):
    got = x.decisions(docs(spark, ROWS)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(ROWS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_hot_group_and_ordinary_groups_agree(spark):
    rows = [(i, "Hot" if i % 3 == 0 else f"t{i // 2}") for i in range(3000)]
    got = x.decisions(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(rows)


def test_repeated_rows_nulls_and_empty(spark):
    d = docs(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "z"), (None, "z")])
    got = x.decisions(d).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got if r.group_size == 3} == {1}
    assert sorted((r.doc_id or -1, r.text) for r in x.exact_dedup(d).collect()) == [(-1, "z"), (1, "a")]
    assert x.decisions(spark.createDataFrame([], SCHEMA)).count() == 0
    assert x.exact_dedup(spark.createDataFrame([], SCHEMA)).columns == d.columns


def test_clashing_columns_survive(spark):
    d = docs(spark, ROWS)
    for c in ("sha", "k__", "same__", "W_ID", "kept", "mark"):
        d = d.withColumn(c, F.lit(1))
    out = x.exact_dedup(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 4, 6, 8, 9]
