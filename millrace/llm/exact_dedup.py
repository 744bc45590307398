"""Exact deduplication with a split for heavy hitters.

A frequent-items sketch (the Misra-Gries family: approx_top_k keeps a bounded number of counters and lowers them
together) names every digest that could hold a large share of the rows; all of its counters above that share are taken.
Those digests are counted exactly, with pre-aggregation, and their winners (one row for each, at most as many as there are
counters) are broadcast, so that rows of a hot digest are decided where they are read. All other digests shuffle in the
ordinary way: none of them can hold more than 3.5 / COUNTERS of the rows, and their winners are aggregates, joined back.

Everything is DataFrame functions. Only digests move; texts stay at the scan until the final join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep_winners, settle

#: Counters of the sketch, and hot digests that may be broadcast (about 100 bytes each).
COUNTERS = 8192


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, mark): SHA-256 of the text with A-Z lower-cased, null as empty; mark tells equal rows apart."""
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    return settle(docs.select("doc_id", sha.alias("sha"), F.monotonically_increasing_id().alias("mark")))


def decisions(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text, ...).

    Rows are equal when their texts are after lower-casing A-Z. The row with the largest doc_id stays; a null doc_id
    comes after all others, and of rows that repeat a doc_id and a text one stays. An empty table gives no rows.
    """
    rows = digests(docs)
    top = rows.agg(F.expr(f"approx_top_k(sha, {COUNTERS}, {COUNTERS})").alias("top")).select(F.explode("top").alias("t"))
    total = rows.count()
    # A digest below this share is no danger to a task; the rest of the sketch's items needn't be broadcast.
    hot = top.filter(F.col("t.count") > F.lit(max(2, total // COUNTERS))).select(F.col("t.item").alias("sha"))
    order = F.struct(F.col("doc_id"), (-F.col("mark")).alias("mark"))
    win = settle(rows.join(F.broadcast(hot), "sha").groupBy("sha").agg(F.max(order).alias("w"), F.count("*").alias("group_size")))
    told = lambda met: met.select("doc_id", F.col("w.doc_id").alias("keep_id"), "group_size", (-F.col("w.mark") == F.col("mark")).alias("kept"), F.col("sha").alias("text_sha256"))
    rest = rows.join(F.broadcast(win.select("sha")), "sha", "left_anti")
    each = rest.groupBy("sha").agg(F.max(order).alias("w"), F.count("*").alias("group_size"))
    return told(rows.join(F.broadcast(win), "sha")).unionByName(told(rest.join(each, "sha")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay under decisions(), with all their columns, whatever their names.

    Null and empty texts are equal; nulls, ties and repeated rows are as in decisions(); an empty table stays empty.
    """
    d = decisions(docs)
    twins = d.groupBy(F.col("doc_id").alias("w_id"), F.col("text_sha256").alias("w_key")).agg(F.count("*").alias("w_same"), F.bool_or("kept").alias("won"))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    return keep_winners(docs, sha, twins.filter("won"))
