"""What the operators of this folder share: table reading, durable lineage cuts and row keeping."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. A pure ASCII text takes the fast path, where lower() does exactly that."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def small(batches, rows: int = 256):
    """Arrow batches in slices, so that what Python makes of a batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def tidy(run):
    """A function on Arrow batches that gives freed memory back at its end: idle workers wait for other stages' tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # of glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def columns(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of df (or those of these names), whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def free_name(df: DataFrame, *stems: str) -> list[str]:
    """Names like the stems that clash with no column of df, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def keep_winners(docs: DataFrame, key: Column, winners: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, key) is in winners(w_id, w_key, w_same); one row of those that agree in both.

    w_same is the number of rows of docs with that (doc_id, key): only where it is over 1 are rows compared, each task's
    among themselves first, and in the usual case that there are none, the texts go through one join. Null doc_ids match
    null-safely.
    """
    k, same, wi, row = free_name(docs, "k__", "same__", "wi__", "row__")
    w = settle(winners.select(F.col("w_id").alias(wi), F.col("w_key").alias(k), F.col("w_same").alias(same)))
    left = docs.select(F.struct(*columns(docs)).alias(row), F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias(k)).alias("l")
    met = left.join(w.alias("r"), F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) & F.col("l.doc_id").eqNullSafe(F.col(f"r.{wi}")))
    met = met.select(f"l.{row}", "l.doc_id", "l.text", f"l.{k}", f"r.{same}")
    if not w.filter(F.col(same) > 1).limit(1).count():
        return met.select(f"{row}.*")
    one = met.filter(F.col(same) > 1).groupBy("doc_id", k).agg(F.min_by(row, "text").alias(row))
    return met.filter(F.col(same) == 1).select(f"{row}.*").unionByName(one.select(f"{row}.*"))
