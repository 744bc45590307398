"""Canonical exact digests of documents.

The canonical text is NFC(fold(NFD(text))) with folded white space: normal forms and full case folding are ICU's, which
Spark brings along. Its digest is 128 bits wide: two XXH64 of differing seeds. Documents with equal digests are one bucket, and the canonical bytes of
every bucket with more than one document are compared: the least and the greatest of them must be the same. If they
aren't, the texts of that bucket are told apart by their rank. So equal fingerprints mean equal canonical texts.

Everything is DataFrame functions. Only buckets of two or more documents move texts for the comparison, and of equal
texts in one task only one moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, settle

#: Digests of buckets with several documents are broadcast up to so many (about 50 bytes each), else joined by a shuffle.
SMALL = 500_000
#: Bytes of a block of neighbouring documents; more only where that would be over MOST_BLOCKS blocks.
BLOCK_BYTES, MOST_BLOCKS = 16 << 20, 1 << 18
#: Rows that agree in doc_id and text are one row with a count from so many on (or from this share of all rows on).
MANY, MANY_SHARE = 1000, 8192
#: Rows that a count is spread into by one task at a time.
SPREAD = 4096


def _icu(of: str, method: str, *args: Column) -> Column:
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{of}"), F.lit(method), *args)


def canonical(text: Column) -> Column:
    """NFC of the full case folding of NFD (Unicode's canonical caseless match), runs of white space as one space, none at the ends."""
    t = F.coalesce(text, F.lit(""))
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "decompose", t, F.lit(False)), F.lit(True)), F.lit(False))
    plain = F.octet_length(t) == F.length(t)  # ASCII
    return F.trim(F.regexp_replace(F.when(plain, ascii_lower(t)).otherwise(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits: XXH64 with the seeds 42 and XXH64("wide", 42)."""
    half = lambda *c: F.lower(F.lpad(F.hex(F.xxhash64(*c)), 16, "0"))
    return F.concat(half(canon), half(F.lit("wide"), canon))


def _starts(keys: DataFrame, target: int) -> list[tuple]:
    """The first (doc_id, h) of each block of about target bytes, in order; bytes are added up in ranges of keys(doc_id, h, bytes)."""
    order = (F.asc_nulls_first("doc_id"), F.asc("h"))
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    cut = ranges.select("part", "doc_id", "h", F.floor(before / target).alias("block"))
    # Two rows for each target bytes and one a range, at most.
    got = [tuple(r["k"]) for r in cut.groupBy("part", "block").agg(F.min(F.struct("doc_id", "h")).alias("k")).collect()]
    return sorted(got, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))


def _spread(df: DataFrame) -> DataFrame:
    """df(times, ...) with each row times times, in many tasks."""
    parts = df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / SPREAD))))
    n = F.least(F.lit(SPREAD).cast("long"), F.col("times") - F.col("part") * SPREAD).cast("int")
    own = parts.repartition("doc_id", "fingerprint", "part").withColumn("again", F.explode(F.array_repeat(F.lit(0), n)))
    return own.drop("part", "again", "times")


def with_next(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs(doc_id, text) as rows (doc_id, text, next_text, times), and whether times is over 1 anywhere.

    next_text is the text of the next document by doc_id (nulls first, ties by the text's XXH64), after the last one that
    of the first; a lone document is its own next. Rows that agree in both follow each other; where they are many, all but the last of
    them are one row.

    Blocks of neighbouring documents, of so many bytes each, are shuffled once, and the first document of each also goes
    to the block before. A row finds its block in a broadcast two-level table of their first keys.
    """
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = settle(rows.groupBy("doc_id", "h").agg(F.max(F.octet_length("text") + 64).alias("size"), F.count("*").alias("times")))
    all_ = keys.agg(F.sum("times").alias("n"), F.sum(c("size") * c("times")).alias("bytes"), F.max("times").alias("most")).first()
    if not all_["n"]:
        return rows.select("doc_id", "text", c("text").alias("next_text"), F.lit(1).cast("long").alias("times")), False
    many = max(MANY, all_["n"] // MANY_SHARE)
    hot = all_["most"] > many
    rows = rows.withColumn("times", F.lit(1).cast("long"))
    if hot:  # at most MANY_SHARE keys
        of = keys.filter(c("times") > many).select(c("doc_id").alias("d_"), c("h").alias("h_"), F.lit(True).alias("hot"))
        met = rows.join(F.broadcast(of), c("doc_id").eqNullSafe(c("d_")) & (c("h") == c("h_")), "left").drop("d_", "h_")
        once = met.filter("hot").groupBy("doc_id", "h", "text").agg(F.count("*").alias("times"))
        rows = met.filter("hot is null").drop("hot").unionByName(once)
    target = max(BLOCK_BYTES, all_["bytes"] // MOST_BLOCKS)
    starts = _starts(keys.withColumn("bytes", c("size") * F.when(c("times") > many, 1).otherwise(c("times"))), target)
    wide = math.isqrt(len(starts) - 1) + 1
    tails = [starts[i : i + wide] for i in range(0, len(starts), wide)]
    kind = "array<struct<doc_id: bigint, h: bigint>>"
    table = docs.sparkSession.createDataFrame([([t[0] for t in tails], tails)], f"heads {kind}, tails array<{kind}>")
    key = F.struct("doc_id", "h")
    at = rows.join(F.broadcast(table)).withColumn("i", F.size(F.filter("heads", lambda x: x <= key)) - 1).withColumn("tail", F.get("tails", c("i")))
    at = at.withColumn("j", F.size(F.filter("tail", lambda x: x <= key)) - 1).withColumn("b", c("i") * wide + c("j"))
    begins = F.get("tail", c("j")) == key
    before = F.when(c("b") == 0, F.lit(len(starts) - 1)).otherwise(c("b") - 1)
    own = F.struct(c("b").alias("block"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("block"), F.lit(1).alias("guest"))
    at = at.select("doc_id", "h", "text", "times", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    at = at.select("doc_id", "h", "text", "times", "at.*").repartition(len(starts), "block")
    w = Window.partitionBy("block").orderBy("guest", F.asc_nulls_first("doc_id"), "h", "text")
    out = at.withColumn("next_text", F.lead("text").over(w)).filter("guest = 0").select("doc_id", "text", "next_text", "times")
    if hot:
        last = F.struct(c("next_text"), F.lit(1).cast("long").alias("times"))
        same = F.struct(c("text").alias("next_text"), (c("times") - 1).alias("times"))
        out = out.select("doc_id", "text", F.explode(F.when(c("times") > 1, F.array(last, same)).otherwise(F.array(last))).alias("x")).select("doc_id", "text", "x.*")
    return out, hot


def told_apart(rows: DataFrame, docs: DataFrame) -> DataFrame | None:
    """rows(digest, times), docs(text): digest, sha and rank of the texts in buckets whose canonical bytes aren't all the same.

    None if there is no such bucket.
    """
    several = settle(rows.groupBy("digest").agg(F.sum("times").alias("n")).filter("n > 1").select("digest"))
    canon = docs.select(canonical(F.col("text")).alias("canon")).withColumn("digest", digest(F.col("canon")))
    met = canon.join(F.broadcast(several) if several.count() <= SMALL else several, "digest", "left_semi")
    ends = met.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("z"))
    bad = settle(ends.filter("a <> z").select("digest"))
    if not bad.limit(1).count():
        return None
    every = canon.join(bad, "digest", "left_semi").select("digest", F.sha2("canon", 256).alias("sha")).distinct()
    return every.withColumn("rank", F.dense_rank().over(Window.partitionBy("digest").orderBy("sha")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the next document's first (or
    all that it has). Likeness is 1 if the canonical texts are the same, byte by byte, and else 0: an exact digest knows
    nothing between. A null text counts as empty; texts that only differ in case, white space or normal form have one
    fingerprint. Order is by doc_id, nulls first, ties by the text's XXH64; the next of a repeated row is its repetition,
    and after the last of them the next document. Very long texts are blocks of their own. Other columns of docs play no
    part. An empty table gives no rows.
    """
    c = F.col
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(c("text"), F.lit(1), (n - half).cast("int")), F.substring(c("next_text"), F.lit(1), half))
    rows, hot = with_next(docs)
    rows = rows.select("doc_id", "times", n.cast("long").alias("n_chars"), edited.alias("edited"), canonical(c("text")).alias("canon"), canonical(c("next_text")).alias("next"))
    rows = rows.withColumn("edited_canon", canonical(c("edited")))
    near = lambda x: (c("canon") == c(x)).cast("double")
    rows = settle(rows.select("doc_id", "times", "n_chars", F.sha2(c("edited"), 256).alias("edited_sha256"), digest(c("canon")).alias("digest"), F.sha2(c("canon"), 256).alias("sha"), digest(c("edited_canon")).alias("edited_digest"), near("edited_canon").alias("near_edited"), near("next").alias("near_next")))
    apart = told_apart(rows, docs)
    rank = F.lit(None).cast("int")
    if apart is not None:
        rows, rank = rows.join(apart, ["digest", "sha"], "left"), c("rank")
    own = F.concat("digest", F.coalesce(F.concat(F.lit("-"), rank.cast("string")), F.lit("")))
    rows = rows.withColumn("fingerprint", own)
    changed = F.when(c("near_edited") == 1, c("fingerprint")).when(c("edited_digest") == c("digest"), F.concat("edited_digest", F.lit("-0"))).otherwise(c("edited_digest"))
    out = rows.select("doc_id", "times", "n_chars", "edited_sha256", "fingerprint", changed.alias("edited_fingerprint"), "near_edited", "near_next")
    if hot:
        out = out.filter("times = 1").drop("times").unionByName(_spread(out.filter("times > 1")))
    return out.drop("times")
