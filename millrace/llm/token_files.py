"""Token counts of documents in flat, unindexed token files.

A token file is nothing but token ids of a fixed width, one document after the other, each ended by the end-of-document
id. Files are cut into blocks of bytes, whatever the documents in them; each block is searched for the id at once, and a
prefix scan over the blocks of a file (how many ends so far, and where the last one was) stitches documents that reach
over blocks. Files are read by byte range, so one huge file is many tasks.
"""

from __future__ import annotations

import base64
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, shared_dir, small, tidy

BLOCK_BYTES = 8 << 20


def _open(uri: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark writes it (file:/a, hdfs://..., s3://..., or plain), and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return FileSystem.from_uri(uri)


@functools.lru_cache(maxsize=1)
def _tiktoken(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, ranks: str, eod: int, dtype: str = "uint16") -> DataFrame:
    """Write the tokens of docs(doc_id, text), each text's followed by eod, to one flat file for each task.

    Returns doc_id, file and ord (from 0 in the file), one row for each row of docs; files are there when these rows are.
    A null text has no tokens; an id that dtype can't hold is an error; an empty table writes no file. A task writes to a name of its own attempt and moves the whole file at its end, so
    repeated and speculative attempts do no harm.
    """

    @tidy
    def run(batches):
        code, task = _tiktoken(ranks), TaskContext.get()
        name, n = f"tokens-{task.partitionId():07d}.bin", 0
        fs, at = _open(f"{folder}/{name}")
        tried = f"{at}.{task.taskAttemptId()}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(tried) as f:
            for b in small(batches):
                for t in b.column(1).to_pylist():
                    f.write(np.array([*code.encode_ordinary(t or ""), eod], dtype).tobytes())
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * k), pa.array(np.arange(n, n + k))], names=["doc_id", "file", "ord"])
                n += k
        fs.move(tried, at) if n else fs.delete_file(tried)

    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    return settle(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, file string, ord long"))


def scan_blocks(spark: SparkSession, folder: str, eod: int, dtype: str, block_bytes: int) -> DataFrame:
    """file, block, first (token number of its first token), tokens, ends (where eod stands, from the block's start)."""
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")  # contents aren't read
    bad = F.raise_error(F.concat(F.lit("not whole tokens: "), "path"))
    size = F.when(F.col("length") % width == 0, F.col("length")).otherwise(bad.cast("long"))
    step = block_bytes // width * width
    cut = files.filter("length > 0").select("path", size.alias("length")).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    cut = cut.select("path", "at", F.least(F.lit(step), F.col("length") - F.col("at")).cast("long").alias("bytes"))

    @tidy
    def run(batches):
        for b in batches:
            for path, at, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, p = _open(path)
                with fs.open_input_file(p) as f:
                    a = np.frombuffer(f.read_at(n, at), dtype)
                ends = pa.array([np.flatnonzero(a == eod).astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([p.rpartition("/")[2]]), pa.array([at // step]), pa.array([at // width]), pa.array([len(a)]), ends], names=["file", "block", "first", "tokens", "ends"])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return settle(cut.repartition(parts, "path", "at").mapInArrow(run, "file string, block long, first long, tokens long, ends array<int>"))


def count_tokens(spark: SparkSession, folder: str, eod: int, dtype: str = "uint16", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ord, start, n_tokens, ended: every document of the *.bin files in folder.

    start is the number of its first token in the file; n_tokens doesn't count eod. Tokens after the last eod of a file
    are a document with ended false. An empty document has n_tokens 0; an empty file has no documents; a file that isn't
    a whole number of tokens is an error.
    """
    blocks = scan_blocks(spark, folder, eod, dtype, block_bytes)
    c = F.col
    last = F.when(F.size("ends") > 0, c("first") + F.element_at("ends", -1))
    marks = blocks.select("file", "block", "first", "tokens", F.size("ends").cast("long").alias("n"), last.alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open"))
    at = blocks.select("file", "block", "first", "ends").join(carry, ["file", "block"])
    each = at.select("file", "skip", "open", "first", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(c("k") == 0, c("open")).otherwise(c("first") + F.get("ends", c("k") - 1) + 1)
    whole = each.select("file", (c("skip") + c("k")).alias("ord"), start.alias("start"), (c("first") + c("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = marks.groupBy("file").agg(F.sum("n").alias("ord"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.sum("tokens").alias("all"))
    tail = tail.filter(c("all") > c("start")).select("file", "ord", "start", (c("all") - c("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(tail)


def token_counts(docs: DataFrame, ranks: str, eod: int, dtype: str = "uint16") -> DataFrame:
    """doc_id, n_tokens, file, start for every row of docs, by way of token files in the shared folder.

    A null text counts as empty; repeated rows are documents of their own; an empty table gives no rows. The files are
    removed when the counts have been written.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    try:
        names = write_token_files(docs, folder, ranks, eod, dtype)
        counts = count_tokens(spark, folder, eod, dtype)
        return settle(names.join(counts, ["file", "ord"]).select("doc_id", "n_tokens", "file", "start"))
    finally:
        fs, at = _open(folder)
        fs.delete_dir(at)
