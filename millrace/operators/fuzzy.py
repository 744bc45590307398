"""Fuzzy duplicates of records: blocking, pair scores, groups.

Equal values are compared once. Two texts can only reach the threshold if their lengths are within a factor, and then
a piece of the longer one is in the shorter one, near the same place, but for one character (pigeonhole), and their counts
of characters agree far enough. Values are cut into tiles in order of length, and each tile is written once, to the shared
folder; a task reads a pair of tiles and looks for such pieces there, so that no similar pair is missed and neither candidates
nor a tile's values are shuffled once for each tile they meet. Names that many records have are cut into tiles, too. Pairs are
scored in Arrow batches.
A group is what similar pairs connect, named by its least row; where similarity isn't transitive this differs from
taking records one after the other.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import kind_of, similarity
from ..session import remove, settle, shared_dir, store
from .components import connected_components
from .near_texts import Tile, near_pairs
from .ordered import prefix_sums
from .rows import sample_rows

# Cells that say nothing.
SKIPPED = ["unknown", "n/a", "na", "null", "none", "test", "", "nan"]
#: Values on a side of a tile, at so many characters each; tiles that smaller tables are cut into, about.
TILE, CHARACTERS, TASKS = 1 << 17, 64, 8
#: Records that share a name, on either side of a tile.
RECORDS = 256
#: Tables of so many rows are broadcast; pairs of tiles are dealt over so many tasks at most, about so many to each where there are more than tasks at once.
FEW, MOST_TASKS, PAIRS = 100_000, 1 << 12, 16
# What str.strip takes away.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def _values(df: DataFrame, field: str, key: str) -> DataFrame:
    v = F.lower(F.trim(F.col(field).cast("string")))
    return df.select(F.col(key).alias("id"), v.alias("v")).filter((F.length("v") > 2) & ~F.col("v").isin(SKIPPED))


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """hi, lo: tiles of which texts can meet, by their lengths. Tiles are numbered in order of length."""
    size = settle(tiles.groupBy("tile").agg(F.min("n").alias("least"), F.max("n").alias("most")))  # a row a tile
    pairs = size.select(F.col("tile").alias("hi"), "least", F.explode(F.sequence(F.lit(0).cast("long"), "tile")).alias("lo"))
    pairs = pairs.join(size.select(F.col("tile").alias("lo"), "most"), "lo")
    reach = F.greatest(F.col("least") / 2, F.col("least") * (threshold / (2 - threshold)) - 1e-9)
    return settle(pairs.filter(F.col("most") >= reach).select("hi", "lo"))


def _write_tiles(values: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Write values(v) by tile to folder; returns tile, n of each of them, and how many characters a tile has, about.

    Values of one length are dealt by a hash over the tiles that begin with those of this length, as far as these reach.
    """
    texts = values.withColumn("n", F.length(F.btrim("v", F.lit(BLANKS))).cast("long"))
    lengths = settle(texts.groupBy("n").agg(F.sum("n").alias("chars")))  # a row a length
    total = lengths.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    most = min(TILE * CHARACTERS, max(total // TASKS, TASKS * 1024))
    lengths = settle(prefix_sums(lengths, [], ["n"], "chars", "before"))
    few = lengths.limit(FEW + 1).count() <= FEW
    place = F.col("before") + F.pmod(F.xxhash64("v"), F.col("chars"))
    tiles = texts.join(F.broadcast(lengths) if few else lengths, "n").select("v", "n", F.floor(place / most).cast("long").alias("tile"))
    tiles.repartition("tile").write.partitionBy("tile").option("compression", "zstd").parquet(folder)
    return values.sparkSession.read.schema("v string, n long, tile long").parquet(folder).select("tile", "n"), most


def _read_tile(folder: str, tile: int, most: int) -> list[tuple[list[str], list[str]]]:
    """Values of a tile, and these without blanks at their ends, in order of length; a tile that came out larger in parts."""
    fs, at = store(f"{folder}/tile={tile}")
    v = pq.read_table(at, columns=["v"], filesystem=fs, partitioning=None).column("v").to_pylist()
    n = np.fromiter((len(x.strip()) for x in v), np.int64, len(v))
    order = np.argsort(n, kind="stable")
    v, upto = [v[x] for x in order.tolist()], np.cumsum(n[order])
    m = [x.strip() for x in v]
    parts = max(1, round(int(upto[-1]) / most))
    cut = [0, *np.searchsorted(upto, [upto[-1] * k // parts for k in range(1, parts)], "right").tolist(), len(v)]
    return [(v[x:y], m[x:y]) for x, y in zip(cut, cut[1:], strict=False) if x < y]


def _all_met(values: DataFrame, threshold: float, folder: str | None = None) -> DataFrame:
    """v_i, v_j of all pairs of distinct values(v) that can reach the threshold, and of others.

    Values in order of length are cut into tiles of so many characters, written once to folder (which the rows are read
    from, so it may go when they are there), and pairs of tiles' numbers are dealt over tasks: no candidates are shuffled.
    """
    folder = folder or f"{shared_dir(values.sparkSession)}/tiles-{uuid.uuid4().hex}"
    tiles, most = _write_tiles(values.select("v"), folder)
    pairs = _tile_pairs(tiles, threshold)

    def meet(batches):
        last = one = None
        for hi, lo in (p for b in batches for p in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            one = one if hi == last else [(v, Tile(m)) for v, m in _read_tile(folder, hi, most)]
            last, other = hi, one if hi == lo else _read_tile(folder, lo, most)
            for x, (v, m) in enumerate(one):
                for y, (w, k) in enumerate(other[: x + 1] if hi == lo else other):
                    i, j = near_pairs(m, k, threshold, hi == lo and x == y)
                    yield pa.RecordBatch.from_arrays([pa.array([u[z] for z in at.tolist()], pa.string()) for u, at in ((v, i), (w, j))], names=["v_i", "v_j"])

    # A task with several pairs of a tile reads it once.
    n = pairs.count()
    tasks = min(n, MOST_TASKS, max(n // PAIRS, 8 * values.sparkSession.sparkContext.defaultParallelism))
    return pairs.repartitionByRange(max(1, tasks), "hi", "lo").mapInArrow(meet, "v_i string, v_j string")


def _similar(values: DataFrame, threshold: float) -> DataFrame:
    """a, b, score of distinct values(v); see similar_values."""
    m = lambda c: F.btrim(c, F.lit(BLANKS))
    folder = f"{shared_dir(values.sparkSession)}/tiles-{uuid.uuid4().hex}"
    try:
        met = _all_met(values.filter(m("v") != ""), threshold, folder).withColumns({"m_i": m("v_i"), "m_j": m("v_j")})
        # What the ratio leaves out is at least the edit distance; that is told without leaving the JVM.
        far = F.expr(f"levenshtein(m_i, m_j, cast(ceil({1 - threshold!r} * (length(m_i) + length(m_j))) as int))") >= 0
        met = met.filter(far).select(F.least("v_i", "v_j").alias("a"), F.greatest("v_i", "v_j").alias("b"))
        return settle(met.repartition("a").withColumn("score", similarity(F.col("a"), F.col("b"), numbers=False)).filter(F.col("score") >= threshold))
    finally:
        remove(values.sparkSession, folder)


def similar_values(df: DataFrame, field: str, key: str, threshold: float = 0.85) -> DataFrame:
    """a, b, score: distinct values of field with a ratio from the threshold on (a < b). No such pair is left out."""
    return _similar(settle(_values(df, field, key).select("v").distinct()), threshold)


def groups(df: DataFrame, field: str, key: str, threshold: float = 0.85, sample: int | None = None) -> DataFrame:
    """id, group_id for rows that are in a group of two or more; group_id is the least id of the group.

    sample: look at so many rows only, fixed by key.
    """
    df = df if sample is None else sample_rows(df, sample, key)
    rows = settle(_values(df, field, key))
    values = settle(rows.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    nodes = connected_components(_similar(values.select("v"), threshold), "a", "b")
    at = settle(values.join(nodes, values.v == nodes.node, "left").select("v", "least", "n", F.coalesce("root", "v").alias("root")))
    several = at.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("size")).filter("size > 1")
    return rows.join(at.join(several, "root").select("v", "group_id"), "v").select("id", "group_id")


def records(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """id, record_id for every row: the least id of the rows that agree in all fields (as text; null is a value)."""
    cell = [F.col(f"`{c}`").cast("string") for c in fields]
    rows = df.select(F.col(key).alias("id"), F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cell)])), 256).alias("__same"))
    return rows.join(rows.groupBy("__same").agg(F.min("id").alias("record_id")), "__same").select("id", "record_id")


def score_pairs(df: DataFrame, key: str, primary: str, supporting: list[str], fuzzy: float = 0.85, confidence: float = 0.7) -> DataFrame:
    """id_1, id_2, confidence for records whose primary values are equal or similar.

    A record stands for all rows that agree in the primary and supporting fields, by their least id; records() has which
    rows these are, so copies, however many, are no pairs. The primary field weighs 0.3, the others share 0.7; a field
    that is null in both doesn't count, one that is null in one scores 0 at half its weight.
    """
    fields = list(dict.fromkeys([primary, *supporting]))
    cells = df.select(F.col(key).alias("id"), *[F.col(c).cast("string").alias(c) for c in fields]).withColumn("__v", F.lower(F.trim(primary)))
    cells = cells.filter((F.length("__v") > 2) & ~F.col("__v").isin(SKIPPED))
    names = settle(cells.groupBy(F.col("__v").alias("v")).agg(F.count("*").alias("n")))
    near = _similar(names.select("v"), fuzzy).select("a", "b")
    # A name that one row has and that no other is similar to has no pairs: its record goes no further.
    met = near.select(F.col("a").alias("__v")).union(near.select("b")).union(names.filter("n > 1").select("v")).distinct()
    rows = settle(cells.join(met, "__v", "left_semi").groupBy("__v", *fields).agg(F.min("id").alias("id")))
    several = settle(rows.groupBy(F.col("__v").alias("v")).agg(F.count("*").alias("n")).filter("n > 1"))
    links = near.unionByName(several.select(F.col("v").alias("a"), F.col("v").alias("b")))
    # The records of two names, or the upper triangle of those of one, in tiles; most names have one tile.
    large = several.filter(F.col("n") > RECORDS).withColumn("tiles", F.ceil(F.col("n") / F.lit(RECORDS)).cast("int"))
    few = large.limit(FEW + 1).count() <= FEW

    def counted(d: DataFrame, name: str, tiles: str) -> DataFrame:
        side = large.select(F.col("v").alias(name), F.col("tiles").alias(tiles))
        return d.join(F.broadcast(side) if few else side, name, "left").withColumn(tiles, F.coalesce(tiles, F.lit(1)))

    links = counted(counted(links, "a", "na"), "b", "nb")
    at = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tiles = links.withColumn("ta", F.explode(at("na"))).withColumn("tb", F.explode(at("nb"))).filter("a <> b or ta <= tb").select("a", "b", "ta", "tb")
    own = counted(rows, "__v", "tiles").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int")).select(F.col("__v").alias("v"), "tile", "id", F.struct("id", *fields).alias("r"))
    p = tiles.join(own, (F.col("a") == F.col("v")) & (F.col("ta") == F.col("tile"))).select("a", "b", "ta", "tb", F.col("r").alias("p"))
    q = tiles.join(own, (F.col("b") == F.col("v")) & (F.col("tb") == F.col("tile"))).select("a", "b", "ta", "tb", F.col("r").alias("q"))
    met = p.join(q, ["a", "b", "ta", "tb"]).filter("a <> b or ta <> tb or p.id < q.id")
    turn = (F.col("a") == F.col("b")) & (F.col("p.id") > F.col("q.id"))  # of one name the least id is the first
    met = met.select(F.when(turn, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(turn, F.col("p")).otherwise(F.col("q")).alias("q"))
    score, weight = 0.3 * similarity(F.col("p")[primary], F.col("q")[primary], numbers=False), F.lit(0.3)
    each = 0.7 / len(supporting) if supporting else 0.0
    for c in supporting:
        a, b = F.col("p")[c], F.col("q")[c]
        s = similarity(a, b, kind_of(c))
        weight = weight + F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), each / 2).otherwise(each)
        score = score + F.when(a.isNull() | b.isNull(), 0.0).otherwise(s * each)
    out = met.select(F.least("p.id", "q.id").alias("id_1"), F.greatest("p.id", "q.id").alias("id_2"), (score / weight).alias("confidence"))
    return out.filter(F.col("confidence") >= confidence).orderBy(F.desc("confidence"), "id_1", "id_2")


def drop_second(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Without the second row of each pair."""
    return df.join(pairs.select(F.col("id_2").alias(key)).distinct(), key, "left_anti")
