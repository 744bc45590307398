"""Hard negatives by a two-dimensional block matrix product.

Scores of all rows against the anchors are a product of two matrices, made in tiles:

1. components become integers, and rows are packed in blocks by label, each cut into chunks of dimensions;
2. a block of anchors and a block of rows meet in the tile (block, block, chunk), for which both are repeated along the
   other's side; each task multiplies one chunk of the dimensions, and the partial int64 tiles of a pair of blocks are
   shuffled together and added;
3. a tile keeps only the best of each anchor, and these few are ranked over all tiles.

Tiles of blocks that can share labels come first and give each anchor's positives. Their scores are the windows that all
tiles are then reduced by: of the rows inside an anchor-positive window a tile keeps the best few. So no score is kept
beyond the tile that it is in, and what one task holds is a tile of each chunk, whatever the size of the table or of a label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, settle

#: Anchors and rows of a block (on average), dimensions of a chunk, and groups that labels are dealt to.
ANCHORS, ROWS, DIMS, GROUPS = 256, 2048, 32, 16
#: Components are floored after this scaling.
SCALE = 256
#: Scores times 100 must stay within int64, so a vector's summed squares within this.
LARGEST = 1 << 55


def _quantised(vectors: DataFrame, key: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """(id, label, anchor, v, g): rows that take part, with integer components, and the group that their label is dealt to."""
    x = F.transform(columns(vectors, [vector])[0], lambda c: c.cast("double"))
    of = columns(vectors, [key])[0]
    d = vectors.select(of.cast("long").alias("id"), label.cast("long").alias("label"), anchor.alias("anchor"), x.alias("x"))
    d = d.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    d = d.select("id", "label", "anchor", F.transform("x", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("v"))
    d = d.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.label", "r.anchor", "r.v")
    return d.withColumn("g", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))


def _blocks(counts: dict[int, int], size: int) -> dict[int, int]:
    """Blocks of each group of labels: of size rows on average."""
    return {g: -(-n // size) for g, n in counts.items() if n}


def _packed(rows: DataFrame, blocks: dict[int, int], chunks: int) -> DataFrame:
    """(g, b, k, ids, labels, widths, rest, v): the blocks of rows(id, label, g, v, rest), each in chunks of DIMS dimensions.

    Numbers are int64 in bytes, rows by id. All but v are with the first chunk only; widths tells how much of rest, an
    array of long, is each row's. Shorter vectors are filled up with zeros.
    """
    of = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id", F.lit("block")), of[F.col("g")]).cast("int")).select("g", "b", "id", "label", "rest", "v")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        v, rest = (t.column(c).combine_chunks() for c in ("v", "rest"))
        widths = [np.diff(x.offsets.to_numpy()) for x in (v, rest)]
        m = np.zeros((len(t), chunks * DIMS), np.int64)
        m[np.arange(m.shape[1]) < widths[0][:, None]] = v.flatten().to_numpy(zero_copy_only=False)
        told = [t.column("id").to_numpy(), t.column("label").to_numpy(), widths[1], rest.flatten().to_numpy(zero_copy_only=False)]
        g, b = (pa.array([t.column(c)[0].as_py()] * chunks, pa.int32()) for c in ("g", "b"))
        first = [pa.array([np.asarray(x, np.int64).tobytes(), *[None] * (chunks - 1)], pa.binary()) for x in told]
        parts = pa.array([np.ascontiguousarray(m[:, k * DIMS : (k + 1) * DIMS]).tobytes() for k in range(chunks)], pa.binary())
        return pa.table([g, b, pa.array(range(chunks), pa.int32()), *first, parts], names=PACKED)

    return dealt.groupBy("g", "b").applyInArrow(pack, ", ".join(f"{c} int" for c in PACKED[:3]) + ", " + ", ".join(f"{c} binary" for c in PACKED[3:]))


PACKED = ["g", "b", "k", "ids", "labels", "widths", "rest", "v"]


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64: in doubles where these are exact, which is many times faster."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _ints(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int64)


def _along(blocks: dict[int, int], own: Column | None = None) -> Column:
    """An array of (g, b): all blocks, or those of the group own."""
    of = lambda g, n: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(g.alias("g"), b.alias("b")))
    if own is None:
        return F.flatten(F.array(*[of(F.lit(g), F.lit(n)) for g, n in blocks.items()]))
    n = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[own]
    return F.when(n.isNotNull(), of(own, n))


def _tiles(anchors: DataFrame, a_blocks: dict[int, int], rows: DataFrame, r_blocks: dict[int, int], own_group: bool, reduced, schema: str) -> DataFrame:
    """reduced(ids, labels, rests, row ids, row labels, scores) of all tiles, or of those of blocks of one group of labels.

    A block is repeated for each block of the other side; (a pair of blocks, chunk) is what tasks are dealt by.
    """
    cells = ["ids", "labels", "widths", "rest", "row_ids", "row_labels", "s"]

    def partial(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (len(a) and len(b)):  # no row was dealt to the other block
            return pa.table({c: pa.array([], pa.int32() if c in TILE else pa.binary()) for c in (*TILE, *cells)})
        s = multiply(*(_ints(t.column("v")[0]).reshape(-1, DIMS) for t in (a, b)))
        told = [*(a.column(c) for c in cells[:4]), *(b.column(c) for c in ("ids", "labels"))]
        return pa.table([*(a.column(c) for c in TILE), *told, pa.array([s.tobytes()], pa.binary())], names=[*TILE, *cells])

    def add(t: pa.Table) -> pa.Table:
        total = sum(_ints(x) for x in t.column("s"))
        first = t.filter(t.column("ids").is_valid())
        ids, labels, widths, rest, row_ids, row_labels = (_ints(first.column(c)[0]) for c in cells[:-1])
        return reduced(ids, labels, np.split(rest, np.cumsum(widths)[:-1]), row_ids, row_labels, total.reshape(len(ids), len(row_ids)))

    along = lambda d, other, mine, its: d.select("*", F.explode(_along(other, F.col("g") if own_group else None)).alias("o")).select(F.col("g").alias(f"{mine}g"), F.col("b").alias(f"{mine}b"), F.col("o.g").alias(f"{its}g"), F.col("o.b").alias(f"{its}b"), *PACKED[2:])
    a, b = along(anchors, r_blocks, "a", "r"), along(rows, a_blocks, "r", "a")
    made = a.groupBy(*TILE, "k").cogroup(b.groupBy(*TILE, "k")).applyInArrow(partial, ", ".join([*(f"{c} int" for c in TILE), *(f"{c} binary" for c in cells)]))
    return made.groupBy(*TILE).applyInArrow(add, schema)


TILE = ["ag", "ab", "rg", "rb"]


def _best(of: DataFrame, within: list[str], score: str, key: str, n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*within).orderBy(F.desc(score), key)
    return of.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def _first_positives(n: int):
    def reduced(ids, labels, rests, row_ids, row_labels, scores) -> pa.Table:
        out = []
        for i, (a, label) in enumerate(zip(ids.tolist(), labels.tolist(), strict=True)):
            at = np.flatnonzero((row_labels == label) & (row_ids != a))
            at = at[np.argsort(-scores[i, at], kind="stable")[:n]]  # rows are by id, so ties are, too
            out.append((np.full(len(at), a), row_ids[at], scores[i, at]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["anchor_id", "positive_id", "positive_score"])

    return reduced, "anchor_id long, positive_id long, positive_score long"


def _first_negatives(n: int, low: int, high: int):
    def reduced(ids, labels, rests, row_ids, row_labels, scores) -> pa.Table:
        out = [np.zeros((0, 5), np.int64)]
        for i, (a, label, rest) in enumerate(zip(ids.tolist(), labels.tolist(), rests, strict=True)):
            other = np.flatnonzero(row_labels != label)
            down = -scores[i, other]
            order = np.argsort(down, kind="stable")
            down, other = down[order], other[order]
            for positive, score in rest.reshape(-1, 2).tolist():
                begin = np.searchsorted(down, -(high * score // 100), "left")
                end = min(begin + n, np.searchsorted(down, (-low * score) // 100, "right"))
                if begin < end:
                    at = other[begin:end]
                    out.append(np.column_stack([np.full(len(at), a), np.full(len(at), positive), row_ids[at], np.full(len(at), score), scores[i, at]]))
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pa.table(list(np.concatenate(out).T.copy()), names=names)

    return reduced, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that the column anchor says.

    An anchor's positives are the first rows of its label, by score and then id; its negatives for one of these are the
    first rows of other labels whose scores are from low to high per cent of the positive's. Rows with a null id, label or
    vector, or a component that is null or not finite, take no part; of rows that repeat an id, the one with the least
    label, and then vector, does. A vector that is shorter than others counts as filled up with zeros, an empty one
    scores 0. Other columns play no part. Empty tables, and tables without anchors or with one label, give no rows.
    Vectors so long that scores might not fit are refused.
    """
    spark = vectors.sparkSession
    rows = settle(_quantised(vectors, key, vector, label, anchor))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    seen = rows.groupBy("g").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("dims"), F.max(square).alias("square")).collect()  # GROUPS rows at most
    if any(r["square"] >= LARGEST for r in seen):
        raise ValueError("vectors are too long for scores of 64 bits")
    chunks = max(2, -(-max([r["dims"] for r in seen], default=0) // DIMS))
    r_blocks, a_blocks = _blocks({r["g"]: r["n"] for r in seen}, ROWS), _blocks({r["g"]: r["anchors"] for r in seen}, ANCHORS)
    if not a_blocks:
        return spark.createDataFrame([], RESULT)
    no_rest = F.array().cast("array<long>")
    packed = settle(_packed(rows.withColumn("rest", no_rest), r_blocks, chunks))
    own = rows.filter("anchor")
    found = _tiles(_packed(own.withColumn("rest", no_rest), a_blocks, chunks), a_blocks, packed, r_blocks, True, *_first_positives(positives))
    found = _best(found, ["anchor_id"], "positive_score", "positive_id", positives)
    windows = found.groupBy("anchor_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))), lambda p: F.array(p["positive_id"], p["positive_score"]))).alias("rest"))
    told = settle(_packed(own.join(windows, F.col("id") == F.col("anchor_id")), a_blocks, chunks))
    near = _tiles(told, a_blocks, packed, r_blocks, False, *_first_negatives(negatives, low, high))
    best = _best(near, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
