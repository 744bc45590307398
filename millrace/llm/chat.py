"""Chat formatting after a collapse of cumulative snapshots.

Logs often hold a conversation many times, each time a few turns longer. Every turn gets a hash of its position, role
and text, and the exclusive-or of a conversation's first k of them is the rolling hash of that prefix (two lanes of 64
bits). A conversation whose whole hash is the hash of a proper prefix of another one is dropped by an anti-join; equal
ones are one; what stays is rendered.

Turns of all conversations are ordered together by ranges, which gives each its position; rolling hashes are prefix scans
over blocks of positions: hashes of whole blocks are scanned first, then turns within their block. So no task needs all
turns of a conversation, nor all that have one turn number or none. Only hashes move before the anti-join; texts move
once, of conversations that stay. Very long conversations are rendered in segments, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle
from ..operators.ordered import with_row_id

#: Turns of a block, and of a rendered segment.
BLOCK, SEGMENT = 256, 1024
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turns(conversations: DataFrame) -> DataFrame:
    lanes = [F.xxhash64(F.lit(i), F.col("role").isNull(), F.col("text").isNull(), "role", "text").alias(n) for i, n in enumerate("ab")]
    return conversations.filter("conv_id is not null").select("conv_id", "turn", "role", "text", *lanes)


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a, b, pos, x, y: each turn's position from 1, and the rolling hash up to and with it."""
    t = with_row_id(_turns(conversations).select("conv_id", "turn", "a", "b").distinct(), "conv_id", "turn", "a", "b", name="row", unique=True)
    at = t.join(t.groupBy("conv_id").agg(F.min("row").alias("start")), "conv_id").withColumn("pos", F.col("row") - F.col("start") + 1)
    at = at.select("conv_id", "turn", "a", "b", "pos", F.floor((F.col("pos") - 1) / BLOCK).alias("block"))
    hashed = settle(at.select("*", F.xxhash64(F.lit(0), "pos", "a", "b").alias("h"), F.xxhash64(F.lit(1), "pos", "a", "b").alias("g")))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    carried = carried.select("conv_id", "block", F.coalesce(F.bit_xor("h").over(before), F.lit(0)).alias("ch"), F.coalesce(F.bit_xor("g").over(before), F.lit(0)).alias("cg"))
    rolled = hashed.select("conv_id", "block", "turn", "a", "b", "pos", F.bit_xor("h").over(upto).alias("h"), F.bit_xor("g").over(upto).alias("g"))
    out = rolled.join(carried, ["conv_id", "block"])
    return out.select("conv_id", "turn", "a", "b", "pos", F.col("h").bitwiseXOR(F.col("ch")).alias("x"), F.col("g").bitwiseXOR(F.col("cg")).alias("y"))


def maximal(rolling: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of conversations that are no proper prefix of another one; of equal ones, the least conv_id."""
    sizes = rolling.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max_by(F.struct("x", "y"), "pos").alias("w"))
    whole = sizes.groupBy("n", "w.x", "w.y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = rolling.join(sizes.select("conv_id", "n"), "conv_id").filter("pos < n").select(F.col("pos").alias("n"), "x", "y").distinct()
    return whole.join(proper, ["n", "x", "y"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def render(role: Column, text: Column, template=TEMPLATE) -> Column:
    return F.concat(F.lit(template[0]), F.coalesce(role, F.lit("")), F.lit(template[1]), F.coalesce(text, F.lit("")), F.lit(template[2]))


def collapse_and_render(conversations: DataFrame, template=TEMPLATE) -> DataFrame:
    """conv_id, segment, n_turns, copies, rendered, for each maximal conversation of conversations(conv_id, turn, role, text).

    Turns are in order of turn (null first); repeated rows are one turn, and other turns with the same number follow each
    other in a fixed order. Null roles and texts are values of their own and render as nothing. Rows without a conv_id
    belong to no conversation. segment counts the rendered parts of SEGMENT turns from 0; n_turns and copies (equal
    conversations, this one included) are of the whole conversation. An empty table gives no rows.
    """
    rolling = settle(prefixes(conversations))
    stays = maximal(rolling)
    place = rolling.join(stays, "conv_id").select("conv_id", "turn", "a", "b", "pos", "n_turns", "copies").alias("p")
    turns = _turns(conversations).alias("t")
    met = turns.join(place, (F.col("t.conv_id") == F.col("p.conv_id")) & F.col("t.turn").eqNullSafe(F.col("p.turn")) & (F.col("t.a") == F.col("p.a")) & (F.col("t.b") == F.col("p.b")))
    parts = met.select("p.conv_id", F.floor((F.col("p.pos") - 1) / SEGMENT).cast("long").alias("segment"), "p.n_turns", "p.copies", F.struct("p.pos", render(F.col("t.role"), F.col("t.text"), template).alias("said")).alias("part"))
    out = parts.groupBy("conv_id", "segment").agg(F.first("n_turns").cast("long").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_set("part")).alias("parts"))
    return out.select("conv_id", "segment", "n_turns", "copies", F.concat_ws("", F.transform("parts", lambda p: p["said"])).alias("rendered"))
