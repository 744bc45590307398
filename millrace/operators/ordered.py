"""Operators that depend on row order, without putting all rows in one task.

Rows get a global position by range partitioning: sorted ranges, counted, and shifted by the counts of the ranges before.
Ordered operators then work on buckets of consecutive positions, and what a bucket needs of the ones before or after it
(the last value, a few rows) is carried by a table with one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

ROW, BUCKET = "__row_id", 1 << 16
#: Buckets that are scanned together.
GROUP = 1 << 12


def with_row_id(df: DataFrame, *order: str | Column, name: str = ROW, unique: bool = False) -> DataFrame:
    """df with its position from 0 in the given order (nulls first; ties in any order, but fixed once).

    Ties are dealt over ranges by a hash of the row, and equal rows by where they came from, so that no value is one task;
    unique says that there are none.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = [F.col("`" + c.replace("`", "``") + "`") for c, t in df.dtypes if not t.startswith("map")]
    # Sorted by the hash, a task that is run again numbers its rows alike.
    tied = df if unique else df.withColumn("__tie", F.xxhash64(*row)).sortWithinPartitions("__tie").withColumn("__from", F.monotonically_increasing_id())
    keys = [*order] if unique else [*order, "__tie", "__from"]
    ranged = settle(tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie", "__from").withColumn("__mid", F.monotonically_increasing_id()))
    part = F.shiftright("__mid", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # a row for each partition
    skip = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__skip"))
    out = ranged.withColumn("__part", part).join(F.broadcast(skip), "__part")
    return out.withColumn(name, F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__skip")).drop("__mid", "__part", "__skip")


def _bucket(row: str) -> Column:
    return F.floor(F.col(row) / BUCKET).cast("long")


def _grouped(each: DataFrame) -> DataFrame:
    return each.withColumn("__g", F.floor(F.col("__b") / GROUP).cast("long"))


def _summed_before(each: DataFrame, value: str, name: str) -> DataFrame:
    """each(__b, value) with the sum of value over the buckets before: within groups of buckets, and over groups."""
    at = _grouped(each)
    groups = at.groupBy("__g").agg(F.sum(value).alias("__s"))
    over = groups.select("__g", (F.sum("__s").over(Window.orderBy("__g")) - F.col("__s")).alias("__over"))
    own = F.sum(value).over(Window.partitionBy("__g").orderBy("__b")) - F.col(value)
    return at.withColumn(name, own).join(over, "__g").withColumn(name, F.col(name) + F.col("__over")).drop("__g", "__over")


def _carried(df: DataFrame, what: dict[str, Column], row: str, forward: bool) -> DataFrame:
    """For each bucket the last (or first) non-null of each expression in the buckets before (or after) it."""
    pick = F.max_by if forward else F.min_by
    at = _grouped(df.groupBy(_bucket(row).alias("__b")).agg(*[pick(c, F.when(c.isNotNull(), F.col(row))).alias(n) for n, c in what.items()]))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sort = (lambda c: F.col(c)) if forward else F.desc
    inner = before(Window.partitionBy("__g").orderBy(sort("__b")))
    groups = at.groupBy("__g").agg(*[pick(n, F.when(F.col(n).isNotNull(), F.col("__b"))).alias(n) for n in what])
    over = groups.select("__g", *[F.last(n, ignorenulls=True).over(before(Window.orderBy(sort("__g")))).alias(f"{n}_g") for n in what])
    own = at.select("__g", "__b", *[F.last(n, ignorenulls=True).over(inner).alias(n) for n in what])
    return own.join(over, "__g").select("__b", *[F.coalesce(n, f"{n}_g").alias(n) for n in what])


def _running(forward: bool, row: str, *by: str):
    """From the first row (or back from the last one) to this one; a frame that only grows costs one step a row."""
    return Window.partitionBy(*by).orderBy(row if forward else F.desc(row)).rowsBetween(Window.unboundedPreceding, 0)


def fill(df: DataFrame, col: str, direction: str = "forward", row: str = ROW, by: list[str] | None = None) -> DataFrame:
    """Each null of col takes the last value before it (or the first after it) by row; leading (trailing) ones stay."""
    forward, by = direction == "forward", by or []
    pick, sort = (F.max_by, F.col) if forward else (F.min_by, F.desc)
    if not by:
        carry = _carried(df, {"__c": F.col(col)}, row, forward)
        out = df.withColumn("__b", _bucket(row)).join(carry, "__b")
        return out.withColumn(col, F.coalesce(F.last(col, ignorenulls=True).over(_running(forward, row, "__b")), "__c")).drop("__b", "__c")
    # A group is cut into buckets of rows like the table; a bucket gets the last value of the group's buckets before it.
    each = df.groupBy(*by, _bucket(row).alias("__b")).agg(pick(col, F.when(F.col(col).isNotNull(), F.col(row))).alias("__c"))
    before = Window.partitionBy(*by).orderBy(sort("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.col("__b").alias("__at"), F.last("__c", ignorenulls=True).over(before).alias("__c"))
    out = df.withColumn("__b", _bucket(row))
    same = F.col("__b") == F.col("__at")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = out.join(carry, same).withColumn(col, F.coalesce(F.last(col, ignorenulls=True).over(_running(forward, row, *by, "__b")), "__c"))
    return out.select(*df.columns)


def interpolate(df: DataFrame, col: str, row: str = ROW) -> DataFrame:
    """Linear by position; leading nulls stay, trailing ones take the last value."""
    at = F.when(F.col(col).isNotNull(), F.struct(F.col(row).alias("p"), F.col(col).cast("double").alias("v")))
    df = df.withColumn("__at", at)
    back = _carried(df, {"__cb": F.col("__at")}, row, True)
    ahead = _carried(df, {"__ca": F.col("__at")}, row, False)
    out = df.withColumn("__b", _bucket(row)).join(back, "__b").join(ahead, "__b")
    out = out.withColumn("__p", F.coalesce(F.last("__at", True).over(_running(True, row, "__b")), "__cb"))
    out = out.withColumn("__q", F.coalesce(F.last("__at", True).over(_running(False, row, "__b")), "__ca"))
    p, q = F.col("__p"), F.col("__q")
    step = (q["v"] - p["v"]) * (F.col(row) - p["p"]) / (q["p"] - p["p"])
    value = F.when(F.col(col).isNotNull(), F.col(col).cast("double")).when(q.isNull(), p["v"]).when(p.isNotNull(), p["v"] + step)
    return out.withColumn(col, value).drop("__at", "__b", "__cb", "__ca", "__p", "__q")


def rolling_mean(df: DataFrame, col: str, window: int, out: str, row: str = ROW) -> DataFrame:
    """Mean of the last window rows; null until there are so many, or where one of them is null.

    The last window - 1 rows of a bucket also go to the next one, so no bucket needs another.
    """
    b = F.col(row) % BUCKET
    own = F.struct(_bucket(row).alias("b"), F.lit(False).alias("guest"))
    guest = F.struct((_bucket(row) + 1).alias("b"), F.lit(True).alias("guest"))
    spread = df.withColumn("__at", F.explode(F.when(b >= BUCKET - window + 1, F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy("__at.b").orderBy(row).rowsBetween(1 - window, 0)
    mean = F.when(F.count(col).over(w) == window, F.avg(col).over(w))
    return spread.withColumn(out, mean).filter(~F.col("__at.guest")).drop("__at")


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str | list[str], name: str | list[str], total: str | None = None) -> DataFrame:
    """df, which has one row for each (keys, order), and the sum of value over the rows before in the same key; total is that of all of them.

    value and name may be lists, of several sums at once; total is of the first. Rows of all keys are ordered together by
    ranges, so a key with most of the rows is many tasks. Sums are long.
    """
    values, names = ([x] if isinstance(x, str) else list(x) for x in (value, name))
    both = list(zip(values, names, strict=True))
    at = with_row_id(df, *keys, *order, name="__r", unique=True).withColumn("__b", _bucket("__r"))
    sums = at.groupBy("__b").agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(values)])
    sums = settle(sums) if len(values) > 1 else sums
    run = lambda v: F.sum(v).over(Window.partitionBy("__b").orderBy("__r")) - F.col(v)
    out = at.withColumns({n: run(v) for v, n in both})
    for i in range(len(both)):
        out = out.join(_summed_before(sums.select("__b", f"__s{i}"), f"__s{i}", f"__skip{i}").select("__b", f"__skip{i}"), "__b")
    out = out.withColumns({n: (F.col(n) + F.col(f"__skip{i}")).cast("long") for i, n in enumerate(names)}).drop("__b", "__r", *[f"__skip{i}" for i in range(len(both))])
    if not keys:
        return out
    out = settle(out)
    start = out.groupBy(*keys).agg(*[F.min(n).alias(f"__start{i}") for i, n in enumerate(names)], *([F.sum(values[0]).alias(total)] if total else []))
    start = start.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__start{i}" for i in range(len(both))], *([total] if total else []))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = out.join(start, same).withColumns({n: F.col(n) - F.col(f"__start{i}") for i, n in enumerate(names)})
    return out.drop(*[f"__start{i}" for i in range(len(both))], *[f"__k{i}" for i in range(len(keys))])


def counted(df: DataFrame, col: str) -> DataFrame:
    """__v, __n, __upto: distinct non-null values, how often they are, and how many values there are up to and with them.

    Values are counted before they are ordered, so a frequent value is one row.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    return prefix_sums(counts, [], ["__v"], "__n", "__upto").select("__v", "__n", (F.col("__upto") + F.col("__n")).alias("__upto"))


def each_place(values: DataFrame, name: str, step: int = 1 << 12) -> DataFrame:
    """counted() values with a row for each place (from 1) that they take, dealt over many tasks."""
    first = F.col("__upto") - F.col("__n") + 1
    parts = values.withColumn("__from", F.explode(F.sequence(first, F.col("__upto"), F.lit(step).cast("long")))).repartition("__from")
    return parts.withColumn(name, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + step - 1, "__upto")))).drop("__from")


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """value and (position from 1) / n for every non-null value."""
    at = counted(df, col)
    n = at.agg(F.sum("__n").alias("n"))
    return each_place(at, "i").join(F.broadcast(n)).select(F.col("__v").alias("value"), (F.col("i") / F.col("n")).alias("ecdf"))


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """df with the average rank of col among its non-null values."""
    ranks = counted(df, col).select("__v", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return df.join(ranks, F.col(col) == F.col("__v"), "left").drop("__v")


def rows_at(df: DataFrame, spec: str, keep: bool = True, row: str = ROW) -> DataFrame:
    """Rows at the positions of a text like "0, 3, 7-10", or all others; positions that don't exist are ignored."""
    test = F.lit(False)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        test = test | F.col(row).between(int(a), int(b or a))
    return df.filter(test if keep else ~test)


def head(df: DataFrame, n: int, row: str = ROW) -> DataFrame:
    return df.orderBy(row).limit(n)


def tail(df: DataFrame, n: int, row: str = ROW) -> DataFrame:
    return df.orderBy(F.desc(row)).limit(n)
