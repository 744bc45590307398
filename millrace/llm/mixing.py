"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and MOST, those that meet every source's token target while staying closest (in
relative entropy) to taking each document once are exponentially tilted: rate = min(MOST, exp(l * size / mean size)),
with one multiplier l for each source. The multipliers solve the convex dual

    minimise  sum over documents of  G(l * size / mean)  -  l * target / mean,      G' = rate,

by safeguarded Newton steps. A step needs, for every source, the dual's gradient and curvature: one aggregation over a
histogram (source, size, documents), which is all that the dual depends on. All sources step at once.

Rates are then rounded into whole copies. Each document takes floor(rate) copies and one more if its pseudo-random key
is below its source's threshold. Thresholds are found by narrowing buckets of keys, sums of tokens each time, for large
documents first, so that what these leave is made up for by smaller ones.

Sources may be many: what is known of each (target, multiplier, bounds, thresholds) is a table in the shared folder that
each step makes anew from the one before. Only counts, and the one level of the water-filling that sets targets, reach the
driver; documents stay in three narrow columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, free_name, settle
from ..operators.ordered import with_row_id

MOST = 2
#: Newton steps at most (each is one aggregation), and the relative error of a source's tokens that ends them.
STEPS, ERROR = 60, 1e-7
#: Newton steps that are taken in one job.
CHAIN = 5
#: Documents of more than these shares of their target are rounded first.
TIERS = (1 / 4, 1 / 8, 1 / 16, 1 / 32, 1 / 64, 1 / 256)
#: Keys have 33 bits, narrowed 11 at a time.
KEY_BITS, BUCKET_BITS = 33, 11
#: Up to so many sources (of 40 bytes) their parameters are broadcast; beyond, they are joined by a shuffle.
SMALL = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = MOST) -> DataFrame:
    """sources(source, s) with k, a number from 0 by code point (null last), and target.

    Targets are share of all sizes by weight, the weights repeating. No target is above most times its source's size; what
    is above goes to the others by weight, until none is: weight * unit, or the limit, for one unit that only grows.
    """
    at = with_row_id(sources.withColumn("null_last", F.col("source").isNull()), "null_last", "source", name="k", unique=True).drop("null_last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    at = settle(at.withColumn("weight", weight))
    limit, unit, before = F.col("s") * F.lit(float(most)), 0.0, None
    while before != unit:
        before = unit
        full = F.col("weight") * F.lit(unit) > limit
        sums = at.agg(F.sum("s").alias("all"), F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if sums["free"]:
            unit = max(unit, (share * sums["all"] - (sums["full"] or 0.0)) / sums["free"])
    return at.withColumn("target", F.least(F.col("weight") * F.lit(unit), limit)).drop("weight")


def _at(df: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """df with the columns of state, which has one row for each k."""
    return df.join(F.broadcast(state) if few else state, "k")


def multipliers(hist: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """k, l: the dual's multiplier of each k of goals(k, target, mean), for hist(k, size, n).

    A step that leaves the interval known to hold the root is replaced by bisection.
    """
    c, inf = F.col, F.lit(math.inf)
    z = c("size") / c("mean")
    tilt = F.exp(F.least(c("l") * z, F.lit(50.0)))
    tokens = c("n") * c("size")
    names = ("target", "mean", "l", "low", "high", "done")
    state = goals.select("k", "target", "mean", F.lit(0.0).alias("l"), (-inf).alias("low"), inf.alias("high"), F.lit(False).alias("done"))

    def stepped(state: DataFrame) -> DataFrame:
        sums = _at(hist, state, few).groupBy("k").agg(F.sum(tokens * F.least(tilt, F.lit(float(MOST)))).alias("got"), F.sum(F.when(tilt < MOST, tokens * z * tilt).otherwise(0.0)).alias("slope"), *[F.first(x).alias(x) for x in names])
        gap = c("got") - c("target")
        near = c("done") | (F.abs(gap) <= F.greatest(F.lit(ERROR) * c("target"), F.lit(1e-6)))
        new = sums.withColumn("low", F.when(gap > 0, c("low")).otherwise(c("l"))).withColumn("high", F.when(gap > 0, c("l")).otherwise(c("high")))
        newton = c("l") - F.try_divide(gap, c("slope"))
        bounded = (c("low") > -inf) & (c("high") < inf)
        halved = F.when(bounded, (c("low") + c("high")) / 2).when(c("low") > -inf, c("low") + 1 + F.abs("low")).otherwise(c("high") - 1 - F.abs("high"))
        step = F.when((c("slope") > 0) & (newton > c("low")) & (newton < c("high")), newton).otherwise(halved)
        return new.select("k", "target", "mean", F.when(near, c("l")).otherwise(step).alias("l"), "low", "high", (near | (step == c("l"))).alias("done"))

    found = []
    for _ in range(0, STEPS, CHAIN):
        for _ in range(CHAIN):  # a source that is done stays as it is
            state = stepped(state)
        state = settle(state)
        found.append(state.filter("done").select("k", "l"))
        state = state.filter("not done")
        if state.isEmpty():
            break
    else:
        found.append(state.select("k", "l"))
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    # Ten digits: sums in another order give the same.
    return out.select("k", F.format_string("%.9e", "l").cast("double").alias("l"))


def _key(doc_id: Column, source: Column, rate: Column) -> Column:
    """33 bits: a pseudo-random number less the rate's fraction. Documents below 1/2 take one more copy, on the average."""
    u = F.pmod(F.xxhash64(F.lit("mix"), doc_id, source), F.lit(1 << 32))
    return (u - F.floor((rate - F.floor(rate)) * F.lit(float(1 << 32))) + F.lit(1 << 32)).cast("long")


def _thresholds(tier: DataFrame, extra: DataFrame, few: bool) -> DataFrame:
    """k, cut, tokens for tier(k, size, key) and extra(k, extra): the key below which documents take one more copy, and their tokens.

    These are extra up to half a document, or all there are. k without rows in tier are missing. Each narrowing works on what the one
    before found, all in one plan.
    """
    c = F.col
    state = extra.filter("extra > 0").select("k", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below"), "extra", F.lit(None).cast("long").alias("upto"), F.lit(False).alias("all"))
    for shift in range(KEY_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        # all: every document is too few; nothing is left to narrow.
        inside = _at(tier, state, few).filter(c("all") | (F.shiftright("key", shift + BUCKET_BITS) == F.shiftright("lo", shift + BUCKET_BITS)))
        kept = [F.first(x).alias(x) for x in ("below", "extra", "upto", "all")]
        sums = inside.groupBy("k", F.when(c("all"), 0).otherwise(F.shiftright("key", shift)).alias("b")).agg(F.sum("size").alias("s"), *kept)
        w = Window.partitionBy("k").orderBy("b")  # 2 ** BUCKET_BITS rows at most
        run = sums.withColumn("run", c("below") + F.sum("s").over(w))
        cut = run.groupBy("k").agg(F.min(F.when(c("run") >= c("extra"), F.struct("b", "run", "s"))).alias("c"), F.max("run").alias("every"), F.first("extra").alias("extra"), F.first("upto").alias("upto"), F.first("all").alias("was"))
        short = c("was") | c("c").isNull()
        state = cut.select("k", F.when(short, 0).otherwise(F.shiftleft("c.b", shift)).alias("lo"), F.when(short, 0).otherwise(c("c.run") - c("c.s")).alias("below"), "extra", F.when(c("was"), c("upto")).when(c("c").isNull(), c("every")).otherwise(c("c.run")).alias("upto"), short.alias("all"))
    more = c("upto") - c("extra") < c("extra") - c("below")  # the nearer side of the last document
    cut, tokens = F.when(more, c("lo") + 1).otherwise(c("lo")), F.when(more, c("upto")).otherwise(c("below"))
    return state.select("k", F.when(c("all"), F.lit(1 << KEY_BITS)).otherwise(cut).alias("cut"), F.when(c("all"), c("upto")).otherwise(tokens).alias("tokens"))


def plan(docs: DataFrame, **kw) -> tuple[DataFrame, DataFrame, bool]:
    """Narrow rows (doc_id, source, size) of docs, what assign() needs of each source, and whether sources are few."""
    c = F.col
    rows = settle(docs.select("doc_id", "source", words(c("text")).alias("size")))
    info = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("docs")), **kw))
    few = info.limit(SMALL + 1).count() <= SMALL
    named = _named(rows, info.select("k", c("source").alias("src")), few)
    keyed = settle(named.select("k", *rows.columns))
    hist = settle(keyed.groupBy("k", "size").agg(F.count("*").alias("n")))
    # At the limit of a target the multiplier is infinite: every document is taken MOST times. Without tokens any rate does.
    inner = (c("target") > 0) & (c("target") < c("s") * (MOST * (1 - 1e-12)))
    mean = (c("s") / c("docs")).alias("mean")
    lam = multipliers(hist, info.filter(inner).select("k", "target", mean), few)
    par = info.join(lam, "k", "left").select("k", c("source").alias("src"), c("s").alias("source_size"), "target", "l", F.when(c("l").isNotNull(), c("s") / c("docs")).otherwise(1.0).alias("mean"), F.when(c("l").isNotNull() | (c("s") == 0), 1.0).otherwise(float(MOST)).alias("fixed"))
    par = settle(par)
    at = _at(keyed, par.drop("src"), few)
    rated = settle(_rated(at).filter("l is not null").select("k", "size", "tier", "rate", _key(c("doc_id"), c("source"), c("rate")).alias("key")))
    fraction = F.floor(c("size") * (c("rate") - F.floor("rate")) * 1024)
    sums = settle(rated.groupBy("k", "tier").agg(F.sum(c("size") * F.floor("rate")).alias("base"), F.sum(fraction).alias("more"), F.max((c("rate") < MOST) & (c("size") > 0)).alias("open")))
    tiers = sorted(r["tier"] for r in sums.filter("open").select("tier").distinct().collect())  # of len(TIERS) + 1
    left = par.filter("l is not null").select("k", "target").join(sums.groupBy("k").agg(F.sum("base").alias("base")), "k").select("k", (c("target") - c("base")).alias("left"))
    cuts = None
    for t in tiers:
        later = sums.groupBy("k").agg((F.sum(F.when(c("tier") > t, c("more")).otherwise(0)) / 1024).alias("later"), F.max(c("tier") == t).alias("here"))
        extra = left.join(later, "k").filter("here").select("k", (c("left") - c("later")).alias("extra"))
        got = settle(_thresholds(rated.filter((c("tier") == t) & (c("rate") < MOST) & (c("size") > 0)), extra, few))
        left = left.join(got.select("k", "tokens"), "k", "left").select("k", (c("left") - F.coalesce("tokens", F.lit(0))).alias("left"))
        one = got.select("k", F.struct(F.lit(t).alias("tier"), "cut").alias("x"))
        cuts = one if cuts is None else cuts.unionByName(one)
    if cuts is None:
        return rows, par.withColumn("cuts", F.lit(None).cast("map<int, bigint>")), few
    maps = cuts.groupBy("k").agg(F.map_from_entries(F.collect_list("x")).alias("cuts"))
    return rows, settle(par.join(maps, "k", "left")), few


def _named(df: DataFrame, par: DataFrame, few: bool) -> DataFrame:
    """df joined by its source (null-safe) with par, which has one row for each src."""
    return df.join(F.broadcast(par) if few else par, df["source"].eqNullSafe(par["src"]))


def _rated(df: DataFrame) -> DataFrame:
    """The columns rate and tier, from those that plan() finds for each source."""
    rate = F.least(F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.lit(50.0))), F.lit(float(MOST)))
    tier = F.lit(0)
    for share in TIERS:
        tier = tier + (F.col("size") <= F.col("target") * share).cast("int")
    return df.withColumn("rate", F.when(F.col("l").isNull(), F.col("fixed")).otherwise(rate)).withColumn("tier", tier)


def _copies() -> Column:
    cut = F.coalesce(F.try_element_at("cuts", F.col("tier")), F.lit(0))
    more = (F.col("rate") < MOST) & (_key(F.col("doc_id"), F.col("source"), F.col("rate")) < cut)
    return (F.floor("rate") + more.cast("int")).cast("int")


def assign(rows: DataFrame, par: DataFrame, few: bool) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken for rows(doc_id, source, size); a map over the rows where sources are few."""
    at = _rated(_named(rows, par, few))
    copies = _copies()
    return at.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, rate, copies, taken.

    size counts the words of the whole text (null: 0). Targets are those of targets(); each source's sum of taken comes
    near its target, within half a document of its smallest tier where it has such documents. A null source is a source
    like others, the last in order. Rows that agree in doc_id, source and size are taken equally often. A source without
    words has target 0. An empty table gives no rows.
    """
    return assign(*plan(docs, **kw))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: every row of docs as often as mixture() says, with its columns, whatever their names.

    Nulls, repeated rows and empty tables are as in mixture(). Where sources are few, texts aren't shuffled.
    """
    _, par, few = plan(docs, **kw)
    box, = free_name(docs, "box__")
    at = docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"), F.struct(*columns(docs)).alias(box))
    full = _rated(_named(at, par, few))
    return full.select(box, F.explode(F.array_repeat(F.lit(0), _copies()))).select(f"{box}.*")
