"""Scalar functions, dates, conditionals and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditional as cd
from ..functions import dates as dt
from ..functions import math as mt
from ..functions import text as tx
from .basic import NULLS, event_nulls
from .registry import query, r


@query("""select l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) as a, round(l_quantity - l_tax, 6) as s, round(l_quantity * l_tax, 6) as m, round(l_quantity / nullif(l_tax, 0), 4) as d, round(pow(l_quantity, 2), 4) as p,
    greatest(l_quantity, l_tax) as hi, least(l_quantity, l_tax) as lo, round((l_quantity + l_tax) / 2, 6) as mean from lineitem""")
def mth_1_binary(t):
    a, b = F.col("l_quantity"), F.col("l_tax")
    ops = {"a": "add", "s": "subtract", "m": "multiply", "hi": "max", "lo": "min", "mean": "mean"}
    return t("lineitem").select("l_orderkey", "l_linenumber", *[r(mt.binary(a, b, o)).alias(n) for n, o in ops.items()], r(mt.binary(a, b, "divide"), 4).alias("d"), r(mt.binary(a, F.lit(2), "power"), 4).alias("p"))


@query(f"select event_id, greatest({NULLS}, 20) as hi, coalesce({NULLS}, 0) + 20 as unused, round(case when ({NULLS}) is null then 20 else (({NULLS}) + 20) / 2 end, 6) as mean from events")
def mth_1_binary_skips_nulls(t):
    v, b = F.col("value"), F.lit(20.0)
    return event_nulls(t).select("event_id", mt.binary(v, b, "max").alias("hi"), (F.coalesce(v, F.lit(0.0)) + 20).alias("unused"), r(mt.binary(v, b, "mean")).alias("mean"))


@query("select p_partkey, pow(p_size, 2) as p_size_pow2, pow(p_size, 3) as p_size_pow3, pow(p_size, 4) as p_size_pow4 from part")
def mth_2_powers(t):
    return t("part").select("p_partkey", *[c.alias(n) for n, c in mt.powers("p_size", 4).items()])


@query("""with v as (select l_orderkey, l_linenumber, list_filter([l_quantity, case when l_linenumber % 3 <> 0 then l_discount end, l_tax], lambda x: x is not null) as v from lineitem)
    select l_orderkey, l_linenumber, round(list_sum(v), 6) as sum, round(list_avg(v), 6) as mean, round(list_median(v), 6) as median, list_min(v) as min, list_max(v) as max, round(list_stddev_samp(v), 6) as std, round(list_max(v) - list_min(v), 6) as range from v""")
def mth_3_row_wise(t):
    d = t("lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")))
    return d.select("l_orderkey", "l_linenumber", *[r(mt.row_wise(["l_quantity", "l_discount", "l_tax"], h)).alias(h) for h in ("sum", "mean", "median", "min", "max", "std", "range")])


@query("select l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) as l_quantity_multiply_l_discount, round(l_quantity * l_tax, 6) as l_quantity_multiply_l_tax, round(l_discount * l_tax, 6) as l_discount_multiply_l_tax from lineitem")
def mth_4_interactions(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", *[r(c).alias(n) for n, c in mt.interactions(["l_quantity", "l_discount", "l_tax"]).items()])


@query("""select c_custkey, round(ln(1 + c_acctbal - min(c_acctbal) over () + 1), 6) as log, round(sqrt(c_acctbal - min(c_acctbal) over ()), 6) as sqrt, round(sign(c_acctbal) * pow(abs(c_acctbal), 1.0 / 3), 6) as cbrt,
    round(1 / nullif(c_acctbal, 0), 8) as reciprocal, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as minmax, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) as zscore from customer""")
def mth_5_scaled(t):
    d = t("customer").select("c_custkey", "c_acctbal")
    for how in ("log", "sqrt", "cbrt", "reciprocal", "minmax", "zscore"):
        d = mt.scaled(d, "c_acctbal", how, how)
    return d.select("c_custkey", *[r(h).alias(h) for h in ("log", "sqrt", "cbrt", "minmax", "zscore")], r("reciprocal", 8).alias("reciprocal"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def mth_6_expression(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", r(mt.expression("l_extendedprice * (1 - l_discount)"), 4).alias("net"))


@query("""select p_partkey, p_brand || '-' || p_type as c, substr(p_name, 3, 4) as s, substr(p_name, 3) as rest, replace(p_brand, '#', '.') as rep, length(p_name) as n, upper(p_name) as u, lower(p_type) as l,
    (select string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ' order by i) from (select unnest(string_split(p_name, ' ')) as w, generate_subscripts(string_split(p_name, ' '), 1) as i)) as ti, p_name as st from part""")
def str_1_text_functions(t):
    n = F.col("p_name")
    padded = F.concat(F.lit(" \t　"), n, F.lit("\n "))
    return t("part").select("p_partkey", tx.concat(F.col("p_brand"), F.col("p_type"), sep="-").alias("c"), tx.substring(n, 2, 6).alias("s"), tx.substring(n, 2).alias("rest"), tx.replace(F.col("p_brand"), "#", ".").alias("rep"), F.length(n).cast("long").alias("n"), tx.apply(n, "upper").alias("u"), tx.apply(F.col("p_type"), "lower").alias("l"), tx.apply(n, "title").alias("ti"), tx.apply(padded, "strip").alias("st"))


@query("select p_partkey, upper(p_type) as p_type, p_name from part")
def str_2_standardise(t):
    return t("part").withColumn("p_type", tx.apply(F.col("p_type"), "upper")).select("p_partkey", "p_type", "p_name")


@query("select doc_id, sha256(regexp_replace(text, '[^\\p{L}\\p{N}\\p{M}_\\s]', '', 'g')) as no_punctuation, sha256(regexp_replace(text, '\\p{Nd}+', '', 'g')) as no_digits from documents".replace("\\\\", "\\"))
def str_3_remove(t):
    c = F.col("text")
    return t("documents").select("doc_id", F.sha2(tx.remove(c, "punctuation"), 256).alias("no_punctuation"), F.sha2(tx.remove(c, "digits"), 256).alias("no_digits"))


@query("select n_nationkey, case when n_nationkey % 4 <> 0 then n_name end as n_name from nation")
def str_4_trim(t):
    d = t("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("\t "), "n_name", F.lit("\r\n"))).alias("n_name"))
    return d.withColumn("n_name", tx.strip(F.col("n_name")))


@query("select p_partkey, p_brand || '_' || p_type as p_brand_x_p_type from part")
def str_5_interaction(t):
    return t("part").select("p_partkey", tx.concat(F.col("p_brand"), F.col("p_type"), sep="_").alias("p_brand_x_p_type"))


@query("""select o_orderkey, year(d) as year, month(d) as month, day(d) as day, dayofyear(d) as dayofyear, hour(d) as hour, minute(d) as minute, second(d) as second, isodow(d) - 1 as dayofweek, week(d) as week, quarter(d) as quarter
    from (select o_orderkey, o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) + to_seconds(o_orderkey % 59) as d from orders)""")
def dtm_1_parts(t):
    d = t("orders").selectExpr("o_orderkey", "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), cast(o_orderkey % 60 as int), o_orderkey % 59) as d")
    return d.select("o_orderkey", *[dt.part(F.col("d"), p).cast("long").alias(p) for p in ("year", "month", "day", "dayofyear", "hour", "minute", "second", "dayofweek", "week", "quarter")])


@query("""select o_orderkey, (isodow(d) >= 6)::int as is_weekend, (day(d) = 1)::int as is_month_start, (d = last_day(d))::int as is_month_end, (d = date_trunc('quarter', d))::int as is_quarter_start,
    (d = last_day(d) and month(d) % 3 = 0)::int as is_quarter_end, (dayofyear(d) = 1)::int as is_year_start, (month(d) = 12 and day(d) = 31)::int as is_year_end from (select o_orderkey, o_orderdate::date as d from orders)""")
def dtm_2_flags(t):
    return t("orders").select("o_orderkey", *[dt.part(F.col("o_orderdate"), p).alias(p) for p in ("is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end")])


@query("select o_orderkey, dayname(o_orderdate) as day_name, monthname(o_orderdate) as month_name, cast(day(last_day(o_orderdate)) as integer) as days_in_month from orders")
def dtm_3_names(t):
    return t("orders").select("o_orderkey", *[dt.part(F.col("o_orderdate"), p).alias(p) for p in ("day_name", "month_name", "days_in_month")])


@query("""select event_id, cast(floor(epoch_us(ts) / 86400000000.0 - epoch_us(timestamp '2024-01-15 12:00:00') / 86400000000.0) as bigint) as days, round((epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) / 3600000000.0, 6) as hours,
    round((epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) / 60000000.0, 4) as minutes, round((epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')) / 1000000.0, 3) as seconds from events""")
def dtm_4_difference(t):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    d = lambda u: dt.difference(F.col("ts"), at, u)
    return t("events").select("event_id", d("days").alias("days"), r(d("hours")).alias("hours"), r(d("minutes"), 4).alias("minutes"), r(d("seconds"), 3).alias("seconds"))


@query("select o_orderkey, cast(o_orderdate + interval 30 day as timestamp) as due from orders")
def dtm_5_add_days(t):
    return t("orders").select("o_orderkey", dt.add_days(F.col("o_orderdate"), 30).alias("due"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%d/%m/%Y') as eu, strftime(o_orderdate, '%m/%d/%Y') as us, strftime(o_orderdate, '%d %b %Y') as words, strftime(o_orderdate, '%b %Y') as month, strftime(o_orderdate, '%Y/%m/%d') as slashes from orders")
def dtm_6_format(t):
    f = {"iso": "%Y-%m-%d", "eu": "%d/%m/%Y", "us": "%m/%d/%Y", "words": "%d %b %Y", "month": "%b %Y", "slashes": "%Y/%m/%d"}
    return t("orders").select("o_orderkey", *[dt.formatted(F.col("o_orderdate"), p).alias(n) for n, p in f.items()])


@query(f"select event_id, case when coalesce({NULLS} > 40, false) then 'high' else 'low' end as a, case when ({NULLS}) is distinct from 10 then 1.0::double else 0.0::double end as b, case when event_type ilike '%ic%' then 'y' else 'n' end as c from events")
def cnd_1_if_else(t):
    return event_nulls(t).select("event_id", cd.if_else("value", ">", 40, "high", "low").alias("a"), cd.if_else("value", "!=", 10.0, "1", "0").alias("b"), cd.if_else("event_type", "contains", "ic", "y", "n").alias("c"))


@query("select event_id, case when value > 60 then 'top' when value > 20 then 'mid' when event_type = 'click' then 'click' else 'rest' end as label, case when value > 60 then 3.0::double when value > 20 then 2.0::double else 1.0::double end as num from events")
def cnd_2_rules(t):
    a = cd.rules([("value", ">", 60, "top"), ("value", ">", 20, "mid"), ("event_type", "=", "click", "click")], "rest")
    return t("events").select("event_id", a.alias("label"), cd.rules([("value", ">", 60, "3"), ("value", ">", 20, "2")], "1").alias("num"))


@query("""select event_id, cast(case when value <= a + s then 0 when value <= a + 2 * s then 1 when value <= a + 3 * s then 2 when value <= a + 4 * s then 3 else 4 end as integer) as bin
    from events, (select min(value) as a, (max(value) - min(value)) / 5 as s from events)""")
def cnd_3_equal_width(t):
    return cd.equal_width(t("events"), "value", 5, "bin").select("event_id", "bin")


@query("with q as (select quantile_cont(value, [0.25, 0.5, 0.75]) as q from events) select event_id, cast((value > q[1])::int + (value > q[2])::int + (value > q[3])::int as integer) as bin from events, q")
def cnd_4_equal_frequency(t):
    return cd.equal_frequency(t("events"), "value", 4, "bin").select("event_id", "bin")


@query("select event_id, case when value between 10 and 20 then 'a' when value > 20 and value <= 50 then 'b' when value > 50 and value <= 80 then 'c' end as bin from events")
def cnd_5_custom_bins(t):
    return t("events").select("event_id", cd.custom_bins("value", [10, 20, 50, 80], ["a", "b", "c"]).alias("bin"))


# The ratio of the names of two nations of a region, of another implementation, by name.
RATIOS = """('NATION_0', 'NATION_10', 0.941176), ('NATION_0', 'NATION_15', 0.823529), ('NATION_0', 'NATION_20', 0.941176), ('NATION_0', 'NATION_5', 0.875), ('NATION_1', 'NATION_11', 0.941176), ('NATION_1', 'NATION_16', 0.941176), ('NATION_1', 'NATION_21', 0.941176), ('NATION_1', 'NATION_6', 0.875), ('NATION_10', 'NATION_15', 0.888889), ('NATION_10', 'NATION_20', 0.888889), ('NATION_10', 'NATION_5', 0.823529), ('NATION_11', 'NATION_16', 0.888889), ('NATION_11', 'NATION_21', 0.888889), ('NATION_11', 'NATION_6', 0.823529), ('NATION_12', 'NATION_17', 0.888889), ('NATION_12', 'NATION_2', 0.941176), ('NATION_12', 'NATION_22', 0.888889), ('NATION_12', 'NATION_7', 0.823529), ('NATION_13', 'NATION_18', 0.888889), ('NATION_13', 'NATION_23', 0.888889), ('NATION_13', 'NATION_3', 0.941176), ('NATION_13', 'NATION_8', 0.823529), ('NATION_14', 'NATION_19', 0.888889), ('NATION_14', 'NATION_24', 0.888889), ('NATION_14', 'NATION_4', 0.941176), ('NATION_14', 'NATION_9', 0.823529), ('NATION_15', 'NATION_20', 0.777778), ('NATION_15', 'NATION_5', 0.941176), ('NATION_16', 'NATION_21', 0.888889), ('NATION_16', 'NATION_6', 0.941176), ('NATION_17', 'NATION_2', 0.823529), ('NATION_17', 'NATION_22', 0.777778), ('NATION_17', 'NATION_7', 0.941176), ('NATION_18', 'NATION_23', 0.777778), ('NATION_18', 'NATION_3', 0.823529), ('NATION_18', 'NATION_8', 0.941176), ('NATION_19', 'NATION_24', 0.777778), ('NATION_19', 'NATION_4', 0.823529), ('NATION_19', 'NATION_9', 0.941176), ('NATION_2', 'NATION_22', 0.941176), ('NATION_2', 'NATION_7', 0.875), ('NATION_20', 'NATION_5', 0.823529), ('NATION_21', 'NATION_6', 0.823529), ('NATION_22', 'NATION_7', 0.823529), ('NATION_23', 'NATION_3', 0.941176), ('NATION_23', 'NATION_8', 0.823529), ('NATION_24', 'NATION_4', 0.941176), ('NATION_24', 'NATION_9', 0.823529), ('NATION_3', 'NATION_8', 0.875), ('NATION_4', 'NATION_9', 0.875)"""


@query(f"select a, b, s::double as score from (values {RATIOS}) as v(a, b, s)")
def sim_1_similarity(t):
    from ..functions.similarity import similarity

    a = t("nation").select(F.col("n_name").alias("a"), "n_regionkey")
    return a.join(a.withColumnRenamed("a", "b"), "n_regionkey").filter("a < b").select("a", "b", r(similarity(F.col("a"), F.col("b"))).alias("score"))
