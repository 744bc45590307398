"""Missing values, replacement, outliers, types and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..operators import ordered as o
from ..operators import reshape as rs
from ..operators import types as ty
from .basic import MIXED, NULLS, event_nulls, mixed_strings
from .registry import query, r

DATES = "case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d') when 1 then strftime(ts, '%d/%m/%Y') else strftime(ts, '%d.%m.%Y') end"


def date_strings(t):
    f = F.date_format
    m = F.col("event_id") % 3
    return t("events").select("event_id", F.when(m == 0, f("ts", "yyyy-MM-dd")).when(m == 1, f("ts", "dd/MM/yyyy")).otherwise(f("ts", "dd.MM.yyyy")).alias("d"), "ts")


def ordered_nulls(t):
    return o.with_row_id(event_nulls(t).select("event_id", "value"), "event_id")


@query(f"select event_id, case when v in ('-', 'NA', 'N/A', 'null', 'NULL', '') then null else v end as v from (select event_id, {MIXED} as v from events)")
def mis_1_tokens_to_null(t):
    return cl.tokens_to_null(mixed_strings(t))


@query(f"select event_id, round(coalesce({NULLS}, (select avg({NULLS}) from events)), 6) as value from events")
def mis_2_fill_mean(t):
    return cl.fill_missing(event_nulls(t), "value", "mean").select("event_id", r("value").alias("value"))


@query(f"select event_id, coalesce({NULLS}, (select median({NULLS}) from events)) as value from events")
def mis_2_fill_median(t):
    return cl.fill_missing(event_nulls(t), "value", "median").select("event_id", "value")


@query("""with e as (select event_id, case when event_id % 11 = 0 then null else event_type end as event_type from events), c as (select event_type, count(*) as n from e where event_type is not null group by 1)
    select event_id, coalesce(event_type, (select event_type from c order by n desc, event_type limit 1)) as event_type from e""")
def mis_2_fill_mode(t):
    d = t("events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"))
    return cl.fill_missing(d, "event_type", "mode")


@query(f"select event_id, coalesce({NULLS}, -1) as value from events")
def mis_2_fill_constant(t):
    return cl.fill_missing(event_nulls(t), "value", "constant", -1.0).select("event_id", "value")


@query(f"select event_id, round(coalesce({NULLS}, avg({NULLS}) over (partition by event_type)), 6) as value from events")
def mis_3_fill_mean_by_group(t):
    return cl.fill_missing_by(event_nulls(t), "value", "event_type", "mean").select("event_id", r("value").alias("value"))


@query(f"select event_id, coalesce({NULLS}, median({NULLS}) over (partition by event_type)) as value from events")
def mis_3_fill_median_by_group(t):
    return cl.fill_missing_by(event_nulls(t), "value", "event_type", "median").select("event_id", "value")


@query("""with e as (select p_partkey, p_brand, case when p_partkey % 7 = 0 then null else p_type end as p_type from part),
    n as (select p_brand, p_type, count(*) as n from e where p_type is not null group by 1, 2), c as (select p_brand, p_type, row_number() over (partition by p_brand order by n desc, p_type) as i from n)
    select p_partkey, coalesce(e.p_type, c.p_type) as p_type from e left join c on e.p_brand = c.p_brand and c.i = 1""")
def mis_3_fill_mode_by_group(t):
    d = t("part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("p_type"))
    return cl.fill_missing_by(d, "p_type", "p_brand", "mode").select("p_partkey", "p_type")


@query(f"select event_id, last_value({NULLS} ignore nulls) over (order by event_id rows between unbounded preceding and current row) as value from events")
def win_3_forward_fill(t):
    return o.fill(ordered_nulls(t), "value", "forward").select("event_id", "value")


@query(f"select event_id, first_value({NULLS} ignore nulls) over (order by event_id rows between current row and unbounded following) as value from events")
def win_3_backward_fill(t):
    return o.fill(ordered_nulls(t), "value", "backward").select("event_id", "value")


@query(f"""with e as (select event_id, {NULLS} as v, row_number() over (order by event_id) as i from events),
    w as (select *, last_value(case when v is not null then i end ignore nulls) over (order by i rows between unbounded preceding and current row) as p, last_value(v ignore nulls) over (order by i rows between unbounded preceding and current row) as pv,
      first_value(case when v is not null then i end ignore nulls) over (order by i rows between current row and unbounded following) as q, first_value(v ignore nulls) over (order by i rows between current row and unbounded following) as qv from e)
    select event_id, round(case when v is not null then v when q is null then pv when p is not null then pv + (qv - pv) * (i - p) / (q - p) end, 6) as value from w""")
def win_4_interpolate(t):
    return o.interpolate(ordered_nulls(t), "value").select("event_id", r("value").alias("value"))


@query("select event_id, round(case when count(value) over w = 7 then avg(value) over w end, 6) as rolling from events window w as (order by event_id rows between 6 preceding and current row)")
def win_1_rolling_mean(t):
    d = o.with_row_id(t("events").select("event_id", "value"), "event_id")
    return o.rolling_mean(d, "value", 7, "rolling").select("event_id", r("rolling").alias("rolling"))


def _group(how: str, sql: str) -> None:
    def f(t):
        return cl.group_statistic(t("events"), "value", "event_type", how, "stat").select("event_id", r("stat", 4).alias("stat"))

    f.__name__ = f"win_2_group_{how}"
    query(f"select event_id, round({sql} over (partition by event_type), 4)::double as stat from events")(f)


for _how, _sql in (("mean", "avg(value)"), ("median", "median(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("std", "stddev_samp(value)"), ("count", "count(value)")):
    _group(_how, _sql)


@query("select p_partkey, case when p_size = 7 then null else cast(p_size as double) end as p_size, case when p_type = 'ECONOMY' then 'Cheap' else p_type end as p_type from part")
def rpl_1_replace_cells(t):
    d = t("part").select("p_partkey", "p_size", "p_type")
    return cl.replace_cells(cl.replace_cells(d, "p_size", "7", ""), "p_type", "ECONOMY", "Cheap")


@query("select p_partkey, regexp_replace(p_name, 'a', '$1.', 'gi') as p_name, regexp_replace(p_brand, '[0-9]+', '#', 'g') as p_brand from part")
def rpl_2_replace_text(t):
    d = cl.replace_text(t("part"), "p_name", "A", "$1.")
    return cl.replace_text(d, "p_brand", "[0-9]+", "#", regex=True, case=True).select("p_partkey", "p_name", "p_brand")


@query("select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else o_orderstatus end as o_orderstatus from orders")
def rpl_3_map_values(t):
    return cl.map_values(t("orders"), "o_orderstatus", [("O", "open"), ("F", "filled")]).select("o_orderkey", "o_orderstatus")


FENCE = "with f as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)"


@query(f"{FENCE} select event_id, value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) as is_outlier from events, f")
def out_1_iqr(t):
    return cl.flag_outliers(t("events"), "value", "iqr").select("event_id", "is_outlier")


@query("select event_id, abs((value - avg(value) over ()) / stddev_samp(value) over ()) > 2 as is_outlier from events")
def out_2_zscore(t):
    return cl.flag_outliers(t("events"), "value", "zscore", 2.0).select("event_id", "is_outlier")


@query("select event_id, abs((value - avg(value) over ()) / stddev_pop(value) over ()) > 3 as is_outlier from events")
def out_2_zscore_population(t):
    return cl.flag_outliers(t("events"), "value", "zscore_pop").select("event_id", "is_outlier")


@query("""with m as (select median(value) as m from events), d as (select median(abs(value - m)) as d from events, m)
    select event_id, abs(0.6745 * (value - m) / d) > 3.5 as is_outlier from events, m, d""")
def out_3_modified_z(t):
    return cl.flag_outliers(t("events"), "value", "modified_z").select("event_id", "is_outlier")


@query("select event_id, value < 5 or value > 60 as is_outlier from events")
def out_4_bounds(t):
    return cl.flag_outliers(t("events"), "value", "bounds", lower=5, upper=60).select("event_id", "is_outlier")


@query(f"{FENCE} select event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) as value from events, f")
def out_5_cap(t):
    return cl.cap_outliers(t("events"), "value").select("event_id", r("value").alias("value"))


@query("""with s as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events), e as (select min(value) as lo, max(value) as hi from s where i = floor(n * 0.05) or i = n - floor(n * 0.05) - 1)
    select event_id, greatest(least(value, hi), lo) as value from events, e""")
def out_6_winsorize(t):
    return cl.winsorize(t("events"), "value").select("event_id", "value")


@query(f"{FENCE} select event_id, value from events, f where not (value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a))")
def flt_8_drop_outliers(t):
    return cl.drop_outliers(t("events"), "value").select("event_id", "value")


@query(f"select event_id, cast(v as bigint) as v, true as ok from (select event_id, {MIXED} as v from events) where try_cast(v as bigint) is not null union all select event_id, null, false from (select event_id, {MIXED} as v from events) where try_cast(v as bigint) is null")
def typ_1_convert_or_quarantine(t):
    good, bad = ty.convert_or_quarantine(mixed_strings(t), "v", "int64")
    return good.withColumn("ok", F.lit(True)).unionByName(bad.select("event_id", F.lit(None).cast("long").alias("v"), F.lit(False).alias("ok")))


@query("select event_id, cast(round_even(value, 0) as bigint) as i, cast(cast(value as varchar) as double) as f, case when event_id % 3 = 0 then true when event_id % 3 = 1 then false end as b from events")
def typ_2_convert(t):
    word = F.when(F.col("event_id") % 3 == 0, " Yes").when(F.col("event_id") % 3 == 1, "INACTIVE").otherwise("maybe")
    return t("events").select("event_id", ty.convert(F.col("value"), "int").alias("i"), ty.convert(F.col("value").cast("string"), "float").alias("f"), ty.convert(word, "boolean").alias("b"))


@query("select event_id, cast(event_id as double) as num, cast(ts::date as timestamp) as d, event_type from events")
def typ_3_auto_convert(t):
    d = t("events").select("event_id", F.col("event_id").cast("string").alias("num"), F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type")
    return ty.auto_convert(d)


@query("select * from (values ('d', 'datetime64'), ('num', 'float64'), ('event_type', 'category')) as v(column_name, suggestion)")
def typ_4_suggest_types(t):
    d = t("events").select(F.col("event_id").cast("string").alias("num"), F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type")
    return t("events").sparkSession.createDataFrame(list(ty.suggest_types(d).items()), "column_name string, suggestion string")


@query(f"select 'v' as column_name where (select avg((try_cast(v as double) is not null)::int) from (select {MIXED} as v from events)) >= 0.5")
def typ_5_numeric_like(t):
    d = mixed_strings(t).withColumn("w", F.lit("x"))
    return t("events").sparkSession.createDataFrame([(c,) for c in ty.numeric_like(d)], "column_name string")


@query(f"select event_id, {DATES} as d, case event_id % 3 when 0 then '%Y-%m-%d' when 1 then (case when day(ts) > 12 then '%d/%m/%Y' else '%d/%m/%Y' end) else '%d.%m.%Y' end as f from events")
def dtm_7_detect_format(t):
    from ..functions.dates import detect_format

    return date_strings(t).select("event_id", "d", detect_format(F.col("d")).alias("f"))


@query(f"select event_id, cast(ts::date as timestamp) as parsed from (select event_id, ts, {DATES} as d from events)")
def dtm_8_parse_any(t):
    from ..functions.dates import parse_any

    return date_strings(t).select("event_id", parse_any(F.col("d")).alias("parsed"))


@query("""select l_returnflag, round(coalesce(sum(l_quantity) filter (l_linestatus = 'F'), 0), 2) as F, round(coalesce(sum(l_quantity) filter (l_linestatus = 'O'), 0), 2) as O from lineitem group by 1""")
def rsh_1_pivot_sum(t):
    d = rs.pivot(t("lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_quantity"], "sum")
    return d.select("l_returnflag", r("F", 2).alias("F"), r("O", 2).alias("O"))


@query("""select l_returnflag, round(avg(l_quantity) filter (l_linestatus = 'F'), 6) as l_quantity_F, round(avg(l_quantity) filter (l_linestatus = 'O'), 6) as l_quantity_O, round(avg(l_tax) filter (l_linestatus = 'F'), 6) as l_tax_F,
    round(avg(l_tax) filter (l_linestatus = 'O'), 6) as l_tax_O from lineitem group by 1""")
def agg_2_pivot_mean_several(t):
    d = rs.pivot(t("lineitem"), ["l_returnflag"], ["l_linestatus"], ["l_quantity", "l_tax"], "mean")
    return d.select("l_returnflag", *[r(c).alias(c) for c in d.columns[1:]])


@query("select l_returnflag, l_linestatus, count(*) as rows from lineitem group by 1, 2 having count(*) > 1")
def agg_3_pivot_collisions(t):
    return rs.pivot_collisions(t("lineitem"), ["l_returnflag", "l_linestatus"])


@query("select o_orderkey, unnest(['custkey', 'price']) as variable, unnest([o_custkey::double, o_totalprice]) as value from orders")
def rsh_2_melt(t):
    d = t("orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("price"))
    return rs.melt(d, ["o_orderkey"])


@query("select n_nationkey, unnest(['sales', 'sales', 'cost']) as measure, unnest(['2023', '2024', '2024']) as year, unnest([n_nationkey, n_nationkey * 2, n_nationkey * 3]) as value from nation")
def rsh_2_melt_and_split(t):
    k = F.col("n_nationkey")
    d = t("nation").select(k, k.alias("sales_2023"), (k * 2).alias("sales_2024"), (k * 3).alias("cost_2024"))
    return rs.melt(d, ["n_nationkey"], sep="_", parts=["measure", "year"])


@query("select * from (values ('sales', 3, 'wide_time_series')) as v(prefix, n, kind)")
def rsh_4_infer_shape(t):
    e = t("events").groupBy("event_type").agg(*[F.sum("value").alias(c) for c in ("sales_jan_2024", "sales_feb_2024", "sales_mar_2024")]).withColumns({"a": F.lit("x"), "b": F.lit("y"), "c": F.lit("z")})
    s = rs.shape_of(e)
    return t("events").sparkSession.createDataFrame([(k, len(v), s["kind"]) for k, v in s["groups"].items()], "prefix string, n int, kind string")


@query("select n_nationkey, case when n_nationkey % 3 = 0 then 'base' when n_nationkey % 3 = 1 then 'M ' || n_nationkey else 'other' end as m from nation")
def rsh_5_rename_measures(t):
    k = F.col("n_nationkey")
    d = t("nation").select(k, F.when(k % 3 == 1, k.cast("string")).when(k % 3 == 2, "other").alias("m"))
    return rs.rename_measures(d, "m", {f"measure_{i}": f"M {i}" for i in range(30)})
