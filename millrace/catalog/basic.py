"""Sources, projection, filters, ordering, sampling and set operations."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import functions as F

from ..operators import columns as col
from ..operators import ordered as o
from ..operators import rows as rw
from ..operators.cleaning import tokens_to_null
from ..plans.sql import query as sql_query
from ..session import remove, shared_dir
from .registry import query, r

MIXED = "case when event_id % 5 = 0 then 'N/A' when event_id % 5 = 1 then '-' else cast(cast(floor(value) as int) as varchar(20)) end"
NULLS = "case when event_id % 7 = 0 then null else value end"


def event_nulls(t):
    return t("events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def mixed_strings(t):
    return t("events").select("event_id", F.when(F.col("event_id") % 5 == 0, "N/A").when(F.col("event_id") % 5 == 1, "-").otherwise(F.floor("value").cast("int").cast("string")).alias("v"))


def li_dups(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")


@query("select o_orderkey, o_orderstatus from orders")
def prj_1_select_columns(t):
    return col.select(t("orders"), "o_orderkey", "o_orderstatus")


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def prj_2_select_numeric(t):
    return col.select_kind(t("orders"), "numeric")


@query("select * exclude (l_tax, l_shipdate) from lineitem")
def prj_3_drop_columns(t):
    return col.drop(t("lineitem"), "l_tax", "l_shipdate")


@query("select n_nationkey as id, n_name as nation, n_regionkey from nation")
def prj_4_rename(t):
    return col.rename(t("nation"), {"n_nationkey": "id", "n_name": "nation"})


@query("select p_partkey as part_key, p_brand as brand_name from part")
def prj_5_standardise_names(t):
    return col.standardise_names(t("part").select(F.col("p_partkey").alias(" Part Key"), F.col("p_brand").alias("Brand-Name ")))


@query("select p_partkey as Column_0, p_brand as Column_1, p_size as a_b, p_type as a_b_1 from part")
def prj_6_clean_names(t):
    d = t("part").select("p_partkey", "p_brand", "p_size", "p_type")
    return d.toDF(*col.clean_names(["", "Unnamed: 1", "a\nb", "a_b"]))


@query("select p_partkey, l[1] as w1, l[2] as w2, case when len(l) > 2 then array_to_string(l[3:], ' ') end as w3 from (select p_partkey, string_split(p_name || ' of ' || p_type, ' ') as l from part)")
def prj_7_split_column(t):
    d = t("part").select("p_partkey", F.concat_ws(" of ", "p_name", "p_type").alias("p_name"))
    return col.split_column(d, "p_name", " ", ["w1", "w2", "w3"]).drop("p_name")


@query("select p_partkey, p_brand || ' / ' || p_type as both from part")
def prj_8_merge_columns(t):
    return col.merge_columns(t("part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "both", " / ", keep=False)


@query("select r_regionkey, r_name from region")
def prj_9_drop_constant(t):
    return col.drop_constant(t("region").withColumns({"const_col": F.lit(1), "empty_col": F.lit(None).cast("string")}))


@query("select event_id, event_type from events")
def prj_10_drop_missing(t):
    d = t("events").select("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("sparse"))
    return col.drop_missing(d, 50)


@query("select n_nationkey, n_name from nation")
def prj_11_drop_total_columns(t):
    d = t("nation").select("n_nationkey", "n_name", F.lit(1).alias("total_sales"), F.lit(2).alias("Grand Total"), F.lit(3).alias("x-total"))
    return d.drop(*rw.total_columns(d.columns))


@query("select n_nationkey, n_name from nation where n_nationkey % 2 = 0")
def prj_12_drop_empty(t):
    even = F.col("n_nationkey") % 2 == 0
    d = t("nation").select(F.when(even, F.col("n_nationkey")).alias("n_nationkey"), F.when(even, F.col("n_name")).alias("n_name"), F.lit(None).cast("int").alias("none"))
    return col.drop_empty(d)


@query("select event_id, event_type, value from events where event_type = 'click' or value > 50")
def flt_1_filter_compare(t):
    d = t("events").select("event_id", "event_type", "value")
    return d.filter(rw.predicate("event_type", "=", "click") | rw.predicate("value", ">", 50))


@query(f"select event_id, {NULLS} as value from events where coalesce(not ({NULLS} <= 30), true)")
def flt_1_filter_remove(t):
    return rw.filter_rows(event_nulls(t).select("event_id", "value"), "value", "<=", 30, keep=False)


@query(f"select event_id from events where ({NULLS}) is distinct from 10")
def flt_1_filter_not_equal(t):
    return rw.filter_rows(event_nulls(t).select("event_id", "value"), "value", "!=", 10.0).select("event_id")


@query(f"select event_id, {NULLS} is null as missing from events where ({NULLS}) is null or event_id % 2 = 0")
def flt_1_filter_null(t):
    d = event_nulls(t)
    return d.filter(rw.predicate("value", "is null") | (F.col("event_id") % 2 == 0)).select("event_id", F.col("value").isNull().alias("missing"))


@query("select p_partkey, p_type from part where regexp_matches(p_type, 'econ|^pro', 'i')")
def flt_2_contains(t):
    return rw.filter_rows(t("part").select("p_partkey", "p_type"), "p_type", "contains", "econ|^pro")


@query(f"select case when event_id % 2 = 0 then event_id end as a, {NULLS} as b from events where event_id % 2 = 0 or event_id % 7 <> 0")
def flt_3_drop_all_null(t):
    return rw.drop_all_null(event_nulls(t).select(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("a"), F.col("value").alias("b")))


@query("select event_id, value from events where event_id % 7 <> 0")
def flt_4_drop_null_in(t):
    return rw.drop_null_in(event_nulls(t).select("event_id", "value"), "value")


@query("select event_type as label, cast(sum(event_id) as bigint) as s from events group by 1")
def flt_5_drop_total_rows(t):
    by = t("events").groupBy(F.col("event_type").alias("label")).agg(F.sum("event_id").alias("s"))
    total = by.agg(F.lit("Grand Total").alias("label"), F.sum("s").alias("s"))
    sub = by.agg(F.lit(" subtotal ").alias("label"), F.sum("s").alias("s"))
    return rw.drop_total_rows(by.unionByName(total).unionByName(sub))


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) where i in (0, 3) or i between 7 and 10")
def flt_6_rows_at(t):
    return o.rows_at(o.with_row_id(t("orders").select("o_orderkey"), "o_orderkey"), "0, 3, 7-10, 99999999").select("o_orderkey")


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events where event_type in ('click', 'view'))
    select event_id, value from events, q where event_type in ('click', 'view') and value between a - 1.5 * (b - a) and b + 1.5 * (b - a)""")
def flt_7_values_then_iqr(t):
    return rw.values_then_iqr(t("events"), "event_type", ["click", "view"], "value").select("event_id", "value")


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from (select *, count(*) over (partition by l_quantity, l_extendedprice) as n from lineitem) where n > 1")
def flt_9_duplicate_rows(t):
    return rw.duplicate_rows(t("lineitem"), ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("select a.n_name as n_name, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def jn_1_self_join(t):
    return sql_query(t("nation"), "select a.n_name, b.n_name as other from data a join data b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")


@query("select o_orderkey, o_custkey, round(avg(o_totalprice) over (partition by o_custkey), 4) as mean_price from orders")
def jn_4_group_stat_join_back(t):
    from ..operators.cleaning import group_statistic

    d = group_statistic(t("orders"), "o_totalprice", "o_custkey", "mean", "mean_price")
    return d.select("o_orderkey", "o_custkey", r("mean_price", 4).alias("mean_price"))


@query("select o_orderkey from orders where o_orderkey not in (select o_orderkey + 1 from orders where o_orderkey % 5 = 0)")
def jn_5_drop_second(t):
    from ..operators.fuzzy import drop_second

    pairs = t("orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id_1"), (F.col("o_orderkey") + 1).alias("id_2"))
    return drop_second(t("orders").select("o_orderkey"), "o_orderkey", pairs)


@query("select l_returnflag, l_linestatus, l_quantity, l_discount, min(l_orderkey * 10 + l_linenumber) as k from lineitem group by all")
def win_6_dedup_first(t):
    d = li_dups(t).select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return rw.drop_duplicates(d, ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"], "first", row="k")


@query("select l_returnflag, l_discount, max(l_orderkey * 10 + l_linenumber) as k from lineitem group by all")
def win_6_dedup_last(t):
    d = li_dups(t).select("l_returnflag", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return rw.drop_duplicates(d, ["l_returnflag", "l_discount"], "last", row="k")


@query("select distinct l_returnflag, l_linestatus, l_quantity, l_discount from lineitem")
def win_6_dedup_full_rows(t):
    return rw.drop_duplicates(li_dups(t).drop("l_orderkey", "l_linenumber"))


@query("""select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) > 1 as is_duplicate
    from (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem)""")
def win_7_flag_duplicates(t):
    return rw.flag_duplicates(li_dups(t).select("l_orderkey", "l_linenumber", "l_returnflag").distinct(), ["l_orderkey", "l_returnflag"], "l_linenumber").select("l_orderkey", "l_linenumber", "is_duplicate")


@query("select o_custkey, any_value(o_orderkey) as o_orderkey from orders group by o_custkey having count(*) = 1")
def win_7_remove_all_copies(t):
    return rw.drop_duplicates(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "none")


@query(f"select event_id, {NULLS} as value from events order by value desc nulls last, event_id limit 100")
def srt_1_sort_nulls_last(t):
    return rw.sort_rows(event_nulls(t).select("event_id", "value"), ("value", False), "event_id").limit(100)


@query("select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderstatus, o_totalprice desc, o_orderkey")
def srt_2_sort_several(t):
    return rw.sort_rows(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", ("o_totalprice", False), "o_orderkey")


@query("(select o_orderkey, 'head' as part from orders order by o_orderkey limit 5) union all (select o_orderkey, 'tail' from orders order by o_orderkey desc limit 5)")
def lim_1_head_tail(t):
    d = o.with_row_id(t("orders").select("o_orderkey"), "o_orderkey")
    return o.head(d, 5).withColumn("part", F.lit("head")).unionByName(o.tail(d, 5).withColumn("part", F.lit("tail"))).drop(o.ROW)


MIX = "((((({k} * 48271 + 333 - 15) % 2147483647) * 69621 + 42) % 2147483647))".replace("333 - 15", "332598")


@query(f"select event_id from events order by {MIX.format(k='event_id')}, event_id limit 500")
def smp_1_sample_rows(t):
    return rw.sample_rows(t("events").select("event_id"), 500, "event_id")


@query(f"select event_id from (select event_id, row_number() over (order by {MIX.format(k='event_id')}, event_id) as i, count(*) over () as n from events) where i <= round(n * 0.1)")
def smp_2_sample_fraction(t):
    return rw.sample_fraction(t("events").select("event_id"), 0.1, "event_id")


@query(f"""with c as (select event_type, count(*) as c, sum(count(*)) over () as n from events group by 1)
    select event_id, event_type from (select event_id, event_type, row_number() over (partition by event_type order by {MIX.format(k='event_id')}, event_id) as i from events) join c using (event_type)
    where i <= round_even(c * 400.0 / n, 0)""")
def smp_3_stratified(t):
    return rw.stratified_sample(t("events").select("event_id", "event_type"), "event_type", 400, "event_id")


@query(f"select event_id, value from events order by {MIX.format(k='event_id')}, event_id limit 2000")
def smp_4_chart_sample(t):
    from ..plans.charts import downsample

    return downsample(t("events").select("event_id", "value"), "event_id", above=500, to=2000)


@query("select event_type, count(*) as n from events group by 1 order by n desc, 1 limit 3")
def topk_categories(t):
    from ..operators.statistics import value_counts

    return value_counts(t("events"), "event_type", 3).select(F.col("value").alias("event_type"), "n")


@query("select n_nationkey, n_name, cast(null as integer) as extra from nation where n_nationkey < 5 union all select n_nationkey, n_name, n_regionkey from nation where n_nationkey >= 5")
def set_1_union_by_name(t):
    n = t("nation")
    return rw.union_by_name(n.filter("n_nationkey < 5").select("n_nationkey", "n_name"), n.filter("n_nationkey >= 5").select(F.col("n_regionkey").alias("extra"), "n_name", "n_nationkey"))


@query("select n_regionkey from nation where n_nationkey < 12 intersect select n_regionkey from nation where n_nationkey >= 12")
def set_4_intersect(t):
    return sql_query(t("nation"), "select n_regionkey from data where n_nationkey < 12 intersect select n_regionkey from data where n_nationkey >= 12")


@query(f"select event_id, try_cast({MIXED} as bigint) as v from events")
def src_2_null_tokens(t):
    return tokens_to_null(mixed_strings(t)).select("event_id", F.col("v").try_cast("long").alias("v"))


@query("select n_nationkey, nullif(n_name, 'CHINA') as n_name from nation where n_nationkey >= 0")
def src_2_csv_round_trip(t):
    """Text written as CSV and read again with null tokens and an index column."""
    from ..sources.readers import read
    from ..sources.sinks import write_csv

    spark = t("nation").sparkSession
    n = t("nation").orderBy("n_nationkey").select("n_nationkey", F.when(F.col("n_name") == "CHINA", "N/A").otherwise(F.col("n_name")).alias("n_name"))
    path = scratch(spark, "csv")
    write_csv(n, path)
    d = read(spark, path, "csv", index="n_nationkey")
    return d.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


QUOTED = """'He said: "' || coalesce(text, '') || '",' || chr(10) || '"' || chr(13) || chr(10) || ' end'"""


@query(f"select doc_id, cast(length({QUOTED}) as integer) as n_chars, sha256({QUOTED}) as digest, source from documents")
def src_2_quoted(t):
    """A CSV file made by hand: whole texts with line breaks, separators and quotes, in quotes."""
    from ..sources.readers import read

    spark = t("documents").sparkSession
    path = scratch(spark, "quoted")
    cell = F.concat(F.lit('"'), F.replace(F.expr(QUOTED), F.lit('"'), F.lit('""')), F.lit('"'))
    t("documents").select(F.concat_ws(",", cell, "doc_id", "source").alias("value")).write.text(path)
    d = read(spark, path, "csv", header=False, nulls=["no such token"])
    return d.select(F.col("_c1").cast("long").alias("doc_id"), F.length("_c0").alias("n_chars"), F.sha2("_c0", 256).alias("digest"), F.col("_c2").alias("source"))


@query(f"select doc_id, cast(length({QUOTED}) as integer) as n_chars, sha256({QUOTED}) as digest, source from documents")
def snk_1_quoted(t):
    """Whole texts with line breaks, separators and quotes, written as CSV and read again."""
    from ..sources.readers import read
    from ..sources.sinks import write_csv

    spark = t("documents").sparkSession
    path = scratch(spark, "quoted")
    write_csv(t("documents").select("doc_id", F.expr(QUOTED).alias("text"), "source"), path)
    d = read(spark, path, "csv", nulls=["no such token"])
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"), "source")


@query("select c_custkey, c_name || case when c_custkey = (select max(c_custkey) from customer) then ' é' else '' end as c_name, 'iso-8859-1' as encoding from customer")
def src_5_late_byte(t):
    """The only byte that is no UTF-8 is in the last of many lines."""
    from ..sources.readers import probe_encoding, read
    from ..sources.sinks import write_csv

    c = t("customer")
    path = scratch(c.sparkSession, "late")
    last = F.broadcast(c.agg(F.max("c_custkey").alias("last")))
    named = c.join(last).select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") == F.col("last"), " é").otherwise("")).alias("c_name"))
    write_csv(named.repartitionByRange(1, "c_custkey").sortWithinPartitions("c_custkey"), path, encoding="iso-8859-1")
    found = probe_encoding(c.sparkSession, path)
    return read(c.sparkSession, path, "csv", encoding=found).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.lit(found).alias("encoding"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def src_4_nested_document(t):
    """One JSON document over several lines, the first of which looks whole."""
    from ..sources.readers import read

    n = t("nation")
    path = scratch(n.sparkSession, "nested")
    body = F.concat(F.lit('{"at": {"key": '), "n_nationkey", F.lit("}\n, "), F.expr("""'"name": ' || to_json(array(n_name))"""), F.lit(',\n"region": {"key": '), "n_regionkey", F.lit("} }"))
    n.repartition(5, "n_nationkey").groupBy(F.spark_partition_id()).agg(F.array_join(F.collect_list(body), "\n, ").alias("b")).select(F.concat(F.lit("["), "b", F.lit("]")).alias("value")).repartition(5).write.text(path)
    d = read(n.sparkSession, path, "json")
    return d.select(F.col("at.key").cast("int").alias("n_nationkey"), F.col("name")[0].alias("n_name"), F.col("region.key").cast("int").alias("n_regionkey"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def src_4_json_round_trip(t):
    from ..sources.readers import read
    from ..sources.sinks import write_json

    spark = t("nation").sparkSession
    path = scratch(spark, "json")
    write_json(t("nation"), path)
    return read(spark, path, "json", schema=t("nation").schema)


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def snk_4_parquet_round_trip(t):
    from ..sources.sinks import write_parquet

    spark = t("orders").sparkSession
    path = scratch(spark, "parquet")
    write_parquet(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "gzip")
    return spark.read.parquet(path)


@query("select 'INSERT INTO data (n_nationkey, n_name) VALUES (' || n_nationkey || ', ''' || n_name || ''');' as value from nation")
def snk_5_sql_script(t):
    from ..sources.sinks import insert_statements

    return insert_statements(t("nation").select("n_nationkey", "n_name"), "data")


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as value from nation""")
def snk_3_json_records(t):
    from ..sources.sinks import json_lines

    return json_lines(t("nation").select("n_nationkey", "n_name"))


@query("select event_id, cast(event_id as double) as num, event_type, '2024-01-0' || (1 + event_id % 9) as d, cast(cast('2024-01-0' || (1 + event_id % 9) as date) as timestamp) as day from events")
def src_6_robust_load(t):
    from ..sources.readers import robust_load

    d = t("events").select("event_id", F.col("event_id").cast("string").alias("num"), "event_type", F.concat(F.lit("2024-01-0"), 1 + F.col("event_id") % 9).alias("day"), F.lit(None).cast("string").alias("nothing"))
    out = robust_load(d)
    return out.select("event_id", "num", "event_type", F.date_format("day", "yyyy-MM-dd").alias("d"), "day")


def scratch(spark, kind: str) -> str:
    """A new folder where driver and executors meet, which is removed when the program ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(_tidy, spark, path)
    return path


def _tidy(spark, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        remove(spark, path)
