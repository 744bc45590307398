"""Edge cases: nulls, ties, empty tables, unusual names; expected values by plain Python or pandas."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from millrace import session as se
from millrace.functions import conditional, dates, math as mt, similarity, text
from millrace.operators import cleaning, columns, fuzzy, ordered, quality, quantiles, reshape, rows, statistics, types
from millrace.plans import assistant, charts
from millrace.plans.result import HARD_STOP, HardStop, StepResult
from millrace.plans.workflow import Workflow, quarantine_rows, row_digest
from pyspark.sql import functions as F


def one(spark, expr, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr).first()[0]


def nums(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")


def col(df, c="v", by="i"):
    return [r[c] for r in df.orderBy(by).collect()]


def test_predicates_with_nulls(spark):
    d = nums(spark, [1.0, None, 3.0])
    test = {op: [r[0] for r in d.orderBy("i").select(rows.predicate("v", op, 1.0)).collect()] for op in ("=", "!=", ">", "<=", "is null", "is not null")}
    assert test == {"=": [True, False, False], "!=": [False, True, True], ">": [False, False, True], "<=": [True, False, False], "is null": [False, True, False], "is not null": [True, False, True]}
    assert rows.filter_rows(d, "v", ">", 1.0, keep=False).count() == 2


@pytest.mark.parametrize("bucket", [4, 1 << 16])
def test_ordered_operators_equal_pandas(spark, monkeypatch, bucket):
    monkeypatch.setattr(ordered, "BUCKET", bucket)
    rnd = random.Random(1)
    v = [None if rnd.random() < 0.4 else float(rnd.randrange(50)) for _ in range(57)]
    v[0], v[-1] = None, None
    s = pd.Series(v, dtype=float)
    d = ordered.with_row_id(nums(spark, v).repartition(5), "i")
    assert col(d, ordered.ROW) == list(range(57))
    same = lambda got, want: [None if x is None else round(x, 9) for x in got] == [None if math.isnan(x) else round(x, 9) for x in want]
    assert same(col(ordered.fill(d, "v")), s.ffill())
    assert same(col(ordered.fill(d, "v", "backward")), s.bfill())
    assert same(col(ordered.interpolate(d, "v")), s.interpolate())
    full = pd.Series([float(x or 0) for x in v])
    e = ordered.with_row_id(nums(spark, full.tolist()), "i")
    assert same(col(ordered.rolling_mean(e, "v", 4, "m"), "m"), full.rolling(4).mean())
    assert same(col(ordered.average_rank(e, "v", "r"), "r"), full.rank())


def test_quantiles(spark, monkeypatch):
    rnd = random.Random(2)
    v = [float(rnd.randrange(30)) for _ in range(101)]
    ps = [0.0, 0.13, 0.5, 0.77, 1.0]
    for few in (0, 1 << 18):
        monkeypatch.setattr(quantiles, "BOUND", few)
        assert quantiles.quantiles(nums(spark, [*v, None]), ["v"], ps).first().q == pytest.approx(pd.Series(v).quantile(ps).tolist())
        assert quantiles.scalars(nums(spark, []), "v", m=0.5).first().m is None


def test_positions(spark):
    d = ordered.with_row_id(nums(spark, [float(x) for x in range(12)]), "i")
    assert col(ordered.rows_at(d, "0, 3, 7-9, 400")) == [0, 3, 7, 8, 9]
    assert ordered.rows_at(d, "0-9", keep=False).count() == 2
    empty = ordered.with_row_id(nums(spark, []), "i")
    assert empty.count() == 0 and ordered.fill(empty, "v").count() == 0


def test_duplicates(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "b", 2)], "__row_id long, x string, y int")
    assert [r["__row_id"] for r in rows.drop_duplicates(d).orderBy("__row_id").collect()] == [1, 3, 4]
    assert [r["__row_id"] for r in rows.drop_duplicates(d, keep="last").orderBy("__row_id").collect()] == [2, 3, 4]
    assert rows.drop_duplicates(d, ["x", "y"], "none").count() == 2
    assert rows.duplicate_rows(d, ["x", "y"]).count() == 2
    assert rows.drop_duplicates(d, ["x"]).columns == d.columns


def test_total_rows(spark):
    d = spark.createDataFrame([("Grand Total", 1), ("total", 1), (" Subtotal ", 1), ("totally", 1), (None, 1), ("Sum", 1), ("summary", 1)], "n string, v int")
    assert sorted(map(str, (r.n for r in rows.drop_total_rows(d).collect()))) == ["None", "summary", "totally"]
    assert rows.total_columns(["total", "total_sales", "subtotal", "Grand Total", "totals"]) == ["total", "total_sales", "Grand Total"]


def test_columns(spark):
    d = spark.createDataFrame([(1, None, 2, "a-b-c"), (1, None, 3, None)], "k int, e string, v int, s string")
    assert columns.constant_columns(d) == ["k", "e", "s"] and columns.drop_empty(d).columns == ["k", "v", "s"]
    assert columns.drop_missing(d, 50).columns == ["k", "v", "s"]
    out = columns.split_column(d, "s", "-", ["p", "q"]).orderBy("v").collect()
    assert (out[0].p, out[0].q, out[1].p) == ("a", "b-c", None)
    assert columns.merge_columns(d, ["k", "s"], "m", "|").orderBy("v").collect()[1].m == "1|"
    for bad in (lambda: columns.drop(d, "zzz"), lambda: columns.rename(d, {"k": "v"}), lambda: columns.merge_columns(d, ["k"], "v")):
        with pytest.raises(HardStop):
            bad()
    assert columns.clean_names(["", "12", None, "a", "a", "a\tb"]) == ["Column_0", "Column_1", "Column_2", "a", "a_1", "a_b"]
    assert columns.standard_name("  My Col-1 ") == "my_col_1" and columns.name_issues("a  b!") == ["double spaces", "special characters"]


def test_fill_and_outliers(spark):
    d = spark.createDataFrame([("x", 1.0), ("x", None), ("x", 3.0), ("y", None), (None, None), (None, 5.0)], "g string, v double")
    by = {(r.g, r.v) for r in cleaning.fill_missing_by(d, "v", "g").collect()}
    assert by == {("x", 1.0), ("x", 2.0), ("x", 3.0), ("y", None), (None, None), (None, 5.0)}
    assert {r.v for r in cleaning.fill_missing(d, "v", "median").collect()} == {1.0, 3.0, 5.0}
    assert sum(r.is_outlier for r in cleaning.flag_outliers(nums(spark, [1.0, 1.0, 1.0, 1.0]), "v", "modified_z").collect()) == 0
    assert sum(r.is_outlier for r in cleaning.flag_outliers(nums(spark, [1.0, 2.0, 900.0]), "v", "iqr").collect()) == 0
    w = col(cleaning.winsorize(nums(spark, [float(x) for x in range(20)] + [None]), "v", 0.1, 0.05))
    assert w == [2.0, 2.0, 2.0, *map(float, range(3, 19)), 18.0, None]


def test_replace(spark):
    d = spark.createDataFrame([("a.b", 7), ("A.B", 8), (None, None)], "s string, n int")
    assert [r.s for r in cleaning.replace_text(d, "s", "a.b", "$1\\").orderBy("n").collect()] == [None, "$1\\", "$1\\"]
    assert [r.n for r in cleaning.replace_cells(d, "n", "7", "").orderBy("s").collect()] == [None, 8.0, None]
    with pytest.raises(ValueError):
        cleaning.map_values(d, "s", [("a", "b"), ("a", "c")])


def test_types(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(["1", " 2.5 ", "x", None, "1e3", "99999999999999999999"])], "i long, v string")
    good, bad = types.convert_or_quarantine(d, "v", "int64")
    assert {r.i: r.v for r in good.collect()} == {0: 1, 1: 2, 3: 0, 4: 1000} and {r.i for r in bad.collect()} == {2, 5}
    good, bad = types.convert_or_quarantine(d, "v", "float64")
    assert good.count() == 5 and bad.count() == 1 and good.count() + bad.count() == d.count()
    assert one(spark, types.convert(F.col("c"), "int"), "2.5") == 2 and one(spark, types.convert(F.col("c"), "int"), "3.5") == 4
    assert one(spark, types.boolean(F.col("c"), "yes/no"), " Approved ") == "Yes" and one(spark, types.boolean(F.col("c"), (1, 9)), "absent") == 9


def test_dates(spark):
    cases = {"2024-02-29": "2024-02-29", "29/02/2024": "2024-02-29", "2/3/2024": "2024-03-02", "02/29/2024": "2024-02-29", "29.02.2024": "2024-02-29", "Feb 29 2024": "2024-02-29", "29 February 2024": "2024-02-29", "31/12/99": "2099-12-31", "30/02/2024": None, "nonsense": None, "": None}
    for t, want in cases.items():
        got = one(spark, dates.parse_any(F.col("c")), t)
        assert (got and got.strftime("%Y-%m-%d")) == want, t
    assert one(spark, dates.detect_format(F.col("c")), "13/01/2024") == "%d/%m/%Y"
    assert dates.java_pattern("%d %b %Y at %H") == "dd MMM yyyy 'a''t' HH"
    ts = F.col("c").cast("timestamp_ntz")
    assert [one(spark, dates.part(ts, p), "2021-01-01 00:00:00") for p in ("week", "dayofweek", "is_year_start", "is_quarter_end", "days_in_month", "day_name")] == [53, 4, 1, 0, 31, "Friday"]
    assert one(spark, dates.difference(ts, F.lit("2021-01-02").cast("timestamp_ntz")), "2021-01-01 12:00:00") == -1


def test_text(spark):
    assert one(spark, text.title(F.col("c")), "o'neil mc-donald 3rd élan") == "o'neil mc-donald 3rd élan".title()
    assert one(spark, text.strip(F.col("c")), " \t\nx y ") == "x y"
    assert one(spark, text.substring(F.col("c"), 1, 3), "hello") == "el" and one(spark, text.substring(F.col("c"), 2), "hello") == "llo"
    assert one(spark, text.remove(F.col("c"), "punctuation"), "héllo, w_1!") == "héllo w_1"
    assert one(spark, text.replace(F.col("c"), "A.", "$", case=False), "xa.a") == "x$a"


def test_math(spark):
    d = spark.createDataFrame([(1.0, None), (4.0, 0.0), (None, None)], "a double, b double")
    rs = lambda how: [r[0] for r in d.select(mt.row_wise(["a", "b"], how)).collect()]
    assert rs("mean") == [1.0, 2.0, None] and rs("std")[0] is None and rs("median") == [1.0, 2.0, None] and rs("sum") == [1.0, 4.0, 0.0]
    assert [r[0] for r in d.select(mt.binary(F.col("a"), F.col("b"), "divide")).collect()] == [None, None, None]
    with pytest.raises(ValueError):
        mt.expression("java_method('java.lang.System', 'exit', 1)")
    log = [r.x for r in mt.scaled(nums(spark, [-1.0, 0.0, None]), "v", "log", "x").orderBy("i").collect()]
    assert log == [pytest.approx(math.log(2)), pytest.approx(math.log(3)), None]


def test_bins_equal_pandas(spark):
    rnd = random.Random(4)
    v = [float(rnd.randrange(0, 40)) for _ in range(300)]
    got = col(conditional.equal_width(nums(spark, [*v, None]), "v", 7, "b"), "b")
    assert got[:-1] == pd.cut(pd.Series(v), 7, labels=False).tolist() and got[-1] is None
    skewed = [1.0] * 102 + [x + rnd.random() for x in v]  # edges lie between values, so their last bits don't matter
    assert col(conditional.equal_frequency(nums(spark, skewed), "v", 6, "b"), "b") == pd.qcut(pd.Series(skewed), 6, labels=False, duplicates="drop").tolist()
    assert col(nums(spark, [0.0, 1.0, 2.0, 3.0, None]).withColumn("b", conditional.custom_bins("v", [0, 1, 2])), "b") == [0, 0, 1, None, None]


def test_statistics_equal_pandas(spark):
    rnd = random.Random(6)
    v = [rnd.gauss(0, 1) ** 3 for _ in range(200)] + [None]
    s = pd.Series(v, dtype=float)
    r = statistics.profile_numeric(nums(spark, v), ["v"]).first()
    assert (r.skewness, r.kurtosis, r.q1) == pytest.approx((s.skew(), s.kurtosis(), s.quantile(0.25)))
    tiny = statistics.profile_numeric(nums(spark, [1.0, 2.0]), ["v"]).first()
    assert tiny.skewness is None and tiny.kurtosis is None
    d = spark.createDataFrame([(float(rnd.randrange(5)), float(rnd.randrange(6))) for _ in range(150)], "a double, b double")
    p = d.toPandas()
    assert statistics.comissing(d).first().r is None
    for how in ("spearman", "kendall"):
        if how == "kendall":
            pairs = [(x, y) for x, y in zip(p.a, p.b, strict=True)]
            sign = lambda q: (q > 0) - (q < 0)
            c = sum(sign(x - u) * sign(y - w) for i, (x, y) in enumerate(pairs) for u, w in pairs[:i])
            t = lambda z: sum(n * (n - 1) / 2 for n in z.value_counts())
            n0 = len(p) * (len(p) - 1) / 2
            want = c / math.sqrt((n0 - t(p.a)) * (n0 - t(p.b)))
        else:
            want = p.a.rank().corr(p.b.rank())
        assert statistics.correlations(d, ["a", "b"], how).first().r == pytest.approx(want)
    assert statistics.cramers_v(spark.createDataFrame([("a", "x"), ("b", "y")] * 50, "p string, q string"), "p", "q").first().v == pytest.approx(0.9797, abs=0.02)


def test_normality(spark):
    from statistics import NormalDist

    law = NormalDist()
    d = nums(spark, [law.inv_cdf((i + 0.5) / 400) for i in range(400)])
    w, p = statistics.shapiro_wilk(d, "v", "i")
    assert w > 0.995 and p > 0.5
    a = statistics.anderson_darling(d, "v").first()
    assert a.statistic < 0.2 and a.normal and a.critical_5pct == pytest.approx(0.78, abs=0.01)
    q = statistics.qq_line(d, "v").first()
    assert q.slope == pytest.approx(1, abs=0.02) and q.r > 0.999
    got = [one(spark, statistics.normal_quantile(F.col("c")), x, "double") for x in (0.001, 0.3, 0.5, 0.99)]
    assert got == pytest.approx([law.inv_cdf(x) for x in (0.001, 0.3, 0.5, 0.99)], abs=1e-7)


def test_reshape_round_trip(spark):
    d = spark.createDataFrame([(i, k, float(i * j)) for i in range(4) for j, k in enumerate(["p", "q", "r"])], "i int, k string, v double")
    wide = reshape.pivot(d, ["i"], ["k"], ["v"])
    assert wide.columns == ["i", "p", "q", "r"]
    assert sorted(map(tuple, reshape.melt(wide, ["i"], var="k", value="v").collect())) == sorted(map(tuple, d.collect()))
    d = spark.createDataFrame([(1, "p", None), (1, None, 2.0), (2, "p", None)], "i int, k string, v string")
    assert reshape.pivot(d, ["i"], ["k"], ["v"], "sum").orderBy("i").first().p == 0.0
    assert reshape.pivot(d, ["i"], ["k"], ["v"], "mean").count() == 0
    names = ["id", "sales_2021", "sales_2022", "sales_2023", "cost_q1_2023", "cost_q2_2023", "cost_q3_2023", "x"]
    assert reshape.period_groups(names) == {"sales": names[1:4], "cost": names[4:7]}
    assert reshape.split_suggestion(["sales_2021", "sales_2022"]) == {"separator": "_", "n_parts": 2, "names": ["sales", "period"]}


def test_similarity():
    assert similarity.emails("Ann@gmail.com", "ann@gamil.com") == pytest.approx(0.6 + 0.4 * 0.95)
    assert similarity.phones("+1 (555) 123-4567", "5551234567") == 0.95 and similarity.phones("", "1") == 0
    assert similarity.near_numbers(100, 101) == 1 and similarity.near_numbers(100, 102) == 0
    assert similarity.kind_of("HomePhone") == "phone" and similarity.kind_of("e_mail") == "email"


def test_pivot_refuses_too_many_headers(spark):
    d = spark.range(reshape.MOST_HEADERS + 1).select((F.col("id") % 50).alias("i"), F.col("id").alias("k"), F.lit(1.0).alias("v"))
    with pytest.raises(HardStop):
        reshape.pivot_headers(d, ["k"])
    with pytest.raises(HardStop):
        reshape.pivot(d, ["i"], ["k"], ["v"])
    assert len(reshape.pivot_headers(d.filter("k > 0"), ["k"])) == reshape.MOST_HEADERS


def test_fuzzy_finds_all_pairs(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(5, 50))) for _ in range(60)]
    for w in words[:40]:
        i = rnd.randrange(len(w))
        words.append(w[:i] + rnd.choice("xyz") + w[i + 1 :])
    words += ["n/a", "unknown", None, "  ", "ab"]
    d = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = {(r.a, r.b) for r in fuzzy.similar_values(d, "name", "id", 0.85).collect()}
    vals = sorted({w.lower().strip() for w in words if w and len(w.strip()) > 2 and w not in fuzzy.SKIPPED})
    want = {(a, b) for i, a in enumerate(vals) for b in vals[i + 1 :] if SequenceMatcher(None, a, b).ratio() >= 0.85 and min(len(a), len(b)) * 2 >= max(len(a), len(b))}
    assert want and got == want


@pytest.mark.parametrize("threshold", [0.45, 0.7, 0.85, 0.95, 1.0])
def test_fuzzy_misses_no_pair(spark, threshold):
    """Scattered insertions and deletions, of texts of 3 to 90 characters, and blanks at the ends."""
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice("abcdefghij0123456789") for _ in range(n))
    words = ["ieqhh524ynhg5by1ah2rogubobb8ayna1b7o25r9", "tab", "tab\t", "\u00a0tab tab tab"]
    for n in [*range(3, 41), 60, 90]:
        w = make(n)
        words.append(w)
        for share in (0.05, 0.1, 0.14):
            x = list(w)
            for _ in range(round(share * n)):
                del x[rnd.randrange(len(x))]
            for _ in range(round(share * n)):
                x.insert(rnd.randrange(len(x) + 1), make(1))
            words.append("".join(x))
    words.append("ieqh52l4yng5bvy1a2roygubbb8jayn1b7o2s5r9")
    d = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    got = [(r.a, r.b) for r in fuzzy.similar_values(d, "name", "id", threshold).collect()]
    vals = sorted({w.strip(" ") for w in words if len(w.strip(" ")) > 2})
    want = {(a, b) for i, a in enumerate(vals) for b in vals[i + 1 :] if similarity.ratio(a, b) >= threshold and min(len(a.strip()), len(b.strip())) * 2 >= max(len(a.strip()), len(b.strip()))}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_fuzzy_groups_and_scores(spark):
    d = spark.createDataFrame([(1, "John Smithson", "j@x.com", None), (2, "Jon Smithson", "j@x.com", "5"), (3, "JOHN SMITHSON ", None, None), (4, "Mary Major", "m@x.com", "5")], "id long, name string, email string, age string")
    assert {(r.id, r.group_id) for r in fuzzy.groups(d, "name", "id").collect()} == {(1, 1), (2, 1), (3, 1)}
    s = {(r.id_1, r.id_2): r.confidence for r in fuzzy.score_pairs(d, "id", "name", ["email", "age"], confidence=0.0).collect()}
    ratio = SequenceMatcher(None, "john smithson", "jon smithson").ratio()
    assert s[1, 2] == pytest.approx((0.3 * ratio + 0.35) / (0.3 + 0.35 + 0.175)) and s[1, 3] == pytest.approx(0.3 / (0.3 + 0.175)) and (1, 4) not in s
    assert fuzzy.drop_second(d, "id", spark.createDataFrame([(1, 2)], "id_1 long, id_2 long")).count() == 3


def test_workflow(spark):
    d = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    w = Workflow(d)
    w.take_checkpoint()
    good, bad = types.convert_or_quarantine(d, "v", "float64")
    w.apply("convert", lambda _: StepResult(good, quarantine_rows(bad, "convert", "no number", "v")))
    assert not w.may_export() and w.audit()["quarantined"] == 1 and w.audit()["dropped"] == 0
    assert w.apply("drop", columns.drop, "none").failure == HARD_STOP and len(w.states) == 2
    assert w.undo() and w.df.dtypes == [("v", "string")] and w.redo() and w.df.dtypes == [("v", "double")] and not w.redo()
    w.resolve("include")
    assert w.may_export() and w.df.count() == 3
    assert row_digest(d) == row_digest(d.repartition(3)) != row_digest(d.limit(2))


def test_scores_and_assistant(spark):
    d = spark.createDataFrame([(i, None if i < 30 else float(i % 7), "c") for i in range(100)], "i long, v double, k string")
    f = quality.facts(d.unionByName(d.limit(12)))
    recs = quality.recommendations(f)
    assert [r["priority"] for r in recs][0] == "high" and {"duplicate rows", "constant columns", "missing values"} <= {r["issue"] for r in recs}
    assert quality.grade(85) == "A" and quality.grade(39.9) == "F" and quality.assistant_score([]) == (100, "A")
    r = assistant.parse("group by region and plot 'Total Sales'", ["Region", "plo", "total"])
    assert r.intents == ["aggregation", "chart"] and r.columns == ["Region", "total", "Total Sales"] and r.confidence == pytest.approx(0.8)
    assert assistant.parse("  ").confidence == 0 and assistant.find_column(d, "K") == ("k", "categorical") and assistant.find_column(d, "zz") == (None, None)
    assert charts.downsample(d, "i", above=50, to=20).count() == 20 and charts.downsample(d, "i", above=500).count() == 100


def test_files(spark, tmp_path):
    from millrace.sources import readers, sinks

    p = tmp_path / "a.csv"
    p.write_text("junk\nid,name,v\n1,NA,2.5\n2,b,-\n")
    d = readers.read(spark, str(p), "csv", skip_rows=1, index="id")
    assert d.columns == ["id", "name", "v"] and [tuple(r) for r in d.collect()] == [("1", None, "2.5"), ("2", "b", None)]
    assert readers.validate(spark, str(p), "csv").status == "PASS"
    (tmp_path / "e.csv").write_text("")
    assert readers.validate(spark, str(tmp_path / "e.csv"), "csv").status == "BLOCK"
    (tmp_path / "r.csv").write_text("a,b\n1,2,3,4,5,6\n")
    assert readers.validate(spark, str(tmp_path / "r.csv"), "csv").status == "WARN"
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.read(spark, str(tmp_path / "j.json"), "json").count() == 2
    (tmp_path / "l.csv").write_bytes("a\nÄrger\n".encode("latin-1"))
    assert readers.probe_encoding(spark, str(tmp_path / "l.csv")) == "iso-8859-1"
    t = spark.createDataFrame([(1, "it's", None)], "a int, b string, c double")
    assert sinks.insert_statements(t, "t").first()[0] == "INSERT INTO t (a, b, c) VALUES (1, 'it''s', NULL);"
    assert "c REAL" in sinks.sql_script(t, "t")
    at = str(tmp_path / "projects")
    sinks.save_project(t, at, "my/../project")
    back, meta = sinks.load_project(spark, at, "my/../project")
    assert back.collect() == t.collect() and meta["columns"] == ["a", "b", "c"] and sinks.list_projects(spark, at) == ["myproject"]
    assert sinks.delete_project(spark, at, "my/../project") and sinks.list_projects(spark, at) == []
    assert "<h1>R&amp;D</h1>" in sinks.html_report(t, "R&D")
    for orient in ("records", "values", "index", "columns"):
        assert sinks.json_lines(t, orient, row="a").count() > 0
    assert sinks.size_estimate(t, "json") > sinks.size_estimate(t, "parquet") > 0
    with pytest.raises(NotImplementedError):
        readers.read(spark, "x.xls")


def test_classes(spark):
    d = spark.createDataFrame([(1, "a", True, float("nan"))], "n int, s string, b boolean, f double")
    assert se.column_classes(d) == {"n": "numeric", "s": "categorical", "b": "boolean", "f": "numeric"}
    assert se.nan_to_null(d).first().f is None


def test_correlation_matrices_equal_pandas(spark):
    """Every pair of columns over the rows that have both; constant columns have no correlation."""
    rnd = random.Random(5)
    cells = [[rnd.choice([None, float(rnd.randrange(6))]) if rnd.random() < 0.2 else float(rnd.randrange(40)) for _ in range(3)] + [1.0] for _ in range(150)]
    p = pd.DataFrame(cells, columns=list("abcd")).astype(float)
    d = spark.createDataFrame([tuple(r) for r in cells], "a double, b double, c double, d double").repartition(5)
    for how in ("pearson", "spearman", "kendall"):
        got = {(r.a, r.b): r.r for r in statistics.correlations(d, list("abcd"), how).collect()}
        assert len(got) == 6
        for (a, b), v in got.items():
            both = p[[a, b]].dropna()
            want = brute_tau(both) if how == "kendall" else (both.rank() if how == "spearman" else both).corr().iloc[0, 1]
            assert v is None if "d" in (a, b) else v == pytest.approx(want), (how, a, b)


def brute_tau(both):
    x, y = both.iloc[:, 0].tolist(), both.iloc[:, 1].tolist()
    sign = lambda v: (v > 0) - (v < 0)
    s = tx = ty = n = 0
    for i in range(len(x)):
        for j in range(i):
            s += sign(x[i] - x[j]) * sign(y[i] - y[j])
            tx += x[i] == x[j]
            ty += y[i] == y[j]
            n += 1
    return s / math.sqrt((n - tx) * (n - ty)) if (n - tx) * (n - ty) else None


def test_kendall_of_many_values(spark):
    """More distinct pairs than a quadratic way would take: y is x turned around in blocks of ten."""
    d = spark.range(40_000).selectExpr("cast(id as double) a", "cast(id - id % 10 + 9 - id % 10 as double) b")
    n = 40_000
    want = 1 - 4 * (n / 10 * 45) / (n * (n - 1))
    assert statistics.kendall(d, ["a", "b"]).first().r == pytest.approx(want)


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_quantiles_of_columns_and_groups(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "BOUND", few)
    rnd = random.Random(3)
    rows_ = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([None, float(rnd.randrange(9))]), rnd.random()) for _ in range(400)] + [("lone", None, 0.5)]
    d, p = spark.createDataFrame(rows_, "g string, a double, b double"), pd.DataFrame(rows_, columns=["g", "a", "b"])
    got = {(r.g, r.column_name): r.q for r in quantiles.quantiles(d, ["a", "b"], [0.1, 0.5, 0.75], ["g"]).collect()}
    want = {(g, c): v[c].dropna().astype(float).quantile([0.1, 0.5, 0.75]).tolist() for g, v in p.groupby("g") for c in ("a", "b") if v[c].notna().any()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    whole = {r.column_name: r for r in statistics.profile_numeric(d, ["a", "b"]).collect()}
    assert whole["a"].median == pytest.approx(p["a"].astype(float).median()) and whole["b"].q3 == pytest.approx(p["b"].quantile(0.75))
    assert statistics.profile_numeric(d.filter("g = 'lone'"), ["a"]).first().median is None
    assert [r.median for r in statistics.summary(d, "b", "g").orderBy("g").collect()] == pytest.approx(p.groupby("g")["b"].median().tolist())
    filled = cleaning.fill_missing_by(d, "a", "g", "median")
    assert filled.filter("a is null").count() == sum(r[0] is None and r[1] is None for r in rows_) + 1
    assert reshape.pivot(d, ["g"], ["g"], ["b"], "median").count() == 3
    assert cleaning.iqr_fences(spark.createDataFrame([], "v double"), "v").first().asDict() == {"__lo": None, "__hi": None}


def test_ties_are_dealt_over_ranges(spark):
    """A value that nearly all rows have is no single task, neither in a column of its own nor beside others."""
    for d in (spark.range(40_000).selectExpr("cast(if(id % 10 = 0, id, 7) as long) v"), spark.range(40_000).selectExpr("if(id % 10 = 0, id, 7) v", "id i")):
        at = ordered.with_row_id(d.repartition(6), "v")
        sizes = [r[0] for r in at.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < 20_000 and at.select(ordered.ROW).distinct().count() == 40_000
        assert at.agg(F.max(ordered.ROW)).first()[0] == 39_999
        assert [r.v for r in at.orderBy(ordered.ROW).limit(3).collect()] == [0, 7, 7]


def test_places_of_hot_values(spark):
    d = spark.range(30_000).selectExpr("if(id < 29000, 5.0, cast(id as double)) v")
    e = ordered.ecdf(d, "v")
    assert e.count() == 30_000 and e.filter("value = 5").agg(F.max("ecdf")).first()[0] == pytest.approx(29 / 30)
    assert e.select("ecdf").distinct().count() == 30_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert max(r[0] for r in e.groupBy(F.spark_partition_id()).count().select("count").collect()) < 20_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cleaning.winsorize(d, "v", 0.0, 0.5).agg(F.max("v")).first()[0] == 5.0


def test_samples_of_hot_classes(spark):
    d = spark.range(20_000).selectExpr("id", "if(id % 10 = 0, 'b', 'hot') c")
    want = [r.id for r in d.orderBy(rows.mixed(F.col("id")), "id").limit(2000).collect()]
    assert sorted(r.id for r in rows.sample_fraction(d, 0.1, "id").collect()) == sorted(want)
    assert {r.c: r["count"] for r in rows.stratified_sample(d, "c", 1000, "id").groupBy("c").count().collect()} == {"hot": 900, "b": 100}
    assert rows.sample_fraction(d, 0.0, "id").count() == 0 and rows.sample_fraction(d, 1.0, "id").count() == 20_000


def test_duplicates_of_hot_keys(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), ("a", 1), (None, 2), (None, None), ("b", 9)], "k string, o int")
    got = sorted(map(str, ((r.k, r.o, r.is_duplicate) for r in rows.flag_duplicates(d, ["k"], "o").collect())))
    assert got == sorted(map(str, [("a", 1, False), ("a", 1, True), ("a", 3, True), (None, None, False), (None, 2, True), ("b", 9, False)]))
    assert [tuple(r) for r in rows.drop_duplicates(d, ["k"], "none").collect()] == [("b", 9)]


def test_cramers_of_many_columns(spark):
    rnd = random.Random(4)
    cells = [tuple(rnd.choice("abc") for _ in range(20)) for _ in range(60)]
    d = spark.createDataFrame(cells, ", ".join(f"c{i} string" for i in range(20)))
    got = statistics.cramers_matrix(d, d.columns)
    assert got.count() == 190
    v = {(r.a, r.b): r.v for r in got.collect()}
    n = pd.crosstab(pd.Series([c[0] for c in cells]), pd.Series([c[19] for c in cells])).to_numpy()
    e = n.sum(1, keepdims=True) * n.sum(0) / n.sum()
    phi = max(0, ((n - e) ** 2 / e).sum() / 60 - 4 / 59)
    assert v["c0", "c19"] == pytest.approx(math.sqrt(phi / (3 - 4 / 59 - 1)))


def test_wide_crosstabs_are_refused(spark):
    d = spark.range(3000).selectExpr("id a", "id b")
    with pytest.raises(HardStop):
        statistics.crosstab(d, "a", "b")
    assert statistics.crosstab(d, "a", "b", zeros=False).count() == 3000


def test_types_are_of_all_rows(spark):
    """A head that parses doesn't decide, whatever the order of rows."""
    head = [(i, str(i)) for i in range(6000)]
    d = spark.createDataFrame(head + [(i, "word") for i in range(6000, 12000)], "i long, v string")
    for x in (d, d.orderBy(F.desc("i"))):
        assert dict(types.auto_convert(x).dtypes)["v"] == "string" and "v" not in types.suggest_types(x) or types.suggest_types(x)["v"] != "float64"
    most = spark.createDataFrame(head + [(9000, "word")], "i long, v string")
    assert types.conversion_losses(most, types.auto_convert(most)) == {"v": 1}


def test_row_wise_deviation(spark):
    d = spark.createDataFrame([(1.0, 2.0, 4.0), (None, 3.0, 5.0), (None, None, 1.0), (None, None, None)], "a double, b double, c double")
    from millrace.functions.math import row_wise

    got = d.select(*[row_wise(["a", "b", "c"], h).alias(h) for h in ("sum", "mean", "median", "min", "max", "std", "range")]).collect()
    want = pd.DataFrame([[1, 2, 4], [None, 3, 5], [None, None, 1], [None] * 3], dtype=float)
    for h in ("mean", "median", "min", "max", "std"):
        assert [r[h] for r in got] == [None if math.isnan(v) else pytest.approx(v) for v in getattr(want, h)(axis=1)]
    assert [r["range"] for r in got] == [3.0, 2.0, 0.0, None]


def test_copies_are_no_pairs(spark):
    """A record that many rows repeat is one; its rows are found by records()."""
    hot = spark.range(100_000).selectExpr("id", "'mary major' name", "'m@x.com' email")
    d = hot.unionByName(spark.createDataFrame([(200_000, "mary mayor", "m@x.com"), (200_001, "mary major", "other@y.org")], hot.schema))
    pairs = sorted((r.id_1, r.id_2) for r in fuzzy.score_pairs(d, "id", "name", ["email"], confidence=0.0).collect())
    assert pairs == [(0, 200_000), (0, 200_001), (200_000, 200_001)]
    of = fuzzy.records(d, "id", ["name", "email"])
    assert of.count() == 100_002 and of.filter("record_id = 0").count() == 100_000


def test_workbooks(spark, tmp_path):
    import datetime as dt
    import zipfile

    from millrace.sources import excel, readers

    rows_ = [(1, "a <b> & \"c\"", 0.5, True, dt.datetime(2024, 2, 29, 13, 30)), (2, None, None, None, None), (3, " spaces  ", -1e-7, False, dt.datetime(1999, 1, 1)), (4, "N/A\x01", 3.0, True, None)]
    d = spark.createDataFrame(rows_, "n int, t string, x double, b boolean, at timestamp_ntz")
    path = str(tmp_path / "book.xlsx")
    excel.write_excel(d, path, "Sheet & Co")
    assert excel.sheet_names(spark, path) == ["Sheet & Co"]
    got = readers.read(spark, path)
    assert dict(got.dtypes) == {"n": "bigint", "t": "string", "x": "double", "b": "boolean", "at": "timestamp_ntz"}
    assert sorted(map(tuple, got.collect())) == [rows_[0], rows_[1], rows_[2], (4, None, 3.0, True, None)]
    assert readers.read(spark, path, sheet="Sheet & Co", skip_rows=2, header=False, nulls=["x"]).count() == 3
    assert excel.read_excel(spark, path, n=2).count() == 2
    with pytest.raises(HardStop):
        excel.read_excel(spark, path, "nothing")
    (tmp_path / "no.xlsx").write_text("text")
    with pytest.raises(HardStop):
        readers.read(spark, str(tmp_path / "no.xlsx"))
    # As other programs write them: shared texts, gaps, a custom format of dates.
    with zipfile.ZipFile(path) as z, zipfile.ZipFile(tmp_path / "other.xlsx", "w") as o:
        for n in z.namelist():
            if "sheet1" not in n and "styles" not in n:
                o.writestr(n, z.read(n))
        o.writestr("xl/styles.xml", f'<styleSheet xmlns="{excel.MAIN}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        o.writestr("xl/sharedStrings.xml", f'<sst xmlns="{excel.MAIN}"><si><t>name</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>')
        o.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{excel.MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="str"><v>day</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="1"><v>45351</v></c></row></sheetData></worksheet>')
    other = excel.read_excel(spark, str(tmp_path / "other.xlsx"))
    assert other.columns == ["name", "Unnamed: 1", "day"] and [tuple(r) for r in other.collect()] == [(None, None, None), ("one", None, dt.datetime(2024, 2, 29))]


@pytest.mark.parametrize("indent", [False, True])
def test_json_documents(spark, indent):
    import json

    from millrace.sources import sinks

    d = spark.createDataFrame([(1, "a \"q\"", 0.5), (2, None, None), (3, "é\n", 2.0)], "i long, t string, x double")
    for empty in (d, d.limit(0)):
        p = empty.toPandas().set_index("i")
        text = {o: "".join(r.value for r in sinks.json_document(empty, o, row="i", indent=indent).orderBy("ord").collect()) for o in ("columns", "index", "records", "values")}
        rows_ = [{"t": r.t, "x": None if math.isnan(r.x) else r.x} for r in p.itertuples()]
        assert json.loads(text["records"]) == rows_ and json.loads(text["values"]) == [list(r.values()) for r in rows_]
        assert json.loads(text["index"]) == {str(i): r for i, r in zip(p.index, rows_, strict=True)}
        assert json.loads(text["columns"]) == {c: {str(i): r[c] for i, r in zip(p.index, rows_, strict=True)} for c in ("t", "x")}


def test_skipped_lines_of_several_files(spark, tmp_path):
    from millrace.sources import readers

    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("note\n\nname|n\n" + "".join(f"\"x|{i}\"|{k}\n" for i in range(50)))
    got = readers.read(spark, str(tmp_path), "csv", skip_rows=2, sep="|")
    assert got.columns == ["name", "n"] and got.count() == 150 and got.filter("name like 'x|%'").count() == 150
    assert readers.read(spark, str(tmp_path), "csv", skip_rows=2, header=False, sep="|", schema="a string, b int").filter("b is not null").count() == 150
    assert readers.read(spark, str(tmp_path), "csv", skip_rows=500, sep="|").count() == 0


def test_assistant_plans():
    assert assistant.template("please clean and visualize") == assistant.TEMPLATES["clean_and_visualize"]
    assert assistant.template("clean") == [] and assistant.template("date parts") == assistant.TEMPLATES["time_series_analysis"]
    assert assistant.follow_ups(["remove_nulls", "remove_duplicates"]) == ["look at the profile again"] and assistant.follow_ups(["sort_data"]) == []


@pytest.mark.parametrize("bucket", [4, 1 << 16])
def test_fill_within_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(ordered, "BUCKET", bucket)
    rnd = random.Random(6)
    rows_ = [(i, rnd.choice(["hot", "hot", "b", None]), None if rnd.random() < 0.5 else float(i)) for i in range(60)]
    d = ordered.with_row_id(spark.createDataFrame(rows_, "i long, g string, v double").repartition(4), "i")
    p = pd.DataFrame(rows_, columns=["i", "g", "v"])
    for how, want in (("forward", p.groupby("g", dropna=False)["v"].ffill()), ("backward", p.groupby("g", dropna=False)["v"].bfill())):
        got = ordered.fill(d, "v", how, by=["g"])
        assert got.columns == d.columns and col(got) == [None if math.isnan(v) else v for v in want]


def test_csv_records_in_blocks(spark, tmp_path):
    """As Python's reader has them, wherever blocks begin: line breaks, separators, doubled and stray quotes, an unclosed cell."""
    import csv
    import io
    import random

    from millrace.sources.delimited import read_csv

    rng = random.Random(4)
    cells = ["plain", "", "with, comma", "line\nbreak", "crlf\r\nin", 'say "hi"', '"', '""', " lead", "trail ", "é漢", "x" * 90, "a\n\n\nb", '"\n"', "#hash", "\t"]
    texts = ['a,b\n1,"x\ny"\n2,"say ""hi"", ok"\n3,plain\n', 'a,b\n5" disk,x\n6" tape,"y\nz"\n', 'a,b\n1,"un\nclosed', "a,b\n", '\n\na,b\n\n1,"2\n\n"\n \n3,4', "a,b\n1\n1,2,3\n"]
    for i, text in enumerate(("\ufeffa,b\n1,2\n", '\ufeffa,b\n1,"2\n"\n')):
        (tmp_path / f"mark{i}.csv").write_bytes(text.encode())
        assert read_csv(spark, str(tmp_path / f"mark{i}.csv")).columns == ["a", "b"]
    for end in ("\n", "\r\n"):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows([["c1", "c2", "c3"], *([rng.choice(cells) for _ in range(3)] for _ in range(40))])
        texts.append(out.getvalue())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for i, text in enumerate(texts):
            (tmp_path / f"{i}.csv").write_bytes(text.encode())
            head, *want = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
            for size in (20, 333, 1 << 20) if "5\"" not in text else (1 << 20,):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                got = read_csv(spark, str(tmp_path / f"{i}.csv"))
                assert got.columns == head
                assert sorted(tuple(c or "" for c in r) for r in got.collect()) == sorted(tuple((r + [""] * len(head))[: len(head)]) for r in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_csv_written_cells_come_back(spark, tmp_path):
    """By this reader and by Python's, in either encoding; empty texts and nulls stay apart."""
    import csv

    from millrace.sources.delimited import read_csv
    from millrace.sources.sinks import write_csv

    cells = ["", None, "a,b", 'say "hi"', "two\nlines", "cr\r\nlf", " blanks ", "é", '"', "#", "\\", '\\"', "null"]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in cells for b in cells)]
    for encoding in ("utf-8", "iso-8859-1"):
        path = str(tmp_path / encoding)
        write_csv(spark.createDataFrame(rows, "i int, a string, b string"), path, encoding=encoding)
        assert sorted(map(tuple, read_csv(spark, path, encoding=encoding, schema="i int, a string, b string").collect())) == rows
        plain = [r for f in (tmp_path / encoding).glob("*.csv") for r in list(csv.reader(f.open(encoding=encoding, newline="")))[1:]]
        assert sorted(plain, key=lambda r: int(r[0])) == [[str(i), a or "", b or ""] for i, a, b in rows]


def test_encodings_and_json_layouts_by_the_whole(spark, tmp_path):
    from millrace.sources import readers

    (tmp_path / "late.csv").write_bytes(b"a,b\n" * 1500 + "caf\u00e9,1\n".encode("latin-1"))
    assert readers.probe_encoding(spark, str(tmp_path / "late.csv")) == "iso-8859-1"
    assert readers.read(spark, str(tmp_path / "late.csv"), encoding="iso-8859-1").filter("a = 'caf\u00e9'").count() == 1
    (tmp_path / "empty.csv").write_bytes(b"")
    assert readers.probe_encoding(spark, str(tmp_path / "empty.csv")) == "utf-8"
    for i, (text, n) in enumerate([('{"a": {"b": 1}\n, "c": 2}', 1), ('{"a": {"b": 1}, "c": 2}\n{"a": {"b": 3}, "c": 4}\n', 2), ('[{"c": 1,\n"a": {"b": 1}},\n{"c": 2}]', 2), ('[{"c": 1, "a": {"b": 1}}, {"c": 2}]', 2), ('\n\n{"c": 1, "a": {"b": 7}}', 1)]):
        (tmp_path / f"{i}.json").write_text(text)
        d = readers.read(spark, str(tmp_path / f"{i}.json"))
        assert d.select("a.b", "c").count() == n and "_corrupt_record" not in d.columns


@pytest.mark.parametrize(("bound", "sketch", "grid", "slack"), [(1 << 18, 4096, 1024, 3), (40, 16, 20, 1), (1, 8, 4, 0)])
def test_quantiles_equal_numpy_to_the_bit(spark, monkeypatch, bound, sketch, grid, slack):
    """By ordering all values, by brackets in turns, and by brackets that are often wrong: hot values, few values, infinities."""
    for k, v in {"BOUND": bound, "SKETCH": sketch, "GRID": grid, "SLACK": slack}.items():
        monkeypatch.setattr(quantiles, k, v)
    rng = np.random.default_rng(3)
    n, ps = 3001, [i / 19 for i in range(20)] + [0.001, 0.5]
    p = pd.DataFrame({"x": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.6, 7.0, np.round(rng.normal(size=n), 1)), "few": rng.integers(0, 3, n).astype(float), "wide": np.exp(rng.normal(size=n) * 50), "g": rng.integers(0, 2, n)})
    p.loc[5, "wide"] = np.inf
    cols = ["x", "hot", "few", "wide"]
    d = spark.createDataFrame(p)
    got = {r.column_name: r.q for r in quantiles.quantiles(d, cols, ps).collect()}
    with np.errstate(invalid="ignore"):
        assert all(got[c][:-3] + got[c][-2:] == (w := np.quantile(p[c].to_numpy(), ps).tolist())[:-3] + w[-2:] for c in cols)
        if bound > 1 or sketch > 8:
            by = {(r.g, r.column_name): r.q for r in quantiles.quantiles(d, cols[:2], ps, ["g"]).collect()}
            assert all(by[g, c] == np.quantile(v[c].to_numpy(), ps).tolist() for g, v in p.groupby("g") for c in cols[:2])


def test_quantiles_at_the_bound(spark, monkeypatch):
    """One more value than are ordered in a task changes nothing."""
    n = quantiles.BOUND
    for k in (n, n + 1):
        d = spark.range(k).select((F.xxhash64("id") % 1_000_003 / 7).alias("v"))
        assert quantiles.quantiles(d, ["v"], [0.1, 0.5, 0.77]).first().q == np.quantile(d.toPandas().v.to_numpy(), [0.1, 0.5, 0.77]).tolist()


def _tau(x, y):
    """Tau-b by all pairs."""
    a, b = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (a * b).sum() / np.sqrt(np.abs(a).sum() * np.abs(b).sum())


@pytest.mark.parametrize("bound", [1 << 19, 64])
def test_rank_correlations_by_ranges(spark, monkeypatch, bound):
    """In one task, and cut into ranges again and again; hot values, nulls, ties, columns that don't vary."""
    monkeypatch.setattr(statistics, "INVERSIONS", bound)
    rng = np.random.default_rng(6)
    n = 700
    p = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 40, n).astype(float), "c": np.where(rng.random(n) < 0.5, 3.0, rng.normal(size=n)), "d": np.ones(n)})
    p["a"] += p["b"] / 30
    p.loc[rng.random(n) < 0.2, "b"] = np.nan
    p.loc[rng.random(n) < 0.1, "c"] = np.nan
    d = spark.createDataFrame(p.astype(object).where(p.notna(), None), "a double, b double, c double, d double")
    for method in ("kendall", "spearman"):
        got = {(r.a, r.b): r.r for r in statistics.correlations(d, list("abcd"), method).collect()}
        assert len(got) == 6 and all(got[k] is None for k in got if "d" in k)
        for k in (("a", "b"), ("a", "c"), ("b", "c")):
            both = p[list(k)].dropna()
            want = _tau(*both.to_numpy().T) if method == "kendall" else both.rank().corr().iloc[0, 1]
            assert got[k] == pytest.approx(want, abs=1e-9), (method, k)


def test_inversions():
    rng = np.random.default_rng(8)
    for m in (1, 2, 7, 200):
        x, y, n = rng.integers(0, 12, m), rng.integers(-5, 12, m) / 2, rng.integers(1, 9, m)
        want = sum(int(n[i]) * int(n[j]) for i in range(m) for j in range(m) if x[i] < x[j] and y[i] > y[j])
        assert statistics.inversions(x, y, n) == want


def test_erfc_and_cut_kernels(spark):
    d = spark.createDataFrame([(float(x),) for x in np.concatenate([np.linspace(-6, 26, 3001), [0.46875, 4.0, 0.0]])], "x double")
    got = d.select("x", statistics.erfc(F.col("x")).alias("e")).toPandas()
    want = np.array([math.erfc(x) for x in got.x])
    assert np.allclose(got.e, want, rtol=1e-12, atol=0)
    v = np.concatenate([np.random.default_rng(1).normal(size=300), [40.0, 41.0]])
    d = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    k = statistics.kde(d, "v", 50).orderBy("x").toPandas()
    h = v.std(ddof=1) * len(v) ** -0.2
    dense = np.exp(-(((k.x.to_numpy()[:, None] - v) / h) ** 2) / 2).sum(axis=1) / h / len(v) / math.sqrt(2 * math.pi)
    assert len(k) == 50 and np.allclose(k.density, dense, rtol=0, atol=math.exp(-32)) and (k.density == 0).any()
    assert statistics.kde(d.filter("v is null"), "v").count() == 0


def test_column_metadata_counts_values(spark):
    d = spark.createDataFrame([(1, 0.0, "a", None), (2, -0.0, "b", None), (2, 1.0, None, None)], "n int, x double, t string, status string")
    out = quality.column_metadata(d)
    got = {r.column_name: (r.kind, round(r.missing_pct, 1), r.n_unique, r.relevance) for r in out.collect()}
    assert got == {"n": ("numeric", 0.0, 2, "High"), "x": ("binary", 0.0, 2, "High"), "t": ("binary", 33.3, 2, "Medium"), "status": ("categorical", 100.0, 0, "Target")}
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("tile", [2048, 3])
def test_similar_values_at_every_threshold(spark, monkeypatch, tile):
    """Against all pairs of which none is twice as long as the other, down to 0.3: shared pieces, texts too short to have any, texts of one length, in one tile and in many."""
    monkeypatch.setattr(fuzzy, "TILE", tile)
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choices("abcé ", k=rnd.randrange(3, 16))).strip() for _ in range(60)} | {"common start " + "".join(rnd.choices("xyz", k=4)) for _ in range(25)} | {"q" * 300, "q" * 290 + "r" * 9})
    words = [w for w in words if len(w) > 2]
    d = spark.createDataFrame(list(enumerate(words)), "id int, name string")
    for t in (0.3, 0.5, 0.6, 0.85):
        out = fuzzy.similar_values(d, "name", "id", t)
        got = {(r.a, r.b) for r in out.collect()}
        want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if _ratio(a, b) >= t and 2 * min(len(a), len(b)) >= max(len(a), len(b))}
        assert got == want, t
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_of_a_hot_name_in_tiles(spark, monkeypatch):
    """Tiles give the pairs that the whole gives, each once, whichever record comes first."""
    rnd = random.Random(4)
    rows_ = [(i, "one hot name" if i % 3 else rnd.choice(["one hot nome", "another name"]), f"mail{rnd.randrange(6)}@x.org", rnd.choice([None, "555 1234"])) for i in range(90)]
    d = spark.createDataFrame(rows_, "id int, name string, email string, phone string")
    whole = [tuple(r) for r in fuzzy.score_pairs(d, "id", "name", ["email", "phone"], 0.85, 0.3).collect()]
    monkeypatch.setattr(fuzzy, "RECORDS", 2)
    tiled = [tuple(r) for r in fuzzy.score_pairs(d, "id", "name", ["email", "phone"], 0.85, 0.3).collect()]
    assert sorted(tiled) == sorted(whole) and len({t[:2] for t in tiled}) == len(tiled) > 50


def test_guard_suggestions_and_sizes(spark):
    from millrace.plans.workflow import TransformRegistry
    from millrace.sources import sinks

    g, d = TransformRegistry(), nums(spark, [1.0, 2.0])
    twice = lambda x: x.withColumn("v", F.col("v") * 2)
    for name, force in (("sqrt", False), ("Square root", False), ("log", False), ("sqrt", True)):
        d = g.apply(d, "v", name, twice, force)
    assert [r.v for r in d.select("v").collect()] == [8.0, 16.0] and g.done == {"v": ["sqrt", "log", "sqrt"]}
    e = spark.createDataFrame([(1.0, None, "a"), (2.0, None, None), (100.0, 3.0, "b")], "x double, y double, t string")
    assert {r.column_name: r.how for r in cleaning.suggest_fills(e).collect()} == {"x": "median", "y": "drop column", "t": "grouped fill or drop rows"}
    assert {r.format: r.bytes for r in sinks.measured_sizes(e).collect()}["sql"] == 3 * 16 + 2
    assert rows.schema_values(e, e).count() == 0
    assert [r.intents for r in assistant.intents_of(spark.createDataFrame([(None,), ("plot it",)], "q string"), "q").collect()] == [[], ["chart"]]


def test_folders_of_workbooks(spark, tmp_path):
    """Each task's rows in workbooks of its own; types by all of them; an empty table; headers that differ."""
    import datetime as dt

    from millrace.sources import excel

    rows_ = [(i, i / 4 if i % 2 else float(i), None if i % 5 == 0 else f"t<{i}>&", dt.datetime(2024, 1, 1 + i % 28, 12), i % 2 == 0) for i in range(50)]
    d = spark.createDataFrame(rows_, "i int, x double, t string, `at.time` timestamp_ntz, b boolean")
    path = str(tmp_path / "books")
    excel.write_excel(d.repartition(3), path, rows=7)
    assert len(list((tmp_path / "books").glob("*.xlsx"))) >= 8 and not [f for f in (tmp_path / "books").iterdir() if f.suffix not in (".xlsx", ".crc")]
    back = excel.read_excel(spark, path)
    assert back.dtypes == [("i", "bigint"), ("x", "double"), ("t", "string"), ("at.time", "timestamp_ntz"), ("b", "boolean")]
    assert sorted(map(tuple, back.collect())) == rows_
    assert excel.read_excel(spark, path, n=3).count() == 3 and excel.sheet_names(spark, path) == ["Data"]
    excel.write_excel(d.filter("i < 0"), path)
    assert excel.read_excel(spark, path).columns == d.columns and excel.read_excel(spark, path).count() == 0
    excel.write_excel(d.select("x"), path + "/more.xlsx")
    with pytest.raises(HardStop, match="headers"):
        excel.read_excel(spark, path)


def test_workbooks_longer_than_a_batch(spark, tmp_path):
    """A sheet of more rows than a batch keeps the rows between batches; one of whole batches ends with its last one."""
    from millrace.sources import excel

    for n in (8192, 10_000):
        path = str(tmp_path / f"long{n}.xlsx")
        excel.write_excel(spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("t")), path)
        assert sorted(map(tuple, excel.read_excel(spark, path).collect())) == [(i, f"t{i}") for i in range(n)]


def test_chart_points_beyond_the_bound(spark):
    """A matrix has as many fixed rows of a large table as it is asked for."""
    d = spark.range(50_400).select("id", (F.col("id") % 7).alias("x"))
    got = [r.id for r in charts.multivariate(d, "matrix", ["x"], key="id", to=50_000).collect()]
    assert sorted(got) == sorted(r.id for r in rows.sample_rows(d, 50_000, "id").collect()) and len(set(got)) == 50_000
    assert charts.multivariate(d, "matrix", ["x"], key="id").count() == charts.TO


def test_first_points_of_charts(spark):
    """By key, and of a line by x and key, whatever the partitions; without a number a line has all points."""
    d = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 37 % 90).alias("x"), (F.col("id") / 2).alias("y"))
    all_ = sorted((r.x, r.k, r.y) for r in d.collect())
    got = [(r.x, r.k, r.y) for r in charts.bivariate(d.repartition(5), "line", "x", "y", key="k", first=333).collect()]
    assert got == all_[:333]
    assert sorted(r.k for r in charts.bivariate(d.repartition(5), "scatter", "x", "y", key="k", first=77).collect()) == list(range(77))
    assert charts.bivariate(d, "line", "x", "y").count() == 900


def _slips(rnd, text, letters):
    for _ in range(rnd.randrange(5)):
        p = rnd.randrange(len(text))
        text = text[:p] + rnd.choice(["", rnd.choice(letters), rnd.choice(letters) + text[p]]) + text[p + 1 :]
    return text or "x"


@pytest.mark.parametrize("letters", ["ab", "abcdefé", "abcdefghijklmnop"])
def test_near_texts_lose_no_pair(letters):
    """Texts with slips, common beginnings and repeats, within a tile and between two, against all pairs."""
    from millrace.operators.near_texts import near_pairs

    rnd = random.Random(3)
    words = ["".join(rnd.choices(letters, k=rnd.randrange(3, 45))) for _ in range(22)]
    words = sorted({x for w in words for x in (w, _slips(rnd, w, letters), "name " + w, w + w[:20])}, key=lambda x: (len(x), x))
    half = len(words) // 2
    for t in (0.3, 0.75, 0.85, 0.9, 1.0):
        for longer, shorter, same in ((words, words, True), (words[half:], words[:half], False)):
            got = set(zip(*(x.tolist() for x in near_pairs(longer, shorter, t, same)), strict=True))
            want = {(a, b) for a, v in enumerate(longer) for b, w in enumerate(shorter[:a] if same else shorter) if 2 * len(w) >= len(v) and _ratio(v, w) >= t}
            assert want <= got, (t, same)
            assert not same or all(a > b for a, b in got)


def test_similar_values_shuffle_no_candidates(spark):
    """Texts of few letters, of which all share short pieces: few pairs leave the tasks that compare them."""
    name = F.concat(F.lit("name "), F.translate(F.sha1(F.col("id").cast("string")), "0123456789", "ghijklmnop"))
    values = spark.range(4000).select("id", name.alias("v"), name.alias("m"))
    assert fuzzy._all_met(values, 0.85).count() < 400


def _shuffled(spark, run):
    """Rows that the stages of run() write to shuffles."""
    sc = spark.sparkContext
    stages = lambda: (lambda x: [x.apply(i) for i in range(x.size())])(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()))
    last = max([x.stageId() for x in stages()], default=-1)
    out = run()
    return out, sum(x.shuffleWriteRecords() for x in stages() if x.stageId() > last)


def test_tiles_are_written_once(spark, monkeypatch):
    """What similar values and pairs of records shuffle doesn't grow with the number of tiles that a tile meets."""
    monkeypatch.setattr(fuzzy, "TILE", 64)
    sha = F.translate(F.sha1(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    d = spark.range(1000).select("id", F.concat(F.lit("name "), sha).alias("name"), F.lit("x@y.org").alias("email"))
    slips = d.filter("id < 20").select(F.col("id") + 5000, F.concat(F.substring("name", 1, 20), F.lit("xx"), F.substring("name", 23, 100)), "email")
    d = d.unionByName(slips.toDF("id", "name", "email"))
    got, shuffled = _shuffled(spark, lambda: fuzzy.similar_values(d, "name", "id", 0.85).collect())
    assert len(got) == 20 and shuffled < 4 * 1020  # 12 tiles, of which each meets all
    got, shuffled = _shuffled(spark, lambda: fuzzy.score_pairs(d, "id", "name", ["email"]).collect())
    assert sorted((r.id_1, r.id_2) for r in got) == [(i, i + 5000) for i in range(20)] and shuffled < 6 * 1020
    none = d.filter("id < 0")
    assert fuzzy.similar_values(none, "name", "id").count() == fuzzy.score_pairs(none, "id", "name", ["email"]).count() == fuzzy.groups(none, "name", "id").count() == 0


def test_pairs_by_a_column_of_any_name(spark):
    """Records that differ in the case of their name are two, also where the column is named as one of the operator's."""
    d = spark.createDataFrame([(1, "Anna Smith", "x"), (2, "anna smith", "x"), (3, "Berta", "y"), (4, "Berta", "y")], "id int, v string, n string")
    assert [(r.id_1, r.id_2) for r in fuzzy.score_pairs(d, "id", "v", ["n"]).collect()] == [(1, 2)]


def test_a_tile_that_came_out_larger_is_read_in_parts(spark, tmp_path):
    """In order of length, none lost, blanks at the ends of values kept; no part has much more characters than a tile."""
    words = sorted({"x" * (1 + i % 9) + str(i) for i in range(300)} | {"\xa0blank\t"})
    tiles, _ = fuzzy._write_tiles(spark.createDataFrame([(w,) for w in words], "v string"), str(tmp_path / "t"))
    read = [p for (t,) in sorted(tiles.select("tile").distinct().collect()) for p in fuzzy._read_tile(str(tmp_path / "t"), t, 200)]
    assert sorted(w for v, _ in read for w in v) == words and all([w.strip() for w in v] == m for v, m in read)
    sizes = [len(x) for _, m in read for x in m]
    assert sizes == sorted(sizes) and len(read) > 5 and all(sum(map(len, m)) < 320 for _, m in read)


def test_a_folder_is_as_large_as_its_largest_file(spark, tmp_path, monkeypatch):
    from millrace.sources import readers

    monkeypatch.setattr(readers, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(readers, "WARN_BYTES", 500)
    many = tmp_path / "many"
    many.mkdir()
    for i in range(5):
        (many / f"{i}.csv").write_text("a,b\n" + "1,2\n" * 100)
    assert readers.validate(spark, str(many), "csv").status == "PASS"
    (many / "5.csv").write_text("a,b\n" + "1,2\n" * 150)
    assert readers.validate(spark, str(many), "csv").status == "WARN"
    (many / "6.csv").write_text("a,b\n" + "1,2\n" * 300)
    assert readers.validate(spark, str(many), "csv").status == "BLOCK"


def test_csv_blocks_are_cut_as_lines_come():
    """A task that cuts a block holds the record it is at, and no block."""
    import pyarrow as pa
    from millrace.sources import delimited

    read = []

    def batches():
        for i in range(50):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"file": ["f"] * 3, "start": [0] * 3, "value": [b'"a', b'b",1', b"c,2"]})

    (own, lines) = next(blocks := delimited._blocks(batches(), 0))
    out = delimited._cut(lines, False, delimited.Lines(","))
    assert own == ("f", 0) and next(out)[1] == b'"a\nb",1' and next(out)[1] == b"c,2" and read == [0]
    assert len(list(out)) == 98 and next(blocks, None) is None


def test_near_texts_compare_few_pairs(monkeypatch):
    """Of names of a constant beginning and random letters few pairs are compared beyond their keys and counts, and all similar ones are found."""
    from hashlib import sha1

    from millrace.operators import near_texts

    name = lambda i: "name " + sha1(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    n, compared, fit = 6000, [], near_texts._fit
    monkeypatch.setattr(near_texts, "_fit", lambda left, right, i, j, *more: (compared.append(len(i)), fit(left, right, i, j, *more))[1])
    longer, shorter = [name(i) for i in range(n)], [name(i) for i in range(n, 2 * n)]
    for i in range(0, n, 100):
        shorter[i] = longer[i][:20] + "xx" + longer[i][22:]
    i, j = near_texts.near_pairs(longer, shorter, 0.85, False)
    assert {(x, x) for x in range(0, n, 100)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 100 and sum(compared) < n


def test_a_tile_that_meets_several_keeps_its_pieces():
    """Pieces laid for the first tile that it meets find all pairs with others, of other lengths too."""
    from millrace.operators.near_texts import Tile, near_pairs

    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(18, 60))) for _ in range(60)]
    words = sorted({x for w in words for x in (w, _slips(rnd, w, "abcdefgh"), w[: len(w) * 4 // 5])}, key=len)
    third = len(words) // 3
    lists = [words[:third], words[third : 2 * third], words[2 * third :]]
    tile = Tile(lists[2])
    for other in (lists[0], lists[1], tile):
        same = other is tile
        shorter = lists[2] if same else other
        got = set(zip(*(x.tolist() for x in near_pairs(tile, other, 0.8, same)), strict=True))
        want = {(a, b) for a, v in enumerate(lists[2]) for b, w in enumerate(shorter[:a] if same else shorter) if 2 * len(w) >= len(v) and _ratio(v, w) >= 0.8}
        assert want <= got and (want or shorter is lists[0])
