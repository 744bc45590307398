from millrace.llm import chat as x
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, s in sorted(set(rows), key=lambda v: (v[0] is None, v[0], v[1] is not None, v[1])):
        if c is not None:
            convs.setdefault(c, []).append((r, s))
    whole = {}
    for c, turns in convs.items():
        whole.setdefault(tuple(turns), []).append(c)
    proper = {k[:i] for k in whole for i in range(1, len(k))}
    return sorted((min(c), len(k), len(c), "".join(f"<|im_start|>{r or ''}\n{s or ''}<|im_end|>\n" for r, s in k)) for k, c in whole.items() if k not in proper)


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.segment)):
        out.setdefault((r.conv_id, r.n_turns, r.copies), []).append(r.rendered)
    return sorted((*k, "".join(v)) for k, v in out.items())


def conv(c, texts, start=0, step=1):
    return [(c, start + step * i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def test_snapshots(spark):
    rows = conv(1, "a") + conv(2, "ab") + conv(3, "abc") + conv(4, "abd", 5, 3) + conv(5, "abc", 1) + conv(6, "b") + conv(7, ["", None]) + conv(8, [""]) + conv(9, [None])
    rows += [(10, 0, None, "x"), (11, 0, "x", None), (12, 0, "a", "bc"), (13, 0, "ab", "c"), (None, 0, "user", "a"), (14, None, "user", "n"), (14, 0, "user", "m")]
    d = spark.createDataFrame(rows + rows[:5], SCHEMA)
    for c in ("a", "POS", "x", "segment", "part"):
        d = d.withColumn(c, F.lit(1))
    assert got(x.collapse_and_render(d)) == brute(rows)


def test_long_and_hot(spark, monkeypatch):
    monkeypatch.setattr(x, "BLOCK", 16)
    monkeypatch.setattr(x, "SEGMENT", 50)
    rows = conv(1, map(str, range(700))) + conv(2, map(str, range(650))) + conv(3, [*map(str, range(650)), "other"]) + [t for c in range(10, 200) for t in conv(c, ["hot", str(c % 50)])] + conv(500, ["hot"])
    out = x.collapse_and_render(spark.createDataFrame(rows, SCHEMA))
    assert got(out) == brute(rows)
    assert out.filter("conv_id = 1").count() == 14


def test_empty(spark):
    assert x.collapse_and_render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_turns_without_a_number_and_long_texts(spark, monkeypatch):
    """Turns that tie, or have no number, are dealt over blocks like others; a very long text is one turn."""
    monkeypatch.setattr(x, "BLOCK", 16)
    rows = [(1, None, "user", f"n{i}") for i in range(400)] + [(2, 7, "user", f"t{i}") for i in range(300)] + [(3, 1, "user", "w " * 300_000), (4, 1, "user", "w " * 300_000), (4, 2, "assistant", "ok")]
    d = spark.createDataFrame(rows + rows, SCHEMA).repartition(5)
    place = x.prefixes(d)
    assert {r.conv_id: (r.n, r.d) for r in place.groupBy("conv_id").agg(F.max("pos").alias("n"), F.count_distinct("pos").alias("d")).collect()} == {1: (400, 400), 2: (300, 300), 3: (1, 1), 4: (2, 2)}
    out = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in x.collapse_and_render(d).collect()}
    assert {c: v[:2] for c, v in out.items()} == {1: (400, 1), 2: (300, 1), 4: (2, 1)}  # 3 is a prefix of 4
    assert sorted(out[1][2].replace("<|im_start|>user\n", "").split("<|im_end|>\n")[:-1]) == sorted(f"n{i}" for i in range(400))
    again = {r.conv_id: r.rendered for r in x.collapse_and_render(d.repartition(3)).collect()}
    assert again == {c: v[2] for c, v in out.items()}
