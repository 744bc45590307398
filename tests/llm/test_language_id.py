import zlib

import numpy as np
from helpers import SCHEMA
from millrace.llm import language_id as x
from pyspark.sql import functions as F

WORDS = {"aa": "lamo siru pelato nemira olu".split(), "bb": "grikt shwanz krumpf tolk dwin".split(), "cc": "ёжик дома белый снег идёт".split()}


def corpus(n=240, seed=2):
    rng = np.random.default_rng(seed)
    langs = rng.choice(list(WORDS), n)
    return [(i, " ".join(rng.choice(WORDS[k], rng.integers(1, 40))), str(k), "s", 0) for i, k in enumerate(langs)]


def test_subwords_by_hand(monkeypatch):
    def brute(t):
        text = b" " + t.translate(x._FOLD) + b" "
        out = []
        for n in x.LENGTHS:
            for i in range(len(text) - n + 1):
                g = text[i : i + n]
                if b" " not in g[1:-1] and g != b"  ":
                    out.append((int.from_bytes(g, "little") + n * 0x51ED27) % 2**32 * 0x9E3779B1 % 2**32 >> 18)
        return sorted(out)

    for t in ("", "a", "ab cd", "it's 12 o'clock", "één, twee -- drie\n", "  x  "):
        whole = sorted(np.concatenate(list(x.subwords(t.encode()))).tolist())
        assert whole == brute(t.encode())
        monkeypatch.setattr(x, "PIECE", 5)  # pieces lose and repeat nothing
        assert sorted(np.concatenate(list(x.subwords(t.encode()))).tolist()) == whole
        monkeypatch.undo()


def test_held_out_accuracy_and_predictions_of_one_process(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA)
    apart = x.held_out(F.col("doc_id"))
    model = x.train(d.filter(~apart))
    got = x.predict(d, model).select("doc_id", "lang", "lang_pred", "score", "rejected", apart.alias("held_out")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        k, p = model.predict(rows[r.doc_id][1].lower().encode())
        assert (model.languages[k], round(p, 9)) == (r.lang_pred, round(r.score, 9)) and 0 <= r.score <= 1 and r.rejected == (p < model.cut)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.95


def test_only_what_may_teach_does(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, SCHEMA)
    a = x.train(d.filter(~x.held_out(F.col("doc_id"))))
    extra = spark.createDataFrame([(None, "grikt", "zz", "s", 0), (5000, "lamo", None, "s", 0), (5001, "123", "zz", "s", 0), (5002, None, "zz", "s", 0)], SCHEMA)
    b = x.train(d.filter(~x.held_out(F.col("doc_id"))).repartition(7).unionByName(extra).withColumn("source", F.lit("other")))
    assert a.languages == b.languages and (a.table == b.table).all() and (a.temperature, a.cut) == (b.temperature, b.cut)


def test_odd_rows_and_columns(spark):
    model = x.train(spark.createDataFrame(corpus(), SCHEMA))
    odd = [(None, "lamo siru", None, None, None), (1, None, "aa", "s", 0), (2, "", "aa", "s", 0), (3, "12 - !", "aa", "s", 0), (4, "krumpf " * 300_000, None, None, 0), (5, "漢字", None, None, 0), (4, "krumpf", None, None, 0), (4, "krumpf", None, None, 0)]
    d = spark.createDataFrame(odd, SCHEMA)
    d = d.withColumn("Score", F.lit("x")).withColumn("box__", F.lit("x")).select("*", F.lit(1).alias("meta.url"), F.lit(1).alias("a`b"))
    out = x.predict(d, model)
    assert out.columns == [c for c in d.columns if c != "Score"] + ["lang_pred", "score", "rejected"]
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(None, "aa"), (1, "und"), (2, "und"), (3, "und"), (4, "bb"), (5, got[5][1]), (4, "bb"), (4, "bb")], key=repr) and got[5][1] in model.languages
    assert {(r["score"], r["rejected"]) for r in out.filter("lang_pred = 'und'").collect()} == {(0.0, True)}
    empty = spark.createDataFrame([], SCHEMA)
    assert x.predict(empty, model).count() == 0 and x.train(empty) is None
    assert {(r.lang_pred, r.score) for r in x.predict(d, None).collect()} == {("und", 0.0)}
    one = x.train(spark.createDataFrame([(1, "lamo", "aa", "s", 0)], SCHEMA))
    assert [r.lang_pred for r in x.predict(d.filter("doc_id = 5"), one).collect()] == ["aa"]


def test_calibration():
    """Probabilities that are too sure are softened; the cut leaves few wrong ones among the accepted."""
    rng = np.random.default_rng(0)
    true = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-true))).astype(int)
    z = np.column_stack([np.zeros(4000), true]) * 3
    t, cut = x.calibrate(z, y, np.ones(4000))
    assert 2.4 < t < 3.6
    p = x._softmax(z / t)
    fine = p.max(axis=1) >= cut
    assert 0 < fine.mean() < 1 and (p.argmax(axis=1) != y)[fine].mean() <= x.WRONG
