import numpy as np
import pyarrow.parquet as pq
from helpers import SCHEMA, docs
from millrace.llm import quality as x
from pyspark.sql import functions as F


def tables(spark, sf="sf0.01"):
    return [spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark):
    d, labels = tables(spark)
    seen = labels.filter("doc_id % 2 = 0")
    got = {r.doc_id: r for r in x.scores(d, x.train(d, seen)).collect()}
    rest = [r for r in labels.filter("doc_id % 2 = 1").collect()]
    good = [got[r.doc_id].kept for r in rest if r.quality == 1]
    bad = [got[r.doc_id].kept for r in rest if r.quality == 0]
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15


class Dense:
    """The unlabelled documents as dense matrices; what a pool gives, by its definition."""

    def __init__(self, views, sizes):
        self.x = [matrix(v, k) for v, k in zip(views, sizes, strict=True)]
        self.views = views

    def _bins(self, t, i):
        z = np.array([margin(t.model, v, row) * t.platt[0] + t.platt[1] for v, row in ((self.views[i].dense[r], self.x[i][r]) for r in range(len(self.x[i])))])
        return [min(max(int(np.floor((v + x.EDGE) * x.BINS)), 0), 2 * x.EDGE * x.BINS - 1) for v in z]

    def histograms(self, teachers):
        out = np.zeros(4 * x.BINS * x.EDGE)
        for i, t in enumerate(teachers):
            for b in self._bins(t, i):
                out[2 * x.BINS * x.EDGE * i + b] += 1
        return out

    def gradients(self, teachers, models):
        out = []
        for i, m in enumerate(models):
            g, t = np.zeros(len(m.weights())), teachers[1 - i]
            for r, b in enumerate(self._bins(t, 1 - i)) if t.given else ():
                if t.low < b < t.high:
                    continue
                y = float(b >= t.high)
                shape = np.clip((self.views[i].dense[r] - m.mean) / m.scale, -8, 8)
                e = t.weight[int(y)] * (1 / (1 + np.exp(-margin(m, self.views[i].dense[r], self.x[i][r]))) - y)
                g += e * np.concatenate([self.x[i][r], shape, [1.0]])
            out.append(g)
        return np.concatenate(out)


def matrix(v, size):
    out = np.zeros((len(v.dense), size))
    lens = np.bincount(v.row, minlength=len(out))
    for r, f in zip(v.row, v.flat, strict=True):
        out[r, f] += 1 / np.sqrt(lens[r])
    return out


def margin(m, dense, sparse):
    return np.clip((dense - m.mean) / m.scale, -8, 8) @ m.dense + sparse @ m.sparse + m.bias


def test_views_teach_each_other():
    """Two views that each hold half of the signal: metadata's confident labels are taken up by the text view, and back."""
    rnd = np.random.default_rng(0)
    n = 900
    y = rnd.integers(0, 2, n)
    text = x.View.of(rnd.normal(size=(n, 3)) + 2 * y[:, None], [np.zeros(0, np.int64)] * n)
    meta = x.View.of(np.zeros((n, 0)), [[int(v) if rnd.random() > 0.005 else int(1 - v)] for v in y])
    seen, pool = np.arange(150), np.arange(150, n)
    parts = [tuple(v.take(r) for v in (text, meta)) for r in (seen, pool)]
    own = Dense(parts[1], (1 << x.WORD_BITS, 1 << x.META_BITS))
    m = x.cotrain(parts[0], y[seen], x.folds(y[seen], rnd.random(150)), pool=own)
    alone = x.cotrain(parts[0], y[seen], x.folds(y[seen], rnd.random(150)))
    assert min(m.exchanged) > 200 and alone.exchanged == (0, 0)
    assert np.mean((m.score(text, meta)[2] > 0.5) == y) > 0.98
    assert np.mean((m.score(text, meta)[0] > 0.5) == y) >= np.mean((alone.score(text, meta)[0] > 0.5) == y)


def test_brute_force(spark):
    """The distributed classifier against one in a single process, with dense matrices and sums by their definition."""
    d, labels = tables(spark, "sf0.001")
    m = x.train(d, labels)
    assert min(m.exchanged) > 0  # both views teach
    every = d.orderBy("doc_id").toArrow().to_batches()
    dense, words, meta = (sum(c, ()) if i < 2 else sum(c, []) for i, c in enumerate(zip(*map(x._rows, every), strict=True)))
    text, rest = x.View.of(np.asarray(dense, float), words), x.View.of(np.zeros((len(meta), 0)), meta)
    ids = [r.doc_id for r in d.select("doc_id").orderBy("doc_id").collect()]
    quality = {r.doc_id: r.quality for r in labels.collect()}
    seen = np.array([r for r, i in enumerate(ids) if i in quality])
    pool = np.array([r for r, i in enumerate(ids) if i not in quality])
    y = np.array([quality[ids[r]] for r in seen])
    rnd = [(ids[r] * 0x9E3779B97F4A7C15 % 2**64 >> 40) / 2**24 for r in seen]
    own = Dense([v.take(pool) for v in (text, rest)], (1 << x.WORD_BITS, 1 << x.META_BITS))
    brute = x.cotrain((text.take(seen), rest.take(seen)), y, x.folds(y, np.array(rnd)), (1.0, 1.0), own)
    assert brute.exchanged == m.exchanged and np.isclose(brute.cut, m.cut, rtol=1e-6)
    got = {r.doc_id: r for r in x.scores(d, m).collect()}
    for r, want in enumerate(zip(*brute.score(text, rest), strict=True)):
        g = got[ids[r]]
        assert np.allclose((g.text_score, g.meta_score, g.score), want, rtol=1e-4, atol=1e-6) and g.kept == (g.score >= m.cut)


def test_cut():
    y = np.array([0] * 50 + [1] * 100)
    apart = np.concatenate([np.full(50, 0.02), np.full(100, 0.9)])
    assert x._cut(apart, y) == 0.5
    low = apart.copy()
    low[50:60] = 0.3  # good ones between
    assert 0.02 < x._cut(low, y) < 0.3
    wrong = apart.copy()
    wrong[50] = 0.001  # a wrong label doesn't let the bad ones through
    assert x._cut(wrong, y) > 0.02


def test_repeatable(spark):
    d, labels = tables(spark, "sf0.001")
    a, b = (sorted(map(tuple, x.scores(t, x.train(t, labels)).collect())) for t in (d, d.repartition(5)))
    assert [r[:1] + r[4:] for r in a] == [r[:1] + r[4:] for r in b]
    assert np.allclose([r[1:4] for r in a], [r[1:4] for r in b])


def test_edges(spark):
    d, labels = tables(spark, "sf0.001")
    odd = docs(spark, [(None, None), (-1, ""), (-2, "w " * 100_000), (-2, "w " * 100_000)]).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    every = d.unionByName(odd)
    for c in ("SCORE", "kept", "box__", "words"):
        every = every.withColumn(c, F.lit(3))
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None), (6, 7, 0)], labels.schema))
    out = x.scores(every, x.train(every, noisy))
    assert out.count() == every.count() and out.columns == ["doc_id", "text_score", "meta_score", "score", "kept"]
    kept = x.keep_good(every, noisy)
    assert kept.columns == every.columns
    every = every.withColumn("a.dot", F.lit("x"))
    assert x.keep_good(every, noisy).columns == every.columns
    none = labels.limit(0)
    assert x.train(every, none) is None and x.keep_good(every, none).count() == every.count()
    assert x.train(spark.createDataFrame([], SCHEMA), labels) is None


def test_few_bad_labels_are_used(spark, monkeypatch):
    """Rare bad labels, and labels of documents that aren't there: the sample is by class, and of documents there are."""
    monkeypatch.setattr(x, "LABELLED", 60)
    bad = "!!! $$$ ||| " * 30
    d = docs(spark, [(i, bad if i % 100 == 0 else f"a plain text of some words about {i} things") for i in range(1200)])
    labels = spark.range(-50_000, 1000).selectExpr("id as doc_id", "cast(id % 100 <> 0 as int) as quality", "0 as toxic")
    m = x.train(d, labels)
    got = {r.doc_id: r.kept for r in x.scores(d, m).collect()}
    assert m is not None and not got[1000] and not got[1100] and all(got[i] for i in range(1001, 1100))


def test_folds_have_both_classes():
    y, rnd = np.array([0] * 9 + [1] * 100), np.linspace(1, 0, 109)
    fold = x.folds(y, rnd)
    assert [(fold[y == 0] == k).sum() for k in range(4)] == [3, 2, 2, 2]
    assert [(fold[y == 1] == k).sum() for k in range(4)] == [55, 15, 15, 15]


def test_every_unlabelled_document_counts(spark):
    """The sums of a round are over all unlabelled documents, however many; those of one partition or of several are the same."""
    d = docs(spark, [(i, f"some words about {i} things", f"s{i % 7}") for i in range(9000)])
    sure = lambda size, dense: x.Model(np.zeros(dense), np.ones(dense), np.zeros(dense), np.zeros(size), 9.0)
    models = [sure(1 << x.WORD_BITS, x.DENSE), sure(1 << x.META_BITS, 0)]
    teachers = [x.Teacher(m, np.array([1.0, 0.0]), high=2 * x.BINS * x.EDGE - 301, weight=(0.0, 1.0), given=1) for m in models]
    known = spark.range(9000, 9010).withColumnRenamed("id", "doc_id")
    every = d.unionByName(docs(spark, [(9005, "labelled"), (None, "no id")]))
    got = [x.Pool(t, known) for t in (every, every.repartition(7))]
    assert [p.histograms(teachers).sum() for p in got] == [18002, 18002]
    a, b = (p.gradients(teachers, models) for p in got)
    assert np.allclose(a, b)
    loss = 9001 * (1 / (1 + np.exp(-9.0)) - 1)
    assert np.isclose(a[(1 << x.WORD_BITS) + x.DENSE], loss) and np.isclose(a[-1], loss)
    assert a[(1 << x.WORD_BITS) + x.DENSE + 1 + x.meta_features("s3", "en", 28)[0]] < 0
