"""Quality classifier by co-training two views of a document.

The text view sees the words (hashed) and the shape of the text; the metadata view sees source, language and recorded
length. Each view has a logistic model. In each round both views rank all unlabelled documents by their calibrated
scores, and each gives its most confident good and bad ones, a growing share, to the other one to learn from, with the
weight that its ranking has earned on labelled documents that neither has learnt from. Then both are calibrated on further
labelled documents, a logistic combination of the calibrated views scores every document, and documents under a cut,
which is chosen on labelled documents of its own, are rejected. With calibration and cut as found, the models that score
have learnt from all labelled documents of the sample.

The first models are fitted on the driver, on a bounded sample of labelled documents (LABELLED below: of each class the
documents whose hashed ids are the smallest). Pseudo-labels come from all unlabelled documents: their features are
written once, ranks are histograms and gradients sums that are made where the features are, and only these sums reach
the driver. Scoring is one pass over all documents and whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, free_name, settle, small, tidy

#: Labelled documents that models are fitted on at most, and the shares of them that judge pseudo-labels, calibrate, and
#: set the cut; the rest is to learn from.
LABELLED, FOLDS = 6000, (0.15, 0.15, 0.15)
#: Labelled documents of each class that every fold must have.
LEAST = 2
#: What each view gives in each round: this share of the good (and of the bad) documents that there should be.
SHARES = (0.3, 0.5, 0.7)
#: The least weight of a view's pseudo-labels against given labels.
TRUST = 0.02
#: Steps over the unlabelled documents in each round and their size, and parts that sums are brought to before the driver adds them,
#: where there are more tasks than that.
STEPS, RATE, PARTS = 3, 0.12, 64
#: Documents of a packed row of features.
CHUNK = 128
#: Calibrated logits are ranked in bins of 1 / BINS up to EDGE on either side.
BINS, EDGE = 100, 12
#: A document is rejected below this score, or a lower one, not below LOWEST, if that costs less. A good document that is rejected costs
#: as much as so many bad ones that are kept, by shares of their classes.
CUT, LOWEST, COST = 0.5, 0.05, 20
WORD_BITS, META_BITS, DENSE = 13, 9, 14
_UPPER, _DIGITS, _SIGNS, _HIGH = bytes(range(65, 91)), bytes(range(48, 58)), b"!|#*<>{}[]=_~^\\/@$%&+", bytes(range(128, 256))


def text_features(t: bytes) -> tuple[list[float], np.ndarray]:
    """Shape of a UTF-8 text, and hashed words."""
    words, n = t.split(), max(len(t), 1)
    own, w = set(words), max(len(words), 1)
    without = lambda chars: (len(t) - len(t.translate(None, chars))) / n
    lines = t.split(b"\n")
    dense = [
        np.log1p(len(words)), len(t) / w, without(_UPPER), without(_DIGITS), without(_SIGNS), without(_HIGH), without(b".,;:?"),
        len(own) / w, np.log(max(len(own), 1)) / np.log(w + 1), sum(map(eq, words, words[1:])) / w, t.count(b"!") / w, t.count(b"|") / w,
        len(lines) / w, len(set(lines)) / len(lines),
    ]
    return dense, np.fromiter(map(crc32, own), np.uint32, len(own)) & ((1 << WORD_BITS) - 1)


def meta_features(source, lang, n_chars) -> list[int]:
    size = -1 if n_chars is None else int(max(n_chars, 0)).bit_length()
    return [crc32(f"{k}={v}".encode()) & ((1 << META_BITS) - 1) for k, v in (("source", source), ("lang", lang), ("size", size))]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class View:
    """Rows of a view: dense columns, and sparse ones in one flat array."""

    dense: np.ndarray
    flat: np.ndarray
    row: np.ndarray
    weight: np.ndarray

    @classmethod
    def packed(cls, dense, lens, flat):
        row = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        return cls(np.asarray(dense, float).reshape(len(lens), -1), np.asarray(flat, np.int32), row, (1 / np.sqrt(np.maximum(lens, 1))).astype(np.float32)[row])

    @classmethod
    def of(cls, dense, sparse):
        return cls.packed(dense, np.array([len(s) for s in sparse], np.int64), np.concatenate([np.zeros(0, np.int32), *(np.asarray(s, np.int32) for s in sparse)]))

    def take(self, rows: np.ndarray) -> View:
        place = np.full(len(self.dense), -1, np.int32)
        place[rows] = np.arange(len(rows), dtype=np.int32)
        on = place[self.row] >= 0
        return View(self.dense[rows], self.flat[on], place[self.row[on]], self.weight[on])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    sparse: np.ndarray
    bias: float

    def _shape(self, v: View) -> np.ndarray:
        return np.clip((v.dense - self.mean) / self.scale, -8, 8)

    def margin(self, v: View) -> np.ndarray:
        return self._shape(v) @ self.dense + self.bias + np.bincount(v.row, self.sparse[v.flat] * v.weight, minlength=len(v.dense))

    def gradient(self, v: View, y: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
        """Of the summed loss: by sparse and dense weights, and the bias."""
        g = weight * (_sigmoid(self.margin(v)) - y)
        return np.concatenate([np.bincount(v.flat, g[v.row] * v.weight, minlength=len(self.sparse)), self._shape(v).T @ g, [g.sum()]])

    def moved(self, w: np.ndarray) -> Model:
        return Model(self.mean, self.scale, w[len(self.sparse) : -1].copy(), w[: len(self.sparse)].copy(), float(w[-1]))

    def weights(self) -> np.ndarray:
        return np.concatenate([self.sparse, self.dense, [self.bias]])

    @classmethod
    def fit(cls, v: View, y: np.ndarray, size: int, l2: float = 1e-3, steps: int = 120) -> Model:
        """Logistic regression by Adam over all rows at once; deterministic."""
        n, d = v.dense.shape
        mean, scale = (v.dense.mean(axis=0), v.dense.std(axis=0) + 1e-9) if d else (np.zeros(0), np.ones(0))
        x = np.clip((v.dense - mean) / scale, -8, 8)
        w, m, s = np.zeros(size + d + 1), np.zeros(size + d + 1), np.zeros(size + d + 1)
        w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        for t in range(1, steps + 1):
            z = x @ w[size:-1] + w[-1] + np.bincount(v.row, w[v.flat] * v.weight, minlength=n)
            g = (_sigmoid(z) - y) / n
            grad = np.concatenate([np.bincount(v.flat, g[v.row] * v.weight, minlength=size), x.T @ g, [g.sum()]])
            grad[:-1] += l2 * w[:-1] / 10
            m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        return cls(mean, scale, w[size:-1].copy(), w[:size].copy(), float(w[-1]))


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0, toward=None, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for y ~ sigmoid(z @ a + b), a little drawn toward given values (or 0); z: one column a view."""
    x = np.column_stack([z, np.ones(len(y))])
    aim = np.zeros(x.shape[1]) if toward is None else np.asarray(toward, float)
    w = aim.copy()
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * (w - aim))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    text: Model
    meta: Model
    platt: tuple[np.ndarray, np.ndarray]
    both: np.ndarray
    cut: float
    exchanged: tuple[int, int] = (0, 0)

    def score(self, text: View, meta: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The calibrated score of each view, and of both."""
        z = [np.column_stack([m.margin(v), np.ones(len(v.dense))]) @ p for m, v, p in zip((self.text, self.meta), (text, meta), self.platt, strict=True)]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(np.column_stack([*z, np.ones(len(z[0]))]) @ self.both)


def folds(y: np.ndarray, rnd: np.ndarray) -> np.ndarray:
    """0 to learn from, 1 to judge pseudo-labels, 2 to calibrate, 3 for the cut: by class, those with the smallest rnd for the cut.

    Each of the last three has its share, and LEAST different ones at least. Equal rnd go together.
    """
    out = np.zeros(len(y), np.int64)
    for k in (0, 1):
        order = np.unique(rnd[y == k])
        place = np.searchsorted(order, rnd)
        begin = 0
        for fold in (3, 2, 1):
            end = begin + max(LEAST, round(FOLDS[fold - 1] * len(order)))
            out[(y == k) & (place >= begin) & (place < end)] = fold
            begin = end
    return out


@dataclass
class Teacher:
    """A view's model with its calibration: documents in bins up to low are bad, from high on good, with these weights."""

    model: Model
    platt: np.ndarray
    low: int = -1
    high: int = 2 * BINS * EDGE
    weight: tuple[float, float] = (0.0, 0.0)
    given: int = 0
    mass: float = 0.0

    def bins(self, v: View) -> np.ndarray:
        z = self.model.margin(v) * self.platt[0] + self.platt[1]
        return np.clip(np.floor((z + EDGE) * BINS), 0, 2 * BINS * EDGE - 1).astype(np.int64)


def histograms(views: tuple[View, View], teachers: list[Teacher]) -> np.ndarray:
    return np.concatenate([np.bincount(t.bins(v), minlength=2 * BINS * EDGE) for t, v in zip(teachers, views, strict=True)]).astype(float)


def gradients(views: tuple[View, View], teachers: list[Teacher], models: list[Model]) -> np.ndarray:
    """The summed gradient of each model by the labels of the other view's teacher, one after the other."""
    out = []
    for i, (v, m) in enumerate(zip(views, models, strict=True)):
        t = teachers[1 - i]
        at = t.bins(views[1 - i]) if t.given else None
        rows = np.flatnonzero((at <= t.low) | (at >= t.high)) if t.given else []
        y = (at[rows] >= t.high).astype(float) if len(rows) else np.zeros(0)
        out.append(m.gradient(v.take(rows), y, np.asarray(t.weight)[y.astype(int)]) if len(rows) else np.zeros(len(m.weights())))
    return np.concatenate(out)


def _confident(counts: np.ndarray, bad: float, good: float) -> tuple[int, int]:
    """(low, high): the fewest bins from either end that hold bad and good documents or more; apart, or none at all."""
    low = int(np.searchsorted(np.cumsum(counts), bad))
    high = len(counts) - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), good))
    return (low, high) if low < high else (-1, len(counts))


def _auc(score: np.ndarray, y: np.ndarray) -> float:
    """The share of (good, bad) pairs in which the good one scores higher; ties are a half."""
    bad = np.sort(score[y == 0])
    over = np.searchsorted(bad, score[y == 1], "left") + np.searchsorted(bad, score[y == 1], "right")
    return float(over.mean() / 2 / len(bad))


def _teachers(models: list[Model], views: list[View], y: np.ndarray, stands: np.ndarray, n: tuple[int, int], share: float, pool) -> list[Teacher]:
    """views, y, stands: of the labelled documents that judge. n: bad and good documents to learn from.

    A view's weight is the square of 2 * AUC - 1 of its ranking of these, TRUST at least; its pseudo-labels of a class
    weigh no more in sum than the labels of that class.
    """
    teachers = [Teacher(m, _platt(m.margin(v)[:, None], y, stands / stands.mean())) for m, v in zip(models, views, strict=True)]
    counts = pool.histograms(teachers).reshape(2, -1)
    good = stands[y == 1].sum() / stands.sum()
    for t, v, c in zip(teachers, views, counts, strict=True):
        t.low, t.high = _confident(c, share * (1 - good) * c.sum(), share * good * c.sum())
        met = (c[: t.low + 1].sum(), c[t.high :].sum())
        if not min(met):  # all of them rank alike
            continue
        trust = max(TRUST, max(0.0, 2 * _auc(t.bins(v), y) - 1) ** 2)
        t.weight = tuple(trust * min(1.0, k / m) for k, m in zip(n, met, strict=True))
        t.given = int(sum(met))
        t.mass = sum(w * m for w, m in zip(t.weight, met, strict=True))
    return teachers


def _taught(models: list[Model], teachers: list[Teacher], views: list[View], y: np.ndarray, pool) -> list[Model]:
    """The models after a round: Adam from the last ones on, on labelled documents and all pseudo-labels of the other view."""
    models = list(models)
    w = [m.weights() for m in models]
    m1, m2, l2 = [0 * x for x in w], [0 * x for x in w], 1e-3
    total = [len(y) + teachers[1 - i].mass for i in (0, 1)]
    for step in range(1, STEPS + 1):
        flat = pool.gradients(teachers, models)
        grads = [flat[: len(w[0])], flat[len(w[0]) :]]
        for i in (0, 1):
            if not teachers[1 - i].given:
                continue
            g = (models[i].gradient(views[i], y) + grads[i]) / total[i]
            g[:-1] += l2 * w[i][:-1] / 10
            m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.99 * m2[i] + 0.01 * g**2
            w[i] = w[i] - RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-6)
            models[i] = models[i].moved(w[i])
    return models


def _cut(score: np.ndarray, y: np.ndarray) -> float:
    """The score from LOWEST to CUT below which rejecting costs least; of equal costs the highest, halfway down to the next document."""
    known = np.sort(score)
    below = lambda s: (s + (known[known < s].max() if (known < s).any() else 0.0)) / 2
    options = [CUT, *(max(LOWEST, below(s)) for s in np.unique(score[(y == 1) & (score < CUT)]))]
    cost = lambda c: COST * np.mean(score[y == 1] < c) + np.mean(score[y == 0] >= c)
    return float(min(options, key=lambda c: (cost(c), -c)))


def cotrain(views: tuple[View, View], y: np.ndarray, fold: np.ndarray, weight: tuple[float, float] = (1.0, 1.0), pool=None) -> Classifier | None:
    """views and y (1 good, 0 bad) of labelled documents, fold as of folds(); None if a fold has under LEAST of a class.

    weight: how many documents a bad and a good label stand for, by which calibration is corrected. pool: the unlabelled
    documents, with histograms(teachers) and gradients(teachers, models) summed over all of them.
    """
    learn, judge, last, cut = (np.flatnonzero(fold == k) for k in range(4))
    if min(np.bincount(y[r], minlength=2).min() for r in (learn, judge, last, cut)) < LEAST:
        return None
    stands = np.asarray(weight, float)[y]
    sizes = (1 << WORD_BITS, 1 << META_BITS)
    own = [v.take(learn) for v in views]
    models = [Model.fit(v, y[learn].astype(float), k) for v, k in zip(own, sizes, strict=True)]
    exchanged, teachers = (0, 0), []
    for share in SHARES if pool is not None else ():
        teachers = _teachers(models, [v.take(judge) for v in views], y[judge], stands[judge], np.bincount(y[learn], minlength=2), share, pool)
        exchanged = tuple(t.given for t in teachers)
        if not any(exchanged):
            break
        models = _taught(models, teachers, own, y[learn], pool)
    z = [m.margin(v.take(last)) for m, v in zip(models, views, strict=True)]
    even = stands[last] / stands[last].mean()
    platt = tuple(_platt(a[:, None], y[last], even) for a in z)
    logits = np.column_stack([a * p[0] + p[1] for a, p in zip(z, platt, strict=True)])
    # Of views that know nothing of each other, calibrated logits add up, less what both have from the share of good ones.
    base = np.log((even * y[last]).sum() / (even * (1 - y[last])).sum())
    out = Classifier(models[0], models[1], platt, _platt(logits, y[last], even, (1, 1, -base), 1.0), CUT, exchanged)
    out.cut = _cut(out.score(*(v.take(cut) for v in views))[2], y[cut])
    # What was held out has judged, calibrated and set the cut; now the models learn from it, too, beside the last round's pseudo-labels.
    models = [Model.fit(v, y.astype(float), k) for v, k in zip(views, sizes, strict=True)]
    out.text, out.meta = _taught(models, teachers, list(views), y, pool) if any(exchanged) else models
    return out


class Pool:
    """Every row of docs whose doc_id isn't in known, as packed features in the shared folder."""

    def __init__(self, docs: DataFrame, known: DataFrame):
        @tidy
        def features(batches):
            for b in small(batches):
                dense, words, meta = _rows(b)
                made = [pa.array([np.asarray(r, k).tobytes() for r in c], pa.binary()) for c, k in zip((dense, words, meta), (np.float32, np.uint16, np.uint16), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=["doc_id", "dense", "words", "meta"])

        @tidy
        def pack(batches):
            for b in small(batches, CHUNK):
                cells = [b.column(c).to_pylist() for c in ("dense", "words", "meta")]
                lens = [np.array([len(v) // 2 for v in cells[i]], np.int32).tobytes() for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (*map(b"".join, cells), *lens)], names=PACKED)

        # Features go through the join, which are a fraction of the texts; by a shuffle at every size.
        rows = docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(features, "doc_id long, dense binary, words binary, meta binary")
        rows = rows.join(known.select("doc_id").hint("merge"), "doc_id", "left_anti").select("dense", "words", "meta")
        self.rows = settle(rows.mapInArrow(pack, ", ".join(f"{c} binary" for c in PACKED)))
        self.tasks = self.rows.rdd.getNumPartitions()

    def _sum(self, of, size: int) -> np.ndarray:
        """The sum of of(views), an array of size, over all packed rows: in each task, of many tasks in PARTS or more, then here."""

        @tidy
        def each(batches):
            total = np.zeros(size)
            for b in batches:
                for i in range(b.num_rows):
                    dense, words, meta, n_words, n_meta = (b.column(c)[i].as_buffer() for c in range(5))
                    ints = lambda x, k: np.frombuffer(x, k)
                    lens = ints(n_words, np.int32)
                    views = View.packed(ints(dense, np.float32).reshape(len(lens), DENSE), lens, ints(words, np.uint16)), View.packed(np.zeros((len(lens), 0)), ints(n_meta, np.int32), ints(meta, np.uint16))
                    total += of(views)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        def add(batches):
            total = np.zeros(size)
            for b in batches:
                for v in b.column(0).to_pylist():
                    total += np.frombuffer(v)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        sums = self.rows.mapInArrow(each, "s binary")
        if self.tasks > PARTS:
            sums = sums.repartition(max(PARTS, math.isqrt(self.tasks))).mapInArrow(add, "s binary")
        got = sums.collect()
        return sum((np.frombuffer(r["s"]) for r in got), np.zeros(size))

    def histograms(self, teachers: list[Teacher]) -> np.ndarray:
        return self._sum(lambda views: histograms(views, teachers), 4 * BINS * EDGE)

    def gradients(self, teachers: list[Teacher], models: list[Model]) -> np.ndarray:
        return self._sum(lambda views: gradients(views, teachers, models), sum(len(m.weights()) for m in models))


PACKED = ["dense", "words", "meta", "n_words", "n_meta"]


def _rows(b: pa.RecordBatch):
    texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
    dense, words = zip(*map(text_features, texts), strict=True) if texts else ((), ())
    meta = list(map(meta_features, b.column("source").to_pylist(), b.column("lang").to_pylist(), b.column("n_chars").to_pylist()))
    return dense, words, meta


def train(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """docs(doc_id, text, lang, source, n_chars), labels(doc_id, quality 0/1).

    Labels with other or null qualities, or a null doc_id, are ignored; of several for a doc_id the least counts. Of rows
    of docs that repeat a labelled doc_id, the one whose text has the least XXH64 is learnt from. Null texts, sources, languages and lengths are values like
    others; unlabelled rows may have a null doc_id. None if docs is empty or has under 4 * LEAST labelled doc_ids of a
    class; without unlabelled rows nothing is exchanged.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    h = F.xxhash64(F.lit("sample"), "doc_id")
    there = settle(known.join(docs.select("doc_id"), "doc_id", "left_semi"))
    n = {0: 0, 1: 0} | {r["y"]: r["n"] for r in there.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(n.values()) < 4 * LEAST:
        return None
    take = {k: min(n[k], max(LABELLED // 2, LABELLED - n[1 - k])) for k in n}  # what one class leaves is the other's
    ids, other = (there.filter(F.col("y") == k).withColumn("h", h).orderBy("h", "doc_id").limit(take[k]) for k in (0, 1))
    ids = ids.unionByName(other).select("doc_id", "y")  # LABELLED rows at most

    @tidy
    def run(batches):
        for b in small(batches):
            dense, words, meta = _rows(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(map(list, dense), pa.list_(pa.float64())), pa.array(words, pa.list_(pa.uint32())).cast(pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.int32()))], names=["doc_id", "y", "dense", "words", "meta"])

    cells = ("text", "lang", "source", "n_chars")
    met = docs.select("doc_id", *cells).join(F.broadcast(ids), "doc_id")
    one = met.groupBy("doc_id", "y").agg(F.min_by(F.struct(*cells), F.struct(F.xxhash64("text"), *cells[1:])).alias("r"))
    rows = one.select("doc_id", "y", *[F.col(f"r.{c}") for c in cells])
    got = rows.mapInArrow(run, "doc_id long, y int, dense array<double>, words array<int>, meta array<int>").toPandas().sort_values("doc_id", ignore_index=True)
    rnd = (got.doc_id.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(float) / (1 << 24)
    views, y = (View.of(got.dense.tolist(), got.words.tolist()), View.of(np.zeros((len(got), 0)), got.meta.tolist())), got.y.to_numpy()
    del got
    return cotrain(views, y, folds(y, rnd), (n[0] / take[0], n[1] / take[1]), Pool(docs, known))


def scores(docs: DataFrame, model: Classifier | None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (doc_id) with text_score, meta_score, score (of being good) and kept, for every row.

    A null or empty text is scored by its shape, like any other; a null source, language or length is a value of its
    own; repeated rows are scored alike. Without a model scores are null and every row is kept. Columns of docs that have
    one of these names, whatever the case, give way. An empty table gives no rows.
    """
    names = ["text_score", "meta_score", "score", "kept"]
    keep = [c for c in (keep or ["doc_id"]) if c.lower() not in names]
    if model is None:
        return docs.select(*columns(docs, keep), *[F.lit(None).cast("double").alias(c) for c in names[:3]], F.lit(True).alias("kept"))
    box, *own = free_name(docs, "box__", "f_text", "f_lang", "f_source", "f_chars")
    # Columns to keep travel in one struct, so that their names may be any.
    given = docs.select(F.struct(*columns(docs, keep)).alias(box), *[F.col(c).alias(a) for c, a in zip(("text", "lang", "source", "n_chars"), own, strict=True)])

    @tidy
    def run(batches):
        for b in small(batches):
            seen = pa.RecordBatch.from_arrays(b.columns[1:], names=["text", "lang", "source", "n_chars"])
            dense, words, meta = _rows(seen)
            t, m, s = model.score(View.of(np.asarray(dense, float).reshape(-1, DENSE), words), View.of(np.zeros((len(meta), 0)), meta))
            # Six digits, so that sums in another order decide alike.
            out = [b.column(0), *(pa.array(a) for a in (t, m, s)), pa.array(np.round(s, 6) >= round(model.cut, 6))]
            yield pa.RecordBatch.from_arrays(out, names=[box, *names])

    schema = T.StructType([given.schema.fields[0], *(T.StructField(c, T.DoubleType()) for c in names[:3]), T.StructField("kept", T.BooleanType())])
    return given.mapInArrow(run, schema).select(f"{box}.*", *names)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns, whatever their names.

    Every repeated row stays or goes with the others. With too few labels (see train) every row stays, and an empty table stays empty.
    """
    box, = free_name(docs, "all__")
    boxed = docs.select("*", F.struct(*columns(docs)).alias(box))
    return scores(boxed, train(docs, labels), [box]).filter("kept").select(f"{box}.*")
