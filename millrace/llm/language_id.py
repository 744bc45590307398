"""Language identification by averaged embeddings of hashed subwords under a linear softmax.

A text is the mean of the embeddings of its subwords: all runs of 2 to 4 bytes of its lower-cased words, a word's borders
included, hashed into BUCKETS. A linear layer on the mean gives each language's logit. Both are trained together by
stochastic gradient descent, document by document, on the driver, on a bounded sample (LABELLED below) whose features the
executors make. Part of the sample is held apart: it sets the temperature that turns logits into probabilities, and the
score under which a prediction is rejected, so that of those accepted at most WRONG are wrong.

As the model is linear in the mean, embeddings and layer are multiplied once: a prediction adds up a row of a small table
for each subword of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, free_name, small, tidy

#: Documents of the sample, on average (by hash, of each language alike), and languages that are learned at most, the most frequent first.
LABELLED, LANGUAGES = 3000, 200
#: Hash buckets, dimensions of an embedding, lengths of subwords in bytes, bytes of a text that are hashed at once.
BUCKETS, DIMS, LENGTHS, PIECE = 1 << 14, 16, (2, 3, 4), 1 << 20
#: Passes over the sample, first learning rate (it falls to 0), the share that calibrates, and wrong ones among the accepted.
EPOCHS, RATE, APART, WRONG = 5, 10.0, 0.2, 0.01
UNKNOWN = "und"

_FOLD = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def subwords(raw: bytes):
    """Buckets of all subwords of a lower-cased text in UTF-8, in arrays for pieces of it."""
    b = np.frombuffer(b" " + raw.translate(_FOLD) + b" ", np.uint8)
    for at in range(0, len(b), PIECE):
        piece = b[at : at + PIECE + max(LENGTHS) - 1].astype(np.uint32)
        word = piece != 32
        gram, inside, found = piece, np.ones(len(piece), bool), []
        for n in range(2, max(LENGTHS) + 1):
            gram = gram[:-1] | (piece[n - 1 :] << np.uint32(8 * (n - 1)))
            inside = inside[:-1] & word[1 : len(inside)] if n == 3 else inside[:-1] & word[n - 2 : len(word) - 1] if n > 3 else word[:-1] | word[1:]
            if n in LENGTHS:
                begun = min(len(gram), PIECE)  # those that begin in the next piece are counted there
                found.append(((gram[:begun][inside[:begun]] + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        yield np.concatenate(found)


def counts(raw: bytes) -> np.ndarray:
    return sum((np.bincount(h, minlength=BUCKETS) for h in subwords(raw)), np.zeros(BUCKETS, np.int64))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """languages; table: each bucket's part of the logits; a language and its score are accepted from cut on."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    cut: float = 0.0

    def logits(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in subwords(raw):
            total += self.table.take(h, axis=0).sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, raw: bytes) -> tuple[int, float]:
        p = _softmax(self.logits(raw) / self.temperature)
        return int(p.argmax()), float(p.max())


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) by stochastic gradient descent on rows of (buckets, shares); the embeddings begin as random signs."""
    rng = np.random.default_rng(seed)
    e = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, DIMS))
    w, bias, step, steps = np.zeros((k, DIMS), np.float32), np.zeros(k, np.float32), 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            at, share = rows[i]
            own = e[at]
            h = share @ own
            g = _softmax(w @ h + bias).astype(np.float32)
            g[y[i]] -= 1
            back = g @ w
            w -= rate * np.outer(g, h)
            bias -= np.float32(0.05) * rate * g
            e[at] = own - rate * np.outer(share, back)
    return (e @ w.T).astype(np.float32), bias.astype(float)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(temperature, cut): the temperature of the least log loss; the least score with at most WRONG of those from it on wrong."""
    options = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    loss = [-(weight * np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12)).sum() for t in options]
    t = float(options[int(np.argmin(loss))])
    p = _softmax(z / t)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != y
    order = np.argsort(-score, kind="stable")
    share = np.cumsum((weight * wrong)[order]) / np.cumsum(weight[order])
    # Equal scores are accepted together.
    ends = np.flatnonzero(np.append(score[order][1:] < score[order][:-1], True))
    fine = [e for e in ends if share[e] <= WRONG]
    return t, float(score[order][fine[-1]]) if fine else 1.0


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the languages of docs, which are the rows to learn from.

    Rows with a null id or language, or a text without letters, teach nothing; rows that repeat an id and a text are one.
    None if nothing is left. The sample is by a hash of id and text, so it doesn't depend on how rows are stored.
    """
    d = docs.select(*[c.alias(a) for c, a in zip(columns(docs, [key, text, lang]), ("id", "t", "lang"), strict=True)])
    d = d.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & has_letters(F.col("t")))
    seen = d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not seen:
        return None
    quota = LABELLED / len(seen)
    rates = F.create_map(*[F.lit(x) for r in seen for x in (r["lang"], min(1.0, quota / r["n"]))])
    h = F.xxhash64("id", "t")
    some = d.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < rates[F.col("lang")])
    some = some.groupBy("id", "h").agg(F.min(F.struct("lang", "t")).alias("r")).select("h", "r.lang", _lower(F.col("r.t")).alias("raw"))

    @tidy
    def features(batches):
        for b in small(batches):
            made = [counts(r) for r in b.column(2).to_pylist()]
            cells = [[(at := np.flatnonzero(c)).astype(np.uint16).tobytes(), (c[at] / c.sum()).astype(np.float32).tobytes()] for c in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1))], names=["h", "lang", "at", "share"])

    got = some.mapInArrow(features, "h long, lang string, at binary, share binary").toPandas().sort_values(["h", "lang"], ignore_index=True)
    if got.empty:
        return None
    languages = sorted(set(got["lang"]))
    y = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    rows = [(np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(s, np.float32)) for a, s in zip(got["at"], got["share"], strict=True)]
    apart = ((got["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(40)) % np.uint64(1000)) < np.uint64(1000 * APART)
    learn = np.flatnonzero(~apart) if (~apart).any() else np.arange(len(y))
    table, bias = descend([rows[i] for i in learn], y[learn], len(languages))
    model = Model(languages, table, bias)
    if apart.any():
        stands = {r["lang"]: max(1.0, r["n"] / quota) for r in seen}
        z = np.array([rows[i][1] @ table[rows[i][0]] + bias for i in np.flatnonzero(apart)])
        model.temperature, model.cut = calibrate(z, y[apart], got["lang"].map(stands).to_numpy()[apart])
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """docs and each row's language, its probability and whether it is too uncertain to be accepted, by the whole text.

    A null text and one without letters are "und" with the score 0, and rejected; without a model all are. Repeated rows
    are told alike; an empty table gives no rows. Columns of docs that have one of the new names, whatever the case, give
    way; others stay, whatever their names.
    """
    names = [lang.lower(), score.lower(), rejected.lower()]
    kept = columns(docs, [c for c in docs.columns if c.lower() not in names])
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias(lang), F.lit(0.0).alias(score), F.lit(True).alias(rejected))

    def told(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(r) for r in raw], columns=["k", "p"])

    box, p = free_name(docs, "box__", "p__")
    t = columns(docs, [text])[0]
    d = docs.select(F.struct(*kept).alias(box), has_letters(t).alias("some"), F.pandas_udf(told, "k int, p double")(_lower(t)).alias(p))
    k = F.array(*map(F.lit, model.languages))[F.col(f"{p}.k")]
    sure = F.col(f"{p}.p")
    return d.select(f"{box}.*", F.when(F.col("some"), k).otherwise(UNKNOWN).alias(lang), F.when(F.col("some"), sure).otherwise(0.0).alias(score), (~F.col("some") | (sure < model.cut)).alias(rejected))


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; a null id is neither held out nor learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
