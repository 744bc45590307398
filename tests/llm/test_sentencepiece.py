import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from helpers import SCHEMA, docs
from millrace.llm import sentencepiece_bpe as x
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "  ", "a", " a  b ", "\n\n\t", "a\x00b", "▁x▁▁", "<s> </s> <unk> <0x0A>", "日本語 テスト 😀😀", "é" * 50, "x" * 3000, " " * 500, "=" * 300, "ÀÉ́ ﬁ Ⅷ", "�", "a b", "𝔘𝔫𝔦", "'''\"\"\"", "1234567890" * 20]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return x.Codec(x.Vocabulary.load(MODEL))


def test_edges(own, library):
    for t in EDGES:
        assert own.encode(t) == library.encode(t), t
        assert own.decode(own.encode(t)) == library.decode(library.encode(t)), t


def test_random_text(own, library):
    rnd = random.Random(3)
    alphabet = list("aeinrst  the and ▁.,\n1é") + ["ing", "tion", " ", "世", "😀", "er"]
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 60)))
        assert own.encode(t) == library.encode(t), t


def test_long_words(own, library):
    rnd = random.Random(8)
    for alphabet in ("abc", "世界日本語あいう", "the"):
        t = "".join(rnd.choice(alphabet) for _ in range(60_000))
        assert own.encode(t) == library.encode(t)


def plain_bpe(text, score):
    """Best pair of all first, the leftmost of equal ones, all pairs scored anew each time."""
    s = list(text)
    while len(s) > 1:
        best, at = max((score.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(s, s[1:])))
        if best == float("-inf"):
            break
        s[-at : 2 - at] = [s[-at] + s[1 - at]]
    return s


def test_merge_and_few_remembered_pairs(own, library, monkeypatch):
    monkeypatch.setattr(x, "PAIRS", 40)
    few = x.Codec(own.v)
    rnd = random.Random(11)
    alphabet = list("aeinorstl▁") + ["th", "ing", "qu", "é", "世"]
    for _ in range(1500):
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 14)))
        assert few.merge(w) == plain_bpe(w, few.score), w
        assert few.tokens(w) == plain_bpe(w, few.score), w
        assert few.encode(w) == library.encode(w), w
        assert few.pairs == sum(map(len, few.fits.values())) <= 40


def test_documents(own, library):
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        ids = library.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids)


def test_decode_any_ids(own, library):
    rnd = random.Random(5)
    for _ in range(300):
        ids = [264] + [rnd.choice([rnd.randrange(3, 259), rnd.randrange(259, 32000)]) for _ in range(rnd.randrange(12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_queries(spark, library):
    rows = list(enumerate(EDGES)) + [(99, None), (99, None)]
    got = sorted(map(tuple, x.digests(docs(spark, rows), MODEL).collect()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((i, len(e), sha(",".join(map(str, e))), sha(library.decode(e) if e else "")) for i, t in rows for e in [library.encode(t or "")])
    assert got == want
    d = docs(spark, rows).withColumn("IDS", F.lit(1))
    out = x.encode(d, MODEL).collect()
    assert {r.doc_id: r.ids for r in out} == {i: library.encode(t or "") for i, t in rows}
    assert x.digests(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
