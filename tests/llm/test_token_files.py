import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, docs
from millrace.llm import token_files as x
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EOD = 50256


def brute(a, eod):
    out, start = [], 0
    for i, v in enumerate(a):
        if v == eod:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(a) - start, False)] if start < len(a) else [])


@pytest.mark.parametrize("block", [4, 10, 64, 1 << 20])
def test_scan_equals_brute_force(spark, tmp_path, block):
    rnd = np.random.default_rng(1)
    arrays = {
        "a.bin": rnd.integers(0, 4, 500), "b.bin": np.full(40, 3), "c.bin": np.zeros(33), "d.bin": np.array([], int), "e.bin": np.array([0, 3]),
        "f.bin": np.concatenate([np.zeros(300), [3, 3], np.ones(70), [3]]),
    }
    for n, a in arrays.items():
        a.astype("uint16").tofile(tmp_path / n)
    (tmp_path / "other.txt").write_text("x")
    got = x.count_tokens(spark, str(tmp_path), 3, "uint16", block).collect()
    for n, a in arrays.items():
        own = sorted((r.ord, r.start, r.n_tokens, r.ended) for r in got if r.file == n)
        assert own == [(i, *w) for i, w in enumerate(brute(a.tolist(), 3))]


def test_partial_token_is_an_error(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole tokens"):
        x.count_tokens(spark, str(tmp_path), 3).collect()


def test_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(docs(spark, [(-1, None), (-2, ""), (-2, ""), (None, "no id <|endoftext|>"), (-3, "w" * 300_000)]))
    for c in ("file", "ORD", "start"):
        d = d.withColumn(c, F.lit(1))
    code = x._tiktoken(RANKS)
    want = sorted(((r.doc_id, len(code.encode_ordinary(r.text or ""))) for r in d.collect()), key=repr)
    got = x.token_counts(d, RANKS, EOD).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == want
    assert x.token_counts(spark.createDataFrame([], SCHEMA), RANKS, EOD).count() == 0


def test_ids_that_the_type_cannot_hold_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)out of bounds"):
        x.write_token_files(docs(spark, [(1, "some text of words")]), str(tmp_path / "t"), RANKS, EOD, "uint8")
