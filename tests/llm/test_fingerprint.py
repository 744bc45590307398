import hashlib
import re
import unicodedata

import pyarrow.parquet as pq
import xxhash
from helpers import SCHEMA, docs
from millrace.llm import fingerprint as x
from pyspark.sql import functions as F

SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def canon(t):
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFD", t or "").casefold())
    return re.sub(SPACES, " ", folded).strip(" ")


def fp(t):
    b = canon(t).encode()
    return f"{xxhash.xxh64_intdigest(b, 42):016x}{xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b'wide', 42)):016x}"


def brute(rows):
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp(t), fp(e), float(canon(t) == canon(e)), float(canon(t) == canon(nxt))))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    assert got(x.fingerprints(docs(spark, rows))) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, "a"), (8, "É b"), (9, "é  B "), (12, "STRASSE straße"), (13, "strasse STRASSE\n"), (20, "x" * 100_001), (21, "😀😀😀"), (21, "😀😀😀"), (-4, "first"), (None, "no id")]
    d = docs(spark, rows)
    for c in ("digest", "sha", "RANK", "b", "at", "next_text"):
        d = d.withColumn(c, F.lit(1))
    assert got(x.fingerprints(d)) == brute(rows)
    by = {r.doc_id: r.fingerprint for r in x.fingerprints(d).collect()}
    assert by[8] == by[9] and by[12] == by[13] and by[5] == by[6] != by[7]


CASES = ["\u0390", "\u03aa\u0301", "\u03b0", "\u03ab\u0301", "\u0131", "I", "i", "\u0130", "i\u0307", "stra\u00dfe", "STRASSE", "\ufb01", "FI", "a\u0345b", "A\u0399B", "\u212b", "\u00e5", "\u03a3\u03c2", "\u03c3\u03c3", "\u1e9e", "ss", "\ud55c", "\u1112\u1161\u11ab", "a\u0323\u0307", "a\u0307\u0323"]


def test_equal_up_to_case_and_normal_form(spark):
    """Equal fingerprints exactly where canonical caseless matching, by another library, says so."""
    by = {r.doc_id: r.fingerprint for r in x.fingerprints(docs(spark, list(enumerate(CASES)))).collect()}
    for i, a in enumerate(CASES):
        for j, b in enumerate(CASES):
            assert (by[i] == by[j]) == (canon(a) == canon(b)), (a, b)
    assert by[0] == by[1] and by[2] == by[3] and by[4] != by[5] == by[6]


def test_blocks(spark, monkeypatch):
    """Many small blocks, ids that a double can't hold, ties, nulls, and rows that are repeated often."""
    monkeypatch.setattr(x, "BLOCK_BYTES", 300)
    monkeypatch.setattr(x, "MANY", 5)
    monkeypatch.setattr(x, "SPREAD", 7)
    rows = [(2**62 + i, f"text {i} " * (i % 9)) for i in range(90)] + [(7, f"tie {i}") for i in range(40)] + [(None, f"none {i}") for i in range(30)]
    rows += [(None, None)] * 40 + [(8, "again")] * 61 + [(9, "again")] * 3 + [(-(2**63), "least")]
    d = docs(spark, rows).repartition(6)
    assert len(x._starts(d.select("doc_id", F.xxhash64("text").alias("h")).distinct().withColumn("bytes", F.lit(70)), 300)) > 20
    assert got(x.fingerprints(d)) == brute(rows)


def test_lone_and_empty(spark):
    assert got(x.fingerprints(docs(spark, [(3, "one two")]))) == brute([(3, "one two")])
    assert x.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_digests_of_other_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(x, "digest", lambda c: F.lpad(F.length(c).cast("string"), 32, "0"))
    rows = [(1, "aa bb"), (2, "cc dd"), (3, "AA  bb"), (4, "longer than these")]
    by = {r.doc_id: r.fingerprint for r in x.fingerprints(docs(spark, rows)).collect()}
    assert by[1] == by[3] != by[2] and "-" in by[1] and "-" not in by[4]
