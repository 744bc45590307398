import hashlib
import random
import re

from helpers import SCHEMA, docs
from millrace.llm import fill_in_middle as x
from pyspark.sql import functions as F


def brute(i, t):
    t = t or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, t
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "Zq", "P", "S", "M", "<", ">", "<", " ", "\n", "é", "ß", "漢", "🙂", "1", "<P", "S>"]
    return [None, "", "<", "<P>", "<S", "S>", "aa<M>b", "x" * 5000, "é" * 3000, "🙂" * 2000, "<" * 999, "\n\r\x00"] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 400))) for _ in range(n)]


def test_functions_of_chunks_compose_to_the_text():
    """Cut anywhere between code points, whatever the state: the automaton byte by byte."""
    for t in texts(60)[2:]:
        cuts = sorted(random.Random(len(t)).choices(range(len(t) + 1), k=4))
        parts = [t[a:b].encode() for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
        whole = [(s, 0, False) for s in range(4)]
        for p in parts:
            whole = x.compose(whole, x.Chunk(p).function())
        for s in range(4):
            state, n, hit = s, 0, False
            for c in x.CLASS[list(t.encode())]:
                n, hit, state = n + bool(x.BEGINS[state, c]), hit or bool(x.MARKS[state, c]), int(x.NEXT[state, c])
            assert whole[s] == (state, n, hit)


def test_documents_equal_brute_force_however_long_chunks_are(spark):
    rows = list(enumerate(texts(120))) + [(500, "a b<c" * 20), (500, "a b<c" * 20), (501, "a b<c" * 20), (None, "null id"), (None, "null id, and long " * 9)]
    want = sorted((repr(i), *brute(i, t)) for i, t in rows)
    for chunk in (x.CHUNK, 7, 64):
        d = x.transform(docs(spark, rows), chunk=chunk)
        got = d.withColumn("back", x.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(((repr(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(want, key=repr)
        assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)


def test_empty_tables_and_clashing_columns(spark):
    assert x.transform(spark.createDataFrame([], SCHEMA)).count() == 0
    d = docs(spark, [(1, "one two three"), (2, "four " * 40)])
    for c in ("N", "h1", "t", "tk", "id", "box__", "c", "meta.url", "a`b"):
        d = d.withColumn(c, F.lit(9)) if "`" not in c and "." not in c else d.select("*", F.lit(9).alias(c))
    for chunk in (x.CHUNK, 8):
        out = x.transform(d, chunk=chunk)
        assert out.columns == [c for c in d.columns if c != "N"] + x.NAMES
        assert sorted((r["doc_id"], r["meta.url"], r["output"]) for r in out.collect()) == [(i, 9, brute(i, t)[-1]) for i, t in ((1, "one two three"), (2, "four " * 40))]
