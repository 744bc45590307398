import random
import re

import pyarrow.parquet as pq
from helpers import SCHEMA, docs
from millrace.llm import license_scan as x
from pyspark.sql import functions as F


def brute_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(t):
    w = brute_words(t)
    at = [(i, label) for label, p in x.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in at}))


EDGES = [None, "", "Under the MIT license", "under the mit under the mit license, apache license version 2 cc by-nc", "cc by nc cc by nc", "CC-BY-NC-CC-BY-NC", "under\nthe·mit license", "under the mit", "x " * 50_000 + "cc by nc", "cc by nc 4 0 licensed under cc by nc"]


def test_base_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()] + [(10_000 + i, t) for i, t in enumerate(EDGES)]
    d = docs(spark, rows).withColumn("spans", F.lit(1)).withColumn("LABELS", F.lit(1))
    got = {r.doc_id: r for r in x.scan(d).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    gpl = [i for i, t in rows if "GNU General Public License, version 3" in (t or "")]
    assert gpl and all(got[i].labels.split(",").count("gpl-3") == 1 for i in gpl)
    clean = [i for i, t in rows if "icen" not in (t or "").lower() and "cc" not in (t or "").lower()]
    assert clean and all(got[i].labels == "" and got[i].score == 0 for i in clean)
    assert x.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matching_statistics_equal_brute_force():
    rnd = random.Random(2)
    templates = [[rnd.randrange(4) for _ in range(rnd.randrange(3, 14))] for _ in range(12)]
    a = x.Automaton()
    for k, t in enumerate(templates):
        a.add(k, t)
    a.finish()
    runs = {tuple(t[i:j]): set() for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for k, t in enumerate(templates):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                runs[tuple(t[i:j])].add((k, j))
    text = [rnd.randrange(5) for _ in range(3000)]
    s = n = 0
    for i, w in enumerate(text):
        while s and w not in a.after[s]:
            s = a.link[s]
            n = a.length[s]
        if w in a.after[s]:
            s, n = a.after[s][w], n + 1
        want = max((m for m in range(1, min(14, i + 1) + 1) if tuple(text[i + 1 - m : i + 1]) in runs), default=0)
        assert n == want
        if n:
            assert a.ends[s] == runs[tuple(text[i + 1 - n : i + 1])]


def test_spans():
    s = x.scanner()
    grant = dict(t for t in x.TEMPLATES if t[0] == "isc")["isc"]
    got = s.scan(f"intro words here. {grant.upper()} more".encode())
    assert got["labels"] == "isc" and got["score"] == 1.0 and got["spans"][0][:2] == (3, 3 + len(x.words(grant.encode())))
    w = grant.split()
    w[8:8] = ["foo"]
    del w[20]
    edited = s.scan(" ".join(w).encode())
    assert edited["labels"] == "isc" and 0.8 < edited["score"] < 1
    assert s.scan(" ".join(w[:12]).encode())["labels"] == ""
    assert s.scan(b"under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License")["labels"] == "gpl-2"
    assert s.scan(b"This work is licensed under the GNU Lesser General Public License, version 3")["labels"] == "lgpl-3"


def brute_spans(text, base, templates):
    """Spans by their definition: naive matches, every chain by recursion, and every pair of spans held against each other."""
    told = brute_words(text)
    all_of = [(label, brute_words(t)) for label, t in (*base, *templates)]
    runs = {tuple(t[i:j]) for _, t in all_of for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    stats = [max((n for n in range(e + 1) if not n or tuple(told[e - n : e]) in runs), default=0) for e in range(len(told) + 1)]
    ends = [(e, n) for e, n in enumerate(stats) if n >= x.MATCH and (e == len(told) or stats[e + 1] <= n)]
    found = []
    for k, (label, t) in enumerate(all_of):
        if k < len(base):
            continue
        own = sorted((e, at, n) for e, n in ends for at in range(n, len(t) + 1) if told[e - n : e] == t[at - n : at])

        def best(i):
            e, at, n = own[i]
            top = (n, e - n)
            for j in range(i):
                f, u, _ = own[j]
                new = min(n, e - f, at - u)
                if new > 0 and e - new - f <= x.GAP and at - new - u <= x.GAP and memo[j][0] + new > top[0]:
                    top = (memo[j][0] + new, memo[j][1])
            return top

        memo = []
        for i in range(len(own)):
            memo.append(best(i))
            if memo[i][0] >= x.COVER * len(t):
                found.append((memo[i][0] / len(t), memo[i][0], memo[i][1], own[i][0], k))
    taken = []
    for c in sorted(found, key=lambda c: (-c[0] * c[1], -c[1], c[2], c[4])):
        if all(min(c[3], d[3]) - max(c[2], d[2]) <= (c[3] - c[2]) / 2 for d in taken):
            taken.append(c)
    return sorted((a, b, all_of[k][0], cover) for cover, _, a, b, k in taken)


def test_spans_labels_and_score_equal_brute_force():
    rnd = random.Random(7)
    letters = "abcdefgh"
    base = (("p", "a b c"), ("q", "c d"))
    for _ in range(60):
        templates = tuple((f"t{i % 5}", " ".join(rnd.choices(letters, k=rnd.randrange(4, 12)))) for i in range(6))
        pieces = []
        for _ in range(8):
            t = rnd.choice(templates)[1].split()
            for _ in range(rnd.randrange(3)):
                t[rnd.randrange(len(t)) : rnd.randrange(len(t))] = rnd.choices("abxyz", k=rnd.randrange(3))
            pieces += t + rnd.choices("xyz", k=rnd.randrange(4))
        text = " ".join(pieces)
        got = x.Scanner(base, templates).scan(text.encode())
        want = brute_spans(text, base, templates)
        assert got["spans"] == want
        w = text.split()
        there = {label for label, p in base if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
        assert got["labels"] == ",".join(sorted(there | {s[2] for s in want}))
        assert got["score"] == (1.0 if there else max((s[3] for s in want), default=0.0))


def test_long_texts_take_time_in_proportion(spark):
    import time

    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        got = x.scanner().scan(b"This work is licensed under CC BY 4.0. " * n)
        took.append(time.perf_counter() - began)
        assert len(got["spans"]) == n and got["labels"] == "cc-by"
    assert took[1] < 10 * took[0] + 0.5
    d = docs(spark, [(1, "under the mit license " * 60_000), (1, "under the mit license " * 60_000), (None, "cc by nc")])
    got = sorted((r.doc_id or 0, r.n_words, r.n_base) for r in x.scan(d).collect())
    assert got == [(0, 3, 1), (1, 240_000, 60_000), (1, 240_000, 60_000)]
