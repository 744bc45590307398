from collections import Counter

import corpus_pipeline as p
import public_tokenizers
import sentencepiece
from helpers import SCHEMA, docs
from pyspark.sql import functions as F
from test_simhash import brute_components, brute_fp
from test_exact_dedup import fold

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "mixing", "sentencepiece"]
    at = []
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        at.append(docs.collect())
    good, exact, near, mixed, tokens = at
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [r for r in good if quality.get(r.doc_id) == 0] and sum(quality.get(r.doc_id) == 1 for r in good) == sum(quality.values())
    last = {}
    for r in good:
        last[fold(r.text)] = max(r.doc_id, last.get(fold(r.text), -1))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    roots = brute_components([(r.doc_id, brute_fp(r.text)) for r in exact])
    assert sorted(r.doc_id for r in near) == sorted(set(roots.values()))
    text = {r.doc_id: r.text for r in near}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= set(text) and max(copies.values()) <= 2
    assert all(r.text == text[r.doc_id] for r in mixed)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(r.doc_id for r in tokens) == copies
    assert all(list(r.ids) == lib.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in tokens)
    for t in at[:4]:
        assert list(t[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark):
    assert p.run(spark, SF).count() > 50


ODD = [(None, None), (None, None), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, "w " * 120_000), (5, "W " * 120_000), (6, "some text here"), (6, "some text here"), (7, "some text here!"), (None, "no id but a text")]


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, empty tables."""
    odd = docs(spark, ODD).withColumn("source", F.when(F.col("doc_id") > 3, "s")).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    for c in ("ids", "KEPT", "size", "k__", "same__", "fp", "tk", "sha", "box__", "label"):
        odd = odd.withColumn(c, F.lit(c))
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in p.STAGES:
        out = stage(spark, odd, SF)
        kept = Counter((r.doc_id, r.text) if "text" in out.columns else r.doc_id for r in out.collect())
        if name != "sentencepiece":
            assert out.columns == odd.columns and set(kept) <= {(i, t) for i, t in ODD}, name
            assert stage(spark, empty, SF).columns == empty.columns
        assert stage(spark, empty, SF).count() == 0, name
        if name == "exact dedup":
            assert Counter(t for _, t in kept) == Counter(["", " \n\t", "W " * 120_000, "some text here", "some text here!", "no id but a text"])
        if name == "simhash near-dedup":
            assert len(kept) == sum(kept.values()) and (1, None) in kept and (2, "") not in kept
        if name == "sentencepiece":
            assert kept == Counter(i for i, _ in ODD)


def test_columns_of_any_name(spark):
    """Dots and backticks in names; the encoder and the scores keep all of a table's columns, too."""
    d = docs(spark, ODD).select("*", F.lit(1).alias("meta.url"), F.col("doc_id").alias("a`b"))
    for name, stage in p.STAGES[:4]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and {r["meta.url"] for r in out.collect()} == {1}, name
    coded = p.sentencepiece_bpe.encode(d, p.piece_model())
    assert coded.columns == [*d.columns, "ids"] and all(r["a`b"] == r.doc_id for r in coded.collect())
    for model in (None, p.quality.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))):
        scored = p.quality.scores(d, model, ["meta.url", "a`b", "doc_id"])
        assert scored.columns[:3] == ["meta.url", "a`b", "doc_id"] and all(r["a`b"] == r.doc_id for r in scored.collect())


def test_many_rows_that_repeat_an_id_and_a_text(spark):
    """One of them stays, and no window holds them."""
    rows = [(None, "boilerplate " * 40)] * 3000 + [(None, "other")] * 2 + [(1, "Other")]
    for stage in (p.exact_stage, p.near_stage):
        out = stage(spark, docs(spark, rows), SF)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(((r.doc_id, r.text[:5]) for r in out.collect()), key=repr) in ([(None, "boile"), (None, "other")], [(1, "Other"), (None, "boile")])
