"""The queries opN_<name> of this folder, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, hard_negatives, language_id, license_scan, quality, sentencepiece_bpe
from .chat import collapse_and_render
from .common import table
from .exact_dedup import decisions
from .fingerprint import fingerprints
from .mixing import mixture
from .simhash import near_components
from .token_files import token_counts
from .url_filter import verdicts


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixture(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_components(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 50256)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), piece_model())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out(F.col("doc_id"))
    told = language_id.predict(docs, language_id.train(docs.filter(~apart)))
    return told.select("doc_id", apart.alias("held_out"), "lang_pred", "score", "rejected")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES = {f.__name__: f for f in (op1_chat, op2_mixing, op3_simhash, op4_url_filter, op5_license_scan, op6_fingerprint, op7_exact_dedup, op8_token_counts, op9_sentencepiece, op10_quality, op11_language_id, op12_fill_in_middle, op13_hard_negatives)}

ORACLES = {
    "op1_chat": """
        with c as (select conv_id, list(struct_pack(r := role, t := text) order by turn) as l from (select distinct conv_id, turn, role, text from conversations where conv_id is not null) group by conv_id),
        proper as (select distinct list_slice(l, 1, i) as p from (select l, unnest(range(1, len(l))) as i from c))
        select min(conv_id) as conv_id, cast(0 as bigint) as segment, cast(len(l) as bigint) as n_turns, count(*) as copies,
          list_aggregate(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), 'string_agg', '') as rendered
        from c where l not in (select p from proper) group by l""",
    "op4_url_filter": r"""
        with recursive p as (
          select page_id, url, html,
            translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
        rules(action, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        ruled as (select p.page_id, arg_max(struct_pack(a := action, r := h || rules.p), length(h || rules.p)) as r
          from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, rules.p) group by p.page_id),
        links as (select page_id, unnest(regexp_extract_all(html, '<link\b[^>]*>', 0, 'is')) as tag from p where contains(url, '://')),
        node as (select page_id, host || coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's'), ''), '/') as n from p where contains(url, '://')),
        edge as (select distinct n as a, regexp_extract(regexp_extract(tag, 'href\s*=\s*["'']?([^"''>\s]*)', 1, 'i'), '://(.*)$', 1) as b
          from links join node using (page_id) where regexp_matches(tag, '\brel\s*=\s*["'']?canonical\b', 'i')),
        sym as (select a, b from edge union select b, a from edge),
        reach as (select a, b from sym union select reach.a, sym.b from reach join sym on reach.b = sym.a),
        said as (select node.page_id, max(case r.a when 'allow' then 2 else 1 end) as v from node join reach on n = reach.a join node m on m.n = reach.b join ruled on ruled.page_id = m.page_id group by node.page_id)
        select p.page_id, host, path, r.r as rule, coalesce(r.a, case v when 1 then 'block' else 'allow' end) as verdict
        from p left join ruled using (page_id) left join said using (page_id)""",
    "op7_exact_dedup": """
        with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from t window w as (partition by text_sha256)""",
    "op12_fill_in_middle": """
        with t as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
        d as (select doc_id, t, u, len(u) as n, [cast('0x' || substr(h, 8 * i + 1, 8) as bigint) for i in range(4)] as h from t),
        f as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
          case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from d),
        p as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from f)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
          sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256, sha256(t) as restored_sha256 from p""",
    "op13_hard_negatives": """
        with v as (select vec_id as id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
          from embeddings where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.id as a, b.id as b, a.label = b.label as same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as s from v a join v b on a.id % 100 = 0 and a.id <> b.id),
        p as (select * from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
        n as (select p.a as anchor_id, p.b as positive_id, cast(row_number() over (partition by p.a, p.b order by n.s desc, n.b) as integer) as rank, n.b as negative_id, p.s as positive_score, n.s as negative_score
          from p join s n on n.a = p.a and not n.same and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s)
        select * from n where rank <= 10""",
}
