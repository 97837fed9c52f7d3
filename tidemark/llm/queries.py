"""One query for each operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, lm, mixing, packing, quality_rules, site_quality, span_dedup, topk, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is the host; its documents in one language are a path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return site_quality.site_quality(docs, table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.dedup_spans(table(spark, sf_dir, "documents"), lengthen=True, short=True)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).drop("query_row")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_jaccard_join, op3_quality_classifier, op4_substring_dedup, op5_best_fit_packing,
        op6_lm_scoring, op7_language_id, op8_toxicity, op9_exact_topk, op10_source_mixing,
    )
}

#: What SQL can say whole: components of exact similarity, and exact search. The others hold a fitted model, a global packing or a permutation.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ), s as (
            select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' ')) when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end) as g
            from w
        ), n as (
            select doc_id, count(*) as n from s group by doc_id
        ), p as (
            select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
        ), l as (
            select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)
        ), r(doc_id, c) as (
            select doc_id, doc_id from documents union select l.b, r.c from r join l on r.doc_id = l.a
        )
        select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(c) from r where r.doc_id = d.doc_id) as component_id,
            (select count(*) from l where l.a = d.doc_id) as n_links
        from documents d left join n on n.doc_id = d.doc_id
    """,
    "op9_exact_topk": """
        with v as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e
            from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
        ), s as (
            select q.r as qr, q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
            from v q join v c on q.vec_id % 100 = 0 and c.r <> q.r and len(c.e) = len(q.e)
        )
        select query_id, cast(row_number() over (partition by qr order by score desc, vec_id) as integer) as rank, vec_id, score
        from s qualify row_number() over (partition by qr order by score desc, vec_id) <= 10
    """,
}
