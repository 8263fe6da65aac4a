"""The operators as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, html_text, line_dedup, minhash, mixing, pieces, quality_rules, secret_scan, substring_dedup, top_k


def _table(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": _table("documents", minhash.near_duplicates),
        "op2_mix_sources": _table("documents", mixing.mixed_ids),
        "op3_line_dedup": _table("documents", lambda d: line_dedup.dedup_lines(d.select("doc_id", "text"))),
        "op4_secret_scan": _table("documents", secret_scan.find_secrets),
        "op5_html_extraction": _table("pages", html_text.extract),
        "op6_substring_dedup": _table("documents", substring_dedup.repeated_passages),
        "op7_quality_classifier": lambda spark, sf_dir: classifier.kept(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op8_exact_top_k": lambda spark, sf_dir: top_k.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("distance", F.round("distance", 5)),
        "op9_quality_rules": _table("documents", quality_rules.kept_with_distance),
        "op10_sentencepiece": _table("documents", pieces.encode),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.oracle(),
        "op3_line_dedup": LINE_DEDUP,
        "op8_exact_top_k": TOP_K,
    }


#: A line that six documents or more have stays in the one with the least doc_id; rows that repeat a doc_id count each.
LINE_DEDUP = f"""with d as (select row_number() over () as rid, doc_id, text from documents),
l as (select rid, doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from d where doc_id is not null and text is not null),
n as (select line, count(*) as docs, min(doc_id) as owner from (select distinct rid, doc_id, line from l) where regexp_matches(line, '[^ \\t\\r\\x0b\\f]') group by line),
j as (select l.*, coalesce(n.docs >= {line_dedup.MIN_DOCS} and n.owner <> l.doc_id, false) as dropped from l left join n using (line))
select any_value(doc_id) as doc_id, coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '') as text, count(*)::int as n_lines, sum(dropped::int)::int as n_dropped from j group by rid
union all select doc_id, text, case when text is null then 0 else len(string_split(text, chr(10))) end::int, 0 from documents where doc_id is null or text is null"""

#: Distances of all pairs; rounded, as engines add up in different orders.
TOP_K = f"""with p as (select a.vec_id, b.vec_id as neighbour_id, list_distance(a.embedding::double[], b.embedding::double[]) as d from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by vec_id order by d, neighbour_id) as rank from p)
select vec_id, neighbour_id, rank::int as rank, round(d, 5) as distance from r where rank <= {top_k.K}"""
