"""Queries of the training-data problems, over whole tables, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import token_count
from marlstone.llm import clusters, linkage, mixing, neighbours, packing, residue
from marlstone.sources.tables import table


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents").select("doc_id", token_count("text").alias("size")), "doc_id", "size")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1 and piece = 0").select("doc_id", "n_pieces")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of containers: every document and token in one, none above the capacity, no document cut that fits."""
    packed = _packed(spark, d)
    used = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"))
    cut = (F.col("n_pieces") > 1) & (F.col("whole") <= packing.CAPACITY)
    documents = packed.groupBy("doc_id").agg(F.sum("tokens").alias("whole"), F.max("n_pieces").alias("n_pieces"))
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.sum("whole").alias("tokens"), F.count_if(cut).alias("cut")).crossJoin(used)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents").select("doc_id", "source", token_count("text").alias("size"))
    return mixing.mix(documents, table(spark, d, "mix_targets"), "doc_id", "size")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].select("source", "action")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mix, by source: its tokens, and no document more often than allowed."""
    taken, report = _mixed(spark, d)
    most = taken.groupBy("source").agg(F.max("copies").alias("most"))
    kept = F.coalesce("most", F.lit(0)) <= F.col("max_repeats")
    return report.join(most, "source", "left").select("source", "tokens", kept.alias("within_repeats"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.flag_records(table(spark, d, "documents"), "doc_id", "text").where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue.flag_records(table(spark, d, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest(table(spark, d, "sentence_vectors"), "vec_id", "embeddings", k=10, least=0.9, graph=neighbours.Graph(degree=14, beam=24, expand=2))
    return neighbours.mutual_pairs(found, "vec_id").select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "sentence_vectors"), "vec_id", "embeddings", k=10)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(table(spark, d, "meta_items")).select(F.col("cluster").alias("cluster_key"), "parent_asin")


def p7_typical(spark: SparkSession, d: str) -> DataFrame:
    return clusters.typical(clusters.clusters(table(spark, d, "meta_items")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = linkage.product_pairs(linkage.products(table(spark, d, "meta_items")))
    return pairs.select(F.col("a").alias("asin_a"), F.col("b").alias("asin_b"))


def p3_products(spark: SparkSession, d: str) -> DataFrame:
    return linkage.products(table(spark, d, "meta_items"))


QUERIES = {
    "p3_found": p3_found, "p3_products": p3_products, "p7_found": p7_found, "p7_typical": p7_typical,
    "p2_found": p2_found, "p2_neighbours": p2_neighbours,
    "p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_check": p8_check, "p9_check": p9_check, "p9_found": p9_found, "p9_report": p9_report, "p9_mix": p9_mix,
    "p10_found": p10_found, "p10_scores": p10_scores,
}

_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TOKENS = rf"coalesce(length(regexp_replace(regexp_replace(text, '[\p{{L}}\p{{N}}]+', 'a', 'g'), '{_BLANK}', '', 'g')), 0)"

ORACLE = {
    "p8_found": f"""
        with t as (select doc_id, cast({_TOKENS} as bigint) as n from documents)
        select doc_id, cast(ceil(n / 1024.0) as bigint) as n_pieces from t where n > 1024""",
    "p8_check": f"""
        with t as (select cast({_TOKENS} as bigint) as n from documents)
        select count(*) as documents, cast(sum(n) as bigint) as tokens, 0 as cut, 0 as overfull from t""",
    "p9_check": rf"""
        with d as (select regexp_replace(lower(source), '[\s_-]+', '', 'g') as name, cast({_TOKENS} as bigint) as n from documents)
        select m.source, cast(coalesce(sum(d.n), 0) as bigint) as tokens, true as within_repeats
        from mix_targets m left join d on d.name = regexp_replace(lower(m.source), '[\s_-]+', '', 'g') group by m.source""",
    "p2_found": """
        with v as (select vec_id, cast(embeddings as double[]) as e from sentence_vectors where len(embeddings) = 64
              and len(list_filter(embeddings, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embeddings, lambda x: x <> 0)) > 0),
        p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.e, b.e) as s from v a, v b where a.vec_id <> b.vec_id),
        r as (select *, row_number() over (partition by a order by s desc, b) as r from p)
        select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from r where r <= 10 and s >= 0.9""",
    "p9_found": rf"""
        with d as (select regexp_replace(lower(source), '[\s_-]+', '', 'g') as name, cast({_TOKENS} as bigint) as n from documents),
        m as (select source, regexp_replace(lower(source), '[\s_-]+', '', 'g') as name, target_share as s, max_repeats as r from mix_targets),
        t as (select m.source, m.s, m.r, cast(coalesce(sum(d.n), 0) as double) as t from m left join d using (name) group by all),
        a as (select *, sum(t) over () as total from t)
        select source, case when t >= s * total then 'cut' when r * t >= s * total then 'repeat' else 'short' end as action from a""",
}
