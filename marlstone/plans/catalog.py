"""Queries of the exploration and preparation operators, and SQL that must give the same rows.

Every query reads whole tables. Floating results are rounded where the order of addition may differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.json import json_keys, json_size
from marlstone.functions.text import array_sentences, clean_text, concat_sections, is_filled, sentences, words
from marlstone.operators import cluster, models, profile, rank, vectors
from marlstone.sources.images import image_entries
from marlstone.sources.jsonl import ITEMS, REVIEWS, read_items, read_jsonl
from marlstone.sources.staging import scratch
from marlstone.sources.storage import read_path, union_all, write_path
from marlstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# -- counts and profiles ------------------------------------------------------------------------------------------------


@query("select count(*) as n_rows from reviews")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return profile.row_count(table(spark, d, "reviews"))


@query("select count(*) as n_distinct from (select distinct parent_asin from reviews)")
def distinct_products(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_count(table(spark, d, "reviews"), "parent_asin")


@query("select distinct main_category from meta_items")
def distinct_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta_items").select("main_category").distinct()


_ITEM = ["title", "main_category", "features", "description", "average_rating", "rating_number", "price", "store", "parent_asin", "categories", "details", "images"]
_REVIEW = ["rating", "title", "text", "timestamp", "helpful_vote", "parent_asin", "images"]

def _null_sql(t: str, columns: list[str]) -> str:
    return " union all ".join(f"""select '{c}' as column_name, count(*) filter ("{c}" is null) as nulls, count("{c}") as non_nulls, count(*) as total from {t}""" for c in columns)


def _empty_sql(t: str, columns: list[str]) -> str:
    return " union all ".join(f"select '{c}' as column_name, count(*) filter ({c} is null or len({c}) = 0) as empty, count(*) filter (len({c}) > 0) as non_empty, count(*) as total from {t}" for c in columns)


@query(_null_sql("meta_items", _ITEM))
def null_profile_items(spark: SparkSession, d: str) -> DataFrame:
    return profile.null_profile(table(spark, d, "meta_items"), _ITEM)


@query(_null_sql("reviews", _REVIEW))
def null_profile_reviews(spark: SparkSession, d: str) -> DataFrame:
    return profile.null_profile(table(spark, d, "reviews"), _REVIEW)


@query(_empty_sql("meta_items", ["features", "description", "categories", "images"]))
def empty_profile_items(spark: SparkSession, d: str) -> DataFrame:
    return profile.empty_profile(table(spark, d, "meta_items"), ["features", "description", "categories", "images"])


@query(_empty_sql("reviews", ["images"]))
def empty_profile_reviews(spark: SparkSession, d: str) -> DataFrame:
    return profile.empty_profile(table(spark, d, "reviews"), ["images"])


@query("select row_id from meta_items where len(description) = 0")
def empty_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta_items").where(F.size("description") == 0).select("row_id")


@query("select avg(length(description[1])) as mean_length from meta_items")
def first_description_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta_items").agg(F.avg(F.length(F.get("description", F.lit(0)))).alias("mean_length"))


# -- JSON attributes ------------------------------------------------------------------------------------------------------

_KEYS = "select *, case when json_valid(details) and json_type(details) = 'OBJECT' then list_distinct(json_keys(details)) end as keys from meta_items"


@query(f"with k as ({_KEYS}) select count(*) filter (len(keys) = 0) as empty, count(*) filter (len(keys) > 0) as non_empty from k")
def json_size_split(spark: SparkSession, d: str) -> DataFrame:
    return profile.split_counts(table(spark, d, "meta_items"), json_size("details"))


@query(f"with k as ({_KEYS}) select unnest(keys) as item, count(*) as n from k group by 1")
def json_key_counts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "meta_items").select(F.explode(json_keys("details")).alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with k as ({_KEYS}), e as (select main_category, unnest(keys) as item from k),
    c as (select main_category, item, count(*) as item_count from e group by all),
    g as (select main_category, row_number() over (order by sum(item_count) desc, main_category nulls first) as r from c group by 1),
    t as (select c.*, row_number() over (partition by c.main_category order by item_count desc, item) as rank from c join g on c.main_category = g.main_category where g.r <= 10)
    select main_category, item, item_count, rank from t where rank <= 20"""
)
def top_details_per_category(spark: SparkSession, d: str) -> DataFrame:
    """The commonest detail keys of the categories that have most of them."""
    keyed = table(spark, d, "meta_items").select("main_category", F.explode(json_keys("details")).alias("item"))
    return rank.top_items_per_top_group(keyed, "main_category", "item", 10, 20).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    """with e as (select row_id, unnest(images) as e from meta_items), o as (select row_id, e::json as j from e where json_valid(e) and json_type(e) = 'OBJECT'),
    k as (select row_id, j ->> '$.variant' as variant, j, unnest(json_keys(j)) as type from o)
    select row_id, type, variant, json_extract_string(j, '$."' || type || '"') as url from k
    where type <> 'variant' and coalesce(json_extract(j, '$."' || type || '"')::varchar not like '[%' and json_extract(j, '$."' || type || '"')::varchar not like '{%', true)"""
)
def image_addresses(spark: SparkSession, d: str) -> DataFrame:
    return image_entries(table(spark, d, "meta_items"), "row_id")


# -- statistics and charts --------------------------------------------------------------------------------------------------

_STATS = "min(rating) as min, max(rating) as max, round(avg(rating), 6) as mean, round(stddev_samp(rating), 6) as std"


@query(f"with m as (select parent_asin from meta_items where parent_asin is not null) select {_STATS} from reviews join m using (parent_asin)")
def review_stats(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of reviews of known listings; a listing delivered twice counts its reviews twice."""
    joined = rank.join_dimension(table(spark, d, "reviews").select("parent_asin", "rating"), table(spark, d, "meta_items").select("parent_asin"), "parent_asin")
    return profile.describe(joined, "rating").select("min", "max", _r("mean"), _r("std"))


@query(f"with m as (select distinct parent_asin from meta_items) select {_STATS} from reviews join m using (parent_asin)")
def review_stats_deduped(spark: SparkSession, d: str) -> DataFrame:
    joined = rank.join_dimension(table(spark, d, "reviews").select("parent_asin", "rating"), table(spark, d, "meta_items").select("parent_asin"), "parent_asin", dedupe=True)
    return profile.describe(joined, "rating").select("min", "max", _r("mean"), _r("std"))


@query("select main_category, min(rating_number) as min, max(rating_number) as max, round(avg(rating_number), 6) as mean, round(stddev_samp(rating_number), 6) as std from meta_items group by 1")
def category_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.describe(table(spark, d, "meta_items"), "rating_number", "main_category").select("main_category", "min", "max", _r("mean"), _r("std"))


@query(
    """select main_category, cast(min(rating_number) as int) as low, round(quantile_cont(rating_number, 0.25), 6) as q1, round(quantile_cont(rating_number, 0.5), 6) as median,
    round(quantile_cont(rating_number, 0.75), 6) as q3, max(rating_number) as high from meta_items group by 1"""
)
def category_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return profile.quartiles(table(spark, d, "meta_items"), "rating_number", "main_category").select("main_category", "low", _r("q1"), _r("median"), _r("q3"), "high")


_HIST = """with s as (select cast(rating_number as double) as x from meta_items where rating_number is not null), m as (select min(x) as lo, (max(x) - min(x)) / 20.0 as w from s),
    b as (select {bin} as bin, lo, w from s, m)
    select bin, max(lo + (bin + 0.5) * w) as bin_center, count(*) as n from b group by 1"""


@query(_HIST.format(bin="cast(trunc((x - lo) / nullif(w, 0)) as int)"))
def rating_number_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(table(spark, d, "meta_items"), "rating_number", 20)


@query(_HIST.format(bin="least(cast(trunc((x - lo) / nullif(w, 0)) as int), 19)"))
def rating_number_histogram_closed(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(table(spark, d, "meta_items"), "rating_number", 20, last_closed=True)


@query("select store as value, count(*) as n from meta_items group by 1 order by n desc, store nulls first limit 20")
def top_stores(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "meta_items"), "store", 20)


@query("select rating as value, count(*) as n from reviews group by 1 order by n desc, rating nulls first limit 20")
def rating_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_values(table(spark, d, "reviews"), "rating", 20)


@query("select main_category, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from meta_items group by 1")
def category_percent(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "meta_items").groupBy("main_category").agg(F.count(F.lit(1)).alias("n"))
    return profile.percent_of_whole(counts).select("main_category", "n", _r("pct"))


@query(
    """with t as (select store, count(*) as n from meta_items group by 1 order by n desc, store nulls first limit 10)
    select store, n, round(n * 100.0 / sum(n) over (), 6) as pct_of_topk from t"""
)
def top_store_percent(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "meta_items").groupBy("store").agg(F.count(F.lit(1)).alias("n"))
    return profile.percent_of_top(counts, "store", "n", 10).select("store", "n", _r("pct_of_topk"))


@query(f"with p as ({_null_sql('reviews', _REVIEW)}) select column_name, round(cast(nulls as double) / total, 9) as null_share, round(cast(non_nulls as double) / total, 9) as filled_share from p")
def focus_shares(spark: SparkSession, d: str) -> DataFrame:
    """Both shares of every column, each under its own name."""
    p = profile.null_profile(table(spark, d, "reviews"), _REVIEW)
    nulls = profile.focus_share(p, "column_name", "nulls", ["non_nulls"]).withColumnRenamed("share", "null_share")
    filled = profile.focus_share(p, "column_name", "non_nulls", ["nulls"]).withColumnRenamed("share", "filled_share")
    return nulls.join(filled, "column_name").select("column_name", _r("null_share", 9), _r("filled_share", 9))


@query()
def category_box_sample(spark: SparkSession, d: str) -> DataFrame:
    stats = profile.describe(table(spark, d, "meta_items"), "rating_number", "main_category").where("mean is not null")
    return profile.box_sample(stats, 500, 1, "main_category")


@query("select vec_id from sentence_vectors order by md5('7|' || vec_id), vec_id limit 20")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return profile.random_rows(table(spark, d, "sentence_vectors").select("vec_id"), "vec_id", 20, 7)


@query(" union ".join(f"(select vec_id, label from embeddings order by md5('{seed}|' || vec_id), vec_id limit 20)" for seed in (1, 2, 3, 4)))
def sampled_points(spark: SparkSession, d: str) -> DataFrame:
    """The points that four samples of 20 show, each once, in order."""
    return profile.sampled_union(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 20, (1, 2, 3, 4))


@query(" union all ".join(f"(select {seed} as panel, vec_id from embeddings order by md5('{seed}|' || vec_id), vec_id limit 20)" for seed in (1, 2, 3, 4)))
def plane_panels(spark: SparkSession, d: str) -> DataFrame:
    """Which points each of four panels of the plane shows; joined with plane_projection by vec_id they have their places."""
    points = table(spark, d, "embeddings").select("vec_id")
    return union_all(*[profile.random_rows(points, "vec_id", 20, seed).select(F.lit(seed).alias("panel"), "vec_id") for seed in (1, 2, 3, 4)])


# -- text -------------------------------------------------------------------------------------------------------------------

_SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    f"""select review_id, load_no, trim(regexp_replace(regexp_replace(replace(replace(text, '&#34;', '"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '{_SPACES}', ' ', 'g')) as text from reviews"""
)
def clean_reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").select("review_id", "load_no", clean_text("text").alias("text"))


@query("with s as (select row_id, unnest(description) as x from meta_items) select row_id, unnest(string_split(x, '.')) as sentence from s where x is not null")
def description_sentences(spark: SparkSession, d: str) -> DataFrame:
    return array_sentences(table(spark, d, "meta_items").select("row_id", F.col("description").alias("sentence")), "sentence")


@query(
    """with s as (select lang, unnest(string_split(text, '.')) as x from documents where text is not null)
    select lang, count(*) as n, sum(length(x))::bigint as chars from s where length(x) > 0 group by 1"""
)
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    said = sentences(table(spark, d, "documents").select("lang", "text"), "text").where(is_filled("text"))
    return said.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("select row_id, coalesce(array_to_string(description, '.'), '') as description, coalesce(array_to_string(features, '.'), '') as features from meta_items")
def unified_sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "meta_items").select("row_id", concat_sections("description").alias("description"), concat_sections("features").alias("features"))


@query("select title as text from meta_items union all select title from reviews union all select text from documents")
def union_of_texts(spark: SparkSession, d: str) -> DataFrame:
    return union_all(
        table(spark, d, "meta_items").select(F.col("title").alias("text")), table(spark, d, "reviews").select(F.col("title").alias("text")), table(spark, d, "documents").select("text")
    )


@query("with w as (select lang, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) as term from documents) select lang, term, count(*) as n from w group by all")
def terms_by_language(spark: SparkSession, d: str) -> DataFrame:
    return profile.term_counts(table(spark, d, "documents"), "lang", words("text"))


@query(
    """with c as (select doc_type, cast(len(regexp_extract_all(lower(text), '[\\p{L}]+')) as double) as x from documents where text is not null),
    m as (select doc_type, min(x) as lo, (max(x) - min(x)) / 30.0 as w from c group by 1),
    b as (select doc_type, least(cast(trunc((x - lo) / nullif(w, 0)) as int), case when w > 0 then 29 end) as bin, lo, w from c join m using (doc_type))
    select doc_type, bin, max(lo + (bin + 0.5) * w) as bin_center, count(*) as n from b group by all"""
)
def word_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Word counts of texts by kind of document, 30 bins of equal width each."""
    counted = table(spark, d, "documents").where("text is not null").select("doc_type", F.size(words("text")).alias("n_words"))
    return profile.histogram_by(counted, "doc_type", "n_words", 30)


_STOP = ", ".join(f"'{w}'" for w in models.STOP_WORDS)


@query(
    f"""with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}]+'), lambda x: length(x) > 1 and x not in ({_STOP})) as w from documents),
    t as (select doc_id, unnest(w) as term from w union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w),
    f as (select doc_id, term, count(*) as tf from t group by all), n as (select term, count(*) as df from f group by 1),
    s as (select doc_id, term, round(tf * (ln(((select count(*) from documents) + 1.0) / (df + 1)) + 1), 9) as score from f join n using (term)),
    r as (select *, row_number() over (partition by doc_id order by score desc, term) as r from s)
    select d.doc_id, coalesce(list(term order by r) filter (term is not null), []) as keywords from documents d left join r on r.doc_id = d.doc_id and r.r <= 5 group by 1"""
)
def document_keywords(spark: SparkSession, d: str) -> DataFrame:
    return models.keywords(table(spark, d, "documents"), "doc_id", "text", 5)


@query("select cast(rating as double) as rating, helpful_vote, parent_asin, timestamp from reviews")
def reviews_through_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Reviews written as JSON lines and read back under the fixed schema."""
    path = scratch(spark, "jsonl")
    table(spark, d, "reviews").select(*REVIEWS.fieldNames()).write.json(path)
    return read_jsonl(spark, path, REVIEWS).select(F.col("rating").cast("double").alias("rating"), "helpful_vote", "parent_asin", "timestamp")


@query("select parent_asin, title, store, rating_number, average_rating::double as average_rating, len(features) as n_features from meta_items")
def items_through_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as JSON lines and read back under the fixed schema."""
    path = scratch(spark, "jsonl")
    table(spark, d, "meta_items").select(*ITEMS.fieldNames()).write.json(path)
    n = F.when(F.col("features").isNotNull(), F.size("features")).cast("bigint").alias("n_features")
    return read_items(spark, path).select("parent_asin", "title", "store", "rating_number", F.col("average_rating").cast("double").alias("average_rating"), n)


@query("select main_category, count(*) as n from meta_items group by 1")
def stored_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written by path, parted, and read back in its format."""
    path = scratch(spark, "table")
    write_path(table(spark, d, "meta_items").select("row_id", "main_category", "load_no"), path, partition_by=("load_no",))
    return read_path(spark, path).groupBy("main_category").agg(F.count(F.lit(1)).alias("n"))


# -- vectors ------------------------------------------------------------------------------------------------------------------


@query(
    """with e as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings)
    select label, cast(pos as bigint) as pos, round(avg(cast(x as double)), 6) as mean from e where label is not null group by all"""
)
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    means = vectors.mean_vector(table(spark, d, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("pos", "mean")).select("label", F.col("pos").cast("bigint").alias("pos"), _r("mean"))


@query(
    """with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
    p as (select a.vec_id, greatest(1 - list_cosine_similarity(a.v, b.v), 0) as dist from e a, e b),
    r as (select *, row_number() over (partition by vec_id order by dist) as r from p) select vec_id, round(dist, 6) as distance from r where r = 10"""
)
def k_distances(spark: SparkSession, d: str) -> DataFrame:
    return vectors.k_distance(table(spark, d, "embeddings"), "vec_id", "embedding", 10).select("vec_id", _r("distance"))


@query(
    """with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
    p as (select a.vec_id, greatest(1 - list_cosine_similarity(a.v, b.v), 0) as dist from e a, e b),
    r as (select *, row_number() over (partition by vec_id order by dist) as r from p) select row_number() over (order by dist) as place, round(dist, 6) as distance from r where r = 10"""
)
def k_distance_curve(spark: SparkSession, d: str) -> DataFrame:
    return vectors.k_distance_curve(vectors.k_distance(table(spark, d, "embeddings"), "vec_id", "embedding", 10)).select("place", _r("distance"))


@query(
    """with r as (select *, row_number() over (partition by label order by vec_id) as rank from embeddings)
    select label, vec_id, rank from r where rank <= 10"""
)
def head_per_label(spark: SparkSession, d: str) -> DataFrame:
    return rank.head_per_group(table(spark, d, "embeddings"), "label", "vec_id", 10).select("label", "vec_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    """with recursive e as (select vec_id, cast(embedding as double[]) as v from embeddings where len(embedding) > 0),
    p as materialized (select a.vec_id as a, b.vec_id as b from e a, e b where 1 - list_cosine_similarity(a.v, b.v) <= 0.66),
    c as materialized (select a from p group by a having count(*) >= 5),
    g as materialized (select p.a, p.b from p join c on c.a = p.a join c d on d.a = p.b),
    t(n, m) as (select a, a from c union select g.b, t.m from t join g on g.a = t.n where t.m < g.b),
    k as (select n, min(m) as m from t group by n), l as (select n, dense_rank() over (order by m) - 1 as cluster from k),
    x as (select p.b as n, min(l.cluster) as cluster from p join l on l.n = p.a group by 1)
    select e.vec_id, cast(coalesce(l.cluster, x.cluster, -1) as int) as cluster from e left join l on l.n = e.vec_id left join x on x.n = e.vec_id"""
)
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", 0.66, 5)


@query(
    """with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
    n as (select a.vec_id, count(*) as n from e a, e b where 1 - list_cosine_similarity(a.v, b.v) <= 0.66 group by 1)
    select vec_id, n from n where n >= 5"""
)
def density_cores(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.66)
    return near.groupBy(F.col("a").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query()
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.ward(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query()
def bisecting_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.bisecting(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query()
def plane_projection(spark: SparkSession, d: str) -> DataFrame:
    points, share = vectors.project_2d(table(spark, d, "embeddings"), "vec_id", "embedding")
    return points.withColumn("explained_pct", F.lit(share * 100))


@query()
def listing_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Titles and description sentences encoded, averaged by listing, clustered, and joined back to the listings."""
    items = table(spark, d, "meta_items").select("parent_asin", "title", "description")
    titles = items.select(F.col("parent_asin").alias("id"), F.col("title").alias("sentence"))
    said = array_sentences(items.select(F.col("parent_asin").alias("id"), F.col("description").alias("sentence")), "sentence")
    both = union_all(titles, said).where(is_filled("sentence"))
    means = vectors.mean_vector(models.encode(both, "sentence", models.HashingEncoder(32)), "id", "embeddings")
    found = cluster.bisecting(means, "id", "embeddings", 5)
    return found.join(items.select("parent_asin", "title"), F.col("id") == F.col("parent_asin")).select("parent_asin", "title", "cluster")
