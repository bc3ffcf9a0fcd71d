"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are counted per key and input partition, the counts are prefix-summed into offsets, every row gets its exact place
within its key, and places are cut into chunks of equal size. A chunk is the unit of an aggregate; rows of a key
are numbered by the input partition they come from, and chunk states are merged per key in chunk order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 16_384


@dataclass(frozen=True)
class State:
    """A value kept per chunk (an aggregate over rows) and the aggregate that merges chunk values of a key."""

    name: str
    of_rows: Column
    merge: Callable[[Column], Column]


def number_in_key(df: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS, part: Column | None = None, order: Column | None = None) -> DataFrame:
    """Add ``place`` (from 0, exact, without gaps within a key) and ``chunk`` = place div chunk_rows.

    The rows travel once, hashed by key and input partition, so a hot key is spread over as many tasks as it has input
    partitions. Offsets are one row per key and input partition. ``df`` must give the same partitions each time it is
    read, as a file scan or a staged table does. Where places are to follow an order, ``part`` is a column that numbers
    ranges of it and ``order`` the order within a range; else they follow the input.

    Null keys are a key of their own. An empty table gives an empty one. Columns named ``place``, ``chunk`` or ``_oc_*``
    are not allowed beside the keys; callers project first.
    """
    key = F.struct(*[F.col(k) for k in keys])
    rows = df.withColumns({"_oc_key": key, "_oc_part": F.spark_partition_id() if part is None else part, "_oc_row": F.monotonically_increasing_id() if order is None else order})
    counts = rows.groupBy("_oc_key", "_oc_part").agg(F.count(F.lit(1)).alias("_oc_n"))
    before = Window.partitionBy("_oc_key").orderBy("_oc_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_oc_key", "_oc_part", F.coalesce(F.sum("_oc_n").over(before), F.lit(0)).alias("_oc_offset"))
    local = F.row_number().over(Window.partitionBy("_oc_key", "_oc_part").orderBy("_oc_row"))
    numbered = rows.withColumn("_oc_local", local).join(offsets, ["_oc_key", "_oc_part"], "left")
    lost = F.raise_error(F.lit("the input gave other partitions when it was read again; stage it first")).cast("bigint")
    place = F.when(F.col("_oc_offset").isNull(), lost).otherwise(F.col("_oc_offset")) + F.col("_oc_local") - 1
    return numbered.withColumns({"place": place, "chunk": F.floor(place / chunk_rows)}).drop("_oc_key", "_oc_part", "_oc_row", "_oc_local", "_oc_offset")


def chunked_aggregate(df: DataFrame, keys: Sequence[str], states: Sequence[State], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per key: ``keys``, ``n_rows``, ``n_chunks`` and a column per state.

    Nulls in keys form their own key; states see nulls as their aggregate does. Ties are for the states to settle.
    """
    numbered = number_in_key(df, keys, chunk_rows)
    chunks = numbered.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n_rows"), *[s.of_rows.alias(s.name) for s in states])
    return chunks.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_chunks"), *[s.merge(F.col(s.name)).alias(s.name) for s in states]
    )


def ordered_ranges(df: DataFrame, *columns: str) -> DataFrame:
    """df staged in ranges of the columns, ``_range`` numbering them in order. Files may be read in any order afterwards."""
    from marlstone.sources.staging import stage

    return stage(df.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()), "ranges")


def chunk_runs(df: DataFrame, keys: Sequence[str], order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per key the largest step between neighbours in ``order``: ``keys``, ``n_rows``, ``first``, ``last``, ``largest_step``.

    An ordered fold: rows are parted into ranges of key and order, numbered along them and cut into chunks. Each chunk
    keeps its first and last value and its largest inner step; neighbouring chunks of a key are then joined at their
    boundary. Rows whose order is null are left out of the steps but counted.
    """
    ranged = ordered_ranges(df.select(*keys, F.col(order).alias("_at")), *keys, "_at")
    numbered = number_in_key(ranged, keys, chunk_rows, F.col("_range"), F.col("_at"))
    inner = Window.partitionBy(*keys, "chunk").orderBy("place")
    stepped = numbered.withColumn("_step", F.col("_at") - F.lag("_at").over(inner))
    chunks = stepped.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.max("_step").alias("inner")
    )
    edge = F.col("lo") - F.max("hi").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return (
        chunks.withColumn("edge", edge)
        .groupBy(*keys)
        .agg(F.sum("n").alias("n_rows"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.max(F.greatest("inner", "edge")).alias("largest_step"))
    )


# -- the reviews of a product and load ------------------------------------------------------------------------------


def product_key(c: Column) -> Column:
    """Letters and digits of a product id, upper case."""
    return F.upper(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def top_votes(reviews: DataFrame, chunk_rows: int = CHUNK_ROWS, least_rows: int = 10) -> DataFrame:
    """``parent_asin, load_no, n_rows, n_chunks, review_id, votes`` per product key of ten characters and load.

    review_id has the highest helpful_vote within 0..1000000, the smaller id on ties; rows without such a vote or id
    count but cannot win, and a key where none can win is left out. Keys of fewer than least_rows rows are left out.
    """
    slim = reviews.select(product_key(F.col("parent_asin")).alias("parent_asin"), F.col("load_no").cast("bigint").alias("load_no"), "review_id", "helpful_vote")
    slim = slim.where(F.length("parent_asin") == 10)
    fit = F.col("helpful_vote").between(0, 1_000_000) & F.col("review_id").isNotNull()
    best = F.max(F.when(fit, F.struct(F.col("helpful_vote").alias("votes"), (-F.col("review_id")).alias("neg_id"))))
    per_key = chunked_aggregate(slim, ["parent_asin", "load_no"], [State("best", best, F.max)], chunk_rows)
    return per_key.where((F.col("n_rows") >= least_rows) & F.col("best").isNotNull()).select(
        "parent_asin", "load_no", "n_rows", "n_chunks", (-F.col("best.neg_id")).alias("review_id"), F.col("best.votes").cast("bigint").alias("votes")
    )
