"""Ranks, top groups and top items. Ties are always settled by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_groups(counts: DataFrame, group: str, n: str, k: int) -> DataFrame:
    """``group, group_count, rank`` of the k groups with the largest sums of n. A null group can take a rank."""
    sums = counts.groupBy(group).agg(F.sum(n).alias("group_count"))
    rank = F.row_number().over(Window.orderBy(F.desc("group_count"), F.asc_nulls_first(group)))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)


def top_items_per_top_group(df: DataFrame, group: str, item: str, groups: int = 10, items: int = 20) -> DataFrame:
    """``group, item, item_count, rank``: the commonest items within the groups of most items.

    A null group may use up one of the ranks and is then left out, as it equals nothing.
    """
    counts = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("item_count"))
    kept = top_groups(counts, group, "item_count", groups).select(group)  # at most ``groups`` rows
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("item_count"), F.asc_nulls_first(item)))
    return counts.join(F.broadcast(kept), group, "left_semi").withColumn("rank", rank).where(F.col("rank") <= items)


def head_per_group(df: DataFrame, group: str, order: str, k: int = 10) -> DataFrame:
    """The first k rows of every group by ``order``, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def join_dimension(facts: DataFrame, dimension: DataFrame, on: str, dedupe: bool = False) -> DataFrame:
    """Inner join on a key of the same name. Repeated keys of the dimension repeat facts, unless dedupe keeps one of each."""
    return facts.join(dimension.dropDuplicates([on]) if dedupe else dimension, on)
