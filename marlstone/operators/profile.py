"""Counts, shares, histograms and frequencies of columns. Every function is one aggregation, whatever the number of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows of the columns; null counts as a value."""
    return df.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))


def _profile(df: DataFrame, columns: Sequence[str], test, names: tuple[str, str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(test(F.col(c))).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("hit")) for i, c in enumerate(columns)])
    return one.select("_all", F.inline(rows)).select("column_name", F.col("hit").alias(names[0]), (F.col("_all") - F.col("hit")).alias(names[1]), F.col("_all").alias("total"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, nulls, non_nulls, total`` of all columns in one pass."""
    return _profile(df, columns or df.columns, lambda c: c.isNull(), ("nulls", "non_nulls"))


def empty_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, empty, non_empty, total`` of array columns; null counts as empty."""
    return _profile(df, columns, lambda c: c.isNull() | (F.size(c) == 0), ("empty", "non_empty"))


def split_counts(df: DataFrame, size: Column) -> DataFrame:
    """``empty, non_empty``: rows whose size is 0 and above 0; null is neither."""
    return df.agg(F.count_if(size == 0).alias("empty"), F.count_if(size > 0).alias("non_empty"))


def describe(df: DataFrame, column: str, *by: str) -> DataFrame:
    """min, max, mean and sample deviation, of all rows or by group. The deviation of one row is null."""
    x = F.col(column)
    return df.groupBy(*by).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def histogram_by(df: DataFrame, by: str, column: str, bins: int) -> DataFrame:
    """``by, bin, bin_center, n``: equal-width bins from the least to the largest value of each group, the last one closed.

    Null groups are a group; a group of one value has one row with null bin. Null and NaN values are left out.
    """
    some = df.select(F.col(by).alias("_by"), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    counted = some.groupBy("_by", "x").agg(F.count(F.lit(1)).alias("n"))
    span = counted.groupBy("_by").agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / bins).alias("w")).withColumnRenamed("_by", "_of")
    placed = counted.join(span, F.col("_by").eqNullSafe(F.col("_of")))
    at = F.least(F.try_divide(F.col("x") - F.col("lo"), F.col("w")).try_cast("int"), F.lit(bins - 1))
    at = F.when(F.col("w") > 0, at)
    binned = placed.select(F.col("_by").alias(by), at.alias("bin"), (F.col("lo") + (at + 0.5) * F.col("w")).alias("bin_center"), "n")
    return binned.groupBy(by, "bin").agg(F.max("bin_center").alias("bin_center"), F.sum("n").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, last_closed: bool = False) -> DataFrame:
    """``bin, bin_center, n``: equal-width bins from the least to the largest value.

    The largest value has bin ``bins``, a bin of its own, unless last_closed puts it into the last. Bins without rows are
    absent. A column with one value only has one row with null bin. Null and NaN are left out; without any value nothing
    comes out.
    """
    some = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    span = some.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()  # two numbers
    low, width = F.lit(span["lo"]).cast("double"), F.lit(None if span["lo"] is None else (span["hi"] - span["lo"]) / bins).cast("double")
    place = F.try_divide(F.col("x") - low, width).try_cast("int")
    if last_closed:
        place = F.least(place, F.when(place.isNotNull(), F.lit(bins - 1)))
    placed = some.select(place.alias("bin"), (low + (place + 0.5) * width).alias("bin_center"))
    return placed.groupBy("bin").agg(F.max("bin_center").alias("bin_center"), F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """``value, n`` of the commonest values, null among them; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)


def percent_of_whole(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their percent of the sum of all counts; a sum of 0 or null gives null."""
    total = counts.agg(F.sum(n)).first()[0]  # one number
    return counts.withColumn("pct", F.try_divide(F.col(n) * 100.0, F.lit(None if total is None else float(total)).cast("double")))


def percent_of_top(counts: DataFrame, label: str, n: str, k: int = 10) -> DataFrame:
    """``label, n, pct_of_topk``: percent of the kept rows, not of all."""
    top = counts.orderBy(F.desc(n), F.asc_nulls_first(label)).limit(k)
    return top.select(label, n, (F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(F.lit(0)))).alias("pct_of_topk"))


def focus_share(df: DataFrame, label: str, target: str, others: Sequence[str]) -> DataFrame:
    """``label, share``: the target's part of the row's sum, 0 where the sum is 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in others), F.coalesce(F.col(target), F.lit(0)))
    return df.select(label, F.coalesce(F.try_divide(F.col(target).cast("double"), total), F.lit(0.0)).alias("share"))


def quartiles(df: DataFrame, column: str, *by: str) -> DataFrame:
    """What a box plot shows: ``low, q1, median, q3, high``, exact."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.min(column).alias("low"), q.alias("q"), F.max(column).alias("high"))
    return out.select(*by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def box_sample(stats: DataFrame, samples: int = 500, seed: int = 1, *keep: str) -> DataFrame:
    """Normal draws around ``mean`` and ``std`` (0.1 if there is none), held between ``min`` and ``max``: ``samples`` a row."""
    spread = F.when(F.coalesce(F.col("std"), F.lit(0.0)) == 0, F.lit(0.1)).otherwise(F.col("std"))
    drawn = stats.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("x", F.col("mean") + spread * F.randn(seed))
    return drawn.select(*keep, F.greatest("min", F.least("max", "x")).alias("x"))


def term_counts(df: DataFrame, by: str, terms: Column) -> DataFrame:
    """``by, term, n`` of an array column's elements."""
    return df.select(by, F.explode(terms).alias("term")).groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))


def random_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows at random, without repeats: those whose key hashes lowest with the seed, whatever the order of the input. Keys are distinct."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(k)


def sampled_union(df: DataFrame, key: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """The distinct rows of several random samples of k rows each, by rising key; at most k rows a seed."""
    return reduce(DataFrame.unionByName, [random_rows(df, key, k, s) for s in seeds]).dropDuplicates([key]).orderBy(key)
