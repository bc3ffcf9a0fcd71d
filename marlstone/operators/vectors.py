"""Vectors held as arrays of floats: means, projections, exact cosine neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.skew import number_in_key, ordered_ranges

#: Rows of a block when all pairs are wanted; a task compares two blocks.
BLOCK_ROWS = 4_000


def mean_vector(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, vector``: the mean of each group's vectors. Null groups and null or empty vectors are left out.

    All vectors have one length. Sums are partial, so a group of any size is never gathered.
    """
    some = df.where(F.col(group).isNotNull() & (F.size(vector) > 0))
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return some.groupBy(group).agg(vector_to_array(mean).alias(vector))


def project_2d(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, float]:
    """(``key, x, y``, share of the variance explained) by the two main axes of the centred vectors.

    Axes point so that their largest loading is positive. Null and empty vectors are left out.
    """
    some = df.where(F.size(vector) > 0).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(some).transform(some)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    sign = np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)
    point = vector_to_array("p")
    points = model.transform(centred).select(key, (point[0] * float(sign[0])).alias("x"), (point[1] * float(sign[1])).alias("y"))
    return points, float(model.explainedVariance.toArray().sum())


def _blocks(df: DataFrame, key: str, vector: str, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work(left, right)`` for every ordered pair of blocks, each with ``key`` and ``v`` (unit rows).

    Rows are dealt to a square of tasks, so each goes to as many tasks as there are blocks; the square grows with the
    rows. Exact comparison of all pairs is quadratic by nature; this keeps it spread evenly and free of joins.
    """
    some = df.where(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    side = max(1, -(-some.count() // BLOCK_ROWS))
    home = F.pmod(F.xxhash64("key"), F.lit(side)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    left = some.select("key", "v", home.alias("i"), other.alias("j"), F.lit(True).alias("left"))
    right = some.select("key", "v", home.alias("j"), other.alias("i"), F.lit(False).alias("left"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["left"]], group[~group["left"]]
        return work(a.sort_values("key"), b.sort_values("key"))

    return left.unionByName(right).groupBy("i", "j").applyInPandas(run, schema)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def cosine_pairs(df: DataFrame, key: str, vector: str, most: float) -> DataFrame:
    """``a, b, distance`` of all ordered pairs, self included, of cosine distance up to ``most``. A zero vector is at 1 from all."""
    kind = dict(df.dtypes)[key]

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        d = np.maximum(1 - _unit(a["v"]) @ _unit(b["v"]).T, 0)
        r, c = np.nonzero(d <= most)
        return pd.DataFrame({"a": a["key"].to_numpy()[r], "b": b["key"].to_numpy()[c], "distance": d[r, c]})

    return _blocks(df, key, vector, work, f"a {kind}, b {kind}, distance double")


def approximate_pairs(df: DataFrame, key: str, vector: str, most: float, tables: int = 12, width: float = 0.6, seed: int = 3) -> DataFrame:
    """``a, b, distance`` with a < b of most pairs of cosine distance up to ``most``: the way for tables too large for all pairs.

    Unit vectors are hashed by random projections into buckets of ``width``, ``tables`` times; only vectors that share a
    bucket are compared, exactly. More tables find more, a smaller width compares less. Null, empty and zero vectors are left out.
    """
    good = F.coalesce((F.size(vector) > 0) & F.exists(vector, lambda x: x != 0), F.lit(False))
    first = df.where(good).select(F.size(vector)).first()
    # conversions may be evaluated before rows are left out, so the rows that are must not trouble them
    safe = F.when(good, F.col(vector).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), first[0] if first else 1))
    some = df.where(good).select(F.col(key).alias("key"), array_to_vector(safe).alias("v"))
    unit = Normalizer(inputCol="v", outputCol="u").transform(some).select("key", "u")
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxSimilarityJoin(unit, unit, (2 * most) ** 0.5 + 1e-9, "d").where("datasetA.key < datasetB.key")
    return near.select(F.col("datasetA.key").alias("a"), F.col("datasetB.key").alias("b"), (F.col("d") * F.col("d") / 2).alias("distance"))


def k_distance(df: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """``key, distance``: cosine distance to the k-th nearest vector, the vector itself being the first."""
    kind = dict(df.dtypes)[key]

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"key": [], "distance": []})
        d = np.maximum(1 - _unit(a["v"]) @ _unit(b["v"]).T, 0)
        few = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
        return pd.DataFrame({"key": np.repeat(a["key"].to_numpy(), few.shape[1]), "distance": few.ravel()})

    near = _blocks(df, key, vector, work, f"key {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("distance"))
    return near.withColumn("r", rank).where(F.col("r") == k).select(F.col("key").alias(key), "distance")


def k_distance_curve(distances: DataFrame) -> DataFrame:
    """Distances in rising order with their place from 1, for the elbow of a density clustering; numbered without one task holding all."""
    ranged = ordered_ranges(distances, "distance").withColumn("_one", F.lit(0))
    numbered = number_in_key(ranged, ["_one"], part=F.col("_range"), order=F.col("distance"))
    return numbered.withColumn("place", (F.col("place") + 1).cast("bigint")).drop("_one", "_range", "chunk")
