"""Clustering of vectors: by density, by Ward's criterion, and its scalable stand-in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.components import connected_components
from marlstone.operators.skew import number_in_key, ordered_ranges
from marlstone.operators.vectors import cosine_pairs
from marlstone.sources.staging import stage

#: Ward's tree needs all distances at once.
WARD_ROWS = 10_000


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 10) -> DataFrame:
    """``key, cluster`` by density under cosine distance; noise is -1.

    A point is core if min_samples points, itself among them, are within eps. Clusters are numbered from 0 by their
    smallest core; a border point goes to the lowest number next to it.
    """
    pairs = stage(cosine_pairs(df, key, vector, eps), "near")
    core = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("a"), "core")
    from_core = pairs.join(core, "a").select("a", "b")
    parts = connected_components(from_core.join(core.select(F.col("a").alias("b")), "b", "left_semi"))
    ranged = ordered_ranges(parts.select("component").distinct(), "component").withColumn("_one", F.lit(0))
    numbers = number_in_key(ranged, ["_one"], part=F.col("_range"), order=F.col("component")).select("component", F.col("place").alias("cluster"))
    cores = stage(parts.join(numbers, "component").select(F.col("node").alias("a"), "cluster"), "numbered")
    border = from_core.join(cores, "a").groupBy("b").agg(F.min("cluster").alias("c")).select(F.col("b").alias(key), "c")
    own = cores.select(F.col("a").alias(key), "cluster")
    out = df.where(F.size(vector) > 0).select(key).join(own, key, "left").join(border, key, "left")
    return out.select(key, F.coalesce("cluster", "c", F.lit(-1)).cast("int").alias("cluster"))


def ward_labels(x: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of Ward's agglomeration cut at ``clusters``, by nearest-neighbour chains; numbered by first member."""
    n = len(x)
    sizes, sq = np.ones(n), (x**2).sum(1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0) / 2
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        i, j = chain.pop(), chain.pop()
        cost, a, b = d[i, j], min(i, j), max(i, j)
        merges.append((cost, a, b))
        si, sj = sizes[i], sizes[j]
        row = ((si + sizes) * d[i] + (sj + sizes) * d[j] - sizes * cost) / (si + sj + sizes)
        row[~alive] = np.inf
        row[[a, b]] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        sizes[a], alive[b] = si + sj, False
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        up[root(b)] = root(a)
    roots = [root(i) for i in range(n)]
    order = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots], dtype=np.int32)


def ward(df: DataFrame, key: str, vector: str, clusters: int = 5) -> DataFrame:
    """``key, cluster``: exact Ward clustering of at most WARD_ROWS rows; more are refused, see bisecting().

    Clusters are numbered from 0 by their smallest key. Null and empty vectors are left out.
    """
    some = df.where(F.size(vector) > 0).select(key, F.col(vector).cast("array<double>").alias("v"))
    if some.count() > WARD_ROWS:
        raise ValueError(f"Ward clustering holds all distances of its rows: at most {WARD_ROWS:,} rows; use bisecting()")
    kind = dict(some.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(key)
        return pd.DataFrame({key: g[key].to_numpy(), "cluster": ward_labels(np.stack(g["v"].to_numpy()), clusters)})

    return some.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"`{key}` {kind}, cluster int")


def bisecting(df: DataFrame, key: str, vector: str, clusters: int = 5, seed: int = 1) -> DataFrame:
    """``key, cluster`` by bisecting k-means, for any number of rows."""
    some = df.where(F.size(vector) > 0).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BisectingKMeans(k=clusters, featuresCol="v", predictionCol="cluster", seed=seed).fit(some)
    return model.transform(some).select(key, "cluster")


def label_set(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.select(cluster).distinct()
