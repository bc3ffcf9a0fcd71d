"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.staging import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of an edge; component is the smallest node that can be reached.

    Alternating large and small stars: every node links its larger neighbours, then its smaller ones, to the smallest
    node it sees. Rounds grow with the logarithm of the longest path. Neighbourhoods are only aggregated and joined, never
    gathered. Edges with a null end are left out, loops make a node its own component, repeats do not matter.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u").distinct()
    now = stage(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _fingerprint(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_of, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_of.select("u", F.col("m").alias("v")))
        before, now = now, stage(small.where("u != v").distinct(), "edges")
        was, mark = mark, _fingerprint(now)
        unstage(before)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.select(F.col("u").alias("node")).join(out.unionByName(roots).select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return out.unionByName(roots).unionByName(alone)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
