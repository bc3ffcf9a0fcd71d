"""The most similar vectors of every vector: a robust-pruned graph per shard, searched by beams.

Vectors are normalised and exact copies reduced to one. Shards are the cells of a coarse clustering fitted on a bounded
sample; every vector is indexed in its nearest cell, and cells that grow too large are parted by hash. Each shard builds a
directed graph: greedy searches propose neighbours, relaxed distance pruning keeps diverse edges. Every vector is then
searched for, by beam search, in the shards of all cells near it, and the best of all shards are its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources.staging import stage

#: Rows the coarse clustering is fitted on (twice as many at most), wanted rows of a cell, most rows of a shard, most cells,
#: and shards' worth of searches that one task makes.
SAMPLE_ROWS, CELL_ROWS, SHARD_ROWS, MOST_CELLS, BLOCK_SHARDS = 20_000, 6_000, 40_000, 4_096, 10
#: A cell is searched if its centroid is less similar than the nearest by at most this share of the distance of interest.
MARGIN = 0.18


@dataclass(frozen=True)
class Graph:
    """degree: edges a node is pruned to; beam: nodes held by a search; alpha: how much longer a way round may be before an edge stays.

    Links back may fill a node up to twice its degree before it is pruned again.
    """

    degree: int = 16
    beam: int = 32
    alpha: float = 1.2
    expand: int = 3


# -- the graph of a shard -----------------------------------------------------------------------------------------------


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and similarities, best first, of the beam each query ends with; -1 where the beam is not full.

    x and queries are unit rows, edges (n, degree) with -1 for none, entry (queries, entries) node numbers to start from.
    """
    n, q = len(x), len(queries)
    seen = np.full((q, n), -1, dtype=np.int16)
    ids = np.full((q, beam), -1, dtype=np.int32)
    sims = np.full((q, beam), -np.inf, dtype=np.float32)
    fresh = np.zeros((q, beam), dtype=bool)
    live, front = np.arange(q), entry
    while len(live):
        rows = live[:, None]
        known = np.maximum(front, 0)
        new = (front >= 0) & (seen[rows, known] < 0)
        column = np.broadcast_to(np.arange(front.shape[1], dtype=np.int16), front.shape)
        seen[np.broadcast_to(rows, front.shape)[new], front[new]] = column[new]
        new &= seen[rows, known] == column  # of a node that came twice one stays
        near = np.matmul(np.take(x, known, axis=0, mode="clip"), queries[live][:, :, None])[:, :, 0]
        all_ids = np.concatenate([ids[live], np.where(new, front, -1)], axis=1)
        all_sims = np.concatenate([sims[live], np.where(new, near, -np.inf)], axis=1)
        all_fresh = np.concatenate([fresh[live], new], axis=1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        now = np.take_along_axis(all_fresh, best, 1)
        score = np.where(now, sims[live], -np.inf)
        pick = np.argpartition(-score, min(expand, beam) - 1, axis=1)[:, :expand]
        open_ = np.take_along_axis(now, pick, 1)
        chosen = np.where(open_, np.take_along_axis(ids[live], pick, 1), -1)
        np.put_along_axis(now, pick, False, 1)
        fresh[live] = now
        go = open_.any(axis=1)
        live, chosen = live[go], chosen[go]
        front = np.where((chosen >= 0)[:, :, None], edges[np.maximum(chosen, 0)], -1).reshape(len(live), chosen.shape[1] * edges.shape[1])
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges (rows, degree) of the nodes ``own`` out of candidates (rows, c), -1 for none.

    The nearest candidate is kept and drops all those to which it is nearer, by the factor alpha, than the node is.
    """
    c = np.where(candidates == own[:, None], -1, candidates)
    points = x[np.maximum(c, 0)]
    sim = np.where(c >= 0, np.einsum("bcd,bd->bc", points, x[own], optimize=False), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")
    c, sim, points = np.take_along_axis(c, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(points, order[:, :, None], 1)
    away = 2 - 2 * np.where(c >= 0, sim, 1)  # squared distance to the node
    between = np.maximum(2 - 2 * np.matmul(points, points.transpose(0, 2, 1)), 0)
    alive, rows = c >= 0, np.arange(len(c))
    out = np.full((len(c), degree), -1, dtype=np.int64)
    for slot in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, slot] = c[rows, first][some]
        alive &= ~(some[:, None] & (alpha * alpha * between[rows, first] <= away))
        alive[rows, first] = False
    return out


def build_graph(x: np.ndarray, g: Graph, batch: int = 512) -> tuple[np.ndarray, int]:
    """(edges, entry node). Nodes come in batches that at most double the graph; each batch is searched, pruned and linked back."""
    n, width = len(x), 2 * g.degree
    edges = np.full((n, width), -1, dtype=np.int32)
    start = int(np.argmax(x @ x.mean(axis=0)))
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    done = min(n, width)
    first = order[:done]
    edges[first, : g.degree] = robust_prune(x, first, np.broadcast_to(first, (done, done)), g.degree, g.alpha)
    while done < n:
        own = order[done : done + min(batch, done)]
        found, _ = beam_search(x, edges, x[own], np.full((len(own), 1), start), g.beam, g.expand)
        edges[own, : g.degree] = robust_prune(x, own, found, g.degree, g.alpha)
        # links back, by target: they fill free places, and a target they would overflow is pruned from all it has
        out = edges[own, : g.degree]
        to, by = out.ravel(), np.repeat(own, g.degree)
        to, by = to[to >= 0], by[to >= 0]
        o = np.argsort(to, kind="stable")
        to, by = to[o], by[o]
        targets, at, counts = np.unique(to, return_index=True, return_counts=True)
        place, row = np.arange(len(to)) - np.repeat(at, counts), np.repeat(np.arange(len(targets)), counts)
        held = (edges[targets] >= 0).sum(axis=1)
        room = held + counts <= width
        fits = room[row]
        edges[to[fits], (held[row] + place)[fits]] = by[fits]
        tight = np.flatnonzero(~room)
        if len(tight):
            where = np.full(len(targets), -1)
            where[tight] = np.arange(len(tight))
            extra = np.full((len(tight), int(counts[tight].max())), -1, dtype=np.int64)
            extra[where[row[~fits]], place[~fits]] = by[~fits]
            for i in range(0, len(tight), batch):
                some = targets[tight[i : i + batch]]
                pruned = robust_prune(x, some, np.concatenate([edges[some], extra[i : i + batch]], axis=1), g.degree, g.alpha)
                edges[some] = -1
                edges[some, : g.degree] = pruned
        done += len(own)
    return edges, start


def search_shard(x: np.ndarray, nodes: np.ndarray, queries: np.ndarray, k: int, g: Graph, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and similarities (queries, k) of the k nearest nodes but the query's own; nodes has that number or -1."""
    width = min(k + 1, len(x))
    if len(x) <= 4 * g.degree:  # too few for a graph to leave anything out
        sims = queries @ x.T
        ids = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        sims = np.take_along_axis(sims, ids, 1)
    else:
        edges, start = build_graph(x, g)
        ids, sims = np.empty((len(queries), width), dtype=np.int64), np.empty((len(queries), width), dtype=np.float32)
        for i in range(0, len(queries), batch):
            own = nodes[i : i + batch]
            entry = np.stack([np.where(own >= 0, own, start), np.full(len(own), start)], axis=1)
            a, b = beam_search(x, edges, queries[i : i + batch], entry, max(g.beam, width), g.expand)
            ids[i : i + batch], sims[i : i + batch] = a[:, :width], b[:, :width]
    sims = np.where((ids == nodes[:, None]) | (ids < 0), -np.inf, sims)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


# -- cells --------------------------------------------------------------------------------------------------------------


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means; fewer than asked for if the sample has fewer rows."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:cells]]
    for _ in range(rounds if cells > 1 else 0):
        own = np.concatenate([np.argmax(sample[i : i + 4_096] @ centres.T, axis=1) for i in range(0, len(sample), 4_096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres).astype(np.float32)
    return centres


def usable(vector: Column, dim: int) -> Column:
    """Of the given length, all finite, not all zero."""
    low, high = F.array_min(vector), F.array_max(vector)
    finite = ~F.isnan(high) & (high < float("inf")) & (low > float("-inf")) & (F.size(F.array_compact(vector)) == F.size(vector))
    return F.coalesce((F.size(vector) == dim) & finite & ((low != 0) | (high != 0)), F.lit(False))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0, dim: int = 64, graph: Graph = Graph()) -> DataFrame:
    """``key, other, similarity``: up to k most similar other vectors of every usable vector, by cosine, at least ``least``.

    Unusable vectors (null, of another length than dim, all zero, or with a null, NaN or infinite number) are left out.
    Vectors are compared by direction. Ties go to the smaller key. Exact copies are searched for once: a copy's nearest
    are the copies of smallest keys first. Keys are distinct whole numbers. An empty table gives an empty one.

    A vector is indexed in its nearest cell and searched for in every cell whose centroid is nearly as near: the
    difference of the two similarities differs between vectors at distance r by about r / sqrt(dim) at most, so the
    margin is MARGIN * r with r the distance that ``least`` stands for.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("v")).where(F.col("key").isNotNull() & usable(F.col("v"), dim))
    classes = stage(slim.groupBy("v").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    rows = classes.count()
    step = max(1, rows // SAMPLE_ROWS)
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("v").limit(2 * SAMPLE_ROWS).toArrow().to_pandas()["v"]
    wanted = min(MOST_CELLS, -(-rows // CELL_ROWS))
    centres = spark.sparkContext.broadcast(fit_cells(_unit(sample).astype(np.float32), wanted) if len(sample) else np.zeros((1, dim), np.float32))
    margin = MARGIN * float(np.sqrt(2 - 2 * max(least, -1.0)))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"cell": (_unit(b["v"]).astype(np.float32) @ centres.value.T).argmax(axis=1)})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sims = _unit(b["v"]).astype(np.float32) @ centres.value.T
                row, cell = np.nonzero(sims >= sims.max(axis=1, keepdims=True) - margin)
                yield pd.DataFrame({"id": b["id"].to_numpy()[row], "v": b["v"].to_numpy()[row], "cell": cell, "own": sims.argmax(axis=1)[row] == cell})

    # a cell above SHARD_ROWS becomes several shards; its vectors are indexed in one of them and searched for in all,
    # dealt to blocks of searches that each build the shard's graph again
    sizes = classes.select("v").mapInPandas(homes, "cell int").groupBy("cell").count().where(F.col("count") > SHARD_ROWS)
    large = {r[0]: r[1] for r in sizes.collect()} if rows > SHARD_ROWS else {}
    per_cell = lambda most: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, n in large.items() for x in (c, -(-n // most))]), F.col("cell")), F.lit(1)) if large else F.lit(1)
    parts, blocks = per_cell(SHARD_ROWS), per_cell(SHARD_ROWS * BLOCK_SHARDS)
    asked = classes.select("id", "v").mapInPandas(place, "id bigint, v array<float>, cell int, own boolean")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)) if large else F.lit(0))
    asked = asked.withColumn("indexed", F.col("own") & (F.col("part") == F.pmod(F.xxhash64("id"), parts).cast("int")))
    asked = asked.withColumn("of", F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int"))
    block = F.explode(F.when(F.col("indexed"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("of"))) if large else F.lit(0)
    asked = asked.withColumn("block", block).withColumn("asks", F.col("block") == F.col("of")).drop("own", "of")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(group["v"])
        x32, held, ids = unit.astype(np.float32), group["indexed"].to_numpy(), group["id"].to_numpy()
        ask = np.flatnonzero(group["asks"].to_numpy())
        nodes = np.where(held, np.cumsum(held) - 1, -1)[ask]
        if not held.any() or not len(ask):
            return pd.DataFrame({"id": ids[:0], "other": ids[:0], "similarity": np.zeros(0)})
        found, sims = search_shard(x32[held], nodes, x32[ask], k, graph)
        q, slot = np.nonzero(sims >= least - 1e-4)
        at, q = np.flatnonzero(held)[found[q, slot]], ask[q]
        exact = np.einsum("ij,ij->i", unit[q], unit[at])
        keep = exact >= least
        return pd.DataFrame({"id": ids[q][keep], "other": ids[at][keep], "similarity": exact[keep]})

    found = asked.groupBy("cell", "part", "block").applyInPandas(search, "id bigint, other bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    best = found.groupBy("id", "other").agg(F.max("similarity").alias("similarity")).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return _with_copies(slim, classes, best, k).select(F.col("key").alias(key), "other", "similarity")


def _with_copies(slim: DataFrame, classes: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes as neighbours of their members. Per class the k + 1 smallest keys are kept as targets."""
    many = classes.where("n > 1")
    if many.isEmpty():
        return best.withColumnRenamed("id", "key")
    members = stage(slim.join(many, "v").select("key", "id", "n"), "members")
    place = F.row_number().over(Window.partitionBy("id").orderBy("key"))
    heads = members.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("heads"))
    inside = members.join(heads, "id").select("key", F.explode(F.slice(F.array_remove("heads", F.col("key")), 1, k)).alias("other"), F.lit(1.0).alias("similarity"))
    of_class = members.select("key", "id").unionByName(classes.where("n = 1").select(F.col("id").alias("key"), "id"))
    targets = best.join(heads.withColumnRenamed("id", "other"), "other", "left").select("id", F.explode(F.coalesce("heads", F.array("other"))).alias("other"), "similarity")
    outside = of_class.join(targets, "id").select("key", "other", "similarity")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "other"))
    return inside.unionByName(outside).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def mutual_pairs(found: DataFrame, key: str) -> DataFrame:
    """``a, b, similarity`` with a < b: pairs of which one is among the nearest of the other."""
    pair = found.select(F.least(key, "other").alias("a"), F.greatest(key, "other").alias("b"), "similarity")
    return pair.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
