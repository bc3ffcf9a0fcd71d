import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from marlstone.llm import neighbours

SCHEMA = "vec_id bigint, embeddings array<float>"


def pairs_of(rng, n, dim=64):
    base = rng.normal(size=(n, dim))
    near = base[: n // 2] + rng.normal(size=(n // 2, dim)) * 0.15
    x = np.concatenate([base, near]).astype(np.float32)
    return x[rng.permutation(len(x))] * rng.uniform(0.1, 9, size=(len(x), 1)).astype(np.float32)


def brute(x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    top = np.argsort(-s, axis=1)[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in top[i] if s[i, j] >= least}


def test_recall_over_cells_and_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 500)
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 300)
    monkeypatch.setattr(neighbours, "BLOCK_SHARDS", 1)
    x = pairs_of(np.random.default_rng(1), 1_500)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], SCHEMA).withColumn("cell", F.lit("clash"))
    close = {(r[0], r[1]) for r in neighbours.nearest(df, "vec_id", "embeddings", 10, 0.9).collect()}
    want = brute(x, 10, 0.9)
    assert close <= want and len(close) >= 0.97 * len(want) > 0
    every = {(r[0], r[1]) for r in neighbours.nearest(df, "vec_id", "embeddings", 10).collect()}
    assert len(every & brute(x, 10, -1)) >= 0.9 * 10 * len(x)
    mutual = neighbours.mutual_pairs(neighbours.nearest(df, "vec_id", "embeddings", 10, 0.9), "vec_id")
    assert mutual.where("a >= b").count() == 0


def test_graph_search_is_near_exact():
    x = pairs_of(np.random.default_rng(2), 2_000)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids, _ = neighbours.search_shard(u, np.arange(len(u)), u, 10, neighbours.Graph())
    want = brute(x, 10, -1)
    assert len({(i, int(j)) for i in range(len(u)) for j in ids[i]} & want) >= 0.9 * len(want)


def test_unusable_and_copies(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=64), rng.normal(size=64)
    vec = lambda v: [float(t) for t in v]
    near = vec(a + rng.normal(size=64) * 0.05)
    data = [(1, None), (2, []), (3, [1.0] * 63), (4, [0.0] * 64), (5, [float("nan")] * 64), (6, [float("inf")] * 64), (7, [None] * 64), (None, vec(a))]
    data += [(i, vec(a)) for i in range(100, 130)] + [(200, near), (300, vec(b))]
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in neighbours.nearest(df, "vec_id", "embeddings", 3, 0.9).collect():
        got.setdefault(r["vec_id"], []).append(r["other"])
    assert set(got) == {*range(100, 130), 200}
    assert sorted(got[100]) == [101, 102, 103] and sorted(got[129]) == [100, 101, 102] and sorted(got[200]) == [100, 101, 102]
    assert rows(neighbours.nearest(df.limit(0), "vec_id", "embeddings")) == []
    few = spark.createDataFrame([(1, vec(a)), (2, vec(a))], SCHEMA)
    assert rows(neighbours.nearest(few, "vec_id", "embeddings"), "vec_id", "other") == [(1, 2), (2, 1)]
    assert rows(neighbours.nearest(few.limit(1), "vec_id", "embeddings")) == []
