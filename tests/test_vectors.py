import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from marlstone.operators import cluster, models, vectors
from marlstone.operators.components import connected_components


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


def test_mean_and_projection(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), (None, [9.0, 9.0]), ("b", None), ("b", [0.0, 1.0])], "g string, v array<double>")
    assert rows(vectors.mean_vector(df, "g", "v")) == [("a", [2.0, 3.0]), ("b", [0.0, 1.0])]
    x = np.random.default_rng(0).normal(size=(50, 4)) * [5, 2, 0.1, 0.1]
    points, share = vectors.project_2d(frame(spark, x), "id", "v")
    s = np.linalg.svd(x - x.mean(0))[1] ** 2
    assert share == pytest.approx(s[:2].sum() / s.sum(), abs=1e-6)
    assert points.agg(F.avg("x")).first()[0] == pytest.approx(0, abs=1e-6)


def test_neighbour_distances(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)  # several blocks
    x = np.random.default_rng(1).normal(size=(30, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.maximum(1 - u @ u.T, 0)
    got = {r["id"]: r["distance"] for r in vectors.k_distance(frame(spark, x), "id", "v", 4).collect()}
    assert got == pytest.approx({i: np.sort(d[i])[3] for i in range(30)})
    pairs = {(r["a"], r["b"]) for r in vectors.cosine_pairs(frame(spark, x), "id", "v", 0.5).collect()}
    assert pairs == {(i, j) for i in range(30) for j in range(30) if d[i, j] <= 0.5}
    curve = [r["distance"] for r in vectors.k_distance_curve(vectors.k_distance(frame(spark, x), "id", "v", 4)).orderBy("place").collect()]
    assert curve == sorted(curve)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (3, None), (10, 9), (9, 8), (8, 11), (2, 1), *[(100 + i, 101 + i) for i in range(40)]]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a int, b int"))))
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 8, 9: 8, 10: 8, 11: 8} | {100 + i: 100 for i in range(41)}
    assert got == want
    assert rows(connected_components(spark.createDataFrame([], "a int, b int"))) == []


def test_dbscan(spark):
    turn = lambda *a: [[np.cos(t), np.sin(t)] for t in a]
    x = turn(0.0, 0.01, 0.02, 0.1, 2.0, 2.01, 2.02, 4.0)
    got = dict(rows(cluster.dbscan(frame(spark, x), "id", "v", 1 - np.cos(0.085), 3)))
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: -1}
    assert rows(cluster.label_set(cluster.dbscan(frame(spark, x), "id", "v", 1e-9, 3))) == [(-1,)]


def test_ward(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, size=(12, 3)) for c in (0, 5, 10)])
    want = [i // 12 for i in range(36)]
    assert [r[1] for r in sorted(cluster.ward(frame(spark, x), "id", "v", 3).collect())] == want
    assert cluster.ward_labels(x, 36).tolist() == list(range(36)) and set(cluster.ward_labels(x, 1)) == {0}
    # merging costs never fall, so cutting at k + 1 splits exactly one cluster of the cut at k
    for k in range(1, 8):
        a, b = cluster.ward_labels(x, k), cluster.ward_labels(x, k + 1)
        assert len(set(zip(a, b, strict=True))) == k + 1
    assert cluster.bisecting(frame(spark, x), "id", "v", 3).select("cluster").distinct().count() == 3


def test_ward_refuses_too_many_rows(spark, monkeypatch):
    monkeypatch.setattr(cluster, "WARD_ROWS", 3)
    with pytest.raises(ValueError):
        cluster.ward(frame(spark, np.eye(4)), "id", "v", 2)


def test_models(spark):
    df = spark.createDataFrame([(1, "red red kettle"), (2, ""), (3, None), (4, "the kettle and the lid")], "id int, t string")
    enc = models.encode(df, "t", models.HashingEncoder(8)).collect()
    assert all(len(r["embeddings"]) == 8 for r in enc) and np.linalg.norm(enc[0]["embeddings"]) == pytest.approx(1, abs=1e-6)
    found = {r["id"]: r["keywords"] for r in models.keywords(df, "id", "t", 3).collect()}
    assert found[1][0] == "red" and found[2] == [] and found[3] == [] and "the" not in found[4]
    out = models.extract(df, {"t": "keywords_t"}, lambda texts: [[x.split()[0]] for x in texts])
    assert [r["keywords_t"] for r in out.orderBy("id").collect()] == [["red"], [], [], ["the"]]


def test_approximate_pairs_find_most(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(20, 16)), 10, axis=0) + rng.normal(size=(200, 16)) * 0.15
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16)], "id bigint, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if 1 - u[i] @ u[j] <= 0.1}
    got = {(r["a"], r["b"]): r["distance"] for r in vectors.approximate_pairs(df, "id", "v", 0.1).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want)
    assert all(abs(d - (1 - u[a] @ u[b])) < 1e-6 for (a, b), d in got.items())
