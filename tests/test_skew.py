import random

from conftest import rows
from pyspark.sql import functions as F

from marlstone.operators import skew


def test_number_in_key(spark, tmp_path):
    keys = ["hot"] * 900 + [None] * 40 + [f"k{i % 30}" for i in range(300)]
    random.Random(1).shuffle(keys)
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int").repartition(7).write.parquet(path)
    df = spark.read.parquet(path)
    for size in (1, 64, 10_000):
        got = skew.number_in_key(df, ["k"], size).collect()
        places = {}
        for r in got:
            places.setdefault(r["k"], []).append((r["place"], r["chunk"]))
        assert len(got) == len(keys)
        for k, seen in places.items():
            assert sorted(p for p, _ in seen) == list(range(keys.count(k)))
            assert all(c == p // size for p, c in seen)


def test_chunked_aggregate_equals_group_by(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "t")
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(50)])) for _ in range(2_000)]
    spark.createDataFrame(data, "k string, v int").repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    states = [skew.State("total", F.sum("v"), F.sum), skew.State("top", F.max("v"), F.max)]
    got = rows(skew.chunked_aggregate(df, ["k"], states, 100), "k", "n_rows", "total", "top")
    assert got == rows(df.groupBy("k").agg(F.count(F.lit(1)), F.sum("v"), F.max("v")))


def test_top_votes(spark, tmp_path):
    def many(key, load, pairs):
        return [(key, load, i, v) for i, v in pairs]

    data = many("b0-abcdefgh ", 0, [(i, i % 3) for i in range(9)]) + many("B0ABCDEFGH", 0, [(3, 2), (None, 99)])  # spelled apart, ties, a null id
    data += many("B0ABCDEFGH", 1, [(i, 5) for i in range(9)])  # too few
    data += many("B0ZZZZZZZZ", 0, [(i, v) for i, v in enumerate([None, -1, 2_000_000] * 4)])  # none can win
    data += many("B0YYYYYYYY", 2, [(7, 1_000_000), (7, 1_000_000), *[(50 + i, 0) for i in range(8)]])  # repeated rows count
    data += many("short", 0, [(i, 1) for i in range(20)]) + many(None, 0, [(i, 1) for i in range(20)]) + many("  ", 0, [(i, 1) for i in range(20)])
    path = str(tmp_path / "t")
    spark.createDataFrame(data, "parent_asin string, load_no int, review_id bigint, helpful_vote int").withColumn("place", F.lit("clash")).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    for size in (2, 1_000):
        got = rows(skew.top_votes(df, size), "parent_asin", "load_no", "review_id", "votes")
        assert got == [("B0ABCDEFGH", 0, 2, 2), ("B0YYYYYYYY", 2, 7, 1_000_000)]
    assert skew.top_votes(df.limit(0)).count() == 0


def test_runs_across_chunks(spark):
    data = [("a", t) for t in (1, 2, 50, 51, 400, 401)] + [("b", 5), ("c", None), ("c", 1), ("c", 4)]
    df = spark.createDataFrame(data, "k string, t bigint")
    for size in (1, 2, 100):
        assert rows(skew.chunk_runs(df, ["k"], "t", size)) == [("a", 6, 1, 401, 349), ("b", 1, 5, 5, None), ("c", 3, 1, 4, 3)]


def test_runs_over_many_ranges(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", rng.randint(0, 10**6)) for _ in range(5_000)]
    df = spark.createDataFrame(data, "k string, t bigint").repartition(9)
    want = {}
    for k in {k for k, _ in data}:
        t = sorted(x for key, x in data if key == k)
        want[k] = (k, len(t), t[0], t[-1], max(b - a for a, b in zip(t, t[1:], strict=False)))
    assert {r[0]: tuple(r) for r in skew.chunk_runs(df, ["k"], "t", 100).collect()} == want
