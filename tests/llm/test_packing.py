import random

from conftest import rows
from pyspark.sql import functions as F

from marlstone.llm import packing


def test_best_fit_is_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        capacity, limit = rng.choice([10, 37, 100]), rng.choice([1, 3, 8])
        bins, naive, used = packing.BestFit(capacity, limit), {}, {}
        for _ in range(300):
            size = rng.randint(0, capacity)
            number = bins.put(size)
            used[number] = used.get(number, 0) + size
            fitting = {n: f for n, f in naive.items() if f >= size}
            if fitting:
                assert number in fitting and naive[number] == min(fitting.values())
            else:
                assert number not in naive
                if len(naive) >= limit:
                    least = min(naive.values())
                    gone = [n for n, f in naive.items() if f == least and n not in {x for v in bins.at.values() for x in v}]
                    del naive[gone[0]]
                naive[number] = capacity
            naive[number] -= size
            if naive[number] == 0:
                del naive[number]
            assert len(naive) <= limit and max(used.values()) <= capacity
            assert sorted(naive.values()) == sorted(f for f, ns in bins.at.items() for _ in ns)


def test_pack(spark):
    rng = random.Random(2)
    sizes = [(2**60 + i, rng.randint(1, 300)) for i in range(3_000)] + [(1, 1024), (2, 1025), (3, 5000), (4, 0), (5, None), (6, -3), (7, 2048), (8, 10), (8, 10)]
    df = spark.createDataFrame(sizes, "doc_id bigint, size int").withColumn("tokens", F.lit("clash")).repartition(3)
    got = packing.pack(df, "doc_id", "size", open_bins=16).cache()
    assert got.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= 1024
    total = sum(max(0, s or 0) for _, s in sizes)
    report = packing.fill_report(got).first()
    assert report["tokens"] == total and report["fill"] > 0.97
    by = {k: [tuple(r) for r in got.where(F.col("doc_id") == k).orderBy("piece").select("piece", "n_pieces", "tokens").collect()] for k in range(1, 9)}
    assert by[1] == [(0, 1, 1024)] and by[2] == [(0, 2, 1024), (1, 2, 1)] and [t for _, _, t in by[3]] == [1024] * 4 + [904]
    assert by[4] == by[5] == by[6] == [(0, 1, 0)] and by[7] == [(0, 2, 1024), (1, 2, 1024)] and by[8] == [(0, 1, 10)] * 2
    assert got.select("doc_id").distinct().count() == len({k for k, _ in sizes})
    assert rows(packing.pack(df.limit(0), "doc_id", "size")) == []
    text = spark.createDataFrame([("a", 5), (None, 6)], "k string, n int")
    assert rows(packing.pack(text, "k", "n"), "k", "tokens") == [(None, 6), ("a", 5)]
