import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marlstone.llm import mixing


def one_by_one(weights, seats, caps):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [(w / (2 * n + 1), -i) for i, (w, n, c) in enumerate(zip(weights, out, caps)) if n < c and w > 0]
        if not open_:
            break
        out[-max(open_)[1]] += 1
    return out


def test_apportionment():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 8)
        weights = [rng.choice([0.0, 0.1, 0.25, rng.random()]) for _ in range(n)]
        caps = [rng.choice([0, 3, 50, 1000]) for _ in range(n)]
        seats = rng.choice([0, 1, 7, 200])
        got, want = mixing.sainte_lague(weights, seats, caps), one_by_one(weights, seats, caps)
        assert got == want or (sum(got) == sum(want) and len(set(weights)) < n)
    assert sum(mixing.sainte_lague([0.3, 0.7], 10**9, [10**9] * 2)) == 10**9


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, s, rng.randint(50, 400)) for i, s in enumerate(rng.choices([" Big_One", "big one", "BIG-ONE", "small", "tiny", "other", None, ""], [30, 30, 10, 10, 2, 5, 2, 2], k=6_000))]
    docs += [(None, "small", 5), (9_999_999, "small", None), (7, "big one", 100), (9_999_998, "big one", 300_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, size int").withColumn("sid", F.lit("clash"))
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.15, 2), ("absent", 0.05, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    taken, report = mixing.mix(df, targets, "doc_id", "size")
    r = {x["source"]: x.asDict() for x in report.collect()}
    assert set(r) == {"big_one", "small", "tiny", "absent"}
    assert (r["big_one"]["action"], r["small"]["action"], r["tiny"]["action"], r["absent"]["action"]) == ("cut", "repeat", "short", "short")
    t = {s: sum(z or 0 for k, n, z in docs if k is not None and n and n.strip().lower().replace("-", "_").replace(" ", "_") == s) for s in ("big_one", "small", "tiny")}
    assert {s: r[s]["tokens"] for s in t} == t
    used = {x["source"]: x["u"] for x in taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("u")).collect()}
    assert used == {s: r[s]["used_tokens"] for s in used}
    assert r["tiny"]["used_tokens"] == 2 * t["tiny"] and r["big_one"]["repeats"] <= 1 and r["small"]["repeats"] <= 3
    assert taken.where((F.col("source") == "big_one") & (F.col("copies") > 1)).count() == 0
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1)
    assert rows(taken) == rows(mixing.mix(df, targets, "doc_id", "size")[0])  # seeded


def test_hot_source_has_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 2_000)
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"), F.lit(20).alias("size"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    _, report = mixing.mix(df, targets, "doc_id", "size", block=100)
    r = {x["source"]: x for x in report.collect()}
    assert r["b"]["repeats"] == 4 and abs(r["a"]["actual_share"] - 0.6) < 0.02  # 16,000 of 40,000 come from b


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, size int")
    targets = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    taken, report = mixing.mix(df, targets, "doc_id", "size")
    assert taken.count() == 0 and rows(report, "source", "tokens", "action") == [("a", 0, "cut")]  # nothing is needed
    assert mixing.mix(df, targets.limit(0), "doc_id", "size")[1].count() == 0
