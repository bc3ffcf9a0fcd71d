import pytest
from conftest import rows
from pyspark.sql import functions as F

from marlstone.operators import profile, rank


@pytest.fixture(scope="module")
def items(spark):
    data = [("a", ["x"], 1), ("b", [], 2), (None, None, None), ("a", [None], 5), ("c", ["y", "z"], 5)]
    return spark.createDataFrame(data, "k string, arr array<string>, n int")


def test_nulls_and_empties(items):
    assert rows(profile.null_profile(items)) == [("arr", 1, 4, 5), ("k", 1, 4, 5), ("n", 1, 4, 5)]
    assert rows(profile.empty_profile(items, ["arr"])) == [("arr", 2, 3, 5)]
    empty = items.limit(0)
    assert rows(profile.null_profile(empty, ["k"])) == [("k", 0, 0, 0)]
    assert profile.row_count(empty).first()[0] == 0


def test_distinct_counts_null(items):
    assert profile.distinct_count(items, "k").first()[0] == 4


def test_histogram(spark):
    ints = spark.range(11).select(F.col("id").alias("x"))
    open_ = rows(profile.histogram(ints, "x", 10))
    assert len(open_) == 11 and (10, 10.5, 1) in open_
    closed = rows(profile.histogram(ints, "x", 10, last_closed=True))
    assert len(closed) == 10 and (9, 9.5, 2) in closed
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert rows(profile.histogram(same, "x", 5)) == [(None, None, 2)]
    assert rows(profile.histogram(same.where("x is null"), "x", 5)) == []
    odd = spark.createDataFrame([(0.0,), (float("nan"),), (4.0,), (4.0,)], "x double")
    assert rows(profile.histogram(odd, "x", 2, last_closed=True)) == [(0, 1.0, 1), (1, 3.0, 2)]


def test_tops_and_percents(items):
    assert [tuple(r) for r in profile.top_values(items, "k", 2).collect()] == [("a", 2), (None, 1)]
    counts = items.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert sum(r["pct"] for r in profile.percent_of_whole(counts).collect()) == pytest.approx(100)
    top = profile.percent_of_top(counts, "k", "n", 2).collect()
    assert [(r["k"], round(r["pct_of_topk"], 3)) for r in top] == [("a", 66.667), (None, 33.333)]


def test_describe_focus_and_boxes(spark, items):
    one = spark.createDataFrame([(4.0,)], "x double")
    assert tuple(profile.describe(one, "x").first()) == (4.0, 4.0, 4.0, None)
    shares = spark.createDataFrame([("r", 1, 3), ("z", 0, 0), ("n", None, 2)], "l string, a int, b int")
    assert rows(profile.focus_share(shares, "l", "a", ["b"])) == [("n", 0.0), ("r", 0.25), ("z", 0.0)]
    assert tuple(profile.quartiles(items, "n").first()) == (1, 1.75, 3.5, 5.0, 5)
    drawn = profile.box_sample(profile.describe(items, "n"), 50, 3).collect()
    assert len(drawn) == 50 and all(1 <= r["x"] <= 5 for r in drawn)
    assert profile.split_counts(spark.createDataFrame([(0,), (3,), (None,)], "s int"), F.col("s")).first() == (1, 1)
    assert profile.random_rows(spark.range(30), "id", 7, 1).distinct().count() == 7


def test_top_items_per_top_group(spark):
    data = [("g1", "x")] * 4 + [("g1", "y")] * 4 + [("g2", "x")] * 2 + [(None, "x")] * 9 + [("g3", "q")]
    df = spark.createDataFrame(data, "g string, i string")
    # the null group takes the first rank and then equals nothing
    assert rows(rank.top_items_per_top_group(df, "g", "i", 2, 1)) == [("g1", "x", 4, 1)]
    assert rank.head_per_group(df, "g", "i", 3).groupBy("g").count().agg(F.max("count")).first()[0] == 3


def test_join_dimension(spark):
    facts, dim = spark.createDataFrame([(1, 2.0), (None, 1.0)], "k int, r double"), spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, n string")
    assert rank.join_dimension(facts, dim, "k").count() == 2
    assert rank.join_dimension(facts, dim, "k", dedupe=True).count() == 1


def test_histogram_by_group(spark):
    data = [("a", float(i)) for i in range(31)] + [("b", 5.0)] * 3 + [(None, 1.0), (None, 3.0), ("a", None), ("c", None)]
    got = {(r["g"], r["bin"]): r["n"] for r in profile.histogram_by(spark.createDataFrame(data, "g string, x double"), "g", "x", 30).collect()}
    assert got == {("a", i): 1 for i in range(29)} | {("a", 29): 2, ("b", None): 3, (None, 0): 1, (None, 29): 1}
    assert profile.histogram_by(spark.createDataFrame([], "g string, x double"), "g", "x", 30).count() == 0


def test_samples_overlap_once(spark):
    df = spark.range(40)
    one = [r[0] for s in (1, 2) for r in profile.random_rows(df, "id", 15, s).collect()]
    assert [r[0] for r in profile.sampled_union(df, "id", 15, (1, 2)).collect()] == sorted(set(one)) and len(one) == 30
