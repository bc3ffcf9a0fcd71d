import re
from itertools import product

from conftest import rows
from pyspark.sql import functions as F

from marlstone.operators import quality

ITEM, REVIEW = "load_no int, description array<string>, price double", "load_no int, helpful_vote int"


def found(spark, items, reviews):
    values = quality.catalogue_values(spark.createDataFrame(items, ITEM), spark.createDataFrame(reviews, REVIEW))
    return rows(quality.issues(quality.profile(values)), "column_name", "load_no", "issue")


def good_item(i, load):
    return (load, [f"Some words number {'abcdefghij'[i % 10]} and {'klmnopqrst'[i // 10 % 10]} here", "x" * (i % 40)], 1.0 + i)


def test_issues(spark):
    items = [good_item(i, k) for i in range(60) for k in (0, 1)]
    items += [(2, None if i % 3 == 0 else ["", None, "  "] if i % 3 == 1 else d, p) for i in range(60) for _, d, p in [good_item(i, 2)]]  # missing descriptions
    items += [(3, ["12 3", "no"] if i < 20 else d, float("nan") if i < 5 else -1.0 if i < 10 else p) for i in range(60) for _, d, p in [good_item(i, 3)]]  # invalid
    items += [(4, ["Details follow soon."] if i < 30 else d, 9.99 if i < 30 else p) for i in range(60) for _, d, p in [good_item(i, 4)]]  # one value dominates
    reviews = [(0, i) for i in range(100)] + [(1, i) for i in range(100)] + [(2, i + 60) for i in range(100)] + [(3, None if i < 40 else i) for i in range(100)] + [(4, -1 if i < 30 else i) for i in range(100)]
    got = found(spark, items, reviews)
    assert {("description", 2, "missing"), ("description", 3, "invalid"), ("price", 3, "invalid"), ("description", 4, "dominant"), ("price", 4, "dominant"), ("helpful_vote", 2, "shift"), ("helpful_vote", 3, "missing"), ("helpful_vote", 4, "invalid")} <= set(got)
    assert not [g for g in got if g[1] == 1]


def test_shift_is_exact(spark, monkeypatch):
    a, b = [1, 1, 2, 5, 9, 9, 30], [1, 4, 4, 5, 6, 31]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in a + b)
    df = spark.createDataFrame([(0, x) for x in a] + [(1, x) for x in b], REVIEW)
    for values in (1, 3, 100):
        monkeypatch.setattr(quality, "KS_VALUES", values)
        p = quality.profile(quality.catalogue_values(spark.createDataFrame([], ITEM), df)).where("load_no = 1").first()
        assert abs(p["shift"] - want) < 1e-9


def test_edges(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, ["abc"], 1.0)], [(1, 1)]) == []  # no baseline
    assert found(spark, [(0, None, None), (1, None, None)], [(0, None), (1, None)]) == []


def bad(value):
    return value.startswith("AB-003") or value == ""


def naive_cut(values):
    """Cheapest cut by trying every antichain of the small tree, through the same chains."""
    nodes = {}
    for v in values:
        for lvl in range(1, 7):
            nodes.setdefault((lvl, tuple(v[f"e{j}"] for j in range(lvl, 7))), []).append(v)

    def best(lvl, key):
        own = sum(v[f"b{lvl}"] for v in nodes[lvl, key]) + len(key[0]) * quality.EXPRESSION_BITS
        if len({bad(v["value"]) for v in nodes[lvl, key]}) > 1:
            own = float("inf")
        if lvl == 1:
            return min(own, sum(len(v["value"]) * quality.EXPRESSION_BITS for v in nodes[lvl, key]))
        below = {k for (n, k) in nodes if n == lvl - 1 and k[1:] == key}
        return min(own, sum(best(lvl - 1, k) for k in below))

    return sum(best(6, k) for (n, k) in nodes if n == 6)


def test_expressions(spark):
    texts = [f"{a}{b}.{c}0" for a, b, c in product("123", "45", "67")] + [f"AB-{i:04d}" for i in range(40)] + ["n/a", "Ünïcode ß", "(x)*[y]", "", "z" * 3000]
    df = spark.createDataFrame([("c", t, bad(t)) for t in texts] + [("c", None, False), (None, "q", False)], "column_name string, value string, bad boolean")
    got = {r["value"]: r for r in quality.induce(df).collect()}
    assert set(got) == set(texts)
    for t, r in got.items():
        assert re.fullmatch(r["expression"].replace(r"\p{L}\s", r"\w\s").replace(r"\p{L}\p{Nd}\s", r"\w\s").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{Nd}", r"\d"), t, re.S), (t, r["expression"])
    assert got["14.60"]["expression"] == r"\d{2}\.\d{2}"
    kinds = {}
    for t, r in got.items():
        kinds.setdefault(r["expression"], set()).add(bad(t))
    assert all(len(v) == 1 for v in kinds.values()) and got["AB-0031"]["level"] == 0 != got["14.60"]["level"]
    chain = quality.expression_chain(F.col("value"))
    plain = spark.createDataFrame([(t,) for t in texts], "value string").select("value", *[c.alias(n) for n, c in chain.items()]).collect()
    level = {t: r["level"] for t, r in got.items()}
    used = {(level[v["value"]], v[f"e{level[v['value']]}"] if level[v["value"]] else v["value"]) for v in plain}
    spent = sum(v[f"b{level[v['value']]}"] for v in plain if level[v["value"]]) + sum(len(e) * quality.EXPRESSION_BITS for _, e in used)
    assert abs(spent - naive_cut(plain)) < 1e-6


def test_invalid_is_what_violating_expressions_cover(spark, monkeypatch):
    items = [(k, ["Some words here"], p) for k, ps in ((0, [1.5, 2.5, 30.0, 0.0]), (1, [1.5, -2.0, -3.0, 200000.0])) for p in ps]
    values = quality.catalogue_values(spark.createDataFrame(items, ITEM), spark.createDataFrame([], REVIEW))
    shares = lambda: {r["load_no"]: r["invalid"] for r in quality.profile(values).where("column_name = 'price'").collect()}
    assert shares() == {0: 0.25, 1: 0.75}
    monkeypatch.setattr(quality, "induce", lambda v: v.withColumn("level", F.lit(6)).withColumn("expression", F.lit(".+")))
    assert shares() == {0: 1.0, 1: 1.0}  # without expressions nothing tells what violates


def test_many_texts_have_few_expressions(spark):
    rng = __import__("random").Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = [", ".join(" ".join(word() for _ in range(rng.randint(1, 6))).capitalize() for _ in range(rng.randint(2, 12))) + "." for _ in range(600)] + [f"{i}.99" for i in range(100)]
    df = spark.createDataFrame([("c", t, False) for t in texts], "column_name string, value string, bad boolean")
    assert quality.induce(df).select("expression").distinct().count() < 20
