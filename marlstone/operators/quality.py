"""Column profiles per load, with column expressions induced by minimum description length.

Rows are first reduced to distinct values with a count per load; everything after that works on distinct values. Each
value has a chain of ever more general expressions. Expressions form a tree, and the cheapest cut through it, measured in
bits for the expressions plus bits for the values under them, is found bottom-up by one aggregation per level. A cut never
puts conforming and violating values under one expression, so the rows that violate are those under expressions that do.
The rows an expression covers in each load are compared with the baseline load, beside the standard aggregates.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.staging import stage

#: Bits per character of an expression's text, and per repeat whose length must be told.
EXPRESSION_BITS, REPEAT_BITS = 6.0, 4.0
#: An expression conforms if it covers this share of the baseline's values that are not missing.
CONFORMING_SHARE = 0.01
LEVELS = 6
#: Distinct numbers that one task sums up.
KS_VALUES = 100_000


@dataclass(frozen=True)
class Measured:
    """A column to profile: its name, its value as text, whether that is missing or invalid, and the number it is measured by."""

    name: str
    text: Column
    missing: Column
    invalid: Column
    measure: Column


# -- distinct values ----------------------------------------------------------------------------------------------------


def distinct_values(df: DataFrame, table_name: str, columns: Sequence[Measured], load: str = "load_no") -> DataFrame:
    """``table_name, column_name, load_no, state, value, x, n``: distinct values of each column and load, counted.

    state is missing, invalid or valid. Missing values are one row per load whatever they hold.
    """

    def of(c: Measured) -> DataFrame:
        missing = F.coalesce(c.missing, F.lit(True))
        state = F.when(missing, "missing").when(F.coalesce(c.invalid, F.lit(True)), "invalid").otherwise("valid")
        told = df.select(F.lit(table_name).alias("table_name"), F.lit(c.name).alias("column_name"), F.col(load).cast("bigint").alias("load_no"), state.alias("state"), c.text.alias("value"), c.measure.cast("double").alias("x"))
        kept = told.withColumns({"value": F.when(F.col("state") != "missing", F.col("value")), "x": F.when(F.col("state") == "valid", F.col("x"))})
        return kept.groupBy("table_name", "column_name", "load_no", "state", "value", "x").agg(F.count(F.lit(1)).alias("n"))

    return reduce(DataFrame.unionByName, [of(c) for c in columns])


# -- expressions ----------------------------------------------------------------------------------------------------------


#: Characters that stand for a class while expressions are compared; they are private use, so no text means them.
CAPITAL, SMALL, DIGIT, LETTER, SPACE, LETTERS, PHRASE, TEXT, ANY = (chr(0xE000 + i) for i in range(9))
CLASSES = {CAPITAL: "[A-Z]", SMALL: "[a-z]", DIGIT: r"\d", LETTER: r"\p{L}", SPACE: r"\s", LETTERS: r"\p{L}", PHRASE: r"[\p{L}\s]", TEXT: "", ANY: "."}
#: Any number of phrases, each optional, with anything between them.
TEXT_EXPRESSION = r"(?:[\p{L}\s]*[^\p{L}\s]+)*[\p{L}\s]*"


def expression_chain(value: Column) -> dict[str, Column]:
    """``e1 .. e6``, expressions from narrow to wide that match the value, and ``b1 .. b6``, its bits under each.

    1 counted runs of capitals, small letters, digits, other letters and space, punctuation as it is; 2 the same, not
    counted; 3 letters in one class; 4 letters and spaces in one class; 5 phrases in any number with anything between
    them, where there is a phrase; 6 anything. Expressions are held with one character per class; see as_regex.
    """
    marked = mark_classes(value)
    steps = widen(marked)
    count = lambda e, marks: (F.length(e) - F.length(F.translate(e, marks, ""))).cast("double")
    long, small, digits = F.length(value).cast("double"), count(marked, CAPITAL + SMALL), count(marked, DIGIT)
    other, blank = count(marked, LETTER), count(marked, SPACE)
    fixed = small * 4.7 + digits * 3.3 + other * 7.0
    runs, letters, phrases = (steps[f"e{i}"] for i in (2, 3, 4))
    b4 = fixed + small + 5.0 * blank + REPEAT_BITS * count(phrases, PHRASE + DIGIT)
    return steps | {
        "b1": fixed, "b2": fixed + REPEAT_BITS * count(runs, CAPITAL + SMALL + DIGIT + LETTER + SPACE), "b3": fixed + small + REPEAT_BITS * count(letters, LETTERS + DIGIT + SPACE),
        "b4": b4, "b5": F.when(steps["e5"] == TEXT, b4 + 8.0 * (long - small - digits - other - blank)).otherwise(b4), "b6": long * 8.0 + REPEAT_BITS,
    }


def mark_classes(value: Column) -> Column:
    """The text with a class's mark for every letter, digit and space; texts of plain characters need a single pass."""
    plain = {string.ascii_uppercase: CAPITAL, string.ascii_lowercase: SMALL, string.digits: DIGIT, " \t\n\r\f\v": SPACE}
    own = "".join(CLASSES)
    quick = F.translate(value, own + "".join(plain), "?" * len(own) + "".join(mark * len(chars) for chars, mark in plain.items()))
    full = quick
    for pattern, mark in ((r"\p{Nd}", DIGIT), (r"\p{L}", LETTER)):
        full = F.regexp_replace(full, pattern, mark)
    return F.when(value.rlike(r"[^\x00-\x7f]"), full).otherwise(quick)


def widen(marked: Column) -> dict[str, Column]:
    """``e1 .. e6`` from marked text, each from the one before."""
    runs = F.regexp_replace(marked, f"([{CAPITAL}-{SPACE}])\\1+", "$1")
    letters = F.regexp_replace(runs, f"[{CAPITAL}{SMALL}{LETTER}]+", LETTERS)
    phrases = F.regexp_replace(letters, f"[{LETTERS}{SPACE}]+", PHRASE)
    return {"e1": marked, "e2": runs, "e3": letters, "e4": phrases, "e5": F.when(phrases.contains(PHRASE), TEXT).otherwise(phrases), "e6": F.lit(ANY)}


def as_regex(held: Column, counted: Column) -> Column:
    """The regular expression that an expression held as text stands for; counted runs become class{n}."""
    plain = F.regexp_replace(held, r"([\\.\[\](){}?+*|^$])", r"\\$1")
    lookup = F.create_map(*[F.lit(x) for m, c in CLASSES.items() for x in (m, c)])
    pieces = F.regexp_extract_all(plain, F.lit(f"([{CAPITAL}-{ANY}])\\1*|[^{CAPITAL}-{ANY}]+"), 0)
    repeat = lambda p: F.when(counted, F.concat(F.lit("{"), F.length(p).cast("string"), F.lit("}"))).otherwise(F.lit("+"))
    spelt = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.concat(F.try_element_at(lookup, F.substring(p, 1, 1)), repeat(p)), p)), "")
    return F.when(held == TEXT, TEXT_EXPRESSION).otherwise(spelt)


def hashed_chain(values: DataFrame) -> DataFrame:
    """``values`` with its chain, ``h1 .. h6`` (the expressions as hashes) and ``c1 .. c6`` (the bits of their texts)."""
    chain = expression_chain(F.col("value"))
    held = values.withColumns(chain)
    more = {f"h{i}": F.xxhash64(f"e{i}") for i in range(1, LEVELS + 1)} | {f"c{i}": F.length(f"e{i}") * EXPRESSION_BITS for i in range(1, LEVELS + 1)}
    return held.withColumns(more)


def cut_tree(values: DataFrame) -> DataFrame:
    """``column_name, h1, level``: the level at which the cheapest cut meets the chain that starts with expression h1.

    ``values`` has one row per ``column_name`` and distinct ``value``, nulls excluded, and ``bad``, whether it violates.
    Bottom-up, a level keeps what its own expression costs for all values under it or what the level below costs,
    whichever is less; an expression over values of both kinds of ``bad`` is not to be had. Level 0 is every value by
    itself. The cut is the uppermost expression kept. Ties go to the wider expression.
    """
    at = hashed_chain(values).withColumns({"below": F.length("value") * EXPRESSION_BITS, "lo": F.col("bad"), "hi": F.col("bad")})
    kept: list[DataFrame] = []
    for i in range(1, LEVELS + 1):
        rest = range(i, LEVELS + 1)
        sums = [F.sum(f"b{j}").alias(f"b{j}") for j in rest] + [F.max(f"c{j}").alias(f"c{j}") for j in rest]
        at = at.groupBy("column_name", *[f"h{j}" for j in rest]).agg(*sums, F.sum("below").alias("below"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        at = stage(at, f"level{i}")
        own = F.when(F.col("lo") == F.col("hi"), F.col(f"b{i}") + F.col(f"c{i}")).otherwise(float("inf"))
        at = at.withColumns({f"t{i}": own <= F.col("below"), "below": F.least(own, "below")})
        kept.append(at.select("column_name", *[f"h{j}" for j in rest], f"t{i}"))
        at = at.drop(f"t{i}")
    out = kept[0]
    for i in range(2, LEVELS + 1):
        out = out.join(kept[i - 1], ["column_name", *[f"h{j}" for j in range(i, LEVELS + 1)]])
    return out.select("column_name", "h1", F.coalesce(*[F.when(F.col(f"t{i}"), F.lit(i)) for i in range(LEVELS, 0, -1)], F.lit(0)).alias("level"))


def induce(values: DataFrame) -> DataFrame:
    """``values`` (``column_name``, ``value``, ``bad`` and any others, distinct or counted) with the ``level`` and ``expression`` each falls under.

    Expressions come from all distinct values of a column; no expression has values of both kinds of ``bad``, which is a
    matter of the value alone. Null values and an empty table give no row.
    """
    known = values.where(F.col("value").isNotNull() & F.col("column_name").isNotNull())
    cuts = cut_tree(known.select("column_name", "value", "bad").distinct())
    marked = known.withColumn("e1", mark_classes(F.col("value"))).withColumn("h1", F.xxhash64("e1"))
    steps = widen(F.col("e1"))  # only the one of the value's level is worked out
    picked = marked.join(cuts, ["column_name", "h1"]).withColumn("held", F.coalesce(*[F.when(F.col("level") == i, steps[f"e{i}"]) for i in range(1, LEVELS + 1)], F.col("value")))
    return picked.select(*values.columns, "level", as_regex(F.col("held"), F.col("level") == 1).alias("expression"))


# -- the profile ----------------------------------------------------------------------------------------------------------


def largest_shift(valid: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, load_no, shift``: largest difference to load 0 of the shares of values up to x, over all x.

    A running sum over distinct x, made in two steps so that no task holds a column: x is parted into buckets of about
    equally many distinct values, bucket sums are summed up, and each bucket is summed up within itself.
    """
    base = totals.where((F.col("load_no") == 0) & (F.col("valid") > 0)).select(*keys, F.col("valid").alias("of_0"))
    later = totals.where((F.col("load_no") != 0) & (F.col("valid") > 0)).join(base, list(keys), "left_semi").select(*keys, "load_no", F.col("valid").alias("of"))
    own = valid.where("load_no != 0").join(later, [*keys, "load_no"]).select(*keys, "load_no", "x", (F.col("n") / F.col("of")).alias("w"))
    first = valid.where("load_no = 0").drop("load_no").join(base, list(keys)).join(later.drop("of"), list(keys)).select(*keys, "load_no", "x", (-F.col("n") / F.col("of_0")).alias("w"))
    steps = own.unionByName(first).groupBy(*keys, "load_no", "x").agg(F.sum("w").alias("w"))
    distinct = valid.select(*keys, "x").distinct()
    most = distinct.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    buckets = -(-most // KS_VALUES) + 1
    marks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = distinct.groupBy(*keys).agg(F.percentile_approx("x", marks, 50 * buckets).alias("edges"))
    placed = steps.join(edges, list(keys)).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("x")))).drop("edges")
    sums = placed.groupBy(*keys, "load_no", "bucket").agg(F.sum("w").alias("s"))
    before = Window.partitionBy(*keys, "load_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "load_no", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("before"))
    within = F.sum("w").over(Window.partitionBy(*keys, "load_no", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    run = placed.withColumn("run", within).join(offsets, [*keys, "load_no", "bucket"])
    return run.groupBy(*keys, "load_no").agg(F.max(F.abs(F.col("run") + F.col("before"))).alias("shift"))


def profile(values: DataFrame) -> DataFrame:
    """One row per table, column and load from ``distinct_values`` output:

    ``n_rows, missing, invalid, distinct_values, low, high, dominant, shift, nonconforming, expression_shift``, with the
    baseline's shares beside them as ``missing_0, invalid_0, dominant_0``.

    missing is a share of all rows, invalid of rows not missing, dominant of valid rows; a share of none is null. invalid
    is the share of the rows that violating expressions cover, valid rows are those under the others.
    nonconforming is the share of rows not missing under expressions that cover less than CONFORMING_SHARE of load 0;
    expression_shift is half the summed differences of coverage. Load 0 is the baseline; without it nothing is compared.
    """
    keys = ["table_name", "column_name"]
    values = stage(values, "values")
    told = values.where("state != 'missing'").withColumns({"value_of": F.col("column_name"), "column_name": F.concat_ws(".", *keys), "bad": F.col("state") == "invalid"})
    under = induce(told).withColumn("column_name", F.col("value_of"))
    # an expression violates as its values do; the rows it covers are its rows of each load
    cover = stage(under.groupBy(*keys, "load_no", "level", "expression").agg(F.sum("n").alias("n"), F.max("bad").alias("bad"), F.max("n").alias("top"), F.count(F.lit(1)).alias("values")), "cover")
    spread = cover.groupBy(*keys, "load_no").agg(
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_invalid"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("valid"),
        F.max(F.when(~F.col("bad"), F.col("top"))).alias("top"), F.sum("values").alias("distinct_values"),
    )
    plain = values.groupBy(*keys, "load_no").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("state") == "missing", F.col("n")).otherwise(0)).alias("n_missing"), F.min("x").alias("low"), F.max("x").alias("high"))
    totals = stage(plain.join(spread, [*keys, "load_no"], "left").fillna(0, ["n_invalid", "valid", "distinct_values"]), "totals")
    by_x = values.where("state = 'valid'").groupBy(*keys, "load_no", "x").agg(F.sum("n").alias("n"))
    shift = largest_shift(by_x, totals, keys)

    all_of = totals.select(*keys, "load_no", (F.col("n_rows") - F.col("n_missing")).alias("of"))
    shares = cover.join(all_of, [*keys, "load_no"]).select(*keys, "load_no", "level", "expression", (F.col("n") / F.col("of")).alias("share"))
    base = shares.where("load_no = 0").select(*keys, "level", "expression", F.col("share").alias("share_0"))
    both = shares.join(base, [*keys, "level", "expression"], "left").fillna(0.0, ["share_0"])
    # coverage lost is as large as coverage won, so the won part is half of all differences
    drift = both.groupBy(*keys, "load_no").agg(
        F.sum(F.when(F.col("share_0") < CONFORMING_SHARE, F.col("share")).otherwise(0.0)).alias("nonconforming"),
        F.sum(F.greatest(F.col("share") - F.col("share_0"), F.lit(0.0))).alias("expression_shift"),
        F.count(F.lit(1)).alias("expressions"),
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    shares_of = totals.select(
        *keys, "load_no", "n_rows", share("n_missing", F.col("n_rows")).alias("missing"), share("n_invalid", F.col("n_rows") - F.col("n_missing")).alias("invalid"),
        "distinct_values", "low", "high", share("top", F.col("valid")).alias("dominant"),
    )
    first = shares_of.where("load_no = 0").select(*keys, *[F.col(c).alias(f"{c}_0") for c in ("missing", "invalid", "dominant")])
    return shares_of.join(first, keys, "left").join(shift, [*keys, "load_no"], "left").join(drift, [*keys, "load_no"], "left")


def issues(profiled: DataFrame, missing: float = 0.15, invalid: float = 0.05, dominant: float = 0.2, shift: float = 0.3) -> DataFrame:
    """``table_name, column_name, load_no, issue``: what of the loads after the baseline is off by more than the limits."""
    rise = lambda c: F.col(c) - F.col(f"{c}_0")
    found = F.array_compact(
        F.array(
            F.when(rise("missing") > missing, "missing"), F.when(rise("invalid") > invalid, "invalid"),
            F.when(rise("dominant") > dominant, "dominant"), F.when(F.col("shift") > shift, "shift"),
        )
    )
    return profiled.where("load_no > 0").select("table_name", "column_name", "load_no", F.explode(found).alias("issue"))


# -- the catalogue's columns ------------------------------------------------------------------------------------------------


def catalogue_values(meta_items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Distinct values of description and price of listings and of helpful_vote of reviews."""
    text, price, votes = F.col("description"), F.col("price"), F.col("helpful_vote")
    description = Measured(
        "description", F.to_json(text), ~F.coalesce(F.exists(text, lambda e: F.coalesce(F.regexp_replace(e, r"(?U)\s", "") != "", F.lit(False))), F.lit(False)),
        ~F.exists(text, lambda e: F.coalesce(e.rlike("[A-Za-z]{3}"), F.lit(False))), F.aggregate(text, F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(F.length(e), F.lit(0))),
    )
    cost = Measured("price", price.cast("string"), price.isNull(), F.isnan(price) | ~((price > 0) & (price < 100_000)), price)
    helpful = Measured("helpful_vote", votes.cast("string"), votes.isNull(), ~votes.between(0, 1_000_000), votes)
    return distinct_values(meta_items, "meta_items", [description, cost]).unionByName(distinct_values(reviews, "reviews", [helpful]))
