"""Listings of one product: parsed attributes, blocked comparison, probabilistic linkage, clusters of links.

Titles and features are read into brand, line, model, size, colour and material, sizes in canonical units. Listings that
read the same are compared once. Pairs are formed within blocks only, agreement weights are fitted by
expectation-maximisation over the counted agreement patterns, the model number being a field like the others, and pairs
above a probability are links. Products are the components of links.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.text import SPACE, unescape_entities
from marlstone.operators.components import connected_components
from marlstone.sources.staging import stage

FIELDS = ("model", "size", "line", "brand", "colour", "material", "kind")
#: Pairs of at least this probability are links. Rounds of expectation-maximisation.
LINK_PROBABILITY, ROUNDS = 0.8, 60
#: Pairs that each class is seen in beforehand, as it starts.
PRIOR_PAIRS = 10.0
#: A word of titles is common, that is of no brand or line, if its commonest brand has less than this share of its listings.
BRAND_SHARE = 0.6
#: A word is a value of a field if this share of the listings that state it, two at least, state it as that.
STATED_SHARE = 0.5
#: Blocks of more classes than this are parted by one more field, and once more by two, for the weights; links are looked for in them whole.
BLOCK_CLASSES = 100
#: Readings of a large block that a task compares with all of it, and comparisons a task is meant to make.
TILE_LOOKS, TASK_PAIRS = 2_000, 4_000_000
#: Neighbours in a block that a numbered class is compared with, so that the weights know what different products look like.
NEIGHBOURS = 2
#: Fields that the classes of a block agree in, by kind of block; of a line only an end, of a size only its range.
BLOCK_FIELDS = {
    "bh": ("brand", "size"), "bt": ("brand", "size"), "l": ("line", "size"), "ch": ("brand", "colour"), "ct": ("brand", "colour"),
    "mh": ("brand", "material"), "mt": ("brand", "material"), "z": ("brand", "size", "colour"), "y": ("brand", "size", "material"),
}

# fixed values: what sellers write before or after a value in features
SAID_AS = {
    "brand": (r"^(?:brand:|made by|by)\s+(.+)$", r"^(.+) original$"),
    "line": (r"^(?:series|collection:?|line:|range:)\s+(.+)$", r"^from the (.+) range$"),
    "model": (r"^(?:item no\.?|ref\.?|model:?|model no\.?|art\.? no\.?)\s+(.+)$",),
    "size": (r"^(?:size:|measures|spec)\s+(.+)$", r"^(.+) in total$"),
    "colour": (r"^(?:colou?r:|comes in)\s+(.+)$",),
    "material": (r"^(?:material:|made from)\s+(.+)$", r"^(.+) body$"),
}
# fixed values: words that advertise or count and name nothing
PUFFERY = (
    "100% satisfaction", "bestseller", "best gift idea", "family favourite", "fast dispatch", "free returns", "great value", "hot deal", "limited edition", "must have", "new",
    "perfect present", "premium quality", "professional grade", "top choice", "2024 upgrade",
)
ACCESSORY = r"\b(?:accessory only|main article not included|compatible with|replacement|spare by|spare part)\b"
MODEL = r"(?<![a-z0-9])([a-z]{2,3})[ /\-]?(\d{5,10})([a-z]?)(?![a-z0-9])"
# fixed values: unit -> (dimension, worth in its smallest unit, digits after the point it is usually rounded to or -1 if exact)
UNITS = {
    "w": ("w", 1.0, -1), "watt": ("w", 1.0, -1), "watts": ("w", 1.0, -1), "kw": ("w", 1000.0, -1),
    "g": ("g", 1.0, -1), "gram": ("g", 1.0, -1), "grams": ("g", 1.0, -1), "kg": ("g", 1000.0, -1), "lb": ("g", 453.59237, 2), "lbs": ("g", 453.59237, 2), "oz": ("g", 28.349523125, 1),
    "ml": ("ml", 1.0, -1), "l": ("ml", 1000.0, -1), "litre": ("ml", 1000.0, -1), "liter": ("ml", 1000.0, -1), "cl": ("ml", 10.0, -1), "fl oz": ("ml", 29.5735295625, 1),
    "mm": ("mm", 1.0, -1), "cm": ("mm", 10.0, -1), "m": ("mm", 1000.0, -1), "in": ("mm", 25.4, 1), "inch": ("mm", 25.4, 1), "inches": ("mm", 25.4, 1), '"': ("mm", 25.4, 1),
    "pieces": ("n", 1.0, -1), "pcs": ("n", 1.0, -1), "piece": ("n", 1.0, -1), "pack": ("n", 1.0, -1), "set": ("n", 1.0, -1),
}
_UNIT = "fl\\.? ?oz|" + "|".join(sorted((u for u in UNITS if u not in ("fl oz", '"', "set")), key=len, reverse=True)) + '|"'
SIZE = rf"(?<![\w.,])(\d+(?:[.,]\d+)?)[ \-]?({_UNIT})(?![a-z0-9])"
SET_OF = r"\b(?:set|pack) of (\d+)\b"


# -- reading ------------------------------------------------------------------------------------------------------------


def _first(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def model_of(text: Column) -> Column:
    """The first model number in lower-case text, without its separator; null if there is none."""
    return F.nullif(F.concat(*[F.regexp_extract(text, MODEL, i) for i in (1, 2, 3)]), F.lit(""))


def size_of(text: Column) -> Column:
    """The first size in lower-case text as a struct of dimension, value and the error of its rounding; null if none."""
    count = F.nullif(F.regexp_extract(text, SET_OF, 1), F.lit("")).try_cast("double")
    amount = F.replace(F.nullif(F.regexp_extract(text, SIZE, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    unit = F.regexp_replace(F.regexp_extract(text, SIZE, 2), r"^fl\.? ?oz$", "fl oz")
    known = F.create_map(*[F.lit(x) for u, (d, w, e) in UNITS.items() for x in (u, f"{d} {w} {0.0 if e < 0 else 0.6 * 10.0**-e * w}")])
    parts = F.split(F.try_element_at(known, unit), " ")
    measured = F.struct(parts[0].alias("dim"), (amount * parts[1].cast("double")).alias("value"), (parts[2].cast("double") + 0.01).alias("error"))
    return F.when(amount.isNotNull() & parts.isNotNull(), measured).when(count.isNotNull(), F.struct(F.lit("n").alias("dim"), count.alias("value"), F.lit(0.01).alias("error")))


def flat_name(c: Column) -> Column:
    """Letters and digits only: 'Ka-Zehotu' and 'KAZE hotu' are one name."""
    return F.nullif(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def read_listings(items: DataFrame, key: str, row: str, title: str, features: str) -> DataFrame:
    """One row per key: ``key, model, size, line, brand, colour, material, kind`` and ``accessory``, nulls where unsaid.

    Features that name what they state come first; then the title is searched for models, sizes, and for the colours,
    materials and brands that features name. What is left of a title, common words aside, is taken as the line. Rows of a
    key add to each other, the smallest row first, rows without number last. Rows without key are left out.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(unescape_entities(c)), f"{SPACE}+", " "))
    rows = items.select(F.col(key).alias("key"), F.struct(F.col(row).isNull(), F.col(row)).alias("row"), plain(F.coalesce(F.col(title), F.lit(""))).alias("title"), F.transform(F.filter(features, lambda f: f.isNotNull()), plain).alias("said"))
    rows = rows.where("key is not null")
    told = rows.select("key", "row", F.explode_outer("said").alias("f"))
    said = told.select("key", "row", "f", *[_first(F.col("f"), p).alias(n) for n, p in SAID_AS.items()])
    firsts = [F.min_by(v, F.when(v.isNotNull(), F.col("row"))).alias(n) for n, v in (
        ("brand", flat_name(F.col("brand"))), ("line", flat_name(F.col("line"))), ("model", model_of(F.col("model"))), ("size", size_of(F.col("size"))), ("colour", F.col("colour")), ("material", F.col("material")),
    )]
    stated = said.groupBy("key").agg(*firsts, F.max(F.coalesce(F.col("f").rlike(ACCESSORY), F.lit(False))).alias("accessory"))
    stated = stage(stated, "stated")

    # values that features name, as vocabularies for titles and bare features
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("w")) for c in ("brand", "line", "colour", "material")])
    named = stated.select(F.explode(pairs).alias("p")).where("p.w is not null").groupBy("p.w", "p.c").agg(F.count(F.lit(1)).alias("n"))
    named = stage(named.withColumn("all", F.sum("n").over(Window.partitionBy("w"))).where((F.col("n") >= STATED_SHARE * F.col("all")) & (F.col("n") >= 2)), "named")

    def vocabulary(c: str) -> DataFrame:
        return named.where(F.col("c") == c).select("w")

    first_title = rows.where("title != ''").groupBy("key").agg(F.min_by("title", "row").alias("title"))
    bare = told.select("key", F.col("f").alias("w"))
    puffery = r"(?<![\p{L}\p{Nd}])(?:" + "|".join(PUFFERY) + r")(?![\p{L}\p{Nd}])"
    first_title = first_title.withColumn("title", F.regexp_replace("title", puffery, " | "))
    titled = stage(first_title.select("key", "title", model_of(F.col("title")).alias("t_model"), size_of(F.regexp_replace(F.col("title"), MODEL, " ")).alias("t_size"), F.col("title").rlike(ACCESSORY).alias("t_accessory"), F.col("title").rlike(rf"\bfor \S+.*{MODEL}").alias("t_for")), "titles")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("title"), MODEL, " "), SET_OF, " "), SIZE, " ")
    tokens = titled.select("key", F.posexplode(F.filter(F.split(rest, r"[^\p{L}\p{Nd}\-]+"), lambda w: F.length(w) > 1)).alias("at", "w"))
    words = stage(tokens.withColumn("w", F.regexp_replace("w", r"^-+|-+$", "")).where("w != ''"), "words")
    found = {}
    for c, other in (("colour", "material"), ("material", "colour")):  # a word that may be either is neither
        seen = bare.unionByName(words.select("key", "w")).join(vocabulary(c).join(vocabulary(other), "w", "left_anti"), "w")
        found[c] = seen.groupBy("key").agg(F.min("w").alias(f"t_{c}"))
    brands = vocabulary("brand")
    found["brand"] = words.join(brands, "w").groupBy("key").agg(F.min_by("w", "at").alias("t_brand"))

    # words of many brands are common; of the others those that are no brand, colour or material make up the line
    branded = words.join(stated.select("key", "brand").where("brand is not null"), "key").groupBy("w", "brand").agg(F.count(F.lit(1)).alias("n"))
    common = stage(branded.groupBy("w").agg(F.max("n").alias("top"), F.sum("n").alias("all")).where(F.col("top") < BRAND_SHARE * F.col("all")).select("w"), "common")
    known = common.unionByName(brands).unionByName(vocabulary("colour")).unionByName(vocabulary("material")).distinct()
    own = words.join(known, "w", "left_anti").where(~F.col("w").rlike(r"^\d"))
    found["line"] = own.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda p: F.regexp_replace(p["w"], "-", "")), "").alias("t_line"))

    # what is common and no colour or material says what kind of thing it is
    kinds = words.join(common, "w").join(vocabulary("colour"), "w", "left_anti").join(vocabulary("material"), "w", "left_anti").where(~F.col("w").rlike(r"\d") & (F.length("w") > 2))
    found["kind"] = kinds.groupBy("key").agg(F.sort_array(F.collect_set("w")).alias("t_kind"))

    out = stated.withColumn("kind", F.lit(None).cast("array<string>")).join(titled.drop("title"), "key", "left")
    for part in found.values():
        out = out.join(part, "key", "left")
    both = [F.coalesce(c, f"t_{c}").alias(c) for c in FIELDS]
    flag = F.coalesce(F.col("accessory"), F.lit(False)) | F.coalesce(F.col("t_accessory"), F.lit(False)) | F.coalesce(F.col("t_for"), F.lit(False))
    return out.select("key", *both, flag.alias("accessory"))


# -- comparing ------------------------------------------------------------------------------------------------------------


def listing_classes(listings: DataFrame) -> DataFrame:
    """``id, n`` and the fields: listings that read the same as one, where what they say names a product.

    Listings without a model number, and without line and size, stay single.
    """
    named = F.col("model").isNotNull() | (F.col("line").isNotNull() & F.col("size").isNotNull())
    return listings.withColumn("single", F.when(~named, F.col("key"))).groupBy(*FIELDS, "single").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n")).drop("single")


def block_keys() -> Column:
    """Blocks of a class. Sizes are parted so coarsely that equal sizes, however rounded, share one of two parts."""
    some = lambda *c: F.when(F.greatest(*[F.col(x).isNull().cast("int") for x in c], F.lit(0)) == 0, F.lit(True))
    parts = F.array(F.floor(F.col("size.value") / 8), F.floor(F.col("size.value") / 8 + 0.5) + 0.5)
    head, tail = F.substring("line", 1, 3), F.reverse(F.substring(F.reverse("line"), 1, 3))
    sized = lambda tag, *c: F.transform(parts, lambda p: F.concat_ws("|", F.lit(tag), *c, F.col("size.dim"), p.cast("string")))
    one = lambda tag, *c: F.array(F.concat_ws("|", F.lit(tag), *c))
    blocks = [
        F.when(some("brand", "line", "size"), F.concat(sized("bh", "brand", head), sized("bt", "brand", tail))),
        F.when(some("line", "size"), sized("l", "line")),
        F.when(some("brand", "line", "colour"), F.concat(one("ch", "brand", head, "colour"), one("ct", "brand", tail, "colour"))),
        F.when(some("brand", "line", "material"), F.concat(one("mh", "brand", head, "material"), one("mt", "brand", tail, "material"))),
        F.when(some("brand", "size", "colour"), sized("z", "brand", "colour")),
        F.when(some("brand", "size", "material"), sized("y", "brand", "material")),
    ]
    return F.array_distinct(F.concat(*[F.coalesce(b, F.array().cast("array<string>")) for b in blocks]))


def blocked(classes: DataFrame, most: int = BLOCK_CLASSES) -> DataFrame:
    """``id, numbered, block``: the blocks of every class.

    A block of more than ``most`` classes gives way to blocks of its classes that agree in one more field, and those to
    blocks that agree in two more, so that a block that holds a third of all classes does not pair them all. The weights
    are fitted on these; for the links ``large_block_links`` compares what this leaves out.
    """
    values = {f: F.col(f).cast("string") for f in ("line", "brand", "colour", "material")} | {"size": F.concat_ws(" ", "size.dim", F.round("size.value").cast("string")), "kind": F.array_join("kind", " ")}
    used = F.create_map(*[x for tag, fields in BLOCK_FIELDS.items() for x in (F.lit(tag), F.array(*[F.lit(f) for f in fields]))])
    own = F.try_element_at(used, F.split("block", r"\|")[0])
    said = F.filter(F.array(*[F.when(F.col(f).isNotNull() & ~F.array_contains(own, f), F.concat(F.lit(f"{f}="), v)) for f, v in values.items()]), lambda v: v.isNotNull())
    keyed = classes.withColumn("block", F.explode(block_keys()))
    now = keyed.select("id", F.col("model").isNotNull().alias("numbered"), "block", said.alias("said"), F.lit(-1).alias("at"))
    out = []
    for _ in range(2):
        now = stage(now.withColumn("block", F.xxhash64("block")), "blocks")
        large = now.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("block")
        out.append(now.join(large, "block", "left_anti"))
        more = now.join(large, "block").select("id", "numbered", "said", F.col("at").alias("from"), "block", F.posexplode("said").alias("at", "v"))
        now = more.where("at > from").select("id", "numbered", F.concat_ws("|", F.col("block").cast("string"), "v").alias("block"), "said", "at")
    out.append(now.withColumn("block", F.xxhash64("block")))
    return reduce(DataFrame.unionByName, [o.select("id", "numbered", "block") for o in out])


def candidate_pairs(classes: DataFrame, most: int = BLOCK_CLASSES) -> DataFrame:
    """``a, b`` with a < b: classes of one model, classes of one block of which one has no model number, and some neighbours.

    A numbered class is moreover paired with the next NEIGHBOURS numbered classes of each of its blocks: such pairs are
    nearly always of different products, and the weights are fitted on them as on the others.
    """
    models = classes.where("model is not null")
    by_model = models.select(F.col("id").alias("a"), "model").join(models.select(F.col("id").alias("b"), "model"), "model").where("a < b").select("a", "b")
    blocks = stage(blocked(classes, most), "blocked")
    free = blocks.where("not numbered").select(F.col("id").alias("x"), "block")
    both = free.join(blocks.select(F.col("id").alias("y"), "block"), "block").where("x != y")
    order = Window.partitionBy("block").orderBy(F.xxhash64("id", "block"), "id")
    ahead = blocks.where("numbered").select("id", F.array(*[F.lead("id", i).over(order) for i in range(1, NEIGHBOURS + 1)]).alias("y"))
    beside = ahead.select("id", F.explode("y").alias("y")).where("y is not null and id != y")
    pairs = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(beside.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")))
    return by_model.unionByName(pairs).distinct()


def agreement(fields: Sequence[str] = FIELDS) -> Column:
    """The pattern of a pair as a digit per field: 0 unsaid, 1 different, 2 equal, 3 nearly equal (line only)."""
    p, q = (lambda f: F.col(f"p.{f}")), (lambda f: F.col(f"q.{f}"))
    off = F.levenshtein(p("line"), q("line"), 2)
    close = F.abs(p("size.value") - q("size.value")) <= p("size.error") + q("size.error")
    level = {
        "size": F.when((p("size.dim") == q("size.dim")) & close, "2").otherwise("1"),
        "kind": F.when(F.arrays_overlap(p("kind"), q("kind")), "2").otherwise("1"),
        "line": F.when(off == 0, "2").when((off >= 1) & (F.length(p("line")) >= 6), "3").otherwise("1"),
    }
    digits = [F.when(p(f).isNull() | q(f).isNull(), "0").otherwise(level.get(f, F.when(p(f) == q(f), "2").otherwise("1"))) for f in fields]
    return F.concat(*digits)


def fit_linkage(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Log odds of a match for each pattern, by expectation-maximisation with fields independent within each class.

    There is a class of matches and two of others, as these come in two kinds that a single class would mix: products of one
    line that differ in size or number, and products of different lines. Unsaid fields count for no class. Shares are fitted
    from a start at which a class agrees or differs where its kind does; only that matches differ in number and size by
    misreading alone, once in ten thousand, is given, as products that differ in these are different by definition.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    digit = np.array([[int(d) for d in p] for p in patterns])
    agrees, equal, either, differs = [1.0, 0.02, 0.93, 0.05], [1.0, 0.0001, 0.9998, 0.0001], [1.0, 0.5, 0.45, 0.05], [1.0, 0.98, 0.015, 0.005]
    series = {"model": differs, "size": differs, "colour": either, "material": either}
    apart = {"model": differs, "line": differs} | {f: either for f in ("size", "brand", "colour", "material", "kind")}
    share = [np.array([kind.get(f, agrees) for f in FIELDS]) for kind in ({"model": equal, "size": equal, "line": [1.0, 0.002, 0.948, 0.05]}, series, apart)]
    start = [t.copy() for t in share]
    prior, fields = np.array([0.4, 0.3, 0.3]), np.arange(len(FIELDS))
    odds = np.zeros(len(n))
    for _ in range(rounds):
        likely = np.log(prior)[:, None] + np.array([np.log(t[fields, digit]).sum(axis=1) for t in share])
        odds = likely[0] - np.logaddexp(likely[1], likely[2])
        p = np.exp(likely - np.logaddexp(likely[0], np.logaddexp(likely[1], likely[2])))
        prior = (n * p).sum(axis=1) + PRIOR_PAIRS
        prior /= prior.sum()
        for c, (table, before, w) in enumerate(zip(share, start, n * p, strict=True)):
            for f in fields if c else [f for f in fields if FIELDS[f] not in ("model", "size")]:
                sums = np.array([w[digit[:, f] == d].sum() + PRIOR_PAIRS * before[f, d] for d in (1, 2, 3)])
                table[f, 1:] = sums / sums.sum()
    return dict(zip(patterns, (float(x) for x in odds), strict=True))


def large_block_links(classes: DataFrame, kept: dict[str, float], most: int = BLOCK_CLASSES) -> DataFrame | None:
    """``a, b, odds``: pairs of blocks of more than ``most`` classes, one of them without model number, whose pattern is kept.

    Every such pair of a block is compared, whatever else it agrees in. Classes that differ in their number alone have one
    reading, and readings are compared once: a block's are dealt to tiles, each compared with all of the block. Pairs that
    differ in a field in which no kept pattern differs are not looked at further. None if no block is large.
    """
    said = [f for f in FIELDS if f != "model"]
    look = F.xxhash64(*said, *[F.col(f).isNull() for f in said])  # a hash passes nulls over
    members = stage(classes.select("id", F.col("model").isNull().alias("free"), look.alias("look"), *said), "members")
    looks = members.groupBy("look", *said).agg(F.max("free").alias("free"), F.count(F.lit(1)).alias("n"))
    blocks = stage(looks.select("look", "free", "n", F.struct(*said).alias("p"), F.explode(block_keys()).alias("block")).withColumn("block", F.xxhash64("block")), "looks")
    large = stage(blocks.groupBy("block").agg(F.sum("n").alias("classes"), F.count(F.lit(1)).alias("looks"), F.count_if("free").alias("open")).where(F.col("classes") > most), "large")
    work = large.agg(F.sum(F.col("looks") * F.col("open"))).first()[0]
    odds = {p[1:]: x for p, x in kept.items() if p.startswith("0")}
    if not work or not odds:
        return None
    held = blocks.drop("n").join(large.select("block", F.ceil(F.col("looks") / TILE_LOOKS).alias("tiles")), "block")
    left = held.where("free").select(F.col("look").alias("a"), "p", "block", F.pmod(F.col("look"), F.col("tiles")).alias("tile"))
    right = held.select(F.col("look").alias("b"), F.col("p").alias("q"), F.col("free").alias("other"), "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"))
    tasks = min(10_000, max(left.sparkSession.sparkContext.defaultParallelism, -(-work // TASK_PAIRS)))
    both = left.repartition(tasks, "block", "tile").join(right.hint("merge"), ["block", "tile"]).where("not other or a <= b")
    for i, f in enumerate(said):
        if all(p[i] != "1" for p in odds):
            both = both.where(agreement([f]) != "1")
    table = classes.sparkSession.createDataFrame(list(odds.items()), "pattern string, odds double")
    found = stage(both.select("a", "b", agreement(said).alias("pattern")).join(F.broadcast(table), "pattern").select("a", "b", "odds").distinct(), "looks_linked")
    of = lambda side, x: members.select(F.col("look").alias(side), F.col("id").alias(x), F.col("free").alias(f"free_{x}"))
    pairs = found.join(of("a", "x"), "a").join(of("b", "y"), "b").where("(free_x or free_y) and (a != b or x < y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "odds")


def links(classes: DataFrame, least: float = LINK_PROBABILITY) -> DataFrame:
    """``a, b, odds`` of linked classes: log odds of a match of pairs whose probability is at least ``least``.

    At most 4^7 counts of patterns come to the driver; the fitted odds alone decide, over all pairs of blocks of which one
    has no model number, in large blocks as well.
    """
    body = classes.select("id", F.struct(*FIELDS).alias("p"))
    pairs = candidate_pairs(classes).join(body.withColumnRenamed("id", "a"), "a").join(body.select(F.col("id").alias("b"), F.col("p").alias("q")), "b")
    compared = stage(pairs.select("a", "b", agreement().alias("pattern")), "compared")
    counts = {r[0]: r[1] for r in compared.groupBy("pattern").count().collect()}
    # patterns that no counted pair has weigh nothing, but pairs of large blocks may have them
    every = dict.fromkeys(map("".join, product(*["0123" if f == "line" else "012" for f in FIELDS])), 0)
    odds = fit_linkage(every | counts)
    kept = {p: x for p, x in odds.items() if x >= np.log(least / (1 - least))}
    seen = {p: x for p, x in kept.items() if p in counts}
    lookup = F.create_map(*[F.lit(x) for kv in seen.items() for x in kv]) if seen else F.lit(None).cast("map<string,double>")
    linked = compared.withColumn("odds", F.try_element_at(lookup, F.col("pattern"))).where("odds is not null").select("a", "b", "odds")
    rest = large_block_links(classes, kept)
    return linked if rest is None else linked.unionByName(rest).dropDuplicates(["a", "b"])


def products(items: DataFrame, key: str = "parent_asin", row: str = "row_id", title: str = "title", features: str = "features") -> DataFrame:
    """``key, product``: listings of one product, products of at least two listings; product is the smallest key.

    Classes of one model number are joined by their links, as a number alone does not outweigh what differs. A class
    without number goes to the one such group it is linked to most surely, so that no chain joins different numbers; classes linked to no number are joined by their links. Accessories are products of their own and in no group.
    Listings without title and features, and an empty table, give nothing. Repeated rows of a key add to each other.
    """
    listings = stage(read_listings(items, key, row, title, features).where("not accessory"), "listings")
    classes = stage(listing_classes(listings), "classes")
    linked = stage(links(classes), "links")
    around = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"), "odds"))
    # a number's classes are parted where no links hold them together; model is then the first class of such a part
    numbered = classes.where("model is not null").select("id")
    among = linked.join(numbered.withColumnRenamed("id", "a"), "a").join(numbered.withColumnRenamed("id", "b"), "b").select("a", "b")
    loops = numbered.select(F.col("id").alias("a"), F.col("id").alias("b"))
    number = stage(connected_components(among.unionByName(loops)).select(F.col("node").alias("b"), F.col("component").alias("model")), "number")
    unnumbered = classes.where("model is null").select(F.col("id").alias("a"))
    near = stage(around.join(unnumbered, "a"), "near")

    def settle(known: DataFrame) -> DataFrame:
        best = near.join(known, "b").groupBy("a", "model").agg(F.max("odds").alias("odds"), F.count(F.lit(1)).alias("votes"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("odds"), F.desc("votes"), "model"))
        return best.withColumn("r", rank).where("r = 1").select(F.col("a").alias("b"), "model")

    # what was settled last makes offers to the rest, until nothing more is settled; earlier offers to the rest were all refused
    settled, fresh = stage(number, "settled"), number
    while True:
        fresh = stage(settle(fresh).join(settled.select("b"), "b", "left_anti"), "fresh")
        if fresh.isEmpty():
            break
        settled = stage(settled.unionByName(fresh), "settled")
    loose = near.join(settled.select(F.col("b").alias("a")), "a", "left_anti").join(settled.select("b"), "b", "left_anti").select("a", "b")
    groups = connected_components(loose)
    of_class = settled.select(F.col("b").alias("id"), F.concat(F.lit("m:"), "model").alias("g")).unionByName(groups.select(F.col("node").alias("id"), F.concat(F.lit("c:"), "component").alias("g")))
    rest = classes.select("id").join(of_class, "id", "left_anti").withColumn("g", F.concat(F.lit("s:"), "id"))
    whole = stage(of_class.unionByName(rest), "of_class")
    # a class's listings are found again by what they say
    named = F.col("model").isNotNull() | (F.col("line").isNotNull() & F.col("size").isNotNull())
    told = F.xxhash64(*FIELDS, F.when(~named, F.col("key")))
    class_of = classes.withColumn("key", F.col("id")).withColumn("told", told).select("told", "id")
    member = listings.withColumn("told", told).select("key", "told").join(class_of, "told").join(whole, "id").select("key", "g")
    sized = member.groupBy("g").agg(F.min("key").alias("product"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return member.join(sized, "g").select(F.col("key").alias(key), "product")


def product_pairs(found: DataFrame, key: str = "parent_asin") -> DataFrame:
    """``a, b`` with a < b: pairs of listings of one product."""
    left, right = found.select("product", F.col(key).alias("a")), found.select("product", F.col(key).alias("b"))
    return left.join(right, "product").where("a < b").select("a", "b")
