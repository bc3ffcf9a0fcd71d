"""Template residue, filler, error pages and script notices: positive-unlabelled naive Bayes by expectation-maximisation.

Texts are cut into passages. A few seed patterns, a handful for each kind, name passages that are labelled; all others are
unlabelled. Naive Bayes over hashed words and word pairs starts with the labelled passages, and those that are found mostly
beside them, against all others, and expectation-maximisation then moves unlabelled passages by their
posterior. The model alone decides over passages, labelled or not, and their scores decide over records: a slot in a
passage of residue is enough, other kinds must make up most of what the record says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import SPACE, unescape_entities
from marlstone.sources.staging import stage

BUCKETS, ROUNDS, SMOOTHING = 1 << 16, 6, 0.01
#: A passage is labelled, too, if in this share of the records it shares with others, labelled passages make up this share of the others.
SEEDED_SHARE = 0.25
#: Rounds in which labels spread between passages of one record, and records a passage must share with others to be labelled so.
SPREAD_ROUNDS, LEAST_COMPANY = 3, 2
#: Weights are held within this, so that one word seen in one class only does not decide alone.
MOST_WEIGHT = 6.0

# fixed values: ways to write a slot, each with a name inside
_NAME = r"[\p{L}_][\p{L}\p{Nd}_. \-]*+"
_TIGHT = r"[\p{L}_](?:[\p{L}\p{Nd}_. \-]*[\p{L}\p{Nd}_])?"
SLOTS = (
    rf"\{{\{{\{{?\s*{_NAME}\s*\}}\}}\}}?", rf"<%=?\s*{_NAME}\s*%>", rf"\{{%\s*{_NAME}\s*%\}}", rf"\$\{{\s*{_NAME}\s*\}}", rf"\*\|\s*{_NAME}\s*\|\*", rf"%\({_NAME}\)s",
    rf"\[\[\s*{_NAME}\s*\]\]", rf"@@{_NAME}@@", r"__[\p{L}][\p{L}\p{Nd}. \-]*(?:_[\p{L}\p{Nd}. \-]+)*__", r"(?i)\[(?:insert|your)\s[^\]]+\]", r"(?i)<(?:insert|your)\s[^>]+>",
    rf"\{{\s*{_NAME}\s*\}}", rf"\[\s*{_NAME}\s*\]", rf"%{_TIGHT}%", rf"#{_TIGHT}#", rf"\${_TIGHT}\$", rf"<\s*{_NAME}\s*>",
)
#: What every slot begins with.
MARKS = r"[{<$*%\[@_#]"
#: Tags of markup that are dropped; anything else between angle brackets may be a slot.
TAGS = r"(?i)</?(?:p|br|b|i|u|em|strong|div|span|li|ul|ol|h[1-6]|a|img|table|tr|td|th|tbody|thead|hr|font|small|sup|sub)(?:\s[^>]*)?/?>"
#: What programs print for a value that is missing.
VOIDS = r"(?i)(?<![\p{L}\p{Nd}])(?:undefined|nan|null|none|\[object object\])(?![\p{L}\p{Nd}])|#ref!|#n/a|#value!"

#: Labelled passages, as few patterns as each kind needs to be known by: slots and void values by their places, then one or two
#: messages per kind and language.
SEEDS = (
    r"zslotz\b.*\bzslotz", r"zasked\b", r"zvoidz\b.*\bzvoidz", r"^\p{L}+ (?:zvoidz|zslotz)$",
    r"^(?:error|fehler|erreur) 0+\b", r"\bpage not found$", r"^access denied$", r"^internal server error\b", r"^(?:zugriff verweigert|accès refusé|acceso denegado)\b",
    r"^(?:please )?enable javascript\b", r"^checking your browser\b", r"^(?:bitte aktivieren sie|veuillez activer|active) javascript\b", r"\b(?:ohne skripte|sin scripts|les scripts soient)\b",
    r"^(?:lorem|ipsum|dolor|amet|elit)\b.*\b(?:lorem|ipsum|dolor|amet|elit)$", r"^(?:(?:xxx|asdf|test|bla)\s?){2,}$", r"^your text goes here$",
)
NAVIGATION = ("home", "shop", "search", "menu", "cart", "account", "contact", "help", "terms", "back", "to", "start", "login", "c", "imprint", "privacy")


@dataclass(frozen=True)
class Model:
    """Weight of every bucket and the prior log odds: at most BUCKETS + 1 numbers, whatever the corpus."""

    weights: np.ndarray
    prior: float


# -- passages -----------------------------------------------------------------------------------------------------------


def masked(text: Column) -> Column:
    """Lower-case words with slots, void values and digits made alike; zslotz, zasked (a slot that asks), zvoidz, 0."""
    out = text
    for i, s in enumerate(SLOTS):
        out = F.regexp_replace(out, s, " zasked zslotz " if i in (9, 10) else " zslotz ")
    out = F.when(text.rlike(MARKS), out).otherwise(text)  # most passages have no such mark and are spared all that
    out = F.regexp_replace(out, VOIDS, " zvoidz ")
    out = F.regexp_replace(F.lower(out), r"\p{Nd}+", "0")
    return F.trim(F.regexp_replace(out, r"[^\p{L}0]+", " "))


def passages(records: DataFrame, key: str, text: str) -> DataFrame:
    """``key, said``: one row per passage that has a word or slot, as masked words. Null and blank texts give none.

    Entities are decoded and tags of markup dropped; passages end at line breaks and after . ! ? before white space.
    """
    clean = F.regexp_replace(unescape_entities(text), TAGS, "\n")
    cut = F.split(clean, rf"[\r\n]+|(?<=[.!?]){SPACE}+")
    rows = records.select(F.col(key).alias("key"), F.explode(F.transform(cut, masked)).alias("said"))
    return rows.where(F.col("said") != "")


def is_navigation(said: Column) -> Column:
    words = F.split(said, " ")
    foot = said.rlike(r"^c \p{L}+$")
    return foot | ~F.exists(words, lambda w: ~w.isin(*NAVIGATION))


def is_seed(said: Column) -> Column:
    return said.rlike("|".join(f"(?:{p})" for p in SEEDS))


def features(said: Column) -> Column:
    """Hash buckets of a passage's words, word pairs, first word and length; sorted, without repeats."""
    words = F.split(said, " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit("$"))))
    length = F.concat(F.lit("#"), F.least(F.size(words), F.lit(12)).cast("string"))
    named = F.concat(words, pairs, F.array(F.concat(F.lit("^"), F.get(words, F.lit(0))), length))
    return F.array_sort(F.array_distinct(F.transform(named, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))))


def _scores(lists: pd.Series, model: Model) -> np.ndarray:
    sizes = lists.map(len).to_numpy()
    if not len(sizes):
        return np.zeros(0)
    sums = np.add.reduceat(model.weights[np.concatenate(lists.to_numpy())], np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return 1.0 / (1.0 + np.exp(-np.clip(sums + model.prior, -40, 40)))


# -- the model ------------------------------------------------------------------------------------------------------------


def fit(counted: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over ``features, labelled, n`` (distinct passages with their counts).

    Labelled passages stay in the class while the model is fitted. A round is one pass; what comes back is a sum per bucket, at most
    BUCKETS rows. Without any labelled passage nothing is in the class and every weight is 0.
    """
    spark = counted.sparkSession

    def sums(model: Model | None) -> tuple[np.ndarray, float]:
        held = spark.sparkContext.broadcast(model)

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, size = np.zeros(BUCKETS + 1), 0
            for b in batches:
                p = np.zeros(len(b)) if held.value is None else _scores(b["features"], held.value)
                p = np.where(b["labelled"], 1.0, np.where(p > 1e-4, p, 0.0)) * b["n"]
                some = np.flatnonzero(p)
                if len(some):
                    lists = b["features"].to_numpy()[some]
                    np.add.at(total, np.concatenate(lists), np.repeat(p[some], [len(x) for x in lists]))
                total[BUCKETS] += p.sum()
                size += len(b)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"bucket": at, "w": total[at]})

        rows = counted.mapInPandas(of, "bucket bigint, w double").groupBy("bucket").agg(F.sum("w").alias("w")).toArrow().to_pandas()
        out = np.zeros(BUCKETS + 1)
        out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["w"]
        held.unpersist()
        return out[:BUCKETS], float(out[BUCKETS])

    every = counted.select(F.explode("features").alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    n_all = np.zeros(BUCKETS)
    n_all[every["bucket"].to_numpy(dtype=np.int64)] = every["n"]
    size = float(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()[0])
    model: Model | None = None
    for _ in range(rounds):
        inside, n_in = sums(model)
        if n_in == 0:
            return Model(np.zeros(BUCKETS), -40.0)
        outside, n_out = np.maximum(n_all - inside, 0.0), max(size - n_in, 1.0)
        weights = np.log((inside + SMOOTHING) / (n_in + 2 * SMOOTHING)) - np.log((outside + SMOOTHING) / (n_out + 2 * SMOOTHING))
        weights[n_all == 0] = 0.0
        model = Model(np.clip(weights, -MOST_WEIGHT, MOST_WEIGHT), float(np.log(n_in / n_out)))
    return model


def flag_records(records: DataFrame, key: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """``key, slot_passages, bad_words, words, flagged``: one row per record that says anything.

    slot_passages counts passages of residue with a slot or void value. bad_words are words in passages of residue,
    words all words, navigation left out of both. A record is flagged if it has a slot passage or if bad_words are more
    than half of words. Null, blank and wordless texts have no row. Repeated keys are taken as one record. Passages are
    known by a hash of 64 bits.
    """
    spark = records.sparkSession
    size = F.size(F.split("said", " "))
    told = stage(passages(records, key, text).groupBy("key", "said").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("said")), "told")
    distinct = told.groupBy("h", "said").agg(F.sum("n").alias("n"))
    known = stage(distinct.select("h", "n", features(F.col("said")).alias("features"), size.alias("words"), is_seed(F.col("said")).alias("seed"), is_navigation(F.col("said")).alias("navigation"), F.col("said").rlike(r"\b(?:zslotz|zvoidz)\b").alias("slotted")), "passages")

    each = stage(told.select("key", "h", "n").join(known.where("not navigation").select("h", (F.col("words")).alias("size")), "h").select("key", "h", (F.col("n") * F.col("size")).alias("words")), "each")
    every = each.groupBy("key").agg(F.sum("words").alias("all"), F.count(F.lit(1)).alias("passages"))
    company = stage(each.join(every.where("passages > 1"), "key").groupBy("h").agg(F.count(F.lit(1)).alias("company")), "company")
    labels = stage(known.where("seed and not navigation").select("h", (~F.col("slotted")).alias("spreads")), "labels")
    for _ in range(SPREAD_ROUNDS):
        part = each.join(labels.where("spreads"), "h").groupBy("key").agg(F.sum("words").alias("labelled"))
        rest = each.join(part, "key").join(every, "key").join(labels.select("h", F.lit(1).alias("known")), "h", "left").where("known is null and all > words")
        inside = rest.where(F.col("labelled") >= SEEDED_SHARE * (F.col("all") - F.col("words"))).groupBy("h").agg(F.count(F.lit(1)).alias("inside"))
        new = inside.join(company, "h").where((F.col("company") >= LEAST_COMPANY) & (F.col("inside") >= SEEDED_SHARE * F.col("company")))
        labels = stage(labels.unionByName(new.select("h", F.lit(True).alias("spreads"))), "labels")
    plain = known.where("not navigation").join(labels.select("h", F.lit(True).alias("labelled")), "h", "left")
    plain = stage(plain.select("h", "n", "features", "words", "slotted", F.coalesce("labelled", F.lit(False)).alias("labelled")), "features")
    model = spark.sparkContext.broadcast(fit(plain.select("features", "labelled", "n"), rounds))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "words": b["words"], "slotted": b["slotted"], "bad": _scores(b["features"], model.value) > 0.5})

    judged = plain.select("h", "words", "slotted", "features").mapInPandas(judge, "h bigint, words int, slotted boolean, bad boolean")
    words = F.col("n") * F.col("words")
    scored = told.select("key", "h", "n").join(judged, "h", "left")
    summed = scored.groupBy("key").agg(
        F.coalesce(F.sum(F.when(F.col("bad") & F.col("slotted"), F.col("n"))), F.lit(0)).alias("slot_passages"), F.coalesce(F.sum(F.when(F.col("bad"), words)), F.lit(0)).alias("bad_words"),
        F.coalesce(F.sum(words), F.lit(0)).alias("words"),
    )
    flagged = (F.col("slot_passages") > 0) | ((F.col("bad_words") > 0) & (2 * F.col("bad_words") > F.col("words")))
    return summed.select(F.col("key").alias(key), "slot_passages", "bad_words", "words", flagged.alias("flagged"))
