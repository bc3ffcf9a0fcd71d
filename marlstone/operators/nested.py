"""Deeply nested records into related flat tables: structural-variant tables.

Every element's structure is read as a type tree, a bottom-up tree automaton gives the tree one of a few states, and the
state routes the element to a typed table of its variant. All variant tables keep the same supertype keys (row and
position) and the parent link, so that a rendition is found from its element and an element from its row.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import SPACE, unescape_entities

LABELS = ("thumb", "large", "hi_res")
VARIANTS = ("flat", "listed", "sized", "grouped")


# -- type trees -------------------------------------------------------------------------------------------------------


def parse_type(text: str) -> tuple:
    """A type string such as OBJECT<a: STRING, b: ARRAY<BIGINT>> as ('object', {...}), ('array', t) or (name,)."""
    at = 0

    def node() -> tuple:
        nonlocal at
        start = at
        while at < len(text) and text[at] not in "<>,":
            at += 1
        name = text[start:at].strip().lower()
        if at >= len(text) or text[at] != "<":
            if at < len(text) and text[at] == "," and name.startswith("decimal("):  # DECIMAL(p,s)
                at = text.index(")", at) + 1
            return (name.split("(")[0],)
        at += 1
        if name == "array":
            inner = node()
            at += 1
            return ("array", inner)
        fields = {}
        while text[at] != ">":
            if text[at] == "`":
                end = at + 1
                while text[end] != "`" or text[end + 1 : end + 2] == "`":
                    end += 1 + (text[end] == "`")
                key, at = text[at + 1 : end].replace("``", "`"), text.index(":", end) + 1
            else:
                end = text.index(":", at)
                key, at = text[at:end].strip(), end + 1
            while at < len(text) and text[at] == " ":
                at += 1
            fields[key] = node()
            while at < len(text) and text[at] in ", ":
                at += 1
        at += 1
        return ("object", fields)

    return node()


def run_automaton(tree: tuple) -> str:
    """The state a bottom-up run ends in: a leaf state, an inner state, or one of VARIANTS at the root.

    Leaf states: text, void, other. Rules of inner nodes, tried in this order:
      object with type and url                       -> tagged     array of tagged  -> tagged*
      object whose url is text                       -> place
      object with labels to text                     -> flat       array of flat    -> flat*
      object with labels to place                    -> places
      object with sizes in places                    -> media
      object with files in flat*                     -> set        array of set     -> set*
      object with renditions in tagged*              -> listed
      object with media in media                     -> sized
      object with sets in set*                       -> grouped
    Anything else ends in 'none', which no rule takes further.
    """
    if tree[0] == "array":
        inner = run_automaton(tree[1])
        return f"{inner}*" if inner in ("tagged", "flat", "set") else "none"
    if tree[0] != "object":
        return {"string": "text", "void": "void"}.get(tree[0], "other")
    states = {k: run_automaton(v) for k, v in tree[1].items()}
    leaf = ("text", "void")
    if "type" in states and states.get("url") in leaf:
        return "tagged"
    for key, takes, to in (("renditions", ("tagged*",), "listed"), ("media", ("media",), "sized"), ("sets", ("set*",), "grouped"), ("files", ("flat*",), "set"), ("sizes", ("places",), "media")):
        if states.get(key) in takes:
            return to
    labelled = [states[k] for k in LABELS if k in states]
    if labelled and all(s in ("place", "void") for s in labelled) and "place" in labelled:
        return "places"
    if any(s in leaf for s in labelled):
        return "flat"
    if states.get("url") in leaf:
        return "place"
    return "none"


@lru_cache(maxsize=65_536)
def variant_of(shape: str | None) -> str:
    if not shape:
        return "none"
    try:
        state = run_automaton(parse_type(shape))
    except (IndexError, ValueError, RecursionError):
        return "none"
    return state if state in VARIANTS else "none"


def classify_shape(shape: Column) -> Column:
    """Structural variant of each type string; equal strings are worked out once per worker."""

    def of(shapes: pd.Series) -> pd.Series:
        return shapes.map(variant_of)

    return F.pandas_udf(of, T.StringType())(shape)


# -- image records ------------------------------------------------------------------------------------------------------


def route_elements(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row per array element: ``row_id, pos, kind``, a typed struct per variant, null in all but its own, and ``raw``.

    Elements that are null, not JSON or of no known shape have kind 'none' and keep their text as raw, which is null for all
    others. JSON text within a JSON string is unwrapped once.
    """
    raw = df.select(F.col(key).alias("row_id"), F.posexplode(field).alias("pos", "raw"))
    first = raw.withColumn("v", F.try_parse_json("raw"))
    inner = F.try_parse_json(F.try_variant_get("v", "$", "string"))
    parsed = first.withColumn("v", F.when(F.schema_of_variant("v") == "STRING", inner).otherwise(F.col("v")))
    routed = parsed.withColumn("kind", classify_shape(F.schema_of_variant("v")))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    body = {
        "flat": F.struct(get("$.variant").alias("variant"), *[get(f"$.{x}").alias(x) for x in LABELS]),
        "listed": F.struct(get("$.variant").alias("variant"), get("$.renditions", "array<struct<type:string,url:string>>").alias("renditions")),
        "sized": F.struct(get("$.variant").alias("variant"), *[get(f"$.media.sizes.{x}.url").alias(x) for x in LABELS]),
        "grouped": F.struct(get("$.meta.variant").alias("variant"), get("$.sets", f"array<struct<files:array<struct<{','.join(f'{x}:string' for x in LABELS)}>>>>").alias("sets")),
    }
    return routed.select("row_id", F.col("pos").cast("bigint").alias("pos"), "kind", *[F.when(F.col("kind") == k, body[k]).alias(k) for k in VARIANTS], F.when(F.col("kind") == "none", F.col("raw")).alias("raw"))


def variant_table(routed: DataFrame, kind: str) -> DataFrame:
    """The typed table of one variant: ``row_id, pos`` and the variant's own columns; for 'none' the raw text."""
    if kind == "none":
        return routed.where("kind = 'none'").select("row_id", "pos", "raw")
    return routed.where(F.col("kind") == kind).select("row_id", "pos", f"{kind}.*")


def image_renditions(df: DataFrame, key: str = "row_id", field: str = "images") -> DataFrame:
    """``row_id, pos, label, url, parent`` of every rendition with a url that is not blank, over all variants, in one pass.

    parent is the element's variant, '' without one. Repeated elements stay apart by pos; a label that an element names
    twice gives one row, with the first url. Null and empty arrays give no row.
    """
    routed = route_elements(df, key, field)
    pair = lambda label, url: F.struct(label.alias("label"), url.alias("url"))
    flat = lambda s: F.array(*[pair(F.lit(x), s[x]) for x in LABELS])
    files = F.flatten(F.transform(F.col("grouped.sets"), lambda s: s["files"]))
    found = (
        F.when(F.col("kind") == "flat", flat(F.col("flat")))
        .when(F.col("kind") == "listed", F.transform(F.col("listed.renditions"), lambda r: pair(r["type"], r["url"])))
        .when(F.col("kind") == "sized", flat(F.col("sized")))
        .when(F.col("kind") == "grouped", F.flatten(F.transform(files, flat)))
    )
    parent = F.coalesce("flat.variant", "listed.variant", "sized.variant", "grouped.variant", F.lit(""))
    good = F.filter(found, lambda r: (F.trim(r["url"]) != "") & r["label"].isin(*LABELS))
    first = lambda label: F.get(F.filter(good, lambda r: r["label"] == label), F.lit(0))
    once = F.array(*[first(x) for x in LABELS])
    return routed.select("row_id", "pos", parent.alias("parent"), F.explode(F.filter(once, lambda r: r.isNotNull())).alias("r")).select("row_id", "pos", "r.label", "r.url", "parent")


# -- category paths -----------------------------------------------------------------------------------------------------


def category_levels(df: DataFrame, key: str = "row_id", field: str = "categories") -> DataFrame:
    """``row_id, pos, label, parent``: one row per level of a row's category path, top first.

    An element is a single name, several names parted by '>', '|' or a free-standing '/', or a JSON array of names. Names
    are trimmed, entities decoded and blank ones dropped before levels are counted from 0. parent is '' at the top.
    """
    edge = f"^{SPACE}+|{SPACE}+$"
    one = lambda e: F.when(F.trim(e).startswith("["), F.coalesce(F.from_json(e, "array<string>"), F.array(e))).otherwise(F.split(e, r"[>|]|\s/\s"))
    # entities are decoded after the split: a decoded '>' is part of a name
    names = F.flatten(F.transform(F.filter(F.col(field), lambda e: e.isNotNull()), one))
    clean = F.transform(names, lambda x: F.regexp_replace(unescape_entities(x), edge, ""))
    named = df.select(F.col(key).alias("row_id"), F.filter(clean, lambda x: x != "").alias("names"))
    linked = F.transform("names", lambda x, i: F.struct(i.cast("bigint").alias("pos"), x.alias("label"), F.when(i == 0, F.lit("")).otherwise(F.get("names", i - 1)).alias("parent")))
    return named.select("row_id", F.explode(linked).alias("l")).select("row_id", "l.*")


def nested_tables(df: DataFrame) -> DataFrame:
    """Renditions and levels of listings as one table of links: ``row_id, field, pos, label, parent``."""
    images = image_renditions(df).select("row_id", F.lit("images").alias("field"), "pos", "label", "parent")
    levels = category_levels(df).select("row_id", F.lit("categories").alias("field"), "pos", "label", "parent")
    return images.unionByName(levels)
