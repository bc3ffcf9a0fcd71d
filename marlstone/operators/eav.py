"""Attribute-value rows into wide, typed tables by characteristic sets.

Entity, attribute, value rows are mapped to the wanted columns and read, and an entity keeps one cell a column. The exact
set of columns an entity fills is its signature, known from its rows alone; cells stay packed in the signature's order until
each signature has its dense table, with its own columns only and no null. The wide table is the union by name of the
dense tables, columns that a table lacks being null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import SPACE
from marlstone.sources.staging import stage

#: Dense tables put together in one plan; of more, each lot is staged, so that no plan grows with the signatures.
LOT = 32
#: Columns a wide table may have.
MOST_COLUMNS = 10_000
KINDS = {"int": "bigint", "date": "date", "bool": "boolean"}

# fixed values: seller spellings of each wanted column, as letters only
NAMES = {
    "weight_g": ("weight", "item weight", "product weight", "net weight", "gewicht", "poids", "peso"),
    "length_mm": ("length", "item length", "product length", "länge", "longueur", "longitud"),
    "power_w": ("power", "wattage", "power consumption", "leistung", "puissance", "potencia"),
    "warranty_months": ("warranty", "warranty period", "manufacturer warranty", "garantie", "garantía"),
    "piece_count": ("pieces", "piece count", "number of pieces", "anzahl teile"),
    "released_on": ("release date", "released on", "date first available", "first available on", "available since"),
    "waterproof": ("waterproof", "is waterproof", "wasserdicht"),
    "color": ("color", "colour", "farbe", "couleur"),
    "material": ("material", "material type", "matériau"),
}

# fixed values: what a seller writes where nothing is known
SAYS_NOTHING = ("", "-", "--", "?", "n/a", "n.a.", "na", "none", "null", "nan", "tbd", "tba", "unknown", "various", "see description", "not specified", "not applicable")

# fixed values: units and what one is worth in the unit of the column
UNITS = {
    "weight_g": {"g|gr|gram|grams|gramm": 1.0, "kg|kgs|kilogram|kilograms|kilo|kilos": 1000.0, "mg": 0.001, "lb|lbs|pound|pounds": 453.59237, "oz|ounce|ounces": 28.349523125},
    "length_mm": {"mm|millimeter|millimeters|millimetre|millimetres": 1.0, "cm|centimeter|centimeters|centimetre|centimetres": 10.0, "m|meter|meters|metre|metres": 1000.0, "in|inch|inches|\"|\u2033|''": 25.4, "ft|foot|feet": 304.8},
    "power_w": {"w|watt|watts": 1.0, "kw|kilowatt|kilowatts": 1000.0, "mw": 0.001},
    "warranty_months": {"mo|mos|mths|month|months|monat|monate": 1.0, "y|yr|yrs|year|years|jahr|jahre": 12.0},
    "piece_count": {"|pc|pcs|piece|pieces|pack|count|ct|teile|set": 1.0},
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


@dataclass(frozen=True)
class WideColumn:
    """A wanted column: its name, one of the types int, date, bool, string, and the names sellers give it."""

    name: str
    kind: str
    spellings: tuple[str, ...]


def wanted(catalogue: DataFrame, names: Mapping[str, Sequence[str]] = NAMES) -> list[WideColumn]:
    """The columns of a catalogue table (column_name, value_type), few by nature as each becomes a column; over MOST_COLUMNS are refused."""
    rows = catalogue.select("column_name", "value_type").where("column_name is not null").limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"a catalogue of wanted columns has at most {MOST_COLUMNS:,} rows")
    return [WideColumn(r[0], r[1] or "string", tuple(names.get(r[0], (r[0].replace("_", " "),)))) for r in sorted(rows)]


# -- names and values ---------------------------------------------------------------------------------------------------


def attribute_words(c: Column) -> Column:
    """An attribute's name as lower-case words: itemWeight, ITEM_WEIGHT and 'Item weight:' all give 'item weight'."""
    apart = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(apart), r"[^\p{L}\p{Nd}]+", " "))


def column_of(attribute: Column, columns: Sequence[WideColumn]) -> Column:
    """The wanted column an attribute belongs to, null if to none. Only whole names count: 'package length' is no length."""
    lookup = F.create_map(*[F.lit(x) for c in columns for s in c.spellings for x in (s, c.name)])
    return F.try_element_at(lookup, attribute_words(attribute))


def stated(value: Column) -> Column:
    """The value trimmed, null where it states nothing."""
    text = F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(~F.lower(text).isin(*SAYS_NOTHING), text)


def number(text: Column) -> Column:
    """A comma before exactly three digits parts thousands; any other comma is the decimal mark."""
    plain = F.regexp_replace(text, r",(?=\d{3}(?!\d))", "")
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


def unit_worths() -> Column:
    """Map of 'column unit' to what the unit is worth; unit names with their optional letters spelt out."""
    pairs = [(f"{c} {u}", f) for c, units in UNITS.items() for names, f in units.items() for u in names.split("|")]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def iso_date(low: Column) -> Column:
    """Dates as y-m-d, y/m/d, yyyymmdd, d.m.y, 'd month y' and 'month d, y', in lower case; null for any other and for days that do not exist.

    The parts are moved into the order y-m-d by patterns, a month's name being replaced by its number first.
    """
    for i, m in enumerate(MONTHS, 1):
        low = F.regexp_replace(low, f"\\b{m}[a-z]*\\.?", f"#{i:02d}")
    ymd = F.regexp_replace(low, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", "$3-$2-$1")
    ymd = F.regexp_replace(ymd, r"^(\d{1,2})\.?\s*#(\d\d),?\s*(\d{4})$", "$3-$2-$1")
    ymd = F.regexp_replace(ymd, r"^#(\d\d)\s*(\d{1,2}),?\s*(\d{4})$", "$3-$1-$2")
    ymd = F.regexp_replace(ymd, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")
    ymd = F.regexp_replace(F.regexp_replace(ymd, "[/.]", "-"), r"^(\d{4}-\d{1,2}-\d{1,2})[t ].*$", "$1")
    return F.when(ymd.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), ymd).try_cast("date")


def typed_cells(placed: DataFrame, columns: Sequence[WideColumn]) -> DataFrame:
    """``entity, ord, to, i, d, b, s``: each value of a wanted column read by the column's kind, once per row.

    Whole numbers are the value's first number times the worth of the unit after it, rounded; a number below 0 or
    without a unit that the column knows gives null.
    """
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c.name, c.kind)]) if columns else F.lit(None)
    said = placed.select("entity", "ord", "to", F.try_element_at(kinds, F.col("to")).alias("kind"), stated(F.col("value")).alias("said"))
    low = said.withColumn("low", F.lower("said"))
    digits = r"(?<![\d.,])(-?\d+(?:[.,]\d+)*|\.\d+)"
    parts = low.withColumn("number", F.when(F.col("kind") == "int", number(F.nullif(F.regexp_extract("low", digits, 1), F.lit(""))))).withColumn(
        "unit", F.when(F.col("kind") == "int", F.regexp_extract("low", digits + r"[\s\-]*([\p{L}\"'\u2033]*)", 2))
    )
    known = F.create_map(*[F.lit(x) for c in columns for x in (c.name, c.name in UNITS)]) if columns else F.lit(None)
    worth = F.when(F.try_element_at(known, F.col("to")), F.try_element_at(unit_worths(), F.concat_ws(" ", "to", "unit"))).otherwise(F.lit(1.0))
    whole = parts.withColumn("i", F.when(F.col("number") >= 0, F.round(F.col("number") * worth)).try_cast("bigint"))
    yes, no = ("yes", "y", "true", "1", "waterproof", "ja"), ("no", "n", "false", "0", "not waterproof", "nein")
    return whole.select(
        "entity", "ord", "to", "i",
        F.when(F.col("kind") == "date", iso_date(F.col("low"))).alias("d"),
        F.when(F.col("kind") == "bool", F.when(F.col("low").isin(*yes), True).when(F.col("low").isin(*no), False)).alias("b"),
        F.when(F.col("kind") == "string", F.col("low")).alias("s"),
    )


# -- the operator -------------------------------------------------------------------------------------------------------


def characteristic_rows(eav: DataFrame, columns: Sequence[WideColumn]) -> DataFrame:
    """``entity, signature, packed``: the sorted names of the columns an entity fills, and its cells as text in that order.

    Input is ``entity, attribute, value, ord``. Attributes of no wanted column and values that state nothing or cannot be read
    are left out. Of several values for a column the one of smallest ord counts. Both aggregations are partial first, so an
    entity with any number of rows is never gathered. Entities that fill nothing are kept, with an empty signature.
    """
    placed = eav.select("entity", "ord", "value", column_of(F.col("attribute"), columns).alias("to"))
    told = typed_cells(placed, columns).select("entity", "ord", "to", F.coalesce(F.col("i").cast("string"), F.col("d").cast("string"), F.col("b").cast("string"), "s").alias("cell"))
    said = F.col("to").isNotNull() & F.col("cell").isNotNull()
    one = told.select("entity", F.when(said, F.col("to")).alias("to"), "ord", "cell").groupBy("entity", "to").agg(F.min(F.when(F.col("to").isNotNull(), F.struct("ord", "cell"))).alias("first"))
    pair = F.when(F.col("to").isNotNull(), F.struct("to", F.col("first.cell").alias("cell")))
    packed = one.groupBy("entity").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return packed.select("entity", F.col("p.to").alias("signature"), F.col("p.cell").alias("packed"))


def by_signature(rows: DataFrame) -> tuple[DataFrame, list[tuple[str, tuple[str, ...]]]]:
    """(rows staged and parted by ``_table``, (table, signature) of each). Signatures come to the driver, as many as there are tables."""
    named = F.md5(F.concat_ws("\u001f", "signature").cast("binary"))
    stored = stage(rows.withColumn("_table", named).hint("rebalance", "_table"), "signatures", partition_by=("_table",))
    known = stored.groupBy("_table").agg(F.first("signature").alias("signature")).collect()
    return stored, sorted((r[0], tuple(r[1])) for r in known)


def dense_table(stored: DataFrame, table: str, signature: Sequence[str], columns: Sequence[WideColumn]) -> DataFrame:
    """The typed table of one signature, with its columns only; it reads its own folder."""
    kind = {c.name: KINDS.get(c.kind, "string") for c in columns}
    return stored.where(f"_table = '{table}'").selectExpr("entity", *[f"cast(packed[{i}] as {kind[c]}) as `{c}`" for i, c in enumerate(signature)])


def dense_tables(rows: DataFrame, columns: Sequence[WideColumn]) -> dict[tuple[str, ...], DataFrame]:
    """A typed table per signature of ``characteristic_rows`` output."""
    stored, known = by_signature(rows)
    return {signature: dense_table(stored, table, signature, columns) for table, signature in known}


def wide_table(eav: DataFrame, columns: Sequence[WideColumn]) -> DataFrame:
    """``entity`` and the wanted columns, typed, one row per entity that has a row in eav: the dense tables put together.

    Null attributes and values are skipped; an empty input gives an empty table with all columns.
    """
    stored, known = by_signature(characteristic_rows(eav, columns))
    lots = [known[i : i + LOT] for i in range(0, len(known), LOT)]
    tables = [united([dense_table(stored, t, s, columns) for t, s in lot]) for lot in lots[:1]] or [eav.select("entity").limit(0)]
    if len(lots) > 1:
        tables = [stage(united([dense_table(stored, t, s, columns) for t, s in lot]), "lot") for lot in lots]
    whole = united(tables)
    return whole.select("entity", *[F.col(c.name) if c.name in whole.columns else F.lit(None).cast(KINDS.get(c.kind, "string")).alias(c.name) for c in columns])


def united(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables put together by name in a tree, so that the plan's depth grows with the logarithm of their number."""
    half = len(tables) // 2
    return united(tables[:half]).unionByName(united(tables[half:]), allowMissingColumns=True) if half else tables[0]


def cells(wide: DataFrame, columns: Sequence[WideColumn]) -> DataFrame:
    """``entity, column_name, cell``: the filled cells as text."""
    pairs = F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.col(c.name).cast("string").alias("cell")) for c in columns])
    return wide.select("entity", F.inline(F.filter(pairs, lambda p: p["cell"].isNotNull())))


# -- details as attribute-value rows ------------------------------------------------------------------------------------


def detail_rows(df: DataFrame, key: str = "row_id", details: str = "details") -> DataFrame:
    """``entity, attribute, value, ord`` of JSON text: an object, an array of name-value objects, or either within a string.

    Objects of value and unit are put together as 'value unit'; any other object is a group of attributes and is opened.
    Text that is no JSON, null and other JSON give one row without attribute, so that no entity is lost.
    """
    v = F.try_parse_json(F.col(details))
    once = df.select(F.col(key).alias("entity"), F.col(details).alias("t"), F.schema_of_variant(v).alias("k"), F.try_variant_get(v, "$", "string").alias("s"))
    # JSON within a JSON string: what it holds takes the place of the text
    text = once.select("entity", F.when(F.col("k") == "STRING", F.col("s")).when(F.col("k").isNotNull(), F.col("t")).alias("t"), (F.col("k") == "STRING").alias("again"))
    sound = text.select("entity", F.when(~F.col("again") | F.try_parse_json("t").isNotNull(), F.col("t")).alias("t"))
    pair = lambda k, x: F.struct(k.alias("attribute"), x.alias("value"))
    as_map = lambda t: F.from_json(t, "map<string,string>")
    opened = lambda m: F.transform(F.map_entries(m), lambda e: pair(e["key"], e["value"]))
    listed = F.transform(
        F.from_json("t", "array<map<string,string>>"),
        lambda m: pair(F.coalesce(*[F.try_element_at(m, F.lit(x)) for x in ("name", "attribute", "k", "key")]), F.coalesce(*[F.try_element_at(m, F.lit(x)) for x in ("value", "val", "v")])),
    )
    is_object = lambda x: F.coalesce(x.startswith("{"), F.lit(False))
    has_value = lambda x: F.get_json_object(x, "$.value").isNotNull()
    top = F.when(F.ltrim("t").startswith("["), listed).otherwise(opened(as_map(F.col("t"))))
    flat = F.flatten(F.transform(top, lambda e: F.when(is_object(e["value"]) & ~has_value(e["value"]), F.coalesce(opened(as_map(e["value"])), F.array(e))).otherwise(F.array(e))))
    joined = F.transform(
        flat,
        lambda e: pair(e["attribute"], F.when(is_object(e["value"]), F.concat_ws(" ", F.get_json_object(e["value"], "$.value"), F.get_json_object(e["value"], "$.unit"))).otherwise(e["value"])),
    )
    return sound.select("entity", F.posexplode_outer(joined).alias("ord", "e")).select("entity", "e.attribute", "e.value", "ord")
