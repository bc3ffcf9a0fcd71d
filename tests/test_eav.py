import datetime
import json

from conftest import rows

from marlstone.operators import eav

CATALOGUE = [("weight_g", "int", "g", ""), ("length_mm", "int", "mm", ""), ("power_w", "int", "W", ""), ("warranty_months", "int", "month", ""), ("piece_count", "int", None, ""),
             ("released_on", "date", None, ""), ("waterproof", "bool", None, ""), ("color", "string", None, ""), ("material", "string", None, "")]


def columns(spark):
    return eav.wanted(spark.createDataFrame(CATALOGUE, "column_name string, value_type string, unit string, meaning string"))


def found(spark, *details):
    df = spark.createDataFrame([(i, d, "clash") for i, d in enumerate(details)], "row_id bigint, details string, entity string")
    cols = columns(spark)
    return rows(eav.cells(eav.wide_table(eav.detail_rows(df), cols), cols))


def test_values(spark):
    cases = {
        "Item weight:": {"6.78 lbs": "3075", "8,959 Grams": "8959", "1,8 kg": "1800", "10 oz": "283", "2": None, "-3 kg": None, "n.a.": None, "": None},
        "itemLength": {"ca. 23.7 cm": "237", '25.27"': "642", "1.05 m": "1050", "approx. 2 ft": "610", "18.59 in": "472", "wide": None},
        "WATTAGE": {"0.29 kW": "290", "70W": "70", "250 watts": "250"},
        "Garantie": {"3-year limited": "36", "30 mo": "30", "1 yr": "12", "TBD": None},
        "PIECES": {"Set of 10": "10", "12-piece": "12", "7": "7", "14 pcs": "14"},
        "Date First Available": {"14.03.2013": "2013-03-14", "20140401": "2014-04-01", "2019/09/22": "2019-09-22", "16 May 2019": "2019-05-16", "November 5, 2022": "2022-11-05", "30.02.2020": None, "soon": None},
        "is_waterproof": {"YES ": "true", "not waterproof": "false", "N": "false", "maybe": None},
        " color ": {" Ivory": "ivory", "see description": None},
        "Material:": {"OAK  ": "oak"},
    }
    flat = [(k, v, want) for k, vs in cases.items() for v, want in vs.items()]
    got = {r[0]: r[2] for r in found(spark, *[json.dumps({k: v}) for k, v, _ in flat])}
    assert {flat[i][:2]: got.get(i) for i in range(len(flat))} == {f[:2]: f[2] for f in flat}


def test_shapes_of_details(spark):
    one = {"COLOR": "Red", "Package Length": "9 cm", "Shipping Weight": "1 kg"}
    shapes = [
        json.dumps(one), json.dumps(json.dumps(one)), json.dumps({"Specs": one}), json.dumps({"Number of Batteries": "2", "Weight": {"value": 2, "unit": "kg"}}),
        json.dumps([{"name": "Farbe", "value": "red"}, {"attribute": "colour", "val": "blue"}, {"k": "pieces", "v": 3}]), '{"COLOR": "Red", ', "", None, "null", "[]", "7", '"x"', "[1, null]",
        json.dumps({"waterproof": True, "Color": None}), json.dumps({f"a{i}": "x" * 1000 for i in range(300)} | {"material": "Oak"}),
    ]
    assert found(spark, *shapes) == sorted(
        [(0, "color", "red"), (1, "color", "red"), (2, "color", "red"), (3, "weight_g", "2000"), (4, "color", "red"), (4, "piece_count", "3"), (13, "waterproof", "true"), (14, "material", "oak")], key=str
    )


def test_wide_rows_keep_every_entity(spark):
    data = [(1, "color", "Red", 2), (1, "Colour", "blue", 1), (1, "color", "Red", 2), (2, None, "x", 1), (3, "Length", None, 1), (None, "material", "oak", 1), *[(4, "pieces", "5", i) for i in range(500)]]
    df = spark.createDataFrame(data, "entity bigint, attribute string, value string, ord int")
    wide = eav.wide_table(df, columns(spark))
    assert rows(wide, "entity", "color", "material", "piece_count") == [(None, None, "oak", None), (1, "blue", None, None), (2, None, None, None), (3, None, None, None), (4, None, None, 5)]
    assert eav.wide_table(df.limit(0), columns(spark)).count() == 0


def test_every_signature_has_a_dense_table(spark):
    names = [("color", "red"), ("material", "oak"), ("pieces", "2"), ("waterproof", "yes"), ("weight", "2 kg"), ("length", "3 m"), ("power", "5 w"), ("warranty", "1 yr"), ("release date", "2020-01-31")]
    data = [(i, n, v, 0) for i in range(512) for j, (n, v) in enumerate(names) if i >> j & 1] + [(0, None, None, 0)]
    df, cols = spark.createDataFrame(data, "entity bigint, attribute string, value string, ord int"), columns(spark)
    tables = eav.dense_tables(eav.characteristic_rows(df, cols), cols)
    assert len(tables) == 512 and all(t.columns == ["entity", *s] for s, t in tables.items())
    one = tables["color", "piece_count", "released_on", "waterproof"]
    assert [tuple(r) for r in one.collect()] == [(1 + 4 + 8 + 256, "red", 2, datetime.date(2020, 1, 31), True)]
    wide = {r["entity"]: r for r in eav.wide_table(df, cols).collect()}
    want = {"color": "red", "material": "oak", "piece_count": 2, "waterproof": True, "weight_g": 2000, "length_mm": 3000, "power_w": 5, "warranty_months": 12, "released_on": datetime.date(2020, 1, 31)}
    # every row of the result is in a dense table: what is filled is what the signature says
    assert len(wide) == 512 and all(wide[i][c] == (v if i >> j & 1 else None) for i in range(512) for j, (c, v) in enumerate(want.items()))


def test_more_columns_than_a_word_has_bits(spark):
    cols = eav.wanted(spark.createDataFrame([(f"c{i}", "string") for i in range(100)], "column_name string, value_type string"))
    df = spark.createDataFrame([(i % 3, f"c{i}", f"v{i}", 0) for i in range(100)], "entity bigint, attribute string, value string, ord int")
    got = {r["entity"]: r.asDict() for r in eav.wide_table(df, cols).collect()}
    assert len(got) == 3 and all(got[e][f"c{i}"] == (f"v{i}" if i % 3 == e else None) for e in got for i in range(100))


def test_dates_are_dates(spark):
    df = spark.createDataFrame([(1, "release_date", "2020-01-31", 0)], "entity bigint, attribute string, value string, ord int")
    assert eav.wide_table(df, columns(spark)).first()["released_on"] == datetime.date(2020, 1, 31)
