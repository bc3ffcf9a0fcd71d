import json

from conftest import rows

from marlstone.operators import nested

FLAT = {"thumb": "u/t", "large": " ", "hi_res": None, "variant": "MAIN"}
LISTED = {"variant": "PT01", "renditions": [{"type": "thumb", "url": "u/t", "w": 75}, {"type": "large", "url": None, "w": 500}, {"type": "other", "url": "u/o"}, {"type": "thumb", "url": "u/second"}]}
SIZED = {"variant": "PT02", "media": {"sizes": {"thumb": {"url": "u/t", "px": [1, 2], "alt": [{"lang": "en", "text": "x"}]}, "large": {"url": None}}, "credits": None}}
GROUPED = {"meta": {"variant": "PT03", "tags": ["p"]}, "sets": [{"kind": "web", "files": [{"thumb": None}, {"large": "u/l"}]}, {"kind": "print", "files": [{"hi_res": "u/h"}]}]}


def table(spark, images, categories):
    return spark.createDataFrame([(1, images, categories, "clash", 9)], "row_id bigint, images array<string>, categories array<string>, label string, pos int")


def test_automaton():
    assert nested.variant_of("OBJECT<hi_res: STRING, large: VOID, variant: STRING>") == "flat"
    assert nested.variant_of("OBJECT<renditions: ARRAY<OBJECT<type: STRING, url: STRING, w: BIGINT>>>") == "listed"
    assert nested.variant_of("OBJECT<media: OBJECT<sizes: OBJECT<thumb: OBJECT<px: ARRAY<BIGINT>, url: VOID>>>>") == "sized"
    assert nested.variant_of("OBJECT<sets: ARRAY<OBJECT<files: ARRAY<OBJECT<thumb: STRING>>, kind: STRING>>>") == "grouped"
    for shape in ("OBJECT<>", "OBJECT<variant: STRING>", "ARRAY<VOID>", "BIGINT", "DECIMAL(3,2)", "OBJECT<`a b`: DECIMAL(3,2), thumb: BIGINT>", "OBJECT<a: OBJECT<", "", None):
        assert nested.variant_of(shape) == "none"


def test_images(spark):
    images = [json.dumps(FLAT), json.dumps(LISTED), None, "", "no image", '{"thumb": "https://im', "[]", "{}", json.dumps(SIZED), json.dumps(GROUPED), json.dumps(json.dumps(FLAT)), json.dumps({"thumb": "u/t"}), json.dumps(FLAT)]
    got = rows(nested.image_renditions(table(spark, images, None)), "pos", "label", "url", "parent")
    assert got == sorted(
        [(0, "thumb", "u/t", "MAIN"), (1, "thumb", "u/t", "PT01"), (8, "thumb", "u/t", "PT02"), (9, "hi_res", "u/h", "PT03"), (9, "large", "u/l", "PT03"), (10, "thumb", "u/t", "MAIN"), (11, "thumb", "u/t", ""), (12, "thumb", "u/t", "MAIN")],
        key=lambda t: [str(x) for x in t],
    )
    routed = nested.route_elements(table(spark, images, None), "row_id", "images")
    assert rows(nested.variant_table(routed, "listed"), "row_id", "pos", "variant") == [(1, 1, "PT01")]


def test_categories(spark):
    cases = [
        (["Home & Co", " A &amp; B\t", "", None, "  ", "C"], ["Home & Co", "A & B", "C"]), (["A > B>C"], ["A", "B", "C"]), (["A | B", "C/D / E"], ["A", "B", "C/D", "E"]),
        (['["A", "", "B &gt; C", null]'], ["A", "B > C"]), (["[broken"], ["[broken"]), ([], []), (None, []), (["A", "A"], ["A", "A"]),
    ]
    for categories, want in cases:
        got = nested.category_levels(table(spark, None, categories)).orderBy("pos").collect()
        assert [tuple(r) for r in got] == [(1, i, x, want[i - 1] if i else "") for i, x in enumerate(want)]


def test_both_and_empty(spark):
    df = table(spark, [json.dumps(FLAT)], ["A"])
    assert rows(nested.nested_tables(df)) == [(1, "categories", 0, "A", ""), (1, "images", 0, "thumb", "MAIN")]
    assert nested.nested_tables(df.limit(0)).count() == 0
    long = table(spark, [json.dumps(FLAT)] * 2_000, [">".join(f"c{i}" for i in range(300))])
    assert nested.nested_tables(long).count() == 2_300
