from conftest import rows
from pyspark.sql import functions as F

from marlstone.llm import residue

GOOD = [f"The {a} {b} is made of {c} and keeps its shape for years. It fits well and {d} the lid every week." for a in ("small", "large", "round") for b in ("pan", "pot", "jar") for c in ("steel", "oak", "glass") for d in ("cleans", "holds")]
MENTIONS = ["My order page said access denied for two weeks, support fixed it. The pan is fine.", "The manual still had lorem ipsum on page two, yet the pot is fine. The lid holds.", "The label printer uses {{name}} marks, which it replaces evenly. The jar is round."]
BAD = [
    "{{product_name}} is made by {{brand}}.", "Now only [INSERT price] while stocks last.", "Name undefined, brand undefined.", "Error 404: page not found", "Home\nShop\nAccess denied.\n(c) Pan",
    "Please enable JavaScript to view this page", "Lorem ipsum dolor sit amet. Consectetur elit.", "xxx xxx xxx", "Your text goes here.", GOOD[0] + " Discover ${ Size }, the best choice in %brand%.",
]


def test_flags(spark):
    texts = GOOD * 4 + MENTIONS * 6 + BAD
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, said string")
    got = {r["doc_id"] for r in residue.flag_records(df, "doc_id", "text").where("flagged").collect()}
    start = len(texts) - len(BAD)
    assert [texts[i] for i in sorted(got) if i < start] == []
    assert [t for i, t in enumerate(BAD) if start + i not in got] == []


def test_learns_what_it_was_not_told(spark):
    told = ["Error 404: it is gone. Kindly reload the catalogue node."] * 12
    texts = GOOD * 2 + told + ["Kindly reload the catalogue node."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"] for r in residue.flag_records(df, "doc_id", "text").where("flagged").collect()}
    assert got == set(range(len(GOOD) * 2, len(texts)))


def test_edges(spark):
    texts = [None, "", "  \n ", "!!!", "Home", "The pan is fine.", "The pan is fine.", "word " * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "The pot.")], "doc_id bigint, text string")
    assert rows(residue.flag_records(df, "doc_id", "text").where("flagged")) == []
    assert residue.flag_records(df, "doc_id", "text").where("doc_id = 7").first()["words"] == 50_000
    assert residue.flag_records(df.limit(0), "doc_id", "text").count() == 0


def test_masks(spark):
    cases = {"Buy {{ Size }} now": "buy zslotz now", "[INSERT x y]!": "zasked zslotz", "a 10% off b": "a 0 off b", "$product name$": "zslotz", "[Update] it [1]": "zslotz it 0", "<b>x</b> <sku>": "b x b zslotz", "is NaN, None": "is zvoidz zvoidz"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select(residue.masked(F.col("t")))
    got = [" ".join(r[0].split()) for r in df.collect()]
    assert got[:5] == list(cases.values())[:5] and got[6] == list(cases.values())[6]
