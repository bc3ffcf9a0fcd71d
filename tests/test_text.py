import html
import random
import re

from conftest import rows
from pyspark.sql import functions as F

from marlstone.functions.json import json_keys, json_size
from marlstone.functions.text import array_sentences, clean_text, concat_sections, is_filled, sentences, token_count, unescape_entities, unescape_html, words


def clean_plainly(t):
    return None if t is None else re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(t))).strip()


def test_clean_text_cases(spark):
    cases = {"a &amp; b<br />c": "a & b c", "x y": "x y", "&lt;b&gt;hi&lt;/b&gt;": "hi", "5 < 6 and 7 > 2": "5 2", "": "", "  \t ": "", None: None, "&nbsp;a&nbsp;": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(clean_text("t")).collect()] == list(cases.values())


def test_clean_text_agrees_with_plain_python(spark):
    rng = random.Random(1)
    bits = ["a", "Wort", "&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&uuml;", "<b>", "</p>", " ", "\n", " ", " ", "5 < 6", ">", "&copy;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["x" * 200_000]
    texts = [t for t in texts if "&amp;" not in t or not re.search(r"&amp;(?:amp|lt|gt|quot|#39|uuml|copy);?", t)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(clean_text("t")).collect()]
    assert got == [clean_plainly(t) for t in texts]


def test_sentences(spark):
    df = spark.createDataFrame([(1, ["One. Two.", "Three", None]), (2, []), (3, None)], "id int, d array<string>")
    assert [r[0] for r in array_sentences(df, "d").select("d").collect()] == ["One", " Two", "", "Three"]
    one = spark.createDataFrame([("a.b",), (None,), ("",)], "t string")
    assert rows(sentences(one, "t").where(is_filled("t"))) == [("a",), ("b",)]


def test_sections_words_and_tokens(spark):
    df = spark.createDataFrame([(None,), (["", None],), (["One. Two.", "Three"],)], "a array<string>")
    assert [r[0] for r in df.select(concat_sections("a")).collect()] == ["", "", "One. Two..Three"]
    texts = ["Ab1, c--d \u00e9_f !", None, "", " \t\n", "x" * 100_000, "\u00bd kg, 3.5\u00a0l_"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in t.select(token_count("t")).collect()] == [len(re.findall(r"[^\W_]+|\S", x or "")) for x in texts]
    assert t.select(words("t")).first()[0] == ["ab", "c", "d", "é", "f"]


def test_json_keys(spark):
    df = spark.createDataFrame([("{}",), (None,), ("[1,2]",), ("zz",), ('{"a":1,"a":2}',), ("",), ('{"a":',)], "j string")
    assert [r[0] for r in df.select(json_keys("j")).collect()] == [[], None, None, None, ["a"], None, None]
    assert [r[0] for r in df.select(json_size(F.col("j"))).collect()] == [0, None, None, None, 1, None, None]


def test_html_references_are_decoded_once(spark):
    cases = ["&#38;amp;", "&amp;lt;", "&#x41;&#66;&#0;x&#1114112;", "&notit; &notin; &copy2 &hearts;", "&#128;&#150;", "&#55296;", "&;& &#; &#x; a&b", "&NotEqualTilde;", "&#99999999999;", "&amp", "&ampx", "&zzz;", "&#1;&#9;", "&#x1F600;"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(unescape_html("t")).collect()]
    assert got == [html.unescape(c) for c in cases]
    assert spark.createDataFrame([("&#38;amp;",), ("&amp;#38;",)], "t string").select(unescape_entities("t")).collect() == [("&amp;",), ("&#38;",)]
