"""Text expressions, all in the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character references that are replaced in names and titles; those of ``&`` come last, both at once, so that nothing is decoded twice.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&middot;": "·", "&copy;": "©", "&reg;": "®", "&trade;": "™",
    "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&eacute;": "é", "&egrave;": "è",
    "&agrave;": "à", "&ccedil;": "ç", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß",
    "&ntilde;": "ñ", "&iacute;": "í", "&oacute;": "ó", "&aacute;": "á", "&uacute;": "ú", "&euro;": "€", "&deg;": "°", "&times;": "×", "&bull;": "•",
    "&#39;": "'", "&#x27;": "'", "&#34;": '"', "&#160;": "\u00a0",
}

#: White space as Unicode has it; the default \s of the JVM is ASCII only.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape_entities(c: Column | str) -> Column:
    out = _col(c)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, "&(?:amp|#38);", "&")
    return F.when(_col(c).contains("&"), out).otherwise(_col(c))


def unescape_html(c: Column | str) -> Column:
    """Every character reference of HTML 5 and every number decoded once, in one pass over the text; text without '&' is left as it is.

    Names are the standard library's table. A name without its semicolon counts if it is one of those that may lack it, and
    if it begins another word, the rest stays. Numbers of no character give U+FFFD, control characters nothing, and 128 to
    159 are read as Windows-1252.
    """
    text = _col(c)
    old = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    western = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    names, western = (F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in (html5, western))
    piece = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"

    def of(p: Column) -> Column:
        name = F.substring(p, 2, 100)
        hexed = F.nullif(F.regexp_extract(p, "^&#[xX]0*([0-9a-fA-F]*)", 1), F.lit(""))
        digits = F.nullif(F.regexp_extract(p, "^&#0*([0-9]*)", 1), F.lit(""))
        number = F.when(F.length(F.coalesce(hexed, digits)) > 8, F.lit(1 << 40)).otherwise(F.coalesce(F.conv(hexed, 16, 10), digits).cast("bigint"))
        number = F.when(p.rlike("^&#"), F.coalesce(number, F.lit(0)))
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        control = number.isin(11, 127) | number.between(1, 8) | number.between(14, 31)
        numbered = (
            F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
            .when(number.between(128, 159), F.try_element_at(western, number.cast("string")))
            .when(control, "")
            .otherwise(char)
        )
        begins = F.regexp_extract(p, "^&(" + "|".join(old) + ")", 1)
        part = F.when(begins != "", F.concat(F.try_element_at(names, begins), F.substr(p, F.length(begins) + 2)))
        return F.when(~p.startswith("&") | (p == "&"), p).when(number.isNotNull(), numbered).otherwise(F.coalesce(F.try_element_at(names, name), part, p))

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), of), "")).otherwise(text)


def clean_text(c: Column | str) -> Column:
    """Entities decoded, then tags to a space, then white space collapsed and trimmed. Null stays null."""
    out = F.regexp_replace(unescape_html(c), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, f"{SPACE}+", " "))


def sentences(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """One row per piece between dots; pieces are not trimmed and empty ones are kept. Null gives no row."""
    return df.withColumn(to or column, F.explode(F.split(_col(column), r"\.")))


def array_sentences(df: DataFrame, column: str) -> DataFrame:
    """An array column first to its elements, then to sentences, under the same name."""
    return sentences(df.withColumn(column, F.explode(column)), column)


def concat_sections(c: Column | str, by: str = ".") -> Column:
    """Elements joined; a null array gives '', null elements are skipped."""
    return F.concat_ws(by, _col(c))


def is_filled(c: Column | str) -> Column:
    """Neither null nor empty. Blank text counts as filled."""
    return _col(c).isNotNull() & (F.length(_col(c)) > 0)


def words(c: Column | str) -> Column:
    """Lower-case runs of letters; null gives null."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}]+"), lambda w: w != "")


def token_count(c: Column | str) -> Column:
    """Tokens of a text: a longest run of letters and digits is one, as is any other character but white space. Null gives 0."""
    runs = F.regexp_replace(_col(c), r"[\p{L}\p{Nd}\p{Nl}\p{No}]+", "a")
    return F.coalesce(F.length(F.regexp_replace(runs, f"{SPACE}+", "")), F.lit(0)).cast("bigint")
