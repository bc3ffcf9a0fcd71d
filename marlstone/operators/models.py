"""Places for outside models, with stand-ins that need none."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import words


class Encoder(Protocol):
    """Anything that gives a row of ``dim`` numbers per text; it is sent to the workers once and called with lists."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed hashed words, scaled to unit length: a stand-in where no trained encoder is at hand."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def encode(df: DataFrame, text: str, encoder: Encoder, to: str = "embeddings") -> DataFrame:
    """``df`` with a vector per text; null texts are encoded as ''."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(np.asarray(encoder(b.fillna("").tolist()), dtype=np.float32))) if len(b) else pd.Series([], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(to, F.pandas_udf(run, T.ArrayType(T.FloatType()))(F.col(text)))


# fixed values: English words that are no keywords
STOP_WORDS = tuple(
    "a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have "
    "having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she so some such than that the "
    "their theirs them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours".split()
)


def phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term``: a row per word and per neighbouring word pair of each text, stop words left out first."""
    kept = df.select(key, F.filter(words(F.col(text)), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1)).alias("w"))
    lagged = kept.select(key, "w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))
    pairs = F.zip_with("w", "next", lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return lagged.select(key, F.explode(F.array_compact(F.concat("w", pairs))).alias("term"))


def keywords(df: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """``key, keywords``: the phrases of one or two words that stand out most by frequency against all rows; [] where there are none.

    Keys are distinct. Ties go to the phrase that comes first by name.
    """
    terms = phrases(df, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = df.count()
    scored = terms.join(weight, "term").withColumn("score", F.round(F.col("tf") * (F.log(F.lit(total + 1.0) / (F.col("df") + 1)) + 1), 9))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    best = scored.withColumn("r", rank).where(F.col("r") <= top).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("k"))
    named = best.select(key, F.transform("k", lambda s: s["term"]).alias("keywords"))
    return df.select(key).join(named, key, "left").select(key, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def extract(df: DataFrame, columns: dict[str, str], extractor: Callable[[list[str]], list[list[str]]]) -> DataFrame:
    """``df`` with an array column per text column, ``columns`` being text to result, by an outside extractor; [] for null or empty text."""

    def run(s: pd.Series) -> pd.Series:
        full = s.fillna("").astype(str)
        out = pd.Series([[] for _ in full], index=full.index, dtype=object)
        some = full[full != ""]
        if len(some):
            for i, found in zip(some.index, extractor(some.tolist()), strict=True):
                out[i] = list(found)
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(run, T.ArrayType(T.StringType()))
    return df.withColumns({to: udf(F.col(c)) for c, to in columns.items()})
