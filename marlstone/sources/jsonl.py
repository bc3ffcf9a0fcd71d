"""JSON Lines with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_text, _texts = T.StringType(), T.ArrayType(T.StringType())

#: Objects under a text column arrive as their JSON text; a malformed line is a row of nulls; a wrong type is a null.
ITEMS = T.StructType(
    [
        T.StructField("title", _text), T.StructField("main_category", _text), T.StructField("features", _texts), T.StructField("description", _texts),
        T.StructField("average_rating", T.FloatType()), T.StructField("rating_number", T.IntegerType()), T.StructField("price", T.DoubleType()), T.StructField("store", _text),
        T.StructField("parent_asin", _text), T.StructField("categories", _texts), T.StructField("details", _text), T.StructField("images", _texts),
    ]
)
REVIEWS = T.StructType(
    [
        T.StructField("rating", T.FloatType()), T.StructField("title", _text), T.StructField("text", _text), T.StructField("timestamp", _text),
        T.StructField("helpful_vote", T.IntegerType()), T.StructField("parent_asin", _text), T.StructField("images", _texts),
    ]
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One row per line; the schema is never inferred. Fields it does not name are dropped, absent ones are null."""
    return spark.read.schema(schema).json(path)


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_jsonl(spark, path, ITEMS)


def read_reviews(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_jsonl(spark, path, REVIEWS)
