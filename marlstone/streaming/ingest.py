"""The same cleaning on a folder that files keep arriving in."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from marlstone.functions.text import clean_text
from marlstone.sources.jsonl import REVIEWS


def clean_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: T.StructType = REVIEWS, text: str = "text") -> StreamingQuery:
    """Read what is new in the folder, clean the text column, append to the table at ``out``, and stop. Each file is read once."""
    rows = spark.readStream.schema(schema).json(folder)
    cleaned = rows.withColumn(text, clean_text(F.col(text)))
    return cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
