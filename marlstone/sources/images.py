"""Image addresses of listings and their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetch = Callable[[str], bytes | None]


def image_entries(df: DataFrame, key: str = "parent_asin", images: str = "images") -> DataFrame:
    """``key, type, variant, url`` per address of each image object; an address that is null or not text keeps its row with a null url.

    Elements that are no JSON object give no row. Keys with objects or arrays below them are left to the nested tables.
    """
    one = df.select(key, F.explode(images).alias("_e"))
    pairs = F.map_entries(F.map_filter(F.from_json("_e", "map<string,string>"), lambda k, v: (k != "variant") & ~F.coalesce(v.rlike(r"^[\[{]"), F.lit(False))))
    variant = F.get_json_object("_e", "$.variant").alias("variant")
    return one.where(F.try_parse_json("_e").isNotNull()).select(key, variant, F.explode(pairs).alias("p")).select(key, F.col("p.key").alias("type"), "variant", F.col("p.value").alias("url"))


def http_fetch(timeout: float = 5.0) -> Fetch:
    def fetch(url: str) -> bytes | None:
        from urllib.request import urlopen

        with urlopen(url, timeout=timeout) as answer:
            return answer.read() if answer.status == 200 else None

    return fetch


def fetch_images(entries: DataFrame, fetch: Fetch, url: str = "url") -> DataFrame:
    """``entries`` with ``data``: the bytes at each address, null where fetching fails. One address never affects another."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(address: str | None) -> bytes | None:
            try:
                return fetch(address) if address else None
            except Exception:  # noqa: BLE001 - any failure of one address is a missing image
                return None

        for b in batches:
            yield b.assign(data=b[url].map(one).astype(object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return entries.mapInPandas(load, f"{fields}, data binary")
