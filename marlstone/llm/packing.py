"""Items into containers of fixed capacity: bounded-space online best fit.

Each partition keeps a fixed number of open containers in a bitset keyed by free space. An item goes where it leaves the
least space; where nothing fits and no container may be opened, the fullest closes. Memory is constant and nothing is
shuffled. Only an item above the capacity is cut: its full pieces are containers of their own, its rest is an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, OPEN_BINS = 1024, 64


class BestFit:
    """Containers of one partition; ``put`` returns the number of the container an item of at most the capacity goes to."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f is set while an open container has f free
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        numbers = self.at[space]
        number = numbers.pop()
        if not numbers:
            del self.at[space]
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def fresh(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, size: int) -> int:
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.limit:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
            number, space = self.fresh(), self.capacity
        left = space - size
        if left > 0:
            self.at.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``key, piece, n_pieces, tokens, container``: where every item, or every piece of an item above the capacity, goes.

    A null or negative size counts as 0; items of size 0 are placed like others and take no space. Repeated rows are items
    of their own. Container numbers hold the partition in their upper bits. An empty table gives an empty one.
    """
    slim = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            tokens = batch.column("tokens").to_numpy()
            full = np.where(tokens > capacity, tokens // capacity, 0)
            rest = tokens - full * capacity
            pieces = full + ((rest > 0) | (full == 0))
            row = np.repeat(np.arange(len(tokens)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            whole = piece < full[row]
            part = np.where(whole, capacity, rest[row])
            number = np.fromiter((bins.fresh() if w else bins.put(p) for p, w in zip(part.tolist(), whole.tolist(), strict=True)), dtype=np.int64, count=len(row))
            columns = [batch.column("key").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (piece, pieces[row], part, number + base))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "n_pieces", "tokens", "container"])

    kind = dict(slim.dtypes)["key"]
    out = slim.mapInArrow(place, f"key {kind}, piece bigint, n_pieces bigint, tokens bigint, container bigint")
    return out.withColumnRenamed("key", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers, tokens, least, fill`` (share of the space used)."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / capacity).alias("least"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"))
