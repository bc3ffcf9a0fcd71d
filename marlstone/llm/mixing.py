"""Sources mixed to target shares: Sainte-Laguë apportionment of equal-token blocks.

The mix is a number of blocks of equal size. Blocks go to sources by highest quotients of their target shares, each source
up to the blocks it has times the repeats it allows; a source's blocks go to its shards the same way by the shards' sizes.
Within a shard records are put in a seeded order and cut into blocks, and the quota says how often each block is taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources.staging import stage

BLOCK_TOKENS, SHARD_TOKENS, MOST_SHARDS = 4096, 2_000_000, 100_000


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotient weight / (2 k + 1), none above its cap; ties go to the earlier. Fewer seats if all are capped.

    Most seats are given at once: a divisor is found under which rounded quotas do not exceed the seats, the rest go one
    by one. Nulls do not occur; weights of 0 get nothing.
    """

    def given(divisor: float) -> list[int]:
        return [min(c, floor(w / divisor + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]

    if seats <= 0 or not any(w > 0 and c > 0 for w, c in zip(weights, caps, strict=True)):
        return [0] * len(weights)
    low, high = 0.0, 2.5 * max(weights)
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if sum(given(mid)) <= seats else (mid, high)
    out = given(high)
    heap = [(-w / (2 * n + 1), i) for i, (w, n, c) in enumerate(zip(weights, out, caps, strict=True)) if w > 0 and n < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def source_name(c: Column) -> Column:
    """Names without case, blanks, hyphens and underscores; null and empty names give null."""
    return F.nullif(F.regexp_replace(F.lower(c), r"(?U)[\s_\-]+", ""), F.lit(""))


def mix(records: DataFrame, targets: DataFrame, key: str, tokens: str, seed: int = 17, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(records taken, report by source).

    Taken: ``key, source, tokens, copies`` with copies > 0. Report: ``source, target_share, max_repeats, tokens,
    quota_blocks, used_tokens, actual_share, repeats, action``, one row per row of targets with the source as written
    there. The mix is as large as all records of the targets' sources; what a source cannot give goes to others by the
    next quotients, within their caps. Records of no target source, and of null tokens or key, are left out.

    action: cut if the source has its share of all tokens, else repeat if it has within its repeats, else short.
    Targets are at most 10,000 rows. Per source and shard one number is gathered, of at most MOST_SHARDS + sources.
    """
    spark = records.sparkSession
    wanted = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(10_001).collect()
    if len(wanted) > 10_000:
        raise ValueError("at most 10,000 sources can be mixed")
    wanted.sort(key=lambda r: r[0])
    names = spark.createDataFrame([(i, r[0], float(r[1] or 0), int(r[2] or 0)) for i, r in enumerate(wanted)], "sid int, source string, target_share double, max_repeats int")
    named = names.withColumn("_name", source_name(F.col("source")))
    slim = records.select(F.col(key).alias("key"), source_name(F.col("source")).alias("_name"), F.col(tokens).cast("bigint").alias("tokens"))
    slim = slim.where("key is not null and tokens >= 0").join(F.broadcast(named.select("_name", "sid")), "_name").select("key", "sid", "tokens")
    slim = stage(slim.withColumn("place", F.xxhash64("key", F.lit(seed))), "sized")

    has = {r[0]: r[1] for r in slim.groupBy("sid").agg(F.sum("tokens")).collect()}
    total = sum(has.values())
    per_shard = max(SHARD_TOKENS, -(-total // MOST_SHARDS))
    shards = {i: max(1, -(-t // per_shard)) for i, t in has.items()}
    counted = spark.createDataFrame(sorted(shards.items()) or [(-1, 1)], "sid int, shards bigint")
    parted = slim.join(F.broadcast(counted), "sid").withColumn("shard", F.pmod("place", "shards").cast("int"))
    sizes = parted.groupBy("sid", "shard").agg(F.sum("tokens").alias("t")).collect()

    blocks = lambda t: -(-t // block)
    of_shard: dict[int, list[tuple[int, int]]] = {}
    for sid, shard, t in sorted(sizes):
        of_shard.setdefault(sid, []).append((shard, t))
    caps = [int(r[2] or 0) * sum(blocks(t) for _, t in of_shard.get(i, [])) for i, r in enumerate(wanted)]
    quota = sainte_lague([float(r[1] or 0) for r in wanted], total // block, caps)
    rows = []
    for i, q in enumerate(quota):
        own = of_shard.get(i, [])
        took = sainte_lague([float(t) for _, t in own], q, [int(wanted[i][2] or 0) * blocks(t) for _, t in own])
        rows += [(i, s, n // max(1, blocks(t)), n % max(1, blocks(t))) for (s, t), n in zip(own, took, strict=True) if n]
    quotas = spark.createDataFrame(rows or [(-1, 0, 0, 0)], "sid int, shard int, rounds int, extra int")

    before = F.sum("tokens").over(Window.partitionBy("sid", "shard").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    cut = parted.join(F.broadcast(quotas), ["sid", "shard"]).withColumn("number", F.floor(before / block))
    copies = F.col("rounds") + F.when(F.col("number") < F.col("extra"), 1).otherwise(0)
    chosen = cut.select("key", "sid", "tokens", copies.cast("bigint").alias("copies")).where("copies > 0")

    used = chosen.groupBy("sid").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    facts = spark.createDataFrame([(i, int(has.get(i, 0)), q) for i, q in enumerate(quota)] or [(-1, 0, 0)], "sid int, tokens bigint, quota_blocks bigint")
    joined = names.join(F.broadcast(facts), "sid").join(used, "sid", "left").fillna(0, ["used"])
    need = F.col("target_share") * F.lit(total)
    report = joined.select(
        "source", "target_share", "max_repeats", "tokens", "quota_blocks", F.col("used").alias("used_tokens"),
        F.try_divide(F.col("used").cast("double"), F.sum("used").over(Window.partitionBy(F.lit(1)))).alias("actual_share"),
        F.try_divide(F.col("used").cast("double"), F.col("tokens")).alias("repeats"),
        F.when(F.col("tokens") >= need, "cut").when(F.col("max_repeats") * F.col("tokens") >= need, "repeat").otherwise("short").alias("action"),
    )
    taken = chosen.join(F.broadcast(names.select("sid", "source")), "sid").select(F.col("key").alias(key), "source", "tokens", "copies")
    return taken, report
