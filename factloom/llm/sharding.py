"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring. A row belongs to the first point clockwise of its key's hash.
A shard takes at most its capacity; rows that overflow a full shard continue clockwise to the next point whose shard
has room. Who overflows is decided from the number of rows in each arc (a table bounded by shards * vnodes) and each
row's rank in its arc, so no step looks at the rows one after another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ring's points in ascending order, and the shard of each."""
    points = sorted(
        (int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big", signed=True), s)
        for s in range(shards)
        for v in range(vnodes)
    )
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def flow(counts: np.ndarray, owner: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Where the rows of each arc go: (arc, from_rank, to_rank, shard, first slot).

    Hop by hop, every arc offers what it still holds to the point that many steps clockwise; within a hop the arcs
    come in ring order. Ends when all rows are placed; the capacities must hold them all.
    """
    left, taken, room, used = counts.copy(), np.zeros_like(counts), capacity.copy(), np.zeros_like(capacity)
    out, n = [], len(owner)
    for hop in range(n):
        for arc in np.flatnonzero(left):
            s = owner[(arc + hop) % n]
            k = min(left[arc], room[s])
            if k:
                out.append((int(arc), int(taken[arc]), int(taken[arc] + k), int(s), int(used[s])))
                left[arc] -= k
                taken[arc] += k
                room[s] -= k
                used[s] += k
        if not left.any():
            break
    if left.any():
        raise ValueError("the capacities do not hold all rows")
    return out


def bounded_ring(df: DataFrame, key: str, attributes: list[str], shards: int = 16, vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """df's rows of (key, attributes) with shard and slot (gapless from 0 in each shard).

    With slack 0 the capacities are the row counts dealt as evenly as whole numbers allow, so counts differ by one
    at most; with slack s a shard holds up to (1+s) times the mean, and fewer rows move when a shard is added.
    Repeated rows are counted once per group and spread like any others; rows with a null key are hashed by their
    attributes. An empty table gives an empty result.
    """
    where, owner = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(where, h.to_numpy(np.int64)) % len(where))

    grouped = df.groupBy(key, *attributes).agg(F.count("*").alias("_copies"))
    grouped = grouped.withColumn("_hash", F.when(F.col(key).isNull(), F.xxhash64(*attributes)).otherwise(F.xxhash64(key)))
    grouped = stash(grouped.withColumn("_arc", arc_of("_hash")))
    counts = np.zeros(len(where), np.int64)
    for r in grouped.groupBy("_arc").agg(F.sum("_copies").alias("n")).collect():  # a row for each point of the ring at most
        counts[r["_arc"]] = r["n"]
    n = int(counts.sum())
    if slack:
        capacity = np.full(shards, int(np.ceil(n * (1 + slack) / shards)), np.int64)
    else:
        capacity = np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)
    parts = df.sparkSession.createDataFrame(
        flow(counts, owner, capacity), "_arc int, _from long, _to long, shard int, _slot long"
    )
    in_arc = Window.partitionBy("_arc").orderBy("_hash", key, *attributes).rowsBetween(Window.unboundedPreceding, 0)
    ranked = grouped.withColumn("_end", F.sum("_copies").over(in_arc))
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_end") - F.col("_copies"), F.col("_end") - 1)))
    r, p = ranked.alias("r"), F.broadcast(parts).alias("p")  # at most shards rows for each point of the ring
    placed = r.join(p, F.expr("r._arc = p._arc and r._rank >= p._from and r._rank < p._to"))
    return placed.select(
        *[F.col(f"r.{c}").alias(c) for c in (key, *attributes)], "p.shard", F.expr("p._slot + r._rank - p._from").alias("slot")
    )


def op3_bounded_ring(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``. A null text has size 1 and crc32 0."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = bounded_ring(docs, "doc_id", ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
