"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has VNODES points on a ring of 64-bit positions; a key belongs to the arc that ends at the first point at or after its hash. No shard takes
more than ceil((1 + SLACK) * keys / shards). A shard fills from its arcs in ring order, within an arc in order of (hash, key); keys beyond its room continue
clockwise, point by point, to the first shard with room. Adding or removing a shard moves its arcs and some overflow, and little else.

Only counts per arc, shards times VNODES numbers whatever the data, reach the driver, which plans who overflows where.
Rows of arcs that keep all their keys are placed by a map, with no shuffle; only the arcs that overflow are shuffled, by ranges of (arc, hash, key), to rank their keys; a
key that a third of the rows have is spread over many partitions.

Rows: every row is placed, repeated ones each. A null key hashes like any other value, and is last among equal hashes. Keys may be of any type with an order. No text is read, so its length is
of no matter. Extra columns are of no matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokloom.plans.numbering import numbered
from tokloom.session import prepare, save

SHARDS, VNODES, SLACK = 64, 100, 0.05


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions, shard of each)."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int32)


def plan(counts: dict[int, int], owner: np.ndarray, shards: int, slack: float = SLACK) -> dict[int, list[tuple[int, int]]]:
    """For each arc with keys, [(keys, shard)]: the first so many of its keys in order go there, the next so many there."""
    total = sum(counts.values())
    room = [max(1, -(-int(np.ceil((1 + slack) * total)) // shards))] * shards
    placed: dict[int, list[tuple[int, int]]] = {}
    waiting = deque((arc, arc, counts[arc]) for arc in sorted(counts))  # (home, now at, keys)
    while waiting:
        # one turn: every group asks the shard of its point; what is refused goes on to the next point
        for _ in range(len(waiting)):
            home, at, n = waiting.popleft()
            s = int(owner[at])
            k = min(n, room[s])
            if k:
                room[s] -= k
                placed.setdefault(home, []).append((k, s))
            if n > k:
                waiting.append((home, (at + 1) % len(owner), n - k))
    return placed


def _arcs(positions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arc = np.searchsorted(positions, b.column(1).to_numpy(), "left") % len(positions)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(arc.astype(np.int32))], names=["key", "h", "arc"])

    return run


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """(key, shard) of every row."""
    spark = prepare(docs.sparkSession)
    positions, owner = ring(shards, vnodes)
    kind = dict(docs.dtypes)[key]
    keys = docs.select(F.col(key).alias("key")).withColumn("h", F.xxhash64("key")).mapInArrow(_arcs(positions), f"key {kind}, h long, arc int")
    counts = {r["arc"]: r["n"] for r in keys.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards * vnodes rows at most
    placed = plan(counts, owner, shards, slack)
    whole = {arc: p[0][1] for arc, p in placed.items() if len(p) == 1}
    split = [(arc, sum(k for k, _ in p[:i]) + 1, sum(k for k, _ in p[: i + 1]), s) for arc, p in placed.items() if len(p) > 1 for i, (_, s) in enumerate(p)]
    table = np.full(len(owner), -1, np.int32)
    for arc, s in whole.items():
        table[arc] = s

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = table[b.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), b.column(1), b.column(2)], names=["key", "shard", "h", "arc"])

    found = keys.mapInArrow(direct, f"key {kind}, shard int, h long, arc int")
    out = found.where("shard >= 0").select("key", "shard")
    if split:
        ranges = F.broadcast(spark.createDataFrame(split, "arc int, low long, high long, to int"))
        ranked = numbered(save(found.where("shard < 0").select("key", "h", "arc"), "ring-overflow"), "arc", ["h", "key"])
        out = out.union(ranked.join(ranges, "arc").where("r + 1 BETWEEN low AND high").select("key", F.col("to").alias("shard")))
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
