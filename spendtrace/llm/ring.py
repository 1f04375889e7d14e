"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``replicas`` points of a ring; a key belongs to the first point
clockwise from its hash. A shard takes keys up to its bound; the keys beyond it
continue clockwise to the next shard with room. So loads are balanced by
construction and only overflowing keys leave their home.

The walk is decided for whole arcs, not key by key: keys are counted per arc
(map-side combined, at most ``shards * replicas`` rows reach the driver), the
driver grants each arc intervals of its key order, and a key finds its shard and
slot from its rank within the arc. Ranks come from counts per cell of an arc and
row numbers within cells of about ``CELL_ROWS`` rows, so no task holds an arc.
Only id, size and checksum are shuffled, never texts.

Defined results: a null text counts no bytes. A null doc_id is a key like any
other. Repeated rows are ranked as often as they occur; equal rows are
interchangeable. An empty table gives no rows. Columns other than those named
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendtrace.llm.staging import stored

CELL_ROWS = 50_000


class Ring:
    """Points of the shards in clockwise order."""

    def __init__(self, shards: int, replicas: int = 128):
        points = sorted(
            (int.from_bytes(hashlib.blake2b(f"{s}/{r}".encode(), digest_size=8).digest(), "big", signed=True), s)
            for s in range(shards)
            for r in range(replicas)
        )
        self.shards = shards
        self.positions = np.array([p for p, _ in points], dtype=np.int64)
        self.owners = [s for _, s in points]

    def arcs(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the first point clockwise; behind the last one the ring starts again."""
        return np.searchsorted(self.positions, hashes) % len(self.positions)

    def grants(self, counts: dict[int, int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(arc, low, high, shard, first slot): which ranks of each arc go where.

        In round r every arc offers what is left to the r-th distinct shard
        clockwise from it. Each grant empties an arc or fills a shard, so there
        are at most as many as arcs and shards together.
        """
        if sum(counts.values()) > sum(bounds):
            raise ValueError("the bounds are less than the keys")
        room, slots = list(bounds), [0] * self.shards
        placed = dict.fromkeys(counts, 0)
        n = len(self.owners)
        steps = {arc: arc for arc in counts}
        met = {arc: set() for arc in counts}
        out = []
        while any(placed[a] < counts[a] for a in counts):
            for arc in sorted(counts):
                left = counts[arc] - placed[arc]
                if not left:
                    continue
                while (shard := self.owners[steps[arc] % n]) in met[arc]:
                    steps[arc] += 1
                met[arc].add(shard)
                take = min(left, room[shard])
                if take:
                    out.append((arc, placed[arc], placed[arc] + take, shard, slots[shard]))
                    placed[arc] += take
                    room[shard] -= take
                    slots[shard] += take
        return out


def load_bounds(rows: int, shards: int, epsilon: float) -> list[int]:
    """Most keys per shard: with 0, the counts that are at most one apart; else (1 + epsilon) times the mean, rounded up."""
    if epsilon == 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [int(np.ceil((1 + epsilon) * rows / shards))] * shards


def assign_shards(docs: DataFrame, shards: int = 8, replicas: int = 128, epsilon: float = 0.0) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, home (shard of the key's arc), shard and slot, per row."""
    ring = Ring(shards, replicas)

    @F.arrow_udf("int")
    def arc(hashes: pa.Array) -> pa.Array:
        return pa.array(ring.arcs(hashes.to_numpy(zero_copy_only=False)), pa.int32())

    text = F.coalesce("text", F.lit(""))
    keys = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        arc(F.xxhash64("doc_id")).alias("arc"),
        F.xxhash64(F.lit("order"), "doc_id", "text").alias("priority"),
    )
    keys = stored(keys, "ring-keys")
    rows = keys.count()
    cells = max(1, -(-rows // (shards * replicas * CELL_ROWS)))
    keys = keys.withColumn("cell", F.pmod("priority", F.lit(cells)))
    sizes = stored(keys.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n")), "ring-cells")
    counts = {r["arc"]: r["n"] for r in sizes.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    grants = ring.grants(counts, load_bounds(rows, shards, epsilon))
    before = F.sum("n").over(W.partitionBy("arc").orderBy("cell")) - F.col("n")
    starts = sizes.select("arc", "cell", before.alias("start"))
    in_cell = F.row_number().over(W.partitionBy("arc", "cell").orderBy("priority", "doc_id", "size", "text_crc32"))
    ranked = keys.withColumn("in_cell", in_cell - 1).join(starts, ["arc", "cell"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("in_cell"))
    table = docs.sparkSession.createDataFrame(grants, "g_arc int, low long, high long, shard int, first_slot long")
    inside = (F.col("arc") == F.col("g_arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    # At most shards * (replicas + 1) grants, whatever the data.
    placed = ranked.join(F.broadcast(table), inside)
    homes = F.array(*[F.lit(s) for s in ring.owners])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        homes[F.col("arc")].alias("home"),
        "shard",
        (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"),
    )
