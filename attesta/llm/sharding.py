"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""
from __future__ import annotations

import json
import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from attesta.llm.common import keep, table


def ring(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; points come from the shard's and node's numbers alone."""
    points = [(zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(vnodes)]
    return sorted((p * cells >> 32, s) for p, s in points)


def flows(counts: dict[int, int], shards: int, vnodes: int, cells: int, capacity: list[int]) -> list[dict]:
    """How many rows of each ring cell go to which shard, and from which slot on.

    First every shard takes rows of its own arcs, clockwise, up to its capacity.  What finds its shard
    full walks on clockwise to the next shard with room.  Works on the counts of the cells, so it takes
    `cells` numbers however many rows there are.
    """
    nodes = ring(shards, vnodes, cells)
    starts = [c for c, _ in nodes]
    room, parts, over = list(capacity), {}, []
    for cell in sorted(counts):
        at = bisect_left(starts, cell) % len(nodes)
        home, n = nodes[at][1], counts[cell]
        took = min(n, room[home])
        room[home] -= took
        parts[cell] = [(home, took)] if took else []
        if n > took:
            over.append((cell, at, n - took))
    for cell, at, n in over:
        while n:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            took = min(n, room[shard])
            if took:
                room[shard] -= took
                parts[cell].append((shard, took))
                n -= took
    used, out = [0] * shards, []
    for cell, pieces in parts.items():
        first = 0
        for shard, n in pieces:
            out.append({"cell": cell, "first": first, "last": first + n, "shard": shard, "slot0": used[shard]})
            first, used[shard] = first + n, used[shard] + n
    return out


def assign_shards(docs: DataFrame, shards: int = 8, vnodes: int = 128, cells: int = 1 << 14, slack: float = 0.0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, size, text_crc32, shard, slot) for every row of docs.

    A row stands on the ring at a hash of its id and its text's checksum.  It goes to the shard of the
    next virtual node clockwise; a full shard's surplus walks on.  A shard holds at most
    ceil((1 + slack) * rows / shards) rows; without slack the capacities add up to the rows, so counts
    differ by one at most.  Slots are gapless from 0 in each shard.

    Only the counts of the ring's cells (at most `cells` numbers, a parameter) reach the driver, and
    only the table of flows made from them (at most cells + shards * overflowing cells rows) is broadcast.
    Rows are ranked inside their cell, so no task sees a whole shard; equal rows are counted first and
    spread out again at the end, so a row that repeats often makes no hot cell.

    Null text: size 1, checksum 0.  Null id: placed by its text.  Repeated rows: each gets a slot.
    Empty table: no rows.  Other columns are not read; a clash of names cannot arise.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    one = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                      F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"))
    place = F.xxhash64(F.lit("ring"), F.col("id"), F.col("crc"))
    rows = keep(one.groupBy("id", "size", "crc").agg(F.count("*").alias("n")).withColumn("place", place)
                .withColumn("cell", F.pmod(F.col("place"), F.lit(cells)).cast("int")))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    most = [-(-int(total * (1 + slack) + 0.5) // shards)] * shards
    if not slack:
        most = [total // shards + (s < total % shards) for s in range(shards)]
    plan = flows(counts, shards, vnodes, cells, most)
    flow = spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps(plan)), "array<struct<cell: int, first: bigint, last: bigint, shard: int, slot0: bigint>>")))
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("place", "id", "crc", "size")
                           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("to", upto).withColumn("from", F.col("to") - F.col("n"))
    placed = ranked.join(F.broadcast(flow), "cell").where("`from` < last and `to` > first")
    low, high = F.greatest("from", "first"), F.least("to", "last")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.explode(
        F.sequence(F.col("slot0") + low - F.col("first"), F.col("slot0") + high - F.col("first") - 1)).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts."""
    return digest(assign_shards(table(spark, sf_dir, "documents")))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
