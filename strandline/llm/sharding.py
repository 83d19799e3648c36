"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, by DataFrame functions alone.

The ring has CELLS equal cells. A row's place is a hash of its doc_id, text checksum and size; each shard owns the arcs
that end at its virtual nodes. Rows enter in ring order; a row whose shard is full goes on clockwise to the next virtual
node whose shard still has room. Every shard's room is the row count divided by the shards, rounded up or down, so
counts differ by one at most (the law `rows`). Only the counts of cells (CELLS numbers, however many rows) reach the
driver, which walks the ring over counts and hands back, for each cell, which ranks go to which shard and slot.

Defined results: a null text has size 1 and checksum 0; a null doc_id hashes like a constant; repeated rows count each
and get slots of their own; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS, VIRTUAL_NODES = 8, 64
#: Cells of the ring: a power of two.
CELL_BITS = 14
CELLS = 1 << CELL_BITS
#: Rows of a cell that a task ranks, about.
RANKED = 100_000


def ring(spark: SparkSession, shards: int, virtual_nodes: int) -> list[int]:
    """The owner of each cell: of the first virtual node at or after it, clockwise. A smaller shard wins a shared cell."""
    nodes = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.shiftrightunsigned(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), 64 - CELL_BITS).alias("cell"),
    )
    at = {r["cell"]: r["shard"] for r in nodes.groupBy("cell").agg(F.min("shard").alias("shard")).collect()}
    owners, owner = [0] * CELLS, at[min(at)]
    for cell in reversed(range(CELLS)):
        owner = at.get(cell, owner)
        owners[cell] = owner
    return owners


def walk(counts: dict[int, int], owners: list[int], rooms: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) of each run of rows that go to one shard. `counts`: rows by cell;
    `rooms`: rows that each shard takes, in total as many as there are."""
    room, taken, out = list(rooms), [0] * len(rooms), []
    carried: deque[list[int]] = deque()  # runs (cell, first rank, end rank) on their way to a shard with room

    def take(shard: int) -> None:
        while carried and room[shard]:
            cell, first, end = carried[0]
            n = min(end - first, room[shard])
            out.append((cell, first, first + n, shard, taken[shard]))
            room[shard] -= n
            taken[shard] += n
            carried[0][1] += n
            if carried[0][1] == end:
                carried.popleft()

    for turn in range(2):  # what is still carried at the end of the ring goes on from its start
        for cell, owner in enumerate(owners):
            if turn == 0 and counts.get(cell):
                carried.append([cell, 0, counts[cell]])
            take(owner)
        if not carried:
            break
    for shard in range(len(rooms)):  # a shard without a virtual node of its own
        take(shard)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    ).withColumn("place", F.xxhash64("doc_id", "text_crc32", "size"))
    keyed = keyed.withColumn("cell", F.shiftrightunsigned("place", 64 - CELL_BITS).cast("int"))
    rows, _ = common.written(keyed.withColumn("salt", F.monotonically_increasing_id()), "keyed")

    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS at most
    total = sum(counts.values())
    rooms = [total // shards + (k < total % shards) for k in range(shards)]
    runs = json.dumps(walk(counts, ring(spark, shards, virtual_nodes), rooms))
    # A run for each cell, and one more for each time that a shard fills up in it: CELLS + 2 * shards rows, about.
    schema = "array<array<bigint>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(runs), schema)).alias("x")).select(
        F.col("x")[0].cast("int").alias("cell"), F.col("x")[1].alias("first"), F.col("x")[2].alias("end"),
        F.col("x")[3].cast("int").alias("shard"), F.col("x")[4].alias("slot0"),
    )
    # A cell's rows are ranked in parts of about RANKED rows, dealt by a number of each row, so that rows alike don't stand in
    # one task; the rows of the parts before are added. Only cells beyond RANKED rows have parts: CELLS rows at most.
    crowded = json.dumps([[cell, -(-n // RANKED)] for cell, n in counts.items() if n > RANKED])
    dealt = spark.range(1).select(F.explode(F.from_json(F.lit(crowded), schema)).alias("x")).select(F.col("x")[0].cast("int").alias("cell"), F.col("x")[1].alias("parts"))
    rows = rows.join(F.broadcast(dealt), "cell", "left").withColumn("part", F.pmod("salt", F.coalesce("parts", F.lit(1))))
    sizes = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    before = sizes.select("cell", "part", (F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("place", "doc_id")).cast("long") - 1
    ranked = rows.withColumn("rank", rank).join(before, ["cell", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    found = ranked.join(F.broadcast(table), "cell")
    return found.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.documents(spark, sf_dir))
