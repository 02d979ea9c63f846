"""Sharding by histogram sort: probe key boundaries, count exactly, refine, exchange once."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import whole_text, written

KEY_BITS = 62


def find_splitters(count: Callable[[list[tuple[int, int]]], dict[int, int]], total: int, shares: list[float], probes: int, tolerance: float) -> list[int]:
    """Keys that cut the total mass at the given shares.

    ``count`` takes disjoint key ranges (start, width of a cell) and returns the exact mass of each cell by its first key.
    Every round splits the cell around each open splitter into ``probes`` cells, until the mass below a boundary is within
    ``tolerance`` of the aim or a cell is one key wide.
    """
    width, found = 1 << KEY_BITS, {}
    cells = {i: (0, 0, width) for i in range(len(shares))}  # splitter: first key, mass below it, width
    while cells:
        step = {(lo, max(1, w // probes)) for lo, _, w in cells.values()}
        mass = count(sorted(step))
        after = {}
        for i, (lo, below, w) in cells.items():
            aim, cell = shares[i] * total, max(1, w // probes)
            edges, run = [(lo, below)], below
            for k in range(w // cell):
                run += mass.get(lo + k * cell, 0)
                edges.append((lo + (k + 1) * cell, run))
            at, near = min(edges, key=lambda e: (abs(e[1] - aim), e[0]))
            if abs(near - aim) <= tolerance or cell == 1:
                found[i] = at
                continue
            k = max(0, bisect_right([e[1] for e in edges], aim) - 1)
            k = min(k, len(edges) - 2)
            after[i] = (edges[k][0], edges[k][1], cell)
        cells = after
    return [found[i] for i in range(len(shares))]


def _place(keys: Column, bounds: list[int]) -> Column:
    """The number of boundaries at or below the key."""
    return sum((F.when(keys >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, probes: int = 1024, id_col: str = "doc_id", text_col: str = "text", blocks: int = 64, block_bytes: int = 1 << 26) -> DataFrame:
    """Deal rows into shards of nearly equal bytes; equal texts share a shard.

    A row weighs its UTF-8 bytes plus 8. Its key is a hash of the text, so equal texts have one key and all others spread
    evenly. Groups of copies above ``tolerance`` of a shard are few (at most ``shards / tolerance``, whatever the input);
    they go to the emptiest shard first, the largest group first. The other keys are cut where they fill the shards up:
    rounds of exact byte counts below candidate keys move the splitters until each is within ``tolerance`` of its aim. Only
    then the rows are exchanged, once, by shard and block; a block is a hash share of a shard's rows, so a group of copies
    of any size is split over the blocks. A shard has ``blocks`` of them, or as many as keep one near ``block_bytes``. The place of a block's
    first slot comes with a row of its own.

    Returns all rows with ``doc_id, text, size, shard, slot``; slots count from 0 within a shard without gaps. Null texts
    have no bytes, stay null and share a shard with empty ones. A group larger than a shard gets a shard of its own, and the others share the rest. Ids
    may repeat or be null; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"), "key": F.shiftrightunsigned(F.xxhash64(whole_text("text")), 64 - KEY_BITS)})
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("mass")), "shard-keys")
    total = groups.agg(F.sum("mass")).first()[0] or 0
    slack = max(1.0, tolerance * total / shards)
    heavy = {r["key"]: r["mass"] for r in groups.filter(F.col("mass") > slack).collect()}  # at most shards / tolerance rows
    load, home = [0] * shards, {}
    for key, mass in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        home[key] = load.index(min(load))
        load[home[key]] += mass
    light, level = total - sum(heavy.values()), sorted(load)
    for n in range(1, shards + 1):  # the level to which the light keys fill the shards up
        top = (light + sum(level[:n])) / n
        if n == shards or top <= level[n]:
            break
    room = [max(0.0, top - x) for x in load]
    shares = [sum(room[: i + 1]) / (sum(room) or 1) for i in range(shards - 1)]
    spark = docs.sparkSession
    heavy_rows = F.broadcast(spark.createDataFrame([(k, s) for k, s in home.items()], "key long, heavy_shard int"))
    blocks = max(blocks, math.ceil(max([total / shards, *heavy.values()]) / block_bytes))
    small = groups.join(heavy_rows, "key", "left_anti")

    def count(ranges: list[tuple[int, int]]) -> dict[int, int]:
        if not light:
            return {}
        inside = F.lit(None).cast("long")
        for lo, cell in ranges:
            span = cell * max(1, min(probes, (1 << KEY_BITS) // cell))
            inside = F.when((F.col("key") >= lo) & (F.col("key") < lo + span), F.lit(lo) + F.floor((F.col("key") - lo) / F.lit(cell)).cast("long") * cell if cell == 1 else F.lit(lo) + F.shiftright(F.col("key") - lo, int(math.log2(cell))) * cell).otherwise(inside)
        cells = small.withColumn("cell", inside).filter("cell is not null").groupBy("cell").agg(F.sum("mass").alias("mass"))
        return {r["cell"]: r["mass"] for r in cells.collect()}  # at most probes x (shards - 1) rows

    bounds = find_splitters(count, light, shares, probes, slack / 2) if light else [1 << KEY_BITS] * (shards - 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), F.lit(blocks)).cast("int"))
    rows = rows.join(heavy_rows, "key", "left").withColumn("shard", F.coalesce("heavy_shard", _place(F.col("key"), bounds))).drop("heavy_shard")
    sizes = written(rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")), "shard-blocks")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    kind = rows.schema["doc_id"].dataType
    firsts = firsts.select(F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("key"), "block", "shard", "first")
    both = rows.withColumn("first", F.lit(None).cast("long")).select(*firsts.columns).unionByName(firsts)
    inside = Window.partitionBy("shard", "block").orderBy("key", "doc_id")  # the row of the first slot has the smallest key
    numbered = both.withColumn("slot", (F.max("first").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(inside) - 2).cast("long"))
    return numbered.filter(F.col("key") >= 0).select("doc_id", "text", "size", "shard", "slot")
