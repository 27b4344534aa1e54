"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``RING_CELLS`` cells; every shard owns ``vnodes`` cells' starts on
it and a key belongs to the first virtual node at or after its cell.  Spark
counts the rows per cell, the driver walks that fixed number of counts once
(its size depends on the ring alone, not on the data) and writes down, for each
cell, which share of its rows stays and which share moves on clockwise; Spark
then ranks the rows within their cell and reads shard and slot off that plan.

A shard's own keys come first, in ring order, up to its capacity.  Keys over it
continue clockwise to the next shard with room.  Only those keys move, so the
movement is the overflow and no more.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING_CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of the virtual nodes; a cell hit twice goes to the
    smaller shard."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % RING_CELLS
            at[cell] = min(s, at.get(cell, s))
    return sorted(at.items())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows a shard may hold.  With no slack they add up to the total and are
    at most one apart."""
    if slack > 0:
        return [int((1 + slack) * total / shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def plan_cells(counts: dict[int, int], nodes: list[tuple[int, int]], caps: list[int]) -> list[tuple]:
    """(cell, first rank, last rank + 1, shard, slot of the first rank) for the
    rows of each cell, ranks counted from 0 within the cell."""
    starts, load, plan, over = [c for c, _ in nodes], [0] * len(caps), [], []
    for cell in sorted(counts):
        k = bisect_left(starts, cell) % len(nodes)
        shard = nodes[k][1]
        stay = min(counts[cell], caps[shard] - load[shard])
        if stay:
            plan.append((cell, 0, stay, shard, load[shard]))
            load[shard] += stay
        if stay < counts[cell]:
            over.append((cell, stay, k))
    room = sum(c - x for c, x in zip(caps, load))
    for cell, rank, k in over:
        while rank < counts[cell]:
            if not room:
                raise ValueError("capacities below the number of rows")
            shard = nodes[k][1]
            take = min(counts[cell] - rank, caps[shard] - load[shard])
            if take:
                plan.append((cell, rank, rank + take, shard, load[shard]))
                load[shard], rank, room = load[shard] + take, rank + take, room - take
            k = (k + 1) % len(nodes)
    return plan


def shard_rows(rows: DataFrame, key: Column, tie: list[str], shards: int, *, vnodes: int = 64,
               slack: float = 0.0, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``rows`` with ``shard_col`` (0 to shards - 1) and ``slot_col`` (0 to the
    shard's row count - 1, without gaps).

    ``key`` places a row on the ring, ``tie`` names the columns that order rows
    of one cell (give enough to tell rows apart; rows alike in all of them are
    interchangeable).  ``slack`` 0 makes shard sizes differ by one row at most,
    slack e bounds each by (1 + e) times the mean.  A null key is a key like any
    other.  Columns of the same name as the results are replaced; an empty
    table gives no rows.
    """
    spark = rows.sparkSession
    rows = rows.drop(shard_col, slot_col)
    rows = rows.withColumns({"_pos": F.xxhash64(key), "_cell": F.pmod(F.xxhash64(key), F.lit(RING_CELLS)).cast("int")})
    counts = {r["_cell"]: r["n"] for r in rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_cells(counts, ring(shards, vnodes), capacities(sum(counts.values()), shards, slack))
    # at most one entry per ring cell and one more per shard boundary: a size fixed by the ring
    cells = spark.createDataFrame(plan, "_cell int, _lo long, _hi long, _shard int, _slot long")
    cells = cells.groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi", "_shard", "_slot"))).alias("_plan"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_pos", *tie)).cast("long") - 1)
    part = F.filter("_plan", lambda p: (p["_lo"] <= F.col("_rank")) & (F.col("_rank") < p["_hi"]))[0]
    return (ranked.join(F.broadcast(cells), "_cell").withColumn("_part", part)
            .withColumns({shard_col: F.col("_part._shard"), slot_col: F.col("_part._slot") + F.col("_rank") - F.col("_part._lo")})
            .drop("_pos", "_cell", "_plan", "_rank", "_part"))
