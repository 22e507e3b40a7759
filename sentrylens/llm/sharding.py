"""Shards from a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentrylens.llm.common import empty_if_null, staged

POSITIONS = 1 << 14
VIRTUAL_NODES = 32


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Points (position, shard) in clockwise order; a taken position goes to the next free one."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % POSITIONS
            while at in taken:
                at = (at + 1) % POSITIONS
            taken[at] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard takes at most; without slack they add up to all rows."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def bounded_loads(
    points: list[tuple[int, int]], loads: dict[int, int], room: list[int]
) -> list[tuple[int, int, int, int]]:
    """Spread the rows of each arc over shards: (arc, first rank, shard, first slot).

    Arc ``i`` ends at point ``i``. In round ``r`` every arc offers what it has left to the
    ``r``-th different shard clockwise of it, arcs in ring order; a shard takes what it has
    room for, and the rest goes on. The input is one number per point, not per row.
    """
    room, used = list(room), [0] * len(room)
    left = {a: n for a, n in loads.items() if n}
    ranks = dict.fromkeys(left, 0)
    walks = {}
    for a in left:
        order = [points[(a + i) % len(points)][1] for i in range(len(points))]
        walks[a] = list(dict.fromkeys(order))
    parts = []
    for r in range(len(room)):
        for a in sorted(left):
            shard = walks[a][r]
            take = min(left[a], room[shard])
            if take:
                parts.append((a, ranks[a], shard, used[shard]))
                ranks[a] += take
                used[shard] += take
                room[shard] -= take
                left[a] -= take
        left = {a: n for a, n in left.items() if n}
    return parts


def ring_shards(
    df: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = VIRTUAL_NODES,
    slack: float = 0.0,
) -> DataFrame:
    """Assign every row to a shard: ``doc_id, size, text_crc32, home_shard, shard, slot``.

    The ring key is the text: equal texts stand at one point and stay together as far as the
    capacity allows. With ``slack`` 0 the capacities add up to the number of rows and the row
    counts of two shards differ by one at most; with more, fewer rows leave their home shard.

    The rows of an arc are ranked in cells of about the square root of the table's rows:
    cell sizes are summed, then each cell is ranked alone, so a text that
    holds a third of the rows is ranked by many tasks. The driver sees one count per virtual node.

    A null text is empty (size 16); null ids are placed like others. Rows that share everything
    get different slots. An empty table gives an empty result; further columns are ignored.
    """
    n = df.count()
    points = ring(shards, virtual_nodes)
    places = [p for p, _ in points]
    arcs = [bisect_left(places, p) % len(points) for p in range(POSITIONS)]
    text = empty_if_null(F.col(text_col))
    cells = max(1, math.isqrt(n))

    def lookup(values: list[int], at: Column) -> Column:
        return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at)

    position = F.pmod(F.xxhash64(text), F.lit(POSITIONS)).cast("int")
    sized = df.select(
        F.col(id_col).alias("doc_id"),
        (F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(F.col(text_col))) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        position.alias("position"),
    )
    rows = staged(
        sized.select(
            "doc_id",
            "size",
            "text_crc32",
            lookup(arcs, F.col("position") + 1).alias("arc"),
            F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell"),
        )
    )
    counts = rows.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "arc",
        "cell",
        (F.sum("n").over(Window.partitionBy("arc").orderBy("cell")) - F.col("n")).alias("before"),
    )
    loads = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = bounded_loads(points, loads, capacities(n, shards, slack))
    by_arc: dict[int, list[str]] = {}
    for arc, first, shard, slot in parts:
        by_arc.setdefault(arc, []).append(f"named_struct('first', {first}L, 'shard', {shard}, 'slot', {slot}L)")
    quotas = df.sparkSession.sql(
        "SELECT * FROM VALUES "
        + ", ".join(f"({a}, array({', '.join(x)}))" for a, x in by_arc.items() or {-1: ["named_struct('first', 0L, 'shard', 0, 'slot', 0L)"]}.items())
        + " AS t(arc, parts)"
    )
    in_cell = Window.partitionBy("arc", "cell").orderBy("doc_id", "text_crc32", "size")
    part = F.element_at(F.filter("parts", lambda p: p["first"] <= F.col("rank")), -1)
    homes = [s for _, s in points]
    return (
        rows.withColumn("in_cell", F.row_number().over(in_cell) - 1)
        .join(before, ["arc", "cell"])
        .join(F.broadcast(quotas), "arc")
        .withColumn("rank", F.col("before") + F.col("in_cell"))
        .withColumn("part", part)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            lookup(homes, F.col("arc") + 1).alias("home_shard"),
            F.col("part.shard").alias("shard"),
            (F.col("part.slot") + F.col("rank") - F.col("part.first")).alias("slot"),
        )
    )
