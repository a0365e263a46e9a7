"""Shards of near equal size by minimax contiguous partition, with DataFrame operations only.

Rows with equal texts form an atomic group; the groups are ordered by the digest of their text. The smallest
capacity for which a greedy cut (each shard takes groups while they fit) needs at most n shards is
found by binary search, and the cuts of that capacity are taken.

The group sizes stay distributed as running totals. The search sees them through a grid of at most GRID cells:
the ends that are known exactly give a capacity that is feasible, cells taken as if a cut were possible anywhere
inside give one that is not; between the two, the k-th cut can only move inside a known window, because cuts grow
with the capacity. The next round lays the grid over these windows alone, until all ends in them are known. So
a few narrow aggregations give the exact result, whatever the number of groups.

Rows are ordered by (digest, id, place in the input) with a range partitioning, so a group that holds a third of all rows
is spread over tasks, also if its rows have no id or one id. Defined cases: a null text has the size 1 of an empty one and is in its group; rows that repeat
id and text get slots of their own; a null id comes first in its group; fewer groups than shards leave shards
empty; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from tallyrisk.llm.common import write_out

GRID = 4096


def in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with running totals of bytes and rows over the whole order, and whether a group ends with the row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("place"),
    )
    placed = write_out(rows.repartitionByRange("digest", "doc_id", "place").withColumn("chunk", F.spark_partition_id()), "shard-rows")
    # One row per task that wrote: what lies before it, and the digest that follows it.
    chunks = placed.groupBy("chunk").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("digest").alias("first")
    )
    order = Window.orderBy("chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        "chunk",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.lead("first").over(order).alias("follows"),
    )
    inside = Window.partitionBy("chunk").orderBy("digest", "doc_id", "place")
    total = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "digest",
        "chunk",
        F.sum("size").over(total).alias("bytes"),
        F.row_number().over(inside).cast("long").alias("rows"),
        F.lead("digest").over(inside).alias("next"),
    )
    following = F.coalesce("next", "follows")
    return local.join(offsets, "chunk").select(
        "doc_id",
        "size",
        "text_crc32",
        "chunk",
        (F.col("bytes") + F.col("bytes_before")).alias("end_bytes"),
        (F.col("rows") + F.col("rows_before")).alias("end_rows"),
        (following.isNull() | (following != F.col("digest"))).alias("group_end"),
    )


class Grid:
    """What is known of the group ends: exact ends, and spans in which further ends lie."""

    def __init__(self, ends: list[int], spans: list[tuple[int, int]]):
        self.ends = sorted({0, *ends})
        self.spans = sorted(spans)
        self.span_starts = [a for a, _ in self.spans]

    def cut(self, limit: int, hopeful: bool) -> int:
        """The last known end up to the limit; hopeful: a span counts as if each place in it were an end."""
        best = self.ends[bisect_right(self.ends, limit) - 1]
        if hopeful and (k := bisect_right(self.span_starts, limit) - 1) >= 0:
            best = max(best, min(limit, self.spans[k][1]))
        return best

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        places = [0]
        for _ in range(shards):
            places.append(max(places[-1], self.cut(places[-1] + capacity, hopeful)))
        return places[1:]

    def smallest(self, shards: int, total: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity whose greedy cuts reach the end."""
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low


def find_cuts(ends: DataFrame, shards: int) -> list[int]:
    """The places (in bytes) at which the first shards end. ``ends``: column end_bytes, one row per group."""
    total = ends.agg(F.max("end_bytes")).first()[0]
    if total is None:
        return []
    windows, known, unit = [(0, total)], {total}, 2 * total
    while True:
        # Each round at least halves the unit, and the windows are some units wide, so the cells stay few.
        unit = max(1, min(unit // 2, -(-sum(b - a + 1 for a, b in windows) // GRID)))
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("end_bytes").between(a, b)
        cells = (
            ends.where(inside)
            .groupBy(F.floor(F.col("end_bytes") / unit))
            .agg(F.min("end_bytes").alias("low"), F.max("end_bytes").alias("high"), F.count(F.lit(1)).alias("n"))
            .collect()
        )  # about GRID cells
        known |= {r[c] for r in cells for c in ("low", "high")}
        grid = Grid(list(known), [(r["low"], r["high"]) for r in cells if r["n"] > 2])
        feasible = grid.smallest(shards, total, hopeful=False)
        if not grid.spans:
            return grid.cuts(feasible, shards, hopeful=False)[:-1]
        at_least = grid.smallest(shards, total, hopeful=True)
        low, high = grid.cuts(at_least, shards, hopeful=False), grid.cuts(feasible, shards, hopeful=True)
        windows = _merged([(a, b) for a, b in zip(low, high)])


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... in each shard) of each row."""
    rows = write_out(in_order(docs, doc_id, text), "shard-order")
    ends = rows.where("group_end").select("end_bytes", "end_rows")
    cuts = sorted(set(find_cuts(ends, shards)))
    at_cuts = {r["end_bytes"]: r["end_rows"] for r in ends.where(F.col("end_bytes").isin(cuts)).collect()} if cuts else {}
    shard, before = F.lit(0), F.lit(0).cast("long")
    for k, cut in enumerate(cuts):
        past = F.col("end_bytes") > cut
        shard = F.when(past, F.lit(k + 1)).otherwise(shard)
        before = F.when(past, F.lit(at_cuts[cut]).cast("long")).otherwise(before)
    return rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("end_rows") - 1 - before).alias("slot"))
