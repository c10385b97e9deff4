"""Filling fixed-capacity containers.

All that packing needs to know of the items is how many there are of each size, a table
of at most ``capacity`` rows whatever the corpus. On it: items above a third of the
capacity, of which two at most fit a container, are paired greedily, the largest with the
largest that still fits; smaller ones, by falling size, go to the container with the
smallest gap that holds them, in bulk. The plan says which containers take the items of a
size by their rank; ranks come from counts per size and salt, so that a size held by a
third of all items is spread over many tasks.

Defined results: an item above the capacity is cut into full pieces and a rest; null
sizes count as 0; items of size 0 all share container 0; no two rows may have the same id
(equal ids get places of their own).
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import Scratch

CAPACITY = 2048
#: Items of one size that one task ranks, about.
PER_SALT = 1_000_000


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (size, first rank, first container, items of this size per container), and the number of containers."""
    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}
    rows: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    total = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first container, number)
    sizes: list[int] = []  # the gaps in order

    def put(size: int, first: int, n: int, each: int) -> None:
        rows.append((size, used.get(size, 0), first, each))
        used[size] = used.get(size, 0) + n

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        n = left[a]
        i = bisect_left(large, capacity - a + 1) - 1
        if i < 0:
            b, m = 0, n
        elif large[i] == a:
            b, m = a, n // 2
            if not m:
                # a single one left: pair it with a smaller one if there is
                b, m = (large[i - 1], 1) if i else (0, 1)
        else:
            b = large[i]
            m = min(n, left[b])
        put(a, total, m, 1)
        left[a] -= m
        if b:
            put(b, total, m, 1)
            left[b] -= m
        free(capacity - a - b, total, m)
        total += m
        large = [s for s in large if left[s]] if (not left[a] or (b and not left[b])) else large
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(sizes, s)
            if i == len(sizes):
                each = capacity // s
                m = max(1, n // each)
                first, gap, total = total, capacity, total + m
            else:
                gap = sizes[i]
                first, m = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(i)
            each = gap // s
            full = min(m, n // each)
            if full:
                put(s, first, full * each, each)
                n -= full * each
                free(gap - each * s, first, full)
            if full < m:
                if n and n < each:
                    put(s, first + full, n, n)
                    free(gap - n * s, first + full, 1)
                    free(gap, first + full + 1, m - full - 1)
                    n = 0
                else:
                    free(gap, first + full, m - full)
    return np.array(rows, np.int64).reshape(-1, 4), total


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(id_col, piece, start, size, container): pieces have sizes of at most capacity, containers at most capacity in all."""
    n = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    k = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    items = Scratch(items.sparkSession).save(items.select(id_col, size_col))  # sizes may be costly; they're read four times
    cut = items.select(id_col, n.alias("_n"), F.explode(F.sequence(F.lit(0), k - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    cut = cut.select(id_col, "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(capacity)).cast("int").alias("size"))
    sized = cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity + 1 rows at most
    counts = {r["size"]: r["n"] for r in sized}
    table, _ = plan(counts, capacity)
    salts = int(max(8, -(-sum(counts.values()) // PER_SALT)))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    per = cut.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("size", "salt").orderBy(id_col, "piece")) - 1
    ranked = cut.withColumn("local", local).join(before, ["size", "salt"]).select(id_col, "piece", "start", "size", (F.col("local") + F.col("before")).alias("rank"))
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    key = table[:, 0] * (1 << 44) + table[:, 1]

    def place(batches):
        for b in batches:
            size, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            if len(table):
                i = np.maximum(np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1, 0)
                box = np.where(size > 0, table[i, 2] + (rank - table[i, 1]) // table[i, 3], 0)
            else:
                box = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(box, pa.int64())], names=[*b.schema.names[:4], "container"])

    kind = dict(items.dtypes)[id_col]
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, size int, container long")


def containers(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_items, used, unused) of every container."""
    return placed.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))
