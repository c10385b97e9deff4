"""Consolidating pairwise matches into groups.

Union-find runs inside bounded edge partitions and keeps of each only its spanning forest,
as stars around the smallest id. Forests are merged level by level: edges are laid out by
the (hashed) smaller of their ends, so that the neighbours of a node lie together and a
node of very many neighbours is spread over several partitions; union-find in the
partitions turns their nodes into components; and of a component only the nodes that
another partition holds, too, are handed on, as edges between components, to the next
level. Every component holds the smaller end of an edge, and each node is that in one
place, so every level leaves a third fewer nodes or better. Once the edges fit a partition,
one last union-find joins them, and the labels are read back through the levels. What fits
a partition from the start is the case of one level.

Defined results: pairs with a null end or both ends equal link nothing; repeated and
turned pairs count once; the group id is the smallest id of the group; ids without any
link are not part of the result; ids hold no character U+0001; empty input gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch

#: Edges that one task's union-find holds: about 200 bytes each.
BOUND = 1_000_000
#: Stands between the smallest id of a component and the places where it was formed.
SEP = "\x01"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (a, b), every node that isn't the smallest of its component, with that smallest."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)  # sorted, so the smaller code is the smaller id
    up = list(range(len(names)))
    for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist()):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x < y:
            up[y] = x
        elif y < x:
            up[x] = y
    for i in range(len(up)):  # parents are smaller, so one pass resolves all
        up[i] = up[up[i]]
    root = np.array(up, dtype=np.int64)
    nodes = np.nonzero(root != np.arange(len(root)))[0]
    return names[nodes], names[root[nodes]]


def _local(batches, bound: int, components: bool = False):
    """The spanning forests of up to ``bound`` edges at a time; with ``components`` every node with its component's name, unique to the place."""
    from pyspark import TaskContext

    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held, part = 0, 0

    def out():
        x, y = forest(np.concatenate(a).astype(str), np.concatenate(b).astype(str))
        if components:
            roots = np.unique(y)
            x, y = np.concatenate([x, roots]), np.concatenate([y, roots])
            mark = f"{SEP}{TaskContext.get().partitionId()}.{part}"
            y = np.char.add(y, mark) if len(y) else y
        return pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.string()), pa.array(y.tolist(), pa.string())], names=["node", "root"])

    for batch in batches:
        for k in range(0, batch.num_rows, bound):
            piece = batch.slice(k, bound)
            if held and held + piece.num_rows > bound:
                yield out()
                a, b, held, part = [], [], 0, part + 1
            a.append(piece.column(0).to_numpy(zero_copy_only=False))
            b.append(piece.column(1).to_numpy(zero_copy_only=False))
            held += piece.num_rows
    if held:
        yield out()


def _forests(edges: DataFrame, bound: int, components: bool = False) -> DataFrame:
    return edges.mapInArrow(lambda it: _local(it, bound, components), "node string, root string")


def connected(pairs: DataFrame, a: str = "a", b: str = "b", bound: int = BOUND) -> DataFrame:
    """(id, group_id) of every id that a pair links to another. ``bound``: edges in a partition, 16 at least."""
    bound = max(bound, 16)
    keep = Scratch(pairs.sparkSession)
    e = pairs.select(F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("root")).where("node <> root")
    e = keep.save(_forests(e, bound))
    n = e.count()
    levels: list[DataFrame] = []  # (node, root) of every level: root is one of the node's components
    while n > bound:
        x, y = F.xxhash64(F.lit(len(levels)), "node"), F.xxhash64(F.lit(len(levels)), "root")
        by = e.select("node", "root", F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).repartitionByRange(int(-(-n // bound)), "lo", "hi").select("node", "root")
        inside = keep.save(_forests(by, bound, True))
        keep.drop(e)
        per = inside.groupBy("node").agg(F.min("root").alias("first"), F.count(F.lit(1)).alias("n"))
        levels.append(keep.save(per.select("node", F.col("first").alias("root"))))
        shared = per.where("n > 1").select("node", "first")
        links = inside.join(shared, "node").where("root <> first").select(F.col("root").alias("node"), F.col("first").alias("root")).distinct()
        e = keep.save(_forests(links, bound))
        keep.drop(inside)
        n = e.count()
    e = keep.save(_forests(e.coalesce(1), bound))
    top = e.unionByName(e.select(F.col("root").alias("node"), "root").distinct())
    for level in reversed(levels):
        j = level.join(top.select(F.col("node").alias("root"), F.col("root").alias("label")), "root", "left")
        top = keep.save(j.select("node", F.coalesce("label", "root").alias("root")))
    return top.select(F.col("node").alias("id"), F.substring_index("root", SEP, 1).alias("group_id"))


def concept_groups(concepts: DataFrame, links: DataFrame, bound: int = BOUND) -> DataFrame:
    """(concept_id, group_id) of the concepts in groups of two or more: same_as links whose both ends exist."""
    ids = concepts.where("id is not null").select("id").distinct()
    same = links.where("kind = 'same_as' and a <> b").select("a", "b")
    same = same.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    return connected(same, bound=bound).select(F.col("id").alias("concept_id"), "group_id")


def all_concept_groups(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Every concept with its group; one that nothing links is its own."""
    g = concept_groups(concepts, links)
    return concepts.where("id is not null").select(F.col("id").alias("concept_id")).distinct().join(g, "concept_id", "left").withColumn("group_id", F.coalesce("group_id", "concept_id"))
