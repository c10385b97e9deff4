"""Parent-child links to full hierarchies.

A frontier join extends every node by the levels its ancestor already knows: in round k
each open node holds the ancestor pair ``(id, anc)`` that spans 2^k levels. If the
ancestor lies in the frontier (its root, depth and path are known), the node joins the
frontier; otherwise both pairs compose to one of 2^(k+1) levels. So the frontier covers
levels [0, 2^k) after k joins, a tree of depth d needs log2(d) of them, and a round that
reaches no node proves that the open rest runs in loops.

Defined results: null ids and links with a missing end are left out; links stored again
count once; a node with several parents takes the smallest (``n_parents`` tells); of
several rows of an id the latest by ``updated_at`` gives the name; a node on a loop or
below one has depth -1, the smallest id on that loop as root and a null path. Empty
tables give empty results; columns other than those named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch

#: Open rows of up to so many bytes in all are sent to all executors; more are shuffled.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row beside its ids and paths.
ROW_BYTES = 48
#: Stands between the names and ids of a path while it grows.
SEP = "\x01"


def _names(nodes: DataFrame) -> DataFrame:
    order = F.struct(*[F.col(c) for c in ("updated_at", "name") if c in nodes.columns])
    return nodes.where("id is not null").groupBy("id").agg(F.max_by("name", order).alias("name"))


def parents(nodes: DataFrame, edges: DataFrame, kind: str = "contains", names: bool = True) -> DataFrame:
    """One row per node: id, parent (null for roots), n_parents, inner (has children), with names also name."""
    ids = _names(nodes) if names else nodes.where("id is not null").select("id").distinct()
    links = edges.where((F.col("kind") == kind) & F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").distinct()
    up = links.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    above = up.select(F.col("source").alias("id")).distinct().withColumn("inner", F.lit(True))
    one = up.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"), F.count(F.lit(1)).cast("int").alias("n_parents"))
    return ids.join(one, "id", "left").join(above, "id", "left").withColumns({"n_parents": F.coalesce("n_parents", F.lit(0)), "inner": F.coalesce("inner", F.lit(False))})


def _state(links: DataFrame, paths: bool) -> DataFrame:
    """id, up (parent), anc, low (smallest id from the node up to before anc), done, depth, inner [, names, ids]."""
    root = F.col("parent").isNull()
    cols = [
        F.col("id"), F.col("parent").alias("up"), F.coalesce("parent", "id").alias("anc"), F.col("id").alias("low"),
        root.alias("done"), F.when(root, 0).otherwise(1).alias("depth"), F.col("inner"),
    ]
    if paths:
        cols += [F.coalesce("name", F.lit("")).alias("names"), F.col("id").alias("ids")]  # joined by SEP: smaller rows than arrays
    return links.select(*cols)


def _step(u: DataFrame, s: DataFrame, paths: bool, small: bool) -> DataFrame:
    """Open rows u joined with the states s of their ancestors."""
    s = s.select(*[F.col(c).alias("s_" + c) for c in s.columns if c not in ("up", "inner")])
    j = (F.broadcast(u) if small else u).join(s, F.col("anc") == F.col("s_id"))

    def both(c: str) -> Column:
        return F.concat("s_" + c, F.lit(SEP), c).alias(c)

    cols = [F.col("id"), F.col("up"), F.col("s_anc").alias("anc"), F.least("low", "s_low").alias("low"), F.col("s_done").alias("done"), (F.col("depth") + F.col("s_depth")).alias("depth"), F.col("inner")]
    return j.select(*cols, *([both("names"), both("ids")] if paths else []))


def hierarchy(nodes: DataFrame, edges: DataFrame, kind: str = "contains", paths: bool = True) -> DataFrame:
    """(id, root_id, depth, parent_id [, names array, ids array]) of every node; see the module for the defined cases."""
    spark = nodes.sparkSession
    keep = Scratch(spark)

    def measured(df: DataFrame) -> tuple[int, bool]:
        """Rows, and whether they are few enough to be broadcast."""
        wide = ["id", "up", "anc", "low", *(["names", "ids"] if paths else [])]
        got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.octet_length(c) for c in wide), F.lit(ROW_BYTES))).alias("b")).first()
        return got["n"], (got["b"] or 0) <= BROADCAST_BYTES

    start = keep.save(_state(parents(nodes, edges, kind, paths), paths))
    states = [start]  # every round's; what a node knows is in the last one that holds it
    closed = [start.where("done")]
    u = start.where("not done")
    n, small = measured(u)
    loops = None
    while n:
        # only nodes with children are anyone's ancestors: those done in earlier rounds, and all of the last
        seen = states[-1].where("inner")
        for x in states[:-1]:
            seen = seen.unionByName(x.where("inner and done"))
        nxt = keep.save(_step(u, seen, paths, small))
        reached = nxt.where("done")
        left, small = measured(nxt.where("not done"))
        if left == n:
            loops = nxt
            break
        closed.append(reached)
        u, n = nxt.where("not done"), left
        states.append(nxt)
    result = None
    for c in closed:
        c = c.select(F.col("id"), F.col("anc").alias("root_id"), F.col("depth"), F.col("up").alias("parent_id"), *([F.split("names", SEP).alias("names"), F.split("ids", SEP).alias("ids")] if paths else []))
        result = c if result is None else result.unionByName(c)
    if loops is None:
        return result
    # On loops: widen until every node names the same smallest id as its parent, which proves whole loops were seen.
    while True:
        seen = loops.select(F.col("id").alias("s_id"), F.col("low").alias("root_id"), F.col("anc").alias("s_anc"))
        named = keep.save(loops.select("id", "up", "anc", "low").join(F.broadcast(seen) if small else seen, F.col("anc") == F.col("s_id")).drop("s_id"))
        of_up = named.select(F.col("id").alias("up"), F.col("root_id").alias("up_root"))
        if named.join(of_up, "up").where("root_id <> up_root").isEmpty():
            break
        loops = named.select("id", "up", F.col("s_anc").alias("anc"), F.least("low", "root_id").alias("low"))
    looped = named.select("id", "root_id", F.lit(-1).alias("depth"), F.col("up").alias("parent_id"))
    if paths:
        none = F.lit(None).cast("array<string>")
        looped = looped.withColumns({"names": none, "ids": none})
    return result.unionByName(looped)


def descendants(tree: DataFrame) -> DataFrame:
    """Ancestor pairs (id, descendant_id, distance), distance at least 1, from hierarchy(paths=True)."""
    return (
        tree.where("depth > 0")
        .select(F.col("id").alias("descendant_id"), "depth", F.posexplode("ids").alias("at", "id"))
        .where("at < depth")
        .select("id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
    )


def described(nodes: DataFrame, tree: DataFrame, sep: str = ".") -> DataFrame:
    """Every node with its path of names, whether qualified_name ends that path, and its number of descendants."""
    counts = descendants(tree).groupBy("id").agg(F.count(F.lit(1)).alias("n_descendants"))
    order = F.struct("updated_at", "qualified_name")
    q = nodes.where("id is not null").groupBy("id").agg(F.max_by("qualified_name", order).alias("qualified_name"))
    path = F.array_join("names", sep, "")
    agrees = (F.col("path") == F.col("qualified_name")) | F.col("path").endswith(F.concat(F.lit(sep), "qualified_name"))
    return (
        tree.withColumn("path", path)
        .join(q, "id", "left")
        .join(counts, "id", "left")
        .select("id", "parent_id", "root_id", "depth", "path", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), F.coalesce(agrees, F.lit(False)).alias("name_agrees"))
    )
