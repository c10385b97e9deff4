import random

from pyspark.sql import functions as F

from tessera.operators import hierarchy as h

N = "id string, name string, qualified_name string, updated_at long, source string, depth int"
E = "source string, target string, kind string, line int, id string"


def run(spark, nodes, edges, paths=True):
    n = spark.createDataFrame([(i, f"n{i}", f"n{i}", 1, "clash", 9) for i in nodes], N)
    e = spark.createDataFrame([(a, b, "contains", 1, "clash") for a, b in edges], E)
    return n, e, h.hierarchy(n, e, paths=paths)


def brute(nodes, edges):
    ids = {i for i in nodes if i is not None}
    par = {}
    for a, b in edges:
        if a in ids and b in ids:
            par[b] = min(a, par.get(b, a))
    out = {}
    for x in ids:
        seen, y = [], x
        while y in par and y not in seen:
            seen.append(y)
            y = par[y]
        out[x] = (min(seen[seen.index(y) :]), -1) if y in seen else (y, len(seen))
    return out


def got(tree):
    return {r["id"]: (r["root_id"], r["depth"]) for r in tree.collect()}


def test_random_forests_with_loops(spark):
    rng = random.Random(3)
    for size in (1, 5, 60):
        nodes = [f"{i:03d}" for i in range(size)]
        edges = [(rng.choice(nodes), b) for b in nodes if rng.random() < 0.8] + [("gone", nodes[0]), (nodes[-1], None)]
        edges += edges[: size // 3]
        _, _, t = run(spark, nodes + nodes[:2] + [None], edges, paths=False)
        assert got(t) == brute(nodes, edges)


def test_long_chain_paths_and_descendants(spark):
    nodes = [f"{i:03d}" for i in range(70)]
    n, _, t = run(spark, nodes, list(zip(nodes, nodes[1:])))
    last = t.where("id = '069'").first()
    assert last["depth"] == 69 and last["names"] == [f"n{i}" for i in nodes] and last["ids"] == nodes
    assert h.descendants(t).count() == 70 * 69 // 2
    d = {r["id"]: r for r in h.described(n, t).collect()}
    assert d["000"]["n_descendants"] == 69 and d["069"]["n_descendants"] == 0 and d["001"]["path"] == "n000.n001"
    assert d["000"]["name_agrees"] and d["001"]["name_agrees"]


def test_loops_and_their_tails(spark):
    _, _, t = run(spark, list("abcdefz"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("z", "z")])
    assert got(t) == {"a": ("a", -1), "b": ("a", -1), "c": ("a", -1), "d": ("a", -1), "e": ("a", -1), "f": ("f", 0), "z": ("z", -1)}
    assert t.where("names is not null").count() == 1


def test_empty_tables(spark):
    _, _, t = run(spark, [], [])
    assert t.count() == 0
    _, _, t = run(spark, ["a"], [])
    assert got(t) == {"a": ("a", 0)}


def test_latest_row_names_and_smallest_parent(spark):
    n = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "b", 1), ("c", "c", None)], "id string, name string, updated_at long")
    e = spark.createDataFrame([("b", "c", "contains"), ("a", "c", "contains"), ("a", "b", "calls")], "source string, target string, kind string")
    rows = {r["id"]: r for r in h.hierarchy(n, e).collect()}
    assert rows["c"]["names"] == ["new", "c"] and rows["b"]["depth"] == 0
    assert h.parents(n, e).where("id = 'c'").select(F.col("n_parents")).first()[0] == 2
