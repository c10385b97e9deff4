import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import lattice, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_ids_and_normal_forms(spark):
    import hashlib

    assert one(spark, text.natural_id("a", "b"), a="k", b="v") == hashlib.sha1(b"k|v").hexdigest()[:16]
    assert one(spark, text.normalize_entity("a"), a="User_Accounts") == "useraccount"
    assert one(spark, text.normalize_entity("a"), a="bus") == "bus"
    assert one(spark, text.normalize_skill("a"), a="  Type \t Script ") == "type script"
    assert one(spark, text.trim_all("a"), a="\n\t x \r\n") == "x"
    assert one(spark, text.basename("a"), a="a/b/c.py") == "c.py"
    assert one(spark, text.first_line("a"), a="one\r\ntwo") == "one"


def test_clamp(spark):
    t = "".join(chr(97 + i % 26) for i in range(500))
    x = one(spark, text.clamp("a", 132), a=t)
    assert x.startswith(t[:50]) and x.endswith(t[-50:]) and "[trimmed 400 chars]" in x
    assert one(spark, text.clamp("a", 132), a="short") == "short"


def test_round_and_fragments(spark):
    assert one(spark, text.round2(F.lit(2.675))) == math.floor(2.675 * 100 + 0.5) / 100
    df = spark.createDataFrame([("a_b",), ("axb",), ("A_B%",)], "t string")
    assert {r[0] for r in df.where(text.contains_ci("t", "a_b")).collect()} == {"a_b", "A_B%"}


def test_full_text_equals_an_engine(spark):
    """Against the full-text engine of sqlite3, over generated rows and queries."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(a, b)")
    except sqlite3.OperationalError:
        pytest.skip("no full text in this sqlite")
    rng = random.Random(1)
    words = ["Redis", "état", "foo-bar", "src/foo", "cache", "naïve", "RED", "user_id", "x", "9", "foo", "bar", "Straße"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(120)]
    con.executemany("insert into f(rowid, a, b) values (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, a string, b string").cache()
    for q in ["redis", "ETAT", "foo-bar", "foo.bar", "src/foo cache", "red", "naive x", "???", "bar foo-bar", "user"]:
        match = " ".join('"' + t.replace('"', '""') + '"' for t in q.split())
        want = {r[0] for r in con.execute("select rowid from f where f match ?", (match,))}
        got = {r["id"] for r in df.where(text.full_text(["a", "b"], q)).collect()}
        assert got == want, q
    assert df.where(text.full_text(["a", "b"], "  ")).count() == len(rows)


def test_patterns(spark):
    t = "see ./README.md and src/foo/bar.ts:12:3, https://x.example/a/b.js JIRA-1234 GH-42"
    paths = one(spark, F.transform(F.regexp_extract_all(F.regexp_replace(F.lit(t), text.URL, " "), F.lit(text.PATH), 1), lambda x: F.regexp_replace(x, text.PATH_PLACE, "")))
    assert paths == ["./README.md", "src/foo/bar.ts"]
    odd = "C:\\src\\app\\main.mp4 and a/b.7z and /x/y.h5:3"
    assert one(spark, F.regexp_extract_all(F.lit(odd), F.lit(text.PATH), 1)) == ["C:\\src\\app\\main.mp4", "a/b.7z", "/x/y.h5:3"]
    assert one(spark, F.regexp_extract_all(F.lit("ABC-1234567890 x"), F.lit(text.TICKET), 1)) == ["ABC-1234567890"]
    log = "an error happened\nTypeError: x is not a function\n    at foo.bar (src/a.ts:10:5)\n  at <anonymous> b.js:3\nDone"
    assert one(spark, F.regexp_extract_all(F.lit(log), F.lit(text.ERROR), 0)) == ["TypeError: x is not a function"]
    assert [x.strip() for x in one(spark, F.regexp_extract_all(F.lit(log), F.lit(text.STACK_FRAME), 0))] == ["at foo.bar (src/a.ts:10:5)", "at <anonymous> b.js:3"]
    assert one(spark, F.regexp_extract_all(F.lit(t), F.lit(text.TICKET), 1)) == ["JIRA-1234", "GH-42"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_and_centroids(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", block)

    rng = np.random.default_rng(0)
    m = rng.standard_normal((40, 5)).astype("float32")
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(m)] + [(99, 0, None)], "i_id int, g int, i_vec array<float>")
    q = df.where("i_id < 4").select(F.col("i_id").alias("q_id"), F.col("i_vec").alias("q_vec"), "g")
    got = [(r["q_id"], r["i_id"]) for r in vectors.nearest(q, df, 3, 0.0, group="g").orderBy("q_id", "rank").collect()]
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = []
    for a in range(4):
        s = sorted(((float(n[a] @ n[b]), b) for b in range(40) if b % 3 != a % 3), key=lambda x: -x[0])
        want += [(a, b) for x, b in s[:3] if x >= 0]
    assert got == want
    best = sorted(((-float(n[a] @ n[b]), a, b) for a in range(4) for b in range(40) if b % 3 != a % 3))[:5]
    top = vectors.closest_pairs(q.selectExpr("q_id as i_id", "q_vec as i_vec", "g"), df, 5, 0.0, "g", "i_id", "i_vec").collect()
    assert [(r["q_id"], r["i_id"]) for r in top] == [(a, b) for _, a, b in best]
    c = {r["g"]: r for r in vectors.centroids(df, "g", "i_vec").collect()}
    assert c[0]["n_members"] == 15 and np.allclose(c[0]["centroid"], m[0::3].mean(axis=0), atol=1e-6)


def test_blocks_meet_in_many_tasks(spark, monkeypatch):
    """Blocks of one length spread over tasks; gaps, lengths, equal vectors and low bounds come out as by brute force."""
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (400, 6)).astype("float32")
    m[200:260], m[7] = m[3], 0
    rows = [(f"{i:03d}", i % 4, v.tolist()) for i, v in enumerate(m)] + [("x", 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("y", 1, [float("nan")] * 6), ("z", 2, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, g int, embedding array<float>").repartition(5)
    q = df.where("id < '040' or id in ('x', 'z')").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_vec"))
    i = df.select(F.col("id").alias("i_id"), F.col("embedding").alias("i_vec"))
    n = np.divide(m, (s := np.linalg.norm(m.astype(float), axis=1, keepdims=True)), out=np.zeros(m.shape), where=s > 0)
    s = np.round(n @ n.T, 9)
    for k, least in [(1, -1.5), (3, 0.9)]:
        want = {(a, r + 1): (b, x) for a in range(40) for r, (x, b) in enumerate(sorted(((s[a, b], b) for b in range(400) if b != a and s[a, b] >= least), key=lambda t: (-t[0], t[1]))[:k])}
        got = {(int(r["q_id"]), r["rank"]): (r["i_id"], round(r["score"], 9)) for r in vectors.nearest(q, i, k, least).collect()}
        assert {a: x for a, (_, x) in got.items()} == {a: x for a, (_, x) in want.items()}
        assert {a: int(b) for a, (b, _) in got.items() if a[0] == 3} == {a: b for a, (b, _) in want.items() if a[0] == 3}
    top = vectors.closest_pairs(df.where("id < '040'"), df, 3, 0.0, "g").collect()
    assert [(r["q_id"], r["i_id"], round(r["score"], 9)) for r in top] == [(f"{a:03d}", f"{b:03d}", -x) for x, a, b in sorted((-s[a, b], a, b) for a in range(40) for b in range(400) if a % 4 != b % 4)[:3]]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = [vectors.blocks(x, f"{c}_id", f"{c}_vec") for c, x in (("q", q), ("i", i))]
        met = vectors._pairs_of_blocks(*b, 3, 0.9, True, False, True, "string", "string")
        assert met.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_codec():
    b = vectors.encode_vector([1.0, -2.5])
    assert vectors.decode_vector(b) == [1.0, -2.5]
    assert vectors.decode_vector(b[1:]) is None and vectors.decode_vector(None) is None and vectors.decode_vector(b[:-1]) is None


def test_lattice(spark):
    df = spark.createDataFrame([("a", None, "technical", 1), ("a", "model", "meta", 2), ("a", "external", "meta", 3), ("a", None, "technical", 4), ("b", "model", None, 5)], "k string, grounding string, scope string, seq int")
    g = {r[0]: r[1] for r in df.groupBy("k").agg(lattice.dominant_grounding()).collect()}
    assert g == {"a": "stated", "b": "model"}
    assert {r["k"]: r["scope"] for r in lattice.dominant_scope(df, "k").collect()} == {"a": "technical", "b": None}
    d = spark.createDataFrame([("business_logic",), ("devops",), ("chitchat",), (None,)], "domain string")
    assert [r[0] for r in d.select(lattice.scope_from_domain()).collect()] == ["industry", "technical", "meta", "meta"]
