from tessera.operators import enrichment as en


def test_profiled_skills(spark):
    a = spark.createDataFrame([("p", [("React", "uses react-dom"), ("Rust", "feels rusty"), ("Go", " ")])], "project_id string, skills array<struct<name: string, evidence: string>>")
    d = spark.createDataFrame([("p", "React"), ("p", "docker")], "project_id string, title string")
    assert [(r["name"], round(r["confidence"], 3)) for r in en.profiled_skills(a, d).collect()] == [("React", 0.333)]


def test_industries_and_items(spark):
    a = spark.createDataFrame([("p", "Retail", 0.8, ["x"]), ("q", "Retail", 0.8, [" "]), ("r", "unknown", 0.9, ["x"]), ("s", "Health", 0.5, None)], "project_id string, industry string, confidence double, evidence array<string>")
    assert {(r["project_id"], r["grounding"]) for r in en.industry_facts(a).collect()} == {("p", "corroborated"), ("q", "stated"), ("s", "stated")}
    items = [(f"t{i}", "d", "b") for i in range(20)] + [("x", "", "b")]
    ans = spark.createDataFrame([("Retail", items)], "industry string, items array<struct<title: string, description: string, basis: string>>")

    class Web:
        def lookup(self, q):
            return ("https://x.example/" + q, "s" * 900) if q == "t1" else None

    cache = spark.createDataFrame([], "query_hash string, query string, source_url string, snippet string, fetched_at timestamp")
    full = en.research(en.industry_items(ans).withColumnRenamed("title", "query"), cache, Web(), "2024-01-01")
    assert full.count() == 15 and full.where("source_url is not null").first()["snippet"] == "s" * 600
    assert en.research(full, full, None, "2024-01-01").count() == 15 and en.research(full.select("query"), full, Web(), "2024-01-01").count() == 15
    got = {r["title"]: r["grounding"] for r in en.industry_items(ans, full).collect()}
    assert len(got) == 15 and got["t1"] == "external" and got["t2"] == "model"


def test_cluster_actions(spark):
    c = spark.createDataFrame([("f", "1"), ("f", "2")], "fact_id string, cluster_id string")
    a = spark.createDataFrame([("f", "merge", "1", "2"), ("f", "merge", "1", "9"), ("f", "attach", "2", None), ("g", "attach", "1", None), ("h", None, None, None)], "fact_id string, action string, cluster_id string, other_id string")
    assert [(r["action"], r["cluster_id"], r["other_id"]) for r in en.cluster_actions(a, c).orderBy("fact_id", "action").collect()] == [("attach", "2", None), ("create", None, None), ("merge", "1", "2"), ("create", None, None), ("create", None, None)]


def test_duplicates(spark):
    w = spark.createDataFrame([("a", "the cache was flushed by the worker"), ("b", "the cache was flushed by the worker"), ("c", "something else entirely here"), ("d", None), ("e", "the cache was flushed by the worker")], "id string, text string")
    e = en.hash_embedding(w, "id", "text")
    batch = e.where("id in ('a', 'b', 'c', 'd')")
    d = en.duplicates(batch, e)
    assert {(r["window_id"], r["dup_of"]) for r in d.collect()} == {("a", "e"), ("b", "e")}
    labels = spark.createDataFrame([("a", "why", None), ("c", None, None)], "window_id string, rationale string, dup_of string")
    assert {r["rationale"] for r in en.rationale(en.mark_duplicates(labels, d)).collect()} == {"why [dup_of:e]", ""}
