import datetime as dt
import random

from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import code, concepts, facts, graph, incremental, links, model, mutate, skills, triage, windows


def test_upsert_keeps_fills_and_repeats(spark, same):
    old = spark.createDataFrame([("a", "t1", "c1", "s"), ("b", "t2", None, "s")], "id string, title string, cluster string, scope string")
    new = spark.createDataFrame([("a", "T1", "c9", None), ("c", "T3", "c3", "x")], "id string, title string, cluster string, scope string")
    out = mutate.upsert(old, new, ["id"], keep=["cluster"], fill=["scope"])
    rows = {r["id"]: tuple(r) for r in out.collect()}
    assert rows == {"a": ("a", "T1", "c1", "s"), "b": ("b", "t2", None, "s"), "c": ("c", "T3", "c3", "x")}
    assert same(mutate.upsert(out, new, ["id"], keep=["cluster"], fill=["scope"])) == same(out)


def test_other_changes_are_idempotent(spark, same):
    a = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "k string, v int")
    b = spark.createDataFrame([("p", 9), ("r", 7), ("r", 7)], "k string, v int")
    one = mutate.insert_absent(a, b, ["k"])
    assert same(one) == same(mutate.insert_absent(one, b, ["k"])) and one.count() == 4
    two = mutate.replace_partition(a, b, "k")
    assert sorted(tuple(r) for r in two.collect()) == [("p", 9), ("q", 3), ("r", 7), ("r", 7)]
    assert same(two) == same(mutate.replace_partition(two, b, "k"))
    assert mutate.cascade(a, "k", b, "k").count() == 2 and mutate.delete_keys(a, b, "k", "k").count() == 1
    p = mutate.patch(a, spark.createDataFrame([("p", None), ("q", 5)], "k string, v int"), ["k"])
    assert sorted(r["v"] for r in p.collect()) == [1, 2, 5]
    l = mutate.latest(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 1, "z")], "id string, t int, v string"), ["id"], ["t"])
    assert {(r["id"], r["v"]) for r in l.collect()} == {("a", "y"), (None, "z")}


def fold(turns, most, chars):
    """The windows of one conversation by a plain loop."""
    out, cur, size = [], [], 0

    def flush():
        if any(r == "user" for _, r, _ in cur) and any(r in ("assistant", "tool") for _, r, _ in cur):
            out.append((cur[0][0], cur[-1][0]))

    for i, r, t in turns:
        if r == "user":
            flush()
            cur, size = [], 0
        cur.append((i, r, t))
        size += len(t)
        if len(cur) >= most or size >= chars:
            flush()
            cur, size = [], 0
    flush()
    return out


def test_windows_equal_the_fold(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(60):
        t = [(i, rng.choice(["user", "assistant", "tool", "system"]), "x" * rng.randint(0, 12)) for i in range(rng.randint(0, 25))]
        rows += [(f"s{s}", i, r, x, None) for i, r, x in t]
        # what begins without a user turn never becomes a window
        first = next((k for k, x in enumerate(t) if x[1] == "user"), len(t))
        want[f"s{s}"] = fold(t[first:], 4, 30)
    df = spark.createDataFrame(rows, "session_id string, idx int, role string, text string, ts timestamp")
    windows.BLOCK, keep = 5, windows.BLOCK
    try:
        got = {}
        for r in windows.segment(windows.clean(df), 4, 30).collect():
            got.setdefault(r["session_id"], []).append((r["start_idx"], r["end_idx"]))
    finally:
        windows.BLOCK = keep
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_windows_are_stable_and_clean(spark):
    df = spark.createDataFrame([("s", 0, " User ", "hi", None), ("s", 0, "user", "hi", None), ("s", 1, "ASSISTANT", None, None), ("s", None, "user", "x", None), (None, 0, "user", "x", None), ("s", 2, "robot", "x", None)], "session_id string, idx int, role string, text string, ts timestamp")
    a, b = windows.segment(windows.clean(df)).collect(), windows.segment(windows.clean(df)).collect()
    assert a == b and len(a) == 1 and a[0]["text"] == "[user] hi\n\n[assistant]"
    assert windows.segment(windows.clean(df.limit(0))).count() == 0


def test_keep_and_routes(spark):
    rows = [("on_topic", "chitchat", "noise", "this_project", 0.95, False), ("on_topic", "chitchat", "decision_grade", "this_project", 0.8, True), ("off_topic", "devops", "signal", "this_project", 0.59, True), (None, None, None, None, None, True)]
    df = spark.createDataFrame(rows, "relevance string, domain string, quality string, linkage string, confidence double, want boolean")
    assert df.where(triage.keep() != F.col("want")).count() == 0
    r = spark.createDataFrame([("business_logic", "boilerplate"), ("debugging", "signal"), ("chitchat", "signal")], "domain string, quality string").select(triage.routes().alias("r")).collect()
    assert [set(x["r"]) for x in r] == [{"businessLogic", "intent"}, {"decision", "intent", "problemSolution"}, set()]


def test_evidence(spark):
    t = "look\n```bash\n$ npm test\nls -la\n```\nsrc/foo/bar.ts:3 and ABC-12 ABC-12 https://e.example/x/y.js\n$ make all\n```ts\nconst a = 'src/in/fence.ts';\n```\nValueError: boom"
    e = facts.evidence(spark.createDataFrame([("w", t), ("n", None)], "id string, text string"))
    got = {}
    for r in e.collect():
        got.setdefault(r["kind"], []).append(r["title"])
    assert sorted(got["code_block"]) == ["bash", "ts"] and sorted(got["shell_command"]) == ["ls -la", "make all", "npm test"]
    assert got["path_mention"] == ["src/foo/bar.ts"] and got["ticket_id"] == ["ABC-12"] and got["url"] == ["https://e.example/x/y.js"] and got["error_message"] == ["ValueError: boom"]
    f, p = facts.syntax_facts(spark.createDataFrame([("w", t)], "id string, text string"))
    assert p.join(f, p["k_node_id"] == f["id"], "left_anti").count() == 0


def test_path_and_symbol_resolution(spark):
    files = spark.createDataFrame([("src/a/x.ts",), ("lib/a/x.ts",), ("src/b.ts",), (None,)], "path string")
    m = spark.createDataFrame([("src/b.ts",), ("b.ts",), ("a/x.ts",), ("src/a/x.ts",), ("no.ts",), ("",), (None,)], "mention string")
    assert {tuple(r) for r in facts.resolve_paths(m, files).collect()} == {("src/b.ts", "src/b.ts"), ("b.ts", "src/b.ts"), ("src/a/x.ts", "src/a/x.ts")}
    n = spark.createDataFrame([(f"{i}", "function", "Foo") for i in range(7)] + [("f", "file", "foo")], "id string, kind string, name string")
    assert [r["node_id"] for r in facts.resolve_symbols(spark.createDataFrame([("foo",)], "name string"), n).orderBy("rank").collect()] == list("01234")


def test_mentions_by_any_length(spark):
    e = spark.createDataFrame([("tier",), ("accounts table",), ("zz",), ("100%",), (None,), (" ",)], "title string")
    t = spark.createDataFrame([("The Accounts Table is old, FRONTIER too",), ("at 100% load",), (None,)], "text string")
    assert {r["title"] for r in facts.mentioned(e, t).collect()} == {"tier", "accounts table", "100%"}


def test_calls(spark):
    n = spark.createDataFrame([("1", "function", "a"), ("2", "method", "b"), ("3", "function", "b"), ("4", "class", "c")], "id string, kind string, name string")
    r = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c")], "from_node_id string, reference_name string")
    got = {q["reference_name"]: (q["n"], q["target"], q["candidates"]) for q in graph.resolve_calls(r, n).collect()}
    assert got == {"a": (1, "1", None), "b": (2, None, ["2", "3"]), "c": (0, None, None)}


def test_domain_from_definitions(spark):
    """Three tables and a stub, three foreign keys: entities, one external, gaps."""
    sql = """CREATE TABLE accounts (id INT PRIMARY KEY, tier_id INT REFERENCES tier(id));
    CREATE TABLE users (id INT, account_id INT REFERENCES accounts(id));
    CREATE TABLE users_accounts (u INT, CONSTRAINT fk FOREIGN KEY (u) REFERENCES users (id));
    CREATE FUNCTION f() RETURNS INT AS $$ begin; select 1; end; $$ LANGUAGE plpgsql;
    ALTER TABLE users ADD COLUMN created_at TIMESTAMP;"""
    nodes, edges, refs = code.extract(spark.createDataFrame([("s.sql", "sql", sql)], "path string, language string, content string"))
    rel, stubs = code.table_references(refs, nodes)
    tables = nodes.where("kind = 'table'").select("id", "kind", "name", "signature").unionByName(stubs.select("id", "kind", "name", "signature"))
    ents = graph.entities(tables)
    assert {(r["name_lc"], r["external"]) for r in ents.collect()} == {("accounts", False), ("users", False), ("users_accounts", False), ("tier", True)}
    every = edges.select("source", "target", "kind", "metadata", "line").unionByName(rel)
    fk = graph.foreign_keys(every, tables)
    assert {(r["source_entity"], r["target_entity"]) for r in fk.collect()} == {("accounts", "tier"), ("users", "accounts"), ("users_accounts", "users")}
    assert [tuple(r) for r in graph.external_gaps(ents, fk).collect()] == [("tier", "accounts")]
    central = ents.where("not external").select("title")
    rules = spark.createDataFrame([("Accounts must be unique", None)], "title string, summary string")
    assert {r["title"] for r in graph.ungoverned(central, rules).collect()} == {"users", "users_accounts"}
    fields = {r["qualified_name"] for r in nodes.where("kind = 'field'").collect()}
    assert {"accounts.id", "accounts.tier_id", "users.created_at", "users_accounts.u"} <= fields and nodes.where("kind = 'function'").count() == 1


def test_reconcile(spark):
    s = spark.createDataFrame([("c1", "Account"), ("c2", "!!")], "id string, title string")
    t = spark.createDataFrame([("s2", "accounts"), ("s1", "accounts")], "id string, title string")
    p = graph.reconcile(s, t)
    assert [tuple(r) for r in p.collect()] == [("c1", "s1", "account")]
    f = spark.createDataFrame([("c1", None, None), ("s1", "structural", None), ("x", None, "meta")], "id string, grounding string, scope string")
    assert {tuple(r) for r in graph.corroborate(f, p).collect()} == {("c1", "corroborated", "industry"), ("s1", "corroborated", "industry"), ("x", None, "meta")}


def test_prune_and_supersede(spark):
    f = spark.createDataFrame([("a", 0.2, None), ("b", 0.2, "c"), ("c", 0.9, None), ("d", 0.1, None), ("e", 0.1, None)], "id string, confidence double, cluster_id string")
    e = spark.createDataFrame([("d", "x")], "source string, target string")
    l = spark.createDataFrame([("e",)], "k_node_id string")
    assert [r["id"] for r in graph.prune_orphans(f, e, l).collect()] == ["a"]
    v = spark.createDataFrame([("d1", "d2", "b_supersedes_a", 0.9), ("x", "y", "contradicts", 0.7), ("x", "z", "contradicts", 0.5)], "a string, b string, verdict string, confidence double")
    assert {tuple(r) for r in graph.supersede(v).collect()} == {("d2", "d1", "supersedes"), ("x", "y", "contradicts")}


def test_mechanical_links(spark):
    c = spark.createDataFrame([("1", "p", "session caching", "d"), ("2", "q", "Session Caching", "d"), ("3", "q", "session caching", None), ("4", "p", "unique", "d"), ("5", "p", None, "d")], "id string, project_id string, name string, domain string")
    assert {(r["id"], r["n_links"], r["n_same_domain"]) for r in links.mechanical_degrees(c).collect()} == {("1", 2, 1), ("2", 1, 1), ("3", 1, 0)}
    assert {tuple(r) for r in links.mechanical(c.where("id = '1'"), c).collect()} == {("1", "2", 0.8), ("1", "3", 0.6)}
    li = spark.createDataFrame([("1", "2", "same_as", 0.6, "m"), ("3", "1", "same_as", 0.6, "m"), ("1", "1", "same_as", 1.0, "m")], "a string, b string, kind string, score double, source string")
    assert {r["other"] for r in links.other_side(li, F.lit("1")).collect()} == {"2", "3"}


def test_skills_last_write_wins_and_cleaning(spark):
    files = spark.createDataFrame([("p", "typescript"), ("p", "typescript"), ("q", "unknown")], "project_id string, language string")
    f = spark.createDataFrame([("p", "dependency", "TypeScript", None), ("q", "dependency", "react", None), ("p", "dependency", "react", "model"), ("p", "skill", "leftpad", None)], "project_id string, kind string, title string, grounding string")
    ev = skills.last_wins(skills.evidence(files, f))
    s = {r["name"]: r for r in skills.synthesize(ev).collect()}
    assert s["react"]["project_count"] == 2 and s["react"]["grounding"] == "stated" and s["leftpad"]["evidence_weight"] == 3.0
    same_name = skills.last_wins(skills.evidence(files, spark.createDataFrame([("p", "dependency", "typescript", None)], "project_id string, kind string, title string, grounding string")))
    assert [r["weight"] for r in same_name.collect()] == [0.5]
    projects = spark.createDataFrame([("p",), ("q",)], "id string")
    cs = spark.createDataFrame([("1", "p"), ("2", "q"), ("3", "q")], "id string, project_id string")
    ls = spark.createDataFrame([("1", "2"), ("2", "3")], "a string, b string")
    out = skills.clean_project("p", projects, cs, ls, ev)
    assert [tuple(r) for r in out["links"].collect()] == [("2", "3")] and {r["name"] for r in out["skills"].collect()} == {"react"}


def test_fold_against_a_loop(spark):
    rows = [("p", "a", 1, [1.0, 0.0]), ("p", "b", 2, [0.9, 0.1]), ("p", "c", 3, [0.0, 1.0]), ("q", "d", 1, [1.0, 0.0]), ("p", "e", 4, None)]
    df = spark.createDataFrame(rows, "project_id string, id string, t int, v array<float>")
    assert {(r["id"], r["cluster"]) for r in concepts.fold(df, "project_id", "t", "v").collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    cen = spark.createDataFrame([("x", [1.0, 0.0])], "k string, centroid array<double>")
    assert {(r["id"], r["cluster"]) for r in concepts.assign(df, cen, "v").collect()} == {("a", "x"), ("b", "x"), ("c", None), ("d", "x"), ("e", None)}


def test_fold_of_a_large_group(spark):
    """A group of more than 50,000 facts beside a small one, order null at times, against a plain loop."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = (np.eye(4)[rng.integers(0, 4, 50_300)] + rng.normal(0, 0.3, (50_300, 4))).astype("float32")
    rows = [("p" if i >= 300 else "q", f"{i:06d}", int(t) if t else None, x.tolist()) for i, (t, x) in enumerate(zip(rng.integers(0, 1000, len(v)), v))]
    want = set()
    for g in "pq":
        sums, counts, names = np.zeros((0, 4)), np.zeros(0), []
        for _, i, _, x in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, r[2] or 0, r[1])):
            c = sums / counts[:, None]
            s = c @ x / (np.linalg.norm(c, axis=1) * np.linalg.norm(x))
            if not names or s.max() < 0.55:
                sums, counts, names = np.vstack([sums, np.zeros(4)]), np.append(counts, 0), [*names, i]
                s = np.append(np.full(len(names) - 1, -2), 1)
            at = int(s.argmax())
            sums[at] += x
            counts[at] += 1
            want.add((g, i, names[at]))
    got = concepts.fold(spark.createDataFrame(rows, "project_id string, id string, t int, v array<float>"), "project_id", "t", "v").collect()
    assert len(got) == len(rows) and {(r["project_id"], r["id"], r["cluster"]) for r in got} == want


def test_incremental(spark):
    rows = spark.createDataFrame([("f", 0), ("f", 1), ("g", 0)], "source_path string, position long")
    seen = incremental.offsets(rows.where("source_path = 'f' and position = 0"))
    assert {tuple(r) for r in incremental.new_rows(rows, seen).collect()} == {("f", 1), ("g", 0)}
    runs = spark.createDataFrame([("triage", dt.datetime(2024, 1, 1)), ("triage", dt.datetime(2024, 1, 20)), ("other", dt.datetime(2024, 1, 1))], "agent_name string, produced_at timestamp")
    assert incremental.expired(runs, "triage", dt.datetime(2024, 1, 21), 5).count() == 2
    t = [("s", i, r, f"t{i}", None) for i, r in enumerate(["user", "assistant", "user", "assistant"])]
    df = windows.clean(spark.createDataFrame(t, "session_id string, idx int, role string, text string, ts timestamp"))
    first = windows.segment(df.where("idx < 2"))
    assert [r["start_idx"] for r in incremental.new_windows(df, df, first).collect()] == [2]
    assert incremental.unprocessed(windows.segment(df), first.select(F.col("id").alias("window_id"))).count() == 1


def test_model_stage_caches_repairs_and_fails(spark):
    good = model.stable({"relevance": "on_topic", "domain": "devops", "quality": "signal", "linkage": "this_project", "confidence": 0.9})
    p = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "key string, payload string")
    answers = {"a": f"```json\n{good}\n```", "b": "no json", "c": '{"relevance": "wrong"}'}
    answers["b\n\nThe last answer was wrong: no JSON in the answer"] = "well: " + good
    got = {r["key"]: r for r in model.run(model.TRIAGE, p, backend=model.Recorded(answers), model="m").collect()}
    assert got["1"]["ok"] and got["2"]["ok"] and not got["3"]["ok"] and got["3"]["error"]
    memo = spark.createDataFrame([(r["input_hash"], r["output_json"], r["ok"], 1) for r in got.values()], "input_hash string, output_json string, ok boolean, produced_at int")
    again = {r["key"]: r["cached"] for r in model.run(model.TRIAGE, p, memo, model.Offline(), "m").collect()}
    assert again == {"1": True, "2": True, "3": False}
    x = model.EXTRACTORS["decision"].post({"facts": [{"kind": "decision", "title": "t", "confidence": 0.4}, {"kind": "entity", "title": "e"}]})
    assert len(x["facts"]) == 1 and x["confidence"] == 0.4


def test_relations_need_evidence(spark):
    t = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, title string")
    r = spark.createDataFrame([("a", "b", "relates_to", "e"), ("a", "b", "relates_to", " "), ("a", "x", "relates_to", "e"), ("a", "A", "relates_to", "e"), ("a", "b", "nope", "e")], "source string, target string, kind string, evidence string")
    assert model.kept_relations(r, t, ("relates_to",)).count() == 1


def test_python_symbols(spark):
    src = 'import os\nclass Greeter:\n    """Says."""\n    def hello(self):\n        return make_greeter()\n\nasync def make_greeter():\n    return Greeter()\nLIMIT = 3\n'
    n, e, r = code.extract(spark.createDataFrame([("a.py", "python", src), ("b.py", "python", "def ("), ("c.go", "go", "package c\nfunc F() {}\ntype S struct {\n}\n"), ("d.rs", "rust", None)], "path string, language string, content string"))
    got = {(x["kind"], x["qualified_name"]) for x in n.collect()}
    assert {("class", "Greeter"), ("method", "Greeter.hello"), ("function", "make_greeter"), ("constant", "LIMIT"), ("import", "os"), ("function", "F"), ("struct", "S")} <= got
    assert {x["reference_name"] for x in r.collect()} == {"make_greeter", "Greeter"} and e.where("kind = 'contains'").count() >= 4
    assert n.where("name = 'Greeter'").first()["docstring"] == "Says."


def test_schema_conforms(spark):
    df = schemas.conform(spark.createDataFrame([("a", "x")], "id string, extra string"), schemas.NODES)
    assert "is_async" in df.columns and "extra" not in df.columns
    assert schemas.violations(spark.createDataFrame([("same_as",), ("x",), (None,)], "kind string"), "kind", schemas.LINK_KINDS).count() == 1
    assert schemas.dangling(spark.createDataFrame([("a",), ("b",)], "k string"), "k", spark.createDataFrame([("a",)], "id string")).count() == 1


def test_explain_shows_every_title(spark):
    rows = [("c", k, f"{k} {i:04d}") for k in ("intent", "problem", "constraint", "decision", "solution") for i in range(450)] + [("c", "business_rule", "a rule"), ("d", "intent", None), (None, "intent", "lost")]
    got = {r["cluster_id"]: r for r in graph.buckets(spark.createDataFrame(rows, "cluster_id string, kind string, title string")).collect()}
    assert set(got) == {"c", "d"} and got["d"]["intents"] == []
    assert [len(got["c"][b]) for b in ("intents", "problems", "rules", "decisions", "solutions")] == [450, 450, 451, 450, 450]
    assert got["c"]["solutions"] == [f"solution {i:04d}" for i in range(450)]
