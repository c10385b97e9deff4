import json

import pytest

from tessera.operators import model
from tessera.workspace import Workspace, load_config, merged


@pytest.fixture(scope="module")
def app(tmp_path_factory):
    return project(tmp_path_factory)


def project(tmp_path_factory):
    """A project of three files and the transcript of one short conversation."""
    root = tmp_path_factory.mktemp("app")
    (root / "src").mkdir()
    (root / "src" / "auth.py").write_text("def login():\n    return check()\n\ndef check():\n    return 1\n")
    (root / "schema.sql").write_text("CREATE TABLE accounts (id INT, tier INT REFERENCES tier(id));\nCREATE TABLE users (a INT REFERENCES accounts(id));\n")
    (root / "package.json").write_text(json.dumps({"dependencies": {"react": "1"}}))
    t = tmp_path_factory.mktemp("logs")
    from tessera.sources.transcripts import slug

    log = t / slug(str(root)) / "agent-transcripts" / "u" / "u.jsonl"
    log.parent.mkdir(parents=True)
    log.write_text(json.dumps({"role": "user", "content": "see src/auth.py and ABC-12"}) + "\n" + json.dumps({"role": "assistant", "content": "done"}) + "\n")
    return root, t, log


def test_the_whole_way(spark, app, tmp_path_factory):
    root, logs, log = app
    good = json.dumps({"relevance": "on_topic", "domain": "devops", "quality": "signal", "linkage": "this_project", "confidence": 0.9})
    w = Workspace(spark, "file://" + str(tmp_path_factory.mktemp("ws")), backend=model.Recorded({}, good))
    p = str(root)
    assert w.sync(p) == {"added": 2}
    assert w.sync(p) == {"same": 2}
    names = {(r["kind"], r["name"]) for r in w.table("nodes").collect()}
    assert {("function", "login"), ("table", "accounts"), ("table", "users"), ("table", "tier")} <= names
    assert w.table("edges").where("kind = 'calls'").count() == 1 and w.table("edges").where("kind = 'references'").count() == 2
    assert w.search("logi").first()["name"] == "login" and w.node("check").count() == 1
    assert w.ingest("cursor", str(logs), p) == {"turns": 2, "windows": 1, "labelled": 1}
    assert w.ingest("cursor", str(logs), p) == {"turns": 0, "windows": 0, "labelled": 0}
    assert w.triage_audit().count() == 1 and w.unprocessed().count() == 0
    assert {r["title"] for r in w.recall("ABC-12").collect()} == {"ABC-12"}
    assert w.facts_of_file("src/auth.py").count() == 1
    with log.open("a") as f:
        f.write(json.dumps({"role": "user", "content": "more"}) + "\n" + json.dumps({"role": "assistant", "content": "ok"}) + "\n")
    assert w.ingest("cursor", str(logs), p) == {"turns": 2, "windows": 1, "labelled": 1}
    kinds = w.enrich(p)
    assert kinds["dependency"] == 1 and kinds["entity"] == 3 and kinds["knowledge_gap"] >= 1
    assert w.enrich(p) == kinds
    assert {r["title"] for r in w.gaps().collect()} >= {"External entity tier"}
    dm = {r["title"]: r["relates_to"] for r in w.domain_model().collect()}
    assert dm["users"] == ["accounts"] and dm["tier"] is None
    out = w.link(p)
    assert out["skills"] >= 2 and w.skills().count() == out["skills"] and w.profile().count() >= 1
    for s in w.SNAPSHOTS:
        assert w.snapshot(s).count() >= 0
    with pytest.raises(ValueError):
        w.snapshot("nope")
    assert w.verify() == {"pruned": 0, "pairs": 0}
    (root / "src" / "auth.py").unlink()
    assert w.sync(p) == {"same": 1, "gone": 1} and w.node("login").count() == 0
    assert w.clean(p)["evidence"] >= 2 and w.status()["skills"] >= 2
    w.clean(p, yes=True)
    assert w.status()["skills"] == 0 and w.clean(p) == {}
    assert "triage" in w.agents() and w.learn().count() == 0


class Scripted:
    """Answers by stage; sees which calls were made."""

    def chat(self, system, user):
        x = json.loads(user.split("\n\n")[0])
        if "four axes" in system:
            return json.dumps({"relevance": "on_topic", "domain": "architecture", "quality": "decision_grade", "linkage": "this_project", "confidence": 0.9})
        if "Extract decisions" in system:
            return "Sure:\n```json\n" + json.dumps({"facts": [{"kind": "decision", "title": "use session cookies for login", "confidence": 0.9}, {"kind": "decision", "title": "use signed tokens for login", "confidence": 0.8}, {"kind": "nonsense", "title": "x"}]}) + "\n```"
        if "Extract" in system:
            return json.dumps({"facts": []})
        if "Attach" in system:
            c = x["candidates"]
            return json.dumps({"action": "attach", "conceptId": c[0]["id"], "confidence": 0.9, "reason": "same"} if c else {"action": "create", "suggestedName": "login", "confidence": 0.9, "reason": "new"})
        if "Name and summarise" in system:
            return json.dumps({"name": "login sessions", "summary": f"{len(x['facts'])} facts", "structured": {}, "domain": "architecture"})
        if "two facts" in system:
            return json.dumps({"verdict": "b_supersedes_a", "confidence": 0.8, "reason": "newer"})
        if "two concepts" in system:
            return json.dumps({"relation": "variant_of", "confidence": 0.9, "reason": "similar"})
        return "{}"


def test_facts_to_concepts_to_links(spark, tmp_path_factory):
    root, logs, _ = project(tmp_path_factory)
    w = Workspace(spark, "file://" + str(tmp_path_factory.mktemp("ws3")), {"min_similarity": 0.2}, backend=Scripted())
    p = str(root)
    w.ingest("cursor", str(logs), p)
    assert w.extract() == {"decision": 2} and w.extract() == {"decision": 2}
    assert w.table("facts").where("kind = 'decision'").count() == 2
    got = w.cluster()
    assert got["processed"] == 2 and got["created"] == 1 and w.cluster()["processed"] == 0
    assert w.table("facts").where("kind = 'decision' and cluster_id is null").count() == 0
    c = w.table("concepts").collect()
    assert [(r["name"], r["summary"], r["domain"], r["member_count"]) for r in c] == [("login sessions", "2 facts", "architecture", 2)] and c[0]["embedding"]
    other = w.table("concepts").selectExpr("'other' as id", "'p2' as project_id", "id as local_concept_id", "'LOGIN Sessions' as name", "summary", "domain", "scope", "embedding", "current_timestamp() as updated_at")
    w.save("concepts_global", other)
    out = w.link(p)
    assert out["links"] == 2 and {(r["kind"], r["source"], r["score"]) for r in w.table("concept_links").collect()} == {("same_as", "mechanical", 0.8), ("variant_of", "agent:linker", 0.9)}
    assert w.link(p)["links"] == 2
    v = w.verify()
    assert v == {"pruned": 0, "pairs": 1, "supersedes": 1} and w.table("fact_edges").where("kind = 'supersedes'").count() == 1
    assert w.explain(w.table("concepts").first()["id"]).first()["decisions"] == ["use session cookies for login", "use signed tokens for login"]
    assert w.table("runs").where("ok").select("agent_name").distinct().count() >= 6
    assert {"clusterer", "summarizer", "linker", "verifier", "domainModeler", "technicalProfiler", "industryClassifier", "industryEnricher"} <= set(w.agents())


def test_failed_models_keep_windows(spark, app, tmp_path_factory):
    root, logs, _ = app
    w = Workspace(spark, "file://" + str(tmp_path_factory.mktemp("ws2")))
    w.ingest("cursor", str(logs), str(root))
    rows = w.table("triage").collect()
    assert rows and all(r["kept"] and r["confidence"] == 0.1 for r in rows) and w.table("runs").where("ok").count() == 0


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"a": 1, "l": [1]}, "model": "m"}')
    (tmp_path / "b.json").write_text('{"x": {"b": 2, "l": [2]}}')
    c = load_config(str(tmp_path / "a.json"), str(tmp_path / "b.json"), str(tmp_path / "none.json"))
    assert c["x"] == {"a": 1, "b": 2, "l": [2]} and c["model"] == "m" and c["concurrency"] == 4
    assert merged({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}
