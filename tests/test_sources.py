import json

from pyspark.sql import functions as F

from tessera.sources import manifests, transcripts, tree
from tessera.streaming import events as st


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def lines(*items):
    return "\n".join(json.dumps(x) if not isinstance(x, str) else x for x in items) + "\n"


def test_block_transcripts_and_resuming(spark, tmp_path):
    p = tmp_path / transcripts.slug("/home/me/my.app") / "agent-transcripts" / "u1" / "u1.jsonl"
    entries = [
        {"role": "user", "message": {"content": [{"type": "text", "text": " hello "}, {"type": "text", "text": "you"}]}}, "{broken", {"role": "robot", "content": "x"},
        {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "a", "input": {"path": "src/x.ts"}}, {"type": "tool_use", "name": "b", "input": {}}, {"type": "tool_result", "content": "r" * 3000}]}}, {"role": "assistant", "content": "plain"},
    ]
    write(p, lines(*entries))
    raw = transcripts.read(spark, "cursor", str(tmp_path), "/home/me/my.app")
    rows = raw.orderBy("position").collect()
    assert [(r["role"], r["text"]) for r in rows] == [("user", "hello \nyou"), ("assistant", ""), ("assistant", "plain")]
    calls = rows[1]["tool_calls"]
    assert [c["name"] for c in calls] == ["a", "b"] and calls[0]["target_paths"] == ["src/x.ts"] and calls[0]["result_excerpt"] is None and len(calls[1]["result_excerpt"]) == 2000
    turns, tools = transcripts.as_turns(raw, "cursor")
    assert sorted(r["idx"] for r in turns.collect()) == [0, 1, 2] and tools.count() == 2
    known = spark.createDataFrame(turns.select("session_id", "position").collect())
    write(p, lines(*entries, {"role": "user", "content": "more"}))
    again, _ = transcripts.as_turns(transcripts.read(spark, "cursor", str(tmp_path), "/home/me/my.app"), "cursor", known)
    assert [(r["idx"], r["text"]) for r in again.collect()] == [(3, "more")]


def test_typed_transcripts(spark, tmp_path):
    write(tmp_path / "-home-me-app" / "s.jsonl", lines({"type": "user", "message": {"content": "hi"}, "timestamp": 1700000000000}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "yo"}]}, "timestamp": "2024-01-01T00:00:00Z"}))
    rows = transcripts.read(spark, "claude-code", str(tmp_path), "/home/me/app").orderBy("position").collect()
    assert [(r["role"], r["text"], r["ts"]) for r in rows] == [("user", "hi", 1700000000000), ("assistant", "yo", None)]


def test_item_transcripts(spark, tmp_path):
    good = lines({"cwd": "/app"}, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}, {"type": "function_call", "name": "sh", "arguments": '{"path": "a.py"}'}, {"type": "function_call_output", "output": "o" * 5000})
    write(tmp_path / "2024" / "a.jsonl", good)
    write(tmp_path / "2024" / "b.jsonl", good.replace("/app", "/other"))
    rows = transcripts.read(spark, "codex", str(tmp_path), "/app").orderBy("position").collect()
    assert [(r["role"], len(r["text"])) for r in rows] == [("user", 1), ("assistant", 0), ("tool", 4000)]
    assert rows[1]["tool_calls"][0]["target_paths"] == ["a.py"]


def test_whole_transcripts(spark, tmp_path):
    import hashlib

    d = tmp_path / hashlib.md5(b"file:///app").hexdigest() / "chat"
    write(d / "a.json", json.dumps({"sessionId": "s", "requests": [{"message": {"text": "q"}, "response": {"value": "a"}}]}))
    write(d / "b.json", json.dumps({"history": [{"role": "user", "text": "h"}]}))
    rows = transcripts.read(spark, "copilot", str(tmp_path), "/app").collect()
    assert sorted((r["role"], r["text"]) for r in rows) == [("assistant", "a"), ("user", "h"), ("user", "q")]


def test_walk(spark, tmp_path):
    write(tmp_path / ".gitignore", "skipme/\n*.gen.ts\n")
    for name in ("src/a.ts", "src/b.gen.ts", "skipme/c.py", "node_modules/d.js", "e.sql", "f.bin"):
        write(tmp_path / name, "x")
    f = tree.walk(spark, str(tmp_path))
    assert {(r["path"], r["language"]) for r in f.collect()} == {("src/a.ts", "typescript"), ("e.sql", "sql")}
    new = spark.createDataFrame([("src/a.ts", "other"), ("new.py", "h")], "path string, content_hash string")
    assert {tuple(r) for r in tree.changes(f.select("path", "content_hash"), new).collect()} == {("src/a.ts", "changed"), ("e.sql", "gone"), ("new.py", "added")}


def test_manifests(spark):
    files = [
        ("package.json", json.dumps({"dependencies": {"express": "1", "react": "2"}, "devDependencies": {"typescript": "5"}})), ("requirements.txt", "flask==1\n# no\nuvicorn[standard]>=2\n"), ("pyproject.toml", '[project]\ndependencies = ["numpy>=1"]\n[tool.poetry.dependencies]\npython = "^3"\nscipy = "1"\n'),
        ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.0.0\n)\nrequire github.com/c/d v1.2.0\n"), ("Cargo.toml", '[dependencies]\nserde = "1"\n[dev-dependencies]\nx = "1"\n'), ("pubspec.yaml", "dependencies:\n  flutter:\n    sdk: flutter\n  http: ^1\n"), ("composer.json", '{"require": {"php": "8", "monolog/monolog": "2"}}'),
        ("Gemfile", "gem 'rails', '7'\n"), ("pom.xml", "<dependency><groupId>g</groupId><artifactId>junit</artifactId></dependency>"), ("build.gradle", "implementation 'a:b:1'\n"), ("x.csproj", '<PackageReference Include="Newtonsoft.Json" />'), ("Dockerfile", "FROM x"), (".github/workflows/ci.yml", "on: push"),
        ("sub/package.json", '{"dependencies": {"React": "2"}}'), ("a/b/c/d/e/package.json", '{"dependencies": {"deep": "1"}}'), ("bad/package.json", "{"), ("null.json", None),
    ]
    got = {(r["kind"], r["title"].lower()) for r in manifests.facts(spark.createDataFrame(files, "path string, content string")).collect()}
    want = "express react typescript flask uvicorn numpy scipy github.com/a/b github.com/c/d serde http monolog/monolog rails junit a:b:1 newtonsoft.json".split()
    assert got == {("dependency", w) for w in want} | {("tool", "docker"), ("tool", "github actions")}


def test_streams(spark, tmp_path):
    rows = [(i, "u1" if i % 2 else "u2", f"2024-01-01 00:{i:02d}:00") for i in range(20)] + [(30, "u1", "2024-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "id int, user_id string, s string").select("id", "user_id", F.to_timestamp("s").alias("ts"))
    df.unionByName(df.limit(5)).write.parquet(str(tmp_path / "in"))
    s = st.deduplicated(st.source(spark, str(tmp_path / "in"), df.schema))
    st.append(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 21
    got = st.sessions(df).orderBy("user_id", "start").collect()
    assert [(r["user_id"], r["n"]) for r in got] == [("u1", 10), ("u1", 1), ("u2", 10)]
    assert st.tumbling(df, ["user_id"]).agg(F.sum("n")).first()[0] == 21


def test_tools_by_path():
    assert manifests.tools("ops/Dockerfile.dev") == ["Docker"] and manifests.tools("serverless.yaml") == ["Serverless Framework"] and manifests.tools("helmfile.yml") == ["Kubernetes"]
    assert manifests.tools(".circleci/config.yml") == ["CircleCI"] and manifests.tools("deploy/charts/web/values.yaml") == ["Kubernetes"] and manifests.tools("netlify.toml") == ["Netlify"]
    assert manifests.tools(".github/workflows/ci.yml") == ["GitHub Actions"] and manifests.tools("src/k8s.py") == []
