"""A workspace: the layers of projects as tables in a folder, and the commands over them.

Every command reads tables, computes new ones as pure functions and replaces them whole:
a new version is written beside the old and the pointer to it moves last, so a run that
breaks off leaves the old state. Commands are idempotent.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import lattice, text, vectors
from tessera.operators import code, concepts, enrichment, facts, graph, incremental, links, model, mutate, skills, triage, windows
from tessera.runtime import Scratch
from tessera.sources import manifests, transcripts, tree

DDL = {
    "files": schemas.FILES + ", content string, project_id string", "nodes": schemas.NODES, "edges": schemas.EDGES, "refs": schemas.UNRESOLVED, "turns": schemas.TURNS + ", position long", "tool_calls": schemas.TOOL_CALLS,
    "windows": "id string, session_id string, start_idx int, end_idx int, n_turns long, text string, text_hash string", "triage": schemas.TRIAGE, "facts": schemas.FACTS, "fact_edges": schemas.FACT_EDGES, "provenance": schemas.PROVENANCE, "code_links": schemas.CODE_LINKS,
    "concepts": schemas.CONCEPTS, "runs": schemas.AGENT_RUNS + ", key string", "projects": "id string, name string, path string", "concepts_global": "id string, project_id string, local_concept_id string, name string, summary string, domain string, scope string, embedding array<float>, updated_at timestamp",
    "concept_links": "a string, b string, kind string, score double, source string", "skill_evidence": "skill_id string, project_id string, name string, weight double, grounding string", "skills": "skill_id string, name string, evidence_weight double, project_count long, grounding string",
}

DEFAULTS = {"backend": "offline", "model": "offline", "concurrency": 4, "prune_below": 0.25, "max_pairs": 5, "most_links": 200, "min_similarity": 0.78}


def merged(*layers: dict) -> dict:
    """Later layers over earlier ones, dictionaries by key, lists whole."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(*paths: str) -> dict:
    found = [json.load(open(p, encoding="utf-8")) for p in paths if os.path.exists(p)]
    return merged(DEFAULTS, *found)


class Workspace:
    def __init__(self, spark: SparkSession, root: str, config: dict | None = None, backend: model.Backend | None = None):
        self.spark, self.root, self.config, self.backend = spark, root.rstrip("/"), merged(DEFAULTS, config or {}), backend

    # tables

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _version(self, name: str) -> int:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v" and fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])), default=0)

    def table(self, name: str) -> DataFrame:
        v = self._version(name)
        if not v:
            return self.spark.createDataFrame([], DDL[name])
        return self.spark.read.parquet(f"{self.root}/{name}/v{v}")

    def save(self, name: str, df: DataFrame) -> None:
        """A new version; the one before stays for readers, older ones go."""
        v = self._version(name) + 1
        schemas.conform(df, DDL[name].replace(" not null", "")).write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        fs, p = self._fs(f"{self.root}/{name}/v{v - 2}")
        if v > 2 and fs.exists(p):
            fs.delete(p, True)

    # commands

    def register(self, path: str) -> str:
        """A project by its path; registering again changes nothing."""
        new = self.spark.createDataFrame([(path,)], "path string").select(F.substring(F.sha1("path"), 1, 16).alias("id"), text.basename("path").alias("name"), "path")
        self.save("projects", mutate.upsert(self.table("projects"), new, ["id"]))
        return new.first()["id"]

    def sync(self, path: str, full: bool = False) -> dict[str, int]:
        """Indexes the source files that changed, forgets those that are gone, resolves all references afresh."""
        project = self.register(path)
        now = tree.walk(self.spark, path).withColumn("project_id", F.lit(project)).withColumn("path", F.concat(F.lit(project + "/"), "path"))
        files = self.table("files")
        mine = files.where(F.col("project_id") == project)
        state = tree.changes(mine, now)
        counts = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
        todo = now if full else now.join(state.where("state in ('added', 'changed')").select("path"), "path", "left_semi")
        stale = (state if full else state.where("state <> 'same'")).select("path")
        kept_nodes = self.table("nodes").join(stale.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
        kept_refs = self.table("refs").join(stale.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
        nodes, edges, refs = code.extract(todo)
        gone = self.table("nodes").join(stale.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id")
        kept_edges = self.table("edges").where("kind not in ('calls', 'references')").join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
        all_nodes = kept_nodes.unionByName(schemas.conform(nodes, schemas.NODES.replace(" not null", "")))
        all_refs = kept_refs.unionByName(schemas.conform(refs, schemas.UNRESOLVED))
        self.save("files", files.where(F.col("project_id") != project).unionByName(schemas.conform(now, DDL["files"].replace(" not null", ""))))
        self.save("refs", all_refs)
        self.save("nodes", all_nodes)
        all_nodes, all_refs = self.table("nodes"), self.table("refs")
        calls = graph.resolve_calls(all_refs.where("reference_kind = 'calls'").select("from_node_id", "reference_name").distinct(), all_nodes).where("target is not null")
        calls = calls.select(F.col("from_node_id").alias("source"), "target", F.lit("calls").alias("kind"))
        tables, stubs = code.table_references(all_refs, all_nodes)
        links_ = kept_edges.unionByName(schemas.conform(edges, schemas.EDGES.replace(" not null", "")))
        for more in (calls, tables):
            links_ = links_.unionByName(schemas.conform(more, schemas.EDGES.replace(" not null", "")))
        self.save("edges", links_.distinct())
        if not stubs.isEmpty():
            self.save("nodes", mutate.insert_absent(all_nodes, schemas.conform(stubs, schemas.NODES.replace(" not null", "")), ["id"]))
        return counts

    def ingest(self, agent: str, transcripts_root: str, path: str, reprocess: bool = False) -> dict[str, int]:
        """New turns of an agent, the windows they bring, their evidence and labels."""
        old = self.table("turns")
        raw = transcripts.read(self.spark, agent, transcripts_root, path)
        turns, calls = transcripts.as_turns(raw, agent, old.select("session_id", "position"))
        n = turns.count()
        self.save("tool_calls", mutate.insert_absent(self.table("tool_calls"), schemas.conform(calls, schemas.TOOL_CALLS.replace(" not null", "")), ["id"]))
        touched = Scratch(self.spark).save(turns.select("session_id").distinct())
        self.save("turns", old.unionByName(schemas.conform(turns, DDL["turns"].replace(" not null", ""))))
        known = self.table("windows")
        again = windows.segment(windows.clean(self.table("turns").join(touched, "session_id", "left_semi")))
        fresh = again.join(known.select("id"), "id", "left_anti")
        # windows of touched sessions that no longer come out so have been replaced by longer ones
        kept = known.join(touched, "session_id", "left_anti").unionByName(known.join(touched, "session_id", "left_semi").join(again.select("id"), "id", "left_semi"))
        self.save("windows", kept.unionByName(schemas.conform(fresh, DDL["windows"])))
        work = self.table("windows") if reprocess else self.table("windows").join(known.select("id"), "id", "left_anti")
        found, prov = facts.syntax_facts(work)
        self.save("facts", mutate.upsert(self.table("facts"), schemas.conform(found, schemas.FACTS.replace(" not null", "")), ["id"], keep=["created_at", "cluster_id"], fill=["grounding", "scope"]))
        self.save("provenance", self.table("provenance").unionByName(schemas.conform(prov, schemas.PROVENANCE.replace(" not null", ""))).distinct())
        self._link_code()
        labelled = self.triage(work)
        return {"turns": n, "windows": work.count(), "labelled": labelled}

    def _link_code(self) -> None:
        f, files = self.table("facts"), self.table("files")
        bare = files.select("path", F.regexp_replace("path", "^[0-9a-f]{16}/", "").alias("rel"))
        m = f.where("kind = 'path_mention'").select("id", F.regexp_replace("title", r"^\./", "").alias("mention"))
        r = facts.resolve_paths(m, bare, path="rel").join(bare.withColumnRenamed("path", "full"), F.col("path") == F.col("rel"))
        node = F.substring(F.sha1(F.concat_ws("|", F.lit("file"), "full", "full")), 1, 16)
        l = m.join(r, "mention").select(F.col("id").alias("k_node_id"), node.alias("code_node_id"), F.col("path").alias("code_file"), F.lit(1.0).alias("weight"))
        self.save("code_links", l.distinct())

    def _answers(self, stage: model.Stage, payloads: DataFrame) -> DataFrame:
        """(key, output_json) of every payload, null where the stage failed. Runs are recorded; good ones are reused."""
        payloads = Scratch(self.spark).save(payloads)
        memo = self.table("runs")
        out = model.run(stage, payloads, memo, self.backend, self.config["model"], self.config["concurrency"])
        audit = out.where("not cached").select(F.lit(stage.name).alias("agent_name"), F.lit(self.config["model"]).alias("model"), "input_hash", "output_json", "ok", "error", "key", F.current_timestamp().alias("produced_at"))
        self.save("runs", memo.unionByName(schemas.conform(audit, DDL["runs"])))
        good = self.table("runs").where(F.col("ok") & (F.col("agent_name") == stage.name)).groupBy("input_hash").agg(F.max_by("output_json", "produced_at").alias("output_json"))
        return Scratch(self.spark).save(model.with_hash(stage, payloads, self.config["model"]).select("key", "input_hash").join(good, "input_hash", "left").select("key", "output_json"))

    def extract(self) -> dict[str, int]:
        """Facts of the kept windows by the extractors that their labels route to; a failed call leaves the others."""
        labels = self.table("triage")
        t = triage.tasks(labels).join(self.table("windows").select(F.col("id").alias("window_id"), "text"), "window_id").join(labels.select("window_id", "domain"), "window_id")
        payload = F.to_json(F.struct("text", F.col("window_id").alias("windowId"), "domain"))
        t = Scratch(self.spark).save(t.select("agent", "domain", F.col("window_id").alias("key"), payload.alias("payload")))
        found = None
        for name, stage in model.EXTRACTORS.items():
            mine = t.where(F.col("agent") == name)
            x = self._answers(stage, mine).select("key", F.explode(F.from_json("output_json", "struct<facts: array<struct<kind: string, title: string, summary: string, evidence: string, confidence: double>>>")["facts"]).alias("f"))
            x = x.join(mine.select("key", "domain"), "key").withColumn("source", F.lit(f"agent:{name}"))
            found = x if found is None else found.unionByName(x)
        rows = found.select(
            text.natural_id("f.kind", "key", F.lower("f.title")).alias("id"), "f.kind", "f.title", "f.summary", F.col("f.evidence").alias("evidence_text"), F.coalesce("f.confidence", F.lit(0.5)).alias("confidence"), "source",
            F.lit(self.config["model"]).alias("agent_model"), F.lit("stated").alias("grounding"), lattice.scope_from_domain().alias("scope"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"), F.col("key").alias("window_id"),
        )
        rows = Scratch(self.spark).save(rows.dropDuplicates(["id"]))
        self.save("facts", mutate.upsert(self.table("facts"), schemas.conform(rows, schemas.FACTS.replace(" not null", "")), ["id"], keep=["created_at", "cluster_id"], fill=["grounding", "scope"]))
        prov = rows.select(F.col("id").alias("k_node_id"), "window_id")
        self.save("provenance", self.table("provenance").unionByName(schemas.conform(prov, schemas.PROVENANCE.replace(" not null", ""))).distinct())
        return {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}

    def cluster(self, again: bool = False) -> dict[str, int]:
        """Puts facts without a concept into one: an offered concept or two merged ones where the model says so, else new ones, which
        similar new facts share; facts without a vector go to a concept of their kind. Then names, summaries and centroids of what changed."""
        keep = Scratch(self.spark)
        f = self.table("facts")
        open_ = f.where(~F.col("kind").isin(*schemas.EVIDENCE_KINDS) & (F.lit(again) | F.col("cluster_id").isNull()))
        said = open_.select("id", "kind", "title", "summary", "created_at", F.concat_ws(" ", "title", "summary").alias("t"))
        emb = keep.save(said.join(enrichment.hash_embedding(said, "id", "t"), "id"))
        old = self.table("concepts") if not again else self.table("concepts").limit(0)
        near = concepts.nearest_concepts(emb.select(F.col("id").alias("q_id"), F.col("embedding").alias("q_vec")), old.select(F.col("id").alias("i_id"), F.col("embedding").alias("i_vec")))
        near = keep.save(near.join(old.select(F.col("id").alias("i_id"), "name", F.col("summary").alias("about")), "i_id"))
        offered = near.groupBy(F.col("q_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("i_id").alias("id"), "name", F.col("about").alias("summary")))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["summary"].alias("summary"))).alias("candidates"))
        asked = emb.where("embedding is not null").join(offered, "id", "left")
        payload = F.to_json(F.struct(F.struct("id", "kind", "title", "summary").alias("fact"), F.coalesce("candidates", F.array().cast("array<struct<id:string,name:string,summary:string>>")).alias("candidates")))
        a = self._answers(model.CLUSTERER, asked.select(F.col("id").alias("key"), payload.alias("payload")))
        x = F.from_json("output_json", "struct<action: string, conceptId: string, conceptIds: array<string>, suggestedName: string>")
        a = a.select(F.col("key").alias("fact_id"), x.alias("x")).select("fact_id", F.coalesce("x.action", F.lit("create")).alias("action"), F.coalesce("x.conceptId", F.try_element_at("x.conceptIds", F.lit(1))).alias("cluster_id"), F.try_element_at("x.conceptIds", F.lit(2)).alias("other_id"), F.col("x.suggestedName").alias("suggested"))
        acts = keep.save(enrichment.cluster_actions(a, near.select(F.col("q_id").alias("fact_id"), F.col("i_id").alias("cluster_id"))).join(a.select("fact_id", "suggested"), "fact_id"))
        fresh = keep.save(emb.join(acts.where("action = 'create'").select(F.col("fact_id").alias("id"), "suggested"), "id"))
        folded = concepts.fold(fresh, "kind", "created_at", "embedding").select("id", F.concat(F.lit("c:"), "cluster").alias("cluster_id"))
        bare = emb.where("embedding is null").select("id", F.concat(F.lit("u:"), "kind").alias("cluster_id"))
        to = keep.save(acts.where("action <> 'create'").select(F.col("fact_id").alias("id"), "cluster_id").unionByName(folded).unionByName(bare))
        merges = acts.where("action = 'merge'").groupBy(F.col("other_id").alias("cluster_id")).agg(F.min("cluster_id").alias("into"))
        f = f.withColumn("cluster_id", F.when(F.lit(again), None).otherwise(F.col("cluster_id"))).join(to.withColumnRenamed("cluster_id", "_to"), "id", "left").withColumn("cluster_id", F.coalesce("_to", "cluster_id")).drop("_to")
        f = f.join(merges, "cluster_id", "left").withColumn("cluster_id", F.coalesce("into", "cluster_id")).drop("into")
        self.save("facts", f)
        names = fresh.select(F.concat(F.lit("c:"), "id").alias("id"), F.coalesce("suggested", F.substring("title", 1, 60)).alias("name"))
        names = names.unionByName(bare.select(F.col("cluster_id").alias("id"), F.concat(F.substring("cluster_id", 3, 200), F.lit(" (uncategorized)")).alias("name")).distinct())
        dirty = keep.save(to.select(F.col("cluster_id").alias("id")).unionByName(merges.select(F.col("into").alias("id"))).distinct())
        n = self._summarize(dirty, old, names)
        return {"processed": to.count(), "created": fresh.join(folded.select(F.substring("cluster_id", 3, 200).alias("id")).distinct(), "id", "left_semi").count(), "summarized": n}

    def _summarize(self, dirty: DataFrame, old: DataFrame, names: DataFrame) -> int:
        """The concepts table: counts, scopes and centroids of all; names and summaries of the changed ones by the model, else as they were."""
        keep = Scratch(self.spark)
        f = keep.save(self.table("facts").where("cluster_id is not null"))
        known = keep.save(old.select("id", F.col("name").alias("_name"), F.col("summary").alias("_summary"), F.col("domain").alias("_domain")).join(names.groupBy("id").agg(F.min("name").alias("_new")), "id", "full_outer"))
        m = concepts.members(f.join(dirty.withColumnRenamed("id", "cluster_id"), "cluster_id", "left_semi")).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "title", "summary"))).alias("m"))
        m = m.join(known, m["cluster_id"] == known["id"], "left")
        payload = F.to_json(F.struct(F.col("cluster_id").alias("conceptId"), F.coalesce("_name", "_new").alias("currentName"), F.transform("m", lambda x: F.struct(x["kind"].alias("kind"), x["title"].alias("title"), x["summary"].alias("summary"))).alias("facts")))
        got = self._answers(model.SUMMARIZER, m.select(F.col("cluster_id").alias("key"), payload.alias("payload")))
        got = keep.save(got.select(F.col("key").alias("id"), F.from_json("output_json", "struct<name: string, summary: string, domain: string>").alias("x")).select("id", "x.*"))
        vec = enrichment.hash_embedding(f.select("id", F.concat_ws(" ", "title", "summary").alias("t")), "id", "t")
        cen = vectors.centroids(f.select("id", "cluster_id").join(vec, "id"), "cluster_id", "embedding").select(F.col("cluster_id").alias("id"), F.col("centroid").cast("array<float>").alias("embedding"))
        s = concepts.summary(f).withColumnRenamed("cluster_id", "id")
        out = s.join(known, "id", "left").join(got, "id", "left").join(cen, "id", "left")
        out = out.select("id", F.coalesce("name", "_name", "_new").alias("name"), F.coalesce("summary", "_summary").alias("summary"), F.coalesce("domain", "_domain").alias("domain"), "scope", "grounding", F.col("member_count").cast("int").alias("member_count"), "embedding")
        self.save("concepts", out)
        return got.where("name is not null").count()

    def triage(self, work: DataFrame | None = None) -> int:
        """Labels of windows; where the model fails they are kept with little confidence. Good results are reused."""
        w = self.table("windows") if work is None else work
        payload = F.to_json(F.struct(text.clamp("text", 6000).alias("text"), F.col("id").alias("windowId")))
        best = self._answers(model.TRIAGE, w.select(F.col("id").alias("key"), payload.alias("payload")))
        x = F.from_json("output_json", "struct<relevance: string, domain: string, quality: string, linkage: string, confidence: double, rationale: string>")
        good = best.withColumn("x", x)
        failed = triage.failed(good.where("x is null").select(F.col("key").alias("id")))
        labels = good.where("x is not null").select(F.col("key").alias("window_id"), "x.*")
        labels = labels.unionByName(failed, allowMissingColumns=True).withColumns({"model": F.lit(self.config["model"]), "dup_of": F.lit(None).cast("string"), "produced_at": F.current_timestamp()}).withColumn("kept", triage.keep())
        new = schemas.conform(labels, schemas.TRIAGE.replace(" not null", ""))
        self.save("triage", mutate.upsert(self.table("triage"), new, ["window_id"]))
        return new.count()

    def enrich(self, path: str) -> dict[str, int]:
        """Declared dependencies, entities and relations from definitions, corroboration, gaps: all without a model."""
        m = manifests.facts(self._texts(path)).select("id", "kind", "title", F.lit(1.0).alias("confidence"), F.lit("structural:manifest").alias("source"), F.lit("structural").alias("grounding"), F.lit("technical").alias("scope"))
        nodes, edges = self.table("nodes"), self.table("edges")
        ents = graph.entities(nodes.where("kind = 'table'"))
        eid = text.natural_id(F.lit("domain"), F.lit("entity"), "name_lc")
        e = ents.select(eid.alias("id"), F.lit("entity").alias("kind"), "title", F.lit(1.0).alias("confidence"), F.when(F.col("external"), "structural:code:external").otherwise("structural:code").alias("source"), F.lit("structural").alias("grounding"), F.lit("industry").alias("scope"), "name_lc", "external")
        fk = graph.foreign_keys(edges, nodes)
        ids = e.select("id", "name_lc")
        rel = fk.join(ids.select(F.col("name_lc").alias("source_entity"), F.col("id").alias("source")), "source_entity").join(ids.select(F.col("name_lc").alias("target_entity"), F.col("id").alias("target")), "target_entity")
        rel = rel.select("source", "target", F.lit("relates_to").alias("kind"), F.lit(1.0).alias("weight"), F.to_json(F.struct(F.lit("structural").alias("grounding"), F.concat(F.lit("foreign key -> "), "target_entity", F.lit(" (line "), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit(")")).alias("evidence"))).alias("metadata"))
        old = self.table("facts").where("kind <> 'knowledge_gap' or source not like 'gap:%'")
        stated = old.where("kind = 'entity' and source not like 'structural%'").select("id", "title")
        pairs = graph.reconcile(stated, e.select("id", "title"))
        every = mutate.upsert(old, schemas.conform(m.unionByName(e.drop("name_lc", "external")), schemas.FACTS.replace(" not null", "")), ["id"], keep=["created_at", "cluster_id"])
        every = graph.corroborate(every, pairs)
        rules = old.where("kind in ('business_rule', 'constraint')").select("title", "summary")
        ends = rel.select("source").union(rel.select("target")).toDF("id").distinct()
        central = e.where("not external").join(ends, "id", "left_semi").select("id", "title")
        bare = graph.ungoverned(central, rules)
        outside = graph.external_gaps(ents, fk).join(ids.withColumnRenamed("name_lc", "entity"), "entity")

        def gap(df: DataFrame, prefix: str, title, summary) -> DataFrame:
            return df.select(text.natural_id(F.lit("gap"), F.concat(F.lit(prefix), "id")).alias("id"), F.lit("knowledge_gap").alias("kind"), title.alias("title"), summary.alias("summary"), F.lit(1.0).alias("confidence"), F.lit("gap:" + prefix).alias("source"), F.lit("structural").alias("grounding"))

        gaps = gap(outside, "external:", F.concat(F.lit("External entity "), "entity"), F.concat(F.lit("referenced by "), "referrers")).unionByName(gap(bare, "ungoverned:", F.concat(F.lit("No rule mentions "), "title"), F.lit(None).cast("string")))
        self.save("facts", every.unionByName(schemas.conform(gaps, schemas.FACTS.replace(" not null", ""))))
        same = pairs.select(F.col("stated_id").alias("source"), F.col("structural_id").alias("target"), F.lit("same_as").alias("kind"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("metadata"))
        kept = self.table("fact_edges").where("kind not in ('relates_to', 'same_as')")
        self.save("fact_edges", kept.unionByName(schemas.conform(rel, schemas.FACT_EDGES.replace(" not null", ""))).unionByName(schemas.conform(same, schemas.FACT_EDGES.replace(" not null", ""))).dropDuplicates(["source", "target", "kind"]))
        return {r["kind"]: r["n"] for r in self.table("facts").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _texts(self, path: str) -> DataFrame:
        """(path, content) of all files; content only of those that declare dependencies."""
        import re

        def read(names: str | None) -> DataFrame:
            r = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            return (r.option("pathGlobFilter", names) if names else r).load(path)

        rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(path.strip("/")) + "/", "")
        every = read(None).select(rel.alias("path"), F.lit(None).cast("string").alias("content"))
        texts = read(manifests.READ).select(rel.alias("path"), F.try_validate_utf8("content").cast("string").alias("content"))
        return every.unionByName(texts).where(~F.exists(F.split("path", "/"), lambda x: x.isin(*tree.IGNORED)))

    def link(self, path: str) -> dict[str, int]:
        """Exports the project's concepts and skill evidence, then links concepts of equal names and aggregates skills."""
        project = self.register(path)
        c = self.table("concepts")
        out = c.select(text.natural_id(F.lit(project), "id").alias("id"), F.lit(project).alias("project_id"), F.col("id").alias("local_concept_id"), "name", "summary", "domain", "scope", "embedding", F.current_timestamp().alias("updated_at"))
        old = self.table("concepts_global").where(F.col("project_id") != project)
        self.save("concepts_global", old.unionByName(schemas.conform(out, DDL["concepts_global"])))
        ev = skills.last_wins(skills.evidence(self.table("files").where(F.col("project_id") == project), self.table("facts").withColumn("project_id", F.lit(project))))
        self.save("skill_evidence", self.table("skill_evidence").where(F.col("project_id") != project).unionByName(schemas.conform(ev, DDL["skill_evidence"])))
        self.save("skills", skills.synthesize(self.table("skill_evidence")))
        every = self.table("concepts_global")
        mine = every.where(F.col("project_id") == project)
        found = links.mechanical(mine, every).withColumns({"kind": F.lit("same_as"), "source": F.lit("mechanical")})
        judged = self._semantic(mine, every).withColumn("source", F.lit("agent:linker"))
        new = found.unionByName(judged).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind", "score", "source").dropDuplicates(["a", "b", "kind", "source"])
        kept = mutate.cascade(mutate.cascade(self.table("concept_links"), "a", every), "b", every)
        self.save("concept_links", mutate.upsert(kept, schemas.conform(new, DDL["concept_links"]), ["a", "b", "kind", "source"]))
        n = links.mechanical_degrees(self.table("concepts_global")).count()
        return {"linked_concepts": n, "links": self.table("concept_links").count(), "skills": self.table("skills").count()}

    def _semantic(self, mine: DataFrame, every: DataFrame) -> DataFrame:
        """(a, b, kind, score) of the closest pairs across projects that the linker confirms."""
        pairs = Scratch(self.spark).save(links.closest(mine, every, self.config["most_links"], self.config["min_similarity"]))
        c = every.select("id", F.struct("id", "name", "summary", "domain", F.col("project_id").alias("project")).alias("s"))
        j = pairs.join(c.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(c.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        got = self._answers(model.LINKER, j.select(F.concat_ws("|", "a", "b").alias("key"), F.to_json(F.struct(F.col("sa").alias("a"), F.col("sb").alias("b"))).alias("payload")))
        v = got.select(F.split("key", "[|]")[0].alias("a"), F.split("key", "[|]")[1].alias("b"), F.from_json("output_json", "struct<relation: string, confidence: double>").alias("x")).select("a", "b", "x.*").where("relation is not null")
        return links.judged(pairs, v).select("a", "b", "kind", "score")

    def verify(self, prune_below: float | None = None) -> dict[str, int]:
        """Removes orphaned facts of little confidence and what hangs on them; then pairs of facts of one concept and kind go to the verifier, and its verdicts become edges."""
        f = self.table("facts")
        gone = graph.prune_orphans(f, self.table("fact_edges"), self.table("code_links"), self.config["prune_below"] if prune_below is None else prune_below).select("id")
        n = gone.count()
        left = mutate.delete_keys(f, gone, "id")
        self.save("provenance", mutate.cascade(self.table("provenance"), "k_node_id", left))
        self.save("facts", left)
        left = self.table("facts")
        pairs = Scratch(self.spark).save(graph.verify_pairs(left, graph.VERIFIED, self.config["max_pairs"]).select("a", "b"))
        c = left.select("id", F.struct("id", "kind", "title", "summary", F.col("created_at").cast("long").alias("ts")).alias("s"))
        j = pairs.join(c.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(c.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        got = self._answers(model.VERIFIER, j.select(F.concat_ws("|", "a", "b").alias("key"), F.to_json(F.struct(F.col("sa").alias("a"), F.col("sb").alias("b"))).alias("payload")))
        v = got.select(F.split("key", "[|]")[0].alias("a"), F.split("key", "[|]")[1].alias("b"), F.from_json("output_json", "struct<verdict: string, confidence: double>").alias("x")).select("a", "b", "x.*").where("verdict is not null")
        e = Scratch(self.spark).save(graph.supersede(v))
        self.save("fact_edges", mutate.upsert(self.table("fact_edges"), schemas.conform(e.withColumn("weight", F.lit(1.0)), schemas.FACT_EDGES.replace(" not null", "")), ["source", "target", "kind"]))
        return {"pruned": n, "pairs": pairs.count(), **{r["kind"]: r["n"] for r in e.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}}

    def clean(self, path: str, yes: bool = False) -> dict[str, int]:
        """Counts what a project has in the global tables; removes it if told so."""
        p = self.table("projects").where((F.col("path") == path) | (F.col("id") == path)).first()
        if p is None:
            return {}
        c, e = self.table("concepts_global"), self.table("skill_evidence")
        counts = {"concepts": c.where(F.col("project_id") == p["id"]).count(), "evidence": e.where(F.col("project_id") == p["id"]).count()}
        if yes:
            out = skills.clean_project(p["id"], self.table("projects"), c, self.table("concept_links"), e)
            for name in ("concepts", "links", "evidence"):
                self.save({"concepts": "concepts_global", "links": "concept_links", "evidence": "skill_evidence"}[name], out[name])
            self.save("skills", skills.synthesize(self.table("skill_evidence")))
            self.save("projects", out["projects"])
        return counts

    def status(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in DDL}

    # questions

    def search(self, fragment: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        from tessera.plans.code import symbols_like

        return symbols_like(self.table("nodes"), fragment, kind, limit)

    def node(self, name: str) -> DataFrame:
        return self.table("nodes").where(F.col("name") == name).orderBy("kind", "id").limit(1)

    def recall(self, query: str, **options) -> DataFrame:
        return facts.with_window(facts.recall(self.table("facts"), query, **options), self.table("provenance"))

    def decisions(self, query: str, limit: int = 20) -> DataFrame:
        return facts.recall(self.table("facts"), query, limit, facts.DECISIONS)

    def business_logic(self, query: str, limit: int = 20) -> DataFrame:
        return facts.recall(self.table("facts"), query, limit, facts.BUSINESS)

    def facts_of_file(self, path: str, kinds: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        """The limit comes before the filter by kind."""
        f = facts.of_file(self.table("facts"), self.table("code_links"), path).orderBy(F.desc("confidence"), "id").limit(limit)
        return f.where(F.col("kind").isin(*kinds)) if kinds else f

    def explain(self, cluster_id: str) -> DataFrame:
        return graph.buckets(self.table("facts").where(F.col("cluster_id") == cluster_id))

    def domain_model(self, limit: int = 60) -> DataFrame:
        """Entities with the titles that they refer to and up to five code files."""
        f = self.table("facts")
        e = f.where("kind = 'entity'").orderBy("title", "id").limit(limit)
        out = graph.with_titles(self.table("fact_edges"), f, "title").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target_title")).alias("relates_to"))
        files = self.table("code_links").groupBy(F.col("k_node_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set("code_file")), 1, 5).alias("files"))
        return e.join(out, "id", "left").join(files, "id", "left").select("id", "title", "source", "relates_to", "files")

    def gaps(self, limit: int = 100) -> DataFrame:
        return self.table("facts").where("kind = 'knowledge_gap'").orderBy(F.desc("created_at"), "id").limit(limit)

    def skills(self, cross_only: bool = False, limit: int = 200) -> DataFrame:
        s = self.table("skills")
        return (s.where("project_count >= 2") if cross_only else s).orderBy(F.desc("evidence_weight"), "skill_id").limit(limit)

    def profile(self) -> DataFrame:
        return self.table("skills").groupBy(lattice.grounding().alias("grounding")).agg(F.count(F.lit(1)).alias("n"))

    def learn(self, limit: int = 40) -> DataFrame:
        return graph.learning_targets(self.table("facts"), limit)

    def triage_audit(self, dropped_only: bool = False, limit: int = 50) -> DataFrame:
        return triage.audit(self.table("triage"), self.table("windows"), dropped_only, limit)

    def agents(self) -> list[str]:
        return sorted(model.REGISTRY)

    def unprocessed(self) -> DataFrame:
        return incremental.unprocessed(self.table("windows"), self.table("triage"))

    SNAPSHOTS = ("triage-audit", "project-map", "decision-timeline", "cross-project-bridge", "business-logic")

    def snapshot(self, kind: str) -> DataFrame:
        """The rows behind a picture, one JSON text each."""
        f = self.table("facts")
        if kind == "triage-audit":
            df = self.triage_audit(limit=500)
        elif kind == "project-map":
            members = f.where("cluster_id is not null").join(self.table("code_links"), F.col("id") == F.col("k_node_id"), "left")
            df = members.groupBy("cluster_id").agg(F.countDistinct("id").alias("members"), F.slice(F.array_sort(F.collect_set("code_file")), 1, 20).alias("files")).orderBy(F.desc("members"), "cluster_id")
        elif kind == "decision-timeline":
            df = facts.with_window(f.where(F.col("kind").isin("decision", "constraint", "pattern", "business_rule", "problem", "solution", "intent")), self.table("provenance")).orderBy("created_at", "id")
        elif kind == "cross-project-bridge":
            df = links.mechanical_degrees(self.table("concepts_global")).orderBy(F.desc("n_links"), "id")
        elif kind == "business-logic":
            df = graph.buckets(f.join(f.where(F.col("kind").isin("business_rule", "entity", "constraint")).select("cluster_id").distinct(), "cluster_id", "left_semi"))
        else:
            raise ValueError(f"no such snapshot: {kind}")
        return df.select(F.to_json(F.struct(*df.columns)).alias("row"))
