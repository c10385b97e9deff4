"""Queries over projects: skills, industries, status, removal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import mutate, skills
from tessera.plans import inputs as i
from tessera.plans.registry import query
from tessera.runtime import table

_P = "pr AS (SELECT id AS project_id, row_number() OVER (ORDER BY id) - 1 AS n FROM projects)"
_H = "(strpos('0123456789abcdef', substr(kn.id, {0}, 1)) - 1)"
_FACTS = f"pf AS (SELECT pr.project_id, CASE kn.kind WHEN 'ticket_id' THEN 'skill' WHEN 'url' THEN 'tool' ELSE kn.kind END AS kind, kn.title, kn.grounding, kn.confidence FROM kn JOIN pr ON (16 * {_H.format(1)} + {_H.format(2)}) % 40 = pr.n WHERE kn.kind IN ('dependency', 'ticket_id', 'url', 'entity'))"


def facts_of_projects(spark, sf):
    """Facts with a project by the first digits of their ids (the facts' table has none); tickets stand for skills, URLs for tools."""
    n = F.row_number().over(Window.orderBy("id")) - 1  # projects are few by definition
    p = table(spark, sf, "projects").select(F.col("id").alias("project_id"), n.alias("n"))
    f = i.facts(spark, sf).where(F.col("kind").isin("dependency", "ticket_id", "url", "entity"))
    kind = F.when(F.col("kind") == "ticket_id", "skill").when(F.col("kind") == "url", "tool").otherwise(F.col("kind"))
    f = f.withColumn("n", (16 * i.digit("id", 1) + i.digit("id", 2)) % 40)
    return f.join(F.broadcast(p), "n").select("project_id", kind.alias("kind"), "title", "grounding", "confidence")


_ROWS = f"""WITH {i.S_FILES}, {i.S_FACTS}, {_P}, {_FACTS},
  ev AS (SELECT project_id, language AS name, least(3.0, 1 + log10(count(*) + 1)) AS weight, 'structural' AS grounding, 0 AS seq FROM fi WHERE language <> 'unknown' GROUP BY ALL
    UNION ALL SELECT project_id, title, CASE kind WHEN 'skill' THEN 3.0 WHEN 'tool' THEN 1.0 ELSE 0.5 END, coalesce(grounding, 'stated'), 1 FROM pf WHERE kind <> 'entity'),
  ek AS (SELECT *, substr(sha1('skill|technical|' || trim(regexp_replace(lower(name), '\\s+', ' ', 'g'))), 1, 16) AS skill_id FROM ev),
  lw AS (SELECT * FROM ek QUALIFY row_number() OVER (PARTITION BY skill_id, project_id, name ORDER BY seq DESC, weight DESC, grounding DESC) = 1)
  """


def rows(spark, sf):
    return skills.last_wins(skills.evidence(i.files(spark, sf), facts_of_projects(spark, sf)))


@query("language_weights", f"WITH {i.S_FILES} SELECT project_id, language, round(least(3.0, 1 + log10(count(*) + 1)), 6) AS weight FROM fi WHERE language <> 'unknown' GROUP BY ALL")
def language_weights(spark, sf):
    f = i.files(spark, sf).where("language <> 'unknown'").groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return f.select("project_id", "language", F.round(skills.language_weight(F.col("n")), 6).alias("weight"))


@query("skill_evidence", _ROWS + "SELECT skill_id, project_id, name, round(weight, 6) AS weight, grounding FROM lw")
def skill_evidence(spark, sf):
    return rows(spark, sf).withColumn("weight", F.round("weight", 6))


_SKILLS = _ROWS + f"SELECT skill_id, min(name) AS name, floor(round(sum(weight), 9) * 100 + 0.5) / 100 AS evidence_weight, count(DISTINCT project_id) AS project_count, max_by({i.S_GROUNDING}, {i.S_RANK}) AS grounding FROM lw GROUP BY skill_id"


@query("skills", _SKILLS)
def skills_(spark, sf):
    return skills.synthesize(rows(spark, sf))


@query("cross_project_skills", f"SELECT skill_id, name, evidence_weight, project_count FROM ({_SKILLS}) WHERE project_count >= 2 ORDER BY evidence_weight DESC, skill_id LIMIT 200")
def cross_project_skills(spark, sf):
    return skills_(spark, sf).where("project_count >= 2").orderBy(F.desc("evidence_weight"), "skill_id").limit(200).select("skill_id", "name", "evidence_weight", "project_count")


@query("skills_by_grounding", f"SELECT grounding, count(*) AS n FROM ({_SKILLS}) GROUP BY grounding")
def skills_by_grounding(spark, sf):
    return skills_(spark, sf).groupBy("grounding").agg(F.count(F.lit(1)).alias("n"))


@query("industries", f"WITH {i.S_FACTS}, {_P}, {_FACTS} SELECT lower(title) AS name_lc, min(title) AS name, count(DISTINCT project_id) AS projects, round(avg(confidence), 6) AS confidence FROM pf WHERE kind = 'entity' GROUP BY lower(title)")
def industries(spark, sf):
    f = facts_of_projects(spark, sf).where("kind = 'entity'").select(F.col("title").alias("name"), "project_id", "confidence")
    return skills.industries(f).withColumn("confidence", F.round("confidence", 6))


@query("status", f"""WITH {i.S_FACTS}, {i.S_NODES}, {i.S_EDGES}, {i.S_CONCEPTS} SELECT 'code' AS layer, 'nodes' AS metric, count(*) AS n FROM nd UNION ALL SELECT 'code', 'tables', count(*) FROM nd WHERE kind = 'table' UNION ALL SELECT 'code', 'edges', count(*) FROM ed
  UNION ALL SELECT 'knowledge', 'facts', count(*) FROM kn UNION ALL SELECT 'knowledge', 'clustered', count(*) FROM kn WHERE cluster_id IS NOT NULL UNION ALL SELECT 'knowledge', 'concepts', count(DISTINCT cluster_id) FROM kn
  UNION ALL SELECT 'global', 'concepts', count(*) FROM cg UNION ALL SELECT 'global', 'embedded', count(*) FROM cg WHERE embedding IS NOT NULL UNION ALL SELECT 'conversations', 'sessions', count(DISTINCT session_id) FROM turns UNION ALL SELECT 'conversations', 'turns', count(DISTINCT id) FROM turns""")
def status(spark, sf):
    def part(layer, df, **metrics):
        one = df.agg(*[m.alias(k) for k, m in metrics.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(k).alias("metric"), F.col(k).alias("n")) for k in metrics])).alias("x")).select("x.*")

    n = F.count(F.lit(1))
    c = i.concepts(spark, sf)
    return (
        part("code", i.nodes(spark, sf), nodes=n, tables=F.count_if(F.col("kind") == "table"))
        .unionByName(part("code", i.edges(spark, sf), edges=n))
        .unionByName(part("knowledge", i.facts(spark, sf), facts=n, clustered=F.count("cluster_id"), concepts=F.countDistinct("cluster_id")))
        .unionByName(part("global", c, concepts=n, embedded=F.count_if(F.col("embedding").isNotNull())))
        .unionByName(part("conversations", table(spark, sf, "turns"), sessions=F.countDistinct("session_id"), turns=F.countDistinct("id")))
    )


_FIRST = "(SELECT min(id) FROM projects)"


def _first(spark, sf):
    return table(spark, sf, "projects").agg(F.min("id")).first()[0]


@query("clean_project", f"WITH {i.S_CONCEPTS}, {i.S_LINKS}, c AS (SELECT id FROM cg WHERE project_id <> {_FIRST}) SELECT 'concepts' AS part, count(*) AS n FROM c UNION ALL SELECT 'links', count(*) FROM li WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c) UNION ALL SELECT 'projects', count(*) FROM projects WHERE id <> {_FIRST}")
def clean_project(spark, sf):
    out = skills.clean_project(_first(spark, sf), table(spark, sf, "projects"), i.concepts(spark, sf), i.links(spark, sf), rows(spark, sf))
    n = F.count(F.lit(1)).alias("n")
    return out["concepts"].agg(n).select(F.lit("concepts").alias("part"), "n").unionByName(out["links"].agg(n).select(F.lit("links").alias("part"), "n")).unionByName(out["projects"].agg(n).select(F.lit("projects").alias("part"), "n"))


@query("project_concept_counts", f"WITH {i.S_CONCEPTS} SELECT p.id, p.name, count(c.id) AS n FROM projects p LEFT JOIN cg c ON c.project_id = p.id GROUP BY p.id, p.name")
def project_concept_counts(spark, sf):
    n = i.concepts(spark, sf).groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "projects").select("id", "name").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("upserted_facts", f"""WITH {i.S_FACTS}, nw AS (SELECT id, upper(title) AS title FROM kn WHERE kind = 'decision') SELECT kn.id, coalesce(nw.title, kn.title) AS title, kn.cluster_id, epoch_us(kn.created_at) AS created_us FROM kn LEFT JOIN nw ON kn.id = nw.id""")
def upserted_facts(spark, sf):
    """Decisions written again with new titles; cluster and creation time stay."""
    f = i.facts(spark, sf).select("id", "title", "cluster_id", "created_at")
    new = i.facts(spark, sf).where("kind = 'decision'").select("id", F.upper("title").alias("title"), F.lit(None).cast("string").alias("cluster_id"), F.current_timestamp().alias("created_at"))
    return mutate.upsert(f, new, ["id"], keep=["cluster_id", "created_at"]).select("id", "title", "cluster_id", F.unix_micros("created_at").alias("created_us"))


@query("absorbed_concepts", f"WITH {i.S_FACTS}, m AS (SELECT min(cluster_id) AS a, max(cluster_id) AS b FROM kn) SELECT CASE WHEN cluster_id = m.b THEN m.a ELSE cluster_id END AS cluster_id, count(*) AS n FROM kn, m WHERE cluster_id IS NOT NULL GROUP BY 1")
def absorbed_concepts(spark, sf):
    """One concept absorbs another: its members are re-pointed."""
    f = i.facts(spark, sf)
    a, b = f.agg(F.min("cluster_id"), F.max("cluster_id")).first()
    g = mutate.update_where(f.where("cluster_id is not null"), F.col("cluster_id") == b, {"cluster_id": F.lit(a)})
    return g.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
