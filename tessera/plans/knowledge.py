"""Queries over facts and concepts: recall, filters, aggregates, clusters, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import lattice, text, vectors
from tessera.operators import concepts as co
from tessera.operators import facts as fa
from tessera.operators import graph, links
from tessera.plans import inputs as i
from tessera.plans.registry import query
from tessera.runtime import table
from tessera.schemas import EVIDENCE_KINDS

_ALL = ("id", "title", "summary", "evidence_text")
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _recall_sql(terms: list[str], limit: int, where: str = "TRUE") -> str:
    return f"WITH {i.S_FACTS} SELECT id, kind, title, confidence FROM kn WHERE {where} AND {i.s_match(terms, _ALL)} ORDER BY confidence DESC, updated_at DESC, id LIMIT {limit}"


@query("recall", _recall_sql(["registry"], 20, f"{i.S_GROUNDING} NOT IN ('external', 'model')"))
def recall(spark, sf):
    return fa.recall(i.facts(spark, sf), "registry").select("id", "kind", "title", "confidence")


@query("recall_phrases", _recall_sql(["operators see", "webhook"], 1000000))
def recall_phrases(spark, sf):
    """Two terms, one of them cut to a phrase at its punctuation; every match."""
    return fa.recall(i.facts(spark, sf), "Operators-see WEBHOOK", 1000000, include_enrichment=True).select("id", "kind", "title", "confidence")


@query("recall_decisions", _recall_sql(["schema"], 20, f"kind IN ({_LIST(fa.DECISIONS)}) AND {i.S_GROUNDING} NOT IN ('external', 'model')"))
def recall_decisions(spark, sf):
    return fa.recall(i.facts(spark, sf), "schema", kinds=fa.DECISIONS).select("id", "kind", "title", "confidence")


@query("recall_business", _recall_sql(["refund"], 20, f"scope = 'industry' AND kind IN ({_LIST(fa.BUSINESS)}) AND {i.S_GROUNDING} NOT IN ('external', 'model')"))
def recall_business(spark, sf):
    return fa.recall(i.facts(spark, sf), "refund", kinds=fa.BUSINESS, scope="industry").select("id", "kind", "title", "confidence")


@query(
    "context",
    f"""WITH {i.S_FACTS}, {i.S_NODES},
  a AS (SELECT 'fact' AS hit, id, title FROM kn WHERE {i.S_GROUNDING} NOT IN ('external', 'model') AND {i.s_match(["cache"], _ALL)} ORDER BY confidence DESC, updated_at DESC, id LIMIT 12),
  b AS (SELECT 'symbol' AS hit, id, name AS title FROM nd WHERE name ILIKE '%cache%' OR qualified_name ILIKE '%cache%' ORDER BY length(name), id LIMIT 8)
  SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def context(spark, sf):
    from tessera.plans.code import symbols_like

    a = fa.recall(i.facts(spark, sf), "cache", 12).select(F.lit("fact").alias("hit"), "id", "title")
    return a.unionByName(symbols_like(i.nodes(spark, sf), "cache", limit=8).select(F.lit("symbol").alias("hit"), "id", F.col("name").alias("title")))


@query("entities_like", f"WITH {i.S_FACTS} SELECT id, title FROM kn WHERE kind = 'entity' AND (title ILIKE '%cache%' OR summary ILIKE '%cache%') ORDER BY title, id LIMIT 100")
def entities_like(spark, sf):
    f = i.facts(spark, sf).where((F.col("kind") == "entity") & (text.contains_ci("title", "cache") | text.contains_ci("summary", "cache")))
    return f.orderBy("title", "id").limit(100).select("id", "title")


@query("gaps", f"WITH {i.S_FACTS} SELECT id, title FROM kn WHERE kind = 'knowledge_gap' ORDER BY created_at DESC, id LIMIT 100")
def gaps(spark, sf):
    return i.facts(spark, sf).where("kind = 'knowledge_gap'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "title")


@query("project_facts", f"WITH {i.S_FACTS} SELECT id, {i.S_GROUNDING} AS grounding FROM kn WHERE {i.S_GROUNDING} NOT IN ('external', 'model')")
def project_facts(spark, sf):
    return i.facts(spark, sf).where(~lattice.enrichment()).select("id", lattice.grounding().alias("grounding"))


@query("scope_counts", f"WITH {i.S_FACTS} SELECT coalesce(scope, 'untagged') AS value, scope IS NULL AS was_null, count(*) AS n FROM kn GROUP BY scope")
def scope_counts(spark, sf):
    return graph.scope_counts(i.facts(spark, sf), "scope", "untagged")


@query("grounding_counts", f"WITH {i.S_FACTS} SELECT coalesce(grounding, 'stated') AS value, grounding IS NULL AS was_null, count(*) AS n FROM kn GROUP BY grounding")
def grounding_counts(spark, sf):
    return graph.scope_counts(i.facts(spark, sf), "grounding", "stated")


@query("kind_counts", f"WITH {i.S_FACTS} SELECT kind, source, count(*) AS n, round(avg(confidence), 6) AS confidence FROM kn GROUP BY kind, source")
def kind_counts(spark, sf):
    return i.facts(spark, sf).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("clusterable_facts", f"WITH {i.S_FACTS} SELECT id, epoch_us(created_at) AS created_us FROM kn WHERE cluster_id IS NULL AND kind NOT IN ({_LIST(EVIDENCE_KINDS)})")
def clusterable_facts(spark, sf):
    return i.facts(spark, sf).where(F.col("cluster_id").isNull() & ~F.col("kind").isin(*EVIDENCE_KINDS)).select("id", F.unix_micros("created_at").alias("created_us"))


@query("known_concepts", f"WITH {i.S_FACTS} SELECT id, kind, title FROM kn WHERE kind IN ('entity', 'business_rule', 'constraint', 'pattern') AND {i.S_GROUNDING} <> 'model' ORDER BY title, id LIMIT 120")
def known_concepts(spark, sf):
    f = i.facts(spark, sf).where(F.col("kind").isin("entity", "business_rule", "constraint", "pattern") & (lattice.grounding() != "model"))
    return f.orderBy("title", "id").limit(120).select("id", "kind", "title")


@query("timeline", f"WITH {i.S_FACTS} SELECT id, kind, title, epoch_us(created_at) AS created_us FROM kn WHERE kind IN ('decision', 'constraint', 'pattern', 'business_rule', 'problem', 'solution', 'intent')")
def timeline(spark, sf):
    f = i.facts(spark, sf).where(F.col("kind").isin("decision", "constraint", "pattern", "business_rule", "problem", "solution", "intent"))
    return f.orderBy("created_at", "id").select("id", "kind", "title", F.unix_micros("created_at").alias("created_us"))


@query("learning_targets", f"WITH {i.S_FACTS} SELECT id, title, grounding FROM kn WHERE scope = 'industry' AND {i.S_GROUNDING} IN ('model', 'external') ORDER BY grounding DESC, title, id LIMIT 40")
def learning_targets(spark, sf):
    return graph.learning_targets(i.facts(spark, sf)).select("id", "title", "grounding")


@query("classifier_rules", f"WITH {i.S_FACTS} SELECT id, CASE WHEN summary IS NULL THEN title ELSE title || ': ' || summary END AS rule FROM kn WHERE kind = 'business_rule' ORDER BY updated_at DESC, id LIMIT 40")
def classifier_rules(spark, sf):
    f = i.facts(spark, sf).where("kind = 'business_rule'").orderBy(F.desc("updated_at"), "id").limit(40)
    return f.select("id", F.concat_ws(": ", "title", "summary").alias("rule"))


@query("modeler_inputs", f"WITH {i.S_FACTS}, a AS (SELECT 'entity' AS part, id FROM kn WHERE kind = 'entity' AND {i.S_GROUNDING} <> 'external' ORDER BY updated_at DESC, id LIMIT 60), b AS (SELECT 'fact' AS part, id FROM kn WHERE kind IN ('business_rule', 'decision', 'constraint', 'pattern') ORDER BY updated_at DESC, id LIMIT 40) SELECT * FROM a UNION ALL SELECT * FROM b")
def modeler_inputs(spark, sf):
    f = i.facts(spark, sf)
    a = f.where((F.col("kind") == "entity") & (lattice.grounding() != "external")).orderBy(F.desc("updated_at"), "id").limit(60).select(F.lit("entity").alias("part"), "id")
    b = f.where(F.col("kind").isin("business_rule", "decision", "constraint", "pattern")).orderBy(F.desc("updated_at"), "id").limit(40).select(F.lit("fact").alias("part"), "id")
    return a.unionByName(b)


_SUMMARY = f"""WITH {i.S_FACTS}, f AS (SELECT * FROM kn WHERE cluster_id IS NOT NULL),
  n AS (SELECT cluster_id, count(*) AS member_count, max_by({i.S_GROUNDING}, {i.S_RANK}) AS grounding FROM f GROUP BY cluster_id),
  s AS (SELECT cluster_id, scope, count(*) AS n, min({{'c': created_at, 'i': id}}) AS first FROM f WHERE scope IS NOT NULL GROUP BY cluster_id, scope),
  d AS (SELECT cluster_id, scope FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) = 1)
  SELECT n.cluster_id, member_count, grounding, d.scope FROM n LEFT JOIN d ON n.cluster_id = d.cluster_id"""


@query("concept_summaries", _SUMMARY)
def concept_summaries(spark, sf):
    return co.summary(i.facts(spark, sf))


@query("largest_concepts", f"SELECT cluster_id, member_count FROM ({_SUMMARY}) ORDER BY member_count DESC, cluster_id LIMIT 50")
def largest_concepts(spark, sf):
    return co.summary(i.facts(spark, sf)).orderBy(F.desc("member_count"), "cluster_id").limit(50).select("cluster_id", "member_count")


@query("concept_members", f"WITH {i.S_FACTS} SELECT cluster_id, id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, id) AS INTEGER) AS rank FROM kn WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, id) <= 25")
def concept_members(spark, sf):
    return co.members(i.facts(spark, sf)).select("cluster_id", "id", "rank")


@query("business_concepts", f"WITH {i.S_FACTS} SELECT DISTINCT cluster_id FROM kn WHERE cluster_id IS NOT NULL AND kind IN ('business_rule', 'entity', 'constraint')")
def business_concepts(spark, sf):
    return i.facts(spark, sf).where(F.col("cluster_id").isNotNull() & F.col("kind").isin("business_rule", "entity", "constraint")).select("cluster_id").distinct()


@query("explain_concepts", f"""WITH {i.S_FACTS} SELECT cluster_id,
  array_to_string(list_sort(coalesce(list(DISTINCT title) FILTER (WHERE kind = 'intent'), [])), ' / ') AS intents, array_to_string(list_sort(coalesce(list(DISTINCT title) FILTER (WHERE kind = 'problem'), [])), ' / ') AS problems,
  array_to_string(list_sort(coalesce(list(DISTINCT title) FILTER (WHERE kind IN ('constraint', 'business_rule')), [])), ' / ') AS rules, array_to_string(list_sort(coalesce(list(DISTINCT title) FILTER (WHERE kind = 'decision'), [])), ' / ') AS decisions,
  array_to_string(list_sort(coalesce(list(DISTINCT title) FILTER (WHERE kind = 'solution'), [])), ' / ') AS solutions FROM kn WHERE cluster_id IS NOT NULL GROUP BY cluster_id""")
def explain_concepts(spark, sf):
    b = graph.buckets(i.facts(spark, sf))
    return b.select("cluster_id", *[F.array_join(c, " / ").alias(c) for c in b.columns[1:]])


@query("uncategorized_buckets", f"WITH {i.S_FACTS}, {i.S_CONCEPTS} SELECT kind || ' (uncategorized)' AS bucket, count(*) AS n FROM kn WHERE cluster_id IS NULL GROUP BY kind")
def uncategorized_buckets(spark, sf):
    f = i.facts(spark, sf)
    return co.uncategorized(f, f.where("cluster_id is not null")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("verify_pairs", f"""WITH {i.S_FACTS}, f AS (SELECT id, kind, cluster_id, row_number() OVER (PARTITION BY cluster_id, kind ORDER BY created_at, id) AS i FROM kn WHERE cluster_id IS NOT NULL AND kind IN ('decision', 'constraint', 'business_rule', 'pattern')),
  p AS (SELECT a.cluster_id, a.kind, a.id AS a, b.id AS b, a.i AS i, b.i AS j FROM f a JOIN f b ON a.cluster_id = b.cluster_id AND a.kind = b.kind AND a.i < b.i)
  SELECT cluster_id, kind, a, b FROM p QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY kind, i, j) <= 5""")
def verify_pairs(spark, sf):
    return graph.verify_pairs(i.facts(spark, sf), ("decision", "constraint", "business_rule", "pattern")).select("cluster_id", "kind", "a", "b")


@query("stated_entities_reconciled", f"""WITH {i.S_FACTS}, {i.S_NODES}, k AS (SELECT id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t FROM kn WHERE kind = 'entity'),
  s AS (SELECT id, CASE WHEN length(t) > 3 AND t LIKE '%s' THEN substr(t, 1, length(t) - 1) ELSE t END AS key FROM k),
  b AS (SELECT min(id) AS structural_id, CASE WHEN length(t) > 3 AND t LIKE '%s' THEN substr(t, 1, length(t) - 1) ELSE t END AS key FROM (SELECT id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t FROM kn WHERE kind = 'pattern') GROUP BY key)
  SELECT s.id AS stated_id, structural_id, s.key FROM s JOIN b ON s.key = b.key WHERE s.key <> ''""")
def stated_entities_reconciled(spark, sf):
    f = i.facts(spark, sf)
    return graph.reconcile(f.where("kind = 'entity'"), f.where("kind = 'pattern'"))


@query("ungoverned_dependencies", f"WITH {i.S_FACTS}, r AS (SELECT lower(title) AS x FROM kn WHERE kind IN ('business_rule', 'constraint') UNION SELECT lower(summary) FROM kn WHERE kind IN ('business_rule', 'constraint')) SELECT DISTINCT title FROM kn d WHERE kind = 'dependency' AND NOT EXISTS (SELECT 1 FROM r WHERE contains(r.x, lower(d.title)))")
def ungoverned_dependencies(spark, sf):
    f = i.facts(spark, sf)
    d = f.where("kind = 'dependency'").select("title").distinct()
    return graph.ungoverned(d, f.where(F.col("kind").isin("business_rule", "constraint")))


@query("orphan_facts", f"WITH {i.S_FACTS}, {i.S_CONCEPTS} SELECT id FROM kn WHERE cluster_id IS NULL AND confidence < 0.25")
def orphan_facts(spark, sf):
    f = i.facts(spark, sf)
    e = table(spark, sf, "concept_links").select(F.col("a").alias("source"), F.col("b").alias("target"))
    none = f.limit(0).select(F.col("id").alias("k_node_id"))
    return graph.prune_orphans(f, e, none).select("id")


@query("industry_scoped", f"WITH {i.S_FACTS} SELECT CASE WHEN kind IN ('entity', 'business_rule', 'relationship') AND (scope IS NULL OR scope = 'meta') THEN 'industry' ELSE scope END AS scope, count(*) AS n FROM kn GROUP BY 1")
def industry_scoped(spark, sf):
    return graph.industry_scope(i.facts(spark, sf)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("domain_scopes", f"WITH {i.S_CONCEPTS} SELECT CASE WHEN domain = 'business_logic' THEN 'industry' WHEN domain IN ('architecture', 'implementation', 'debugging', 'devops') THEN 'technical' ELSE 'meta' END AS derived, scope, count(*) AS n FROM cg GROUP BY ALL")
def domain_scopes(spark, sf):
    return i.concepts(spark, sf).groupBy(lattice.scope_from_domain().alias("derived"), "scope").agg(F.count(F.lit(1)).alias("n"))


# concepts across projects


@query("mechanical_links", f"""WITH {i.S_CONCEPTS}, c AS (SELECT id, project_id, lower(name) AS lc, domain FROM cg),
  p AS (SELECT a.id, a.lc, count(*) AS n, count(CASE WHEN a.domain = b.domain THEN 1 END) AS n_same_domain FROM c a JOIN c b ON a.lc = b.lc AND a.project_id <> b.project_id GROUP BY a.id, a.lc),
  k AS (SELECT lc, min(id) AS class_id FROM c GROUP BY lc)
  SELECT p.id, k.class_id, p.n AS n_links, n_same_domain, round(0.6 * p.n + 0.2 * n_same_domain, 2)::DOUBLE AS total_score FROM p JOIN k ON p.lc = k.lc""")
def mechanical_links(spark, sf):
    return links.mechanical_degrees(i.concepts(spark, sf))


@query("mechanical_link_pairs", f"""WITH {i.S_CONCEPTS}, c AS (SELECT id, project_id, lower(name) AS lc, domain FROM cg)
  SELECT a.id AS a, b.id AS b, round(0.6 + CASE WHEN a.domain = b.domain THEN 0.2 ELSE 0.0 END, 2)::DOUBLE AS score FROM c a JOIN c b ON a.lc = b.lc AND a.project_id <> b.project_id WHERE CAST('0x' || a.id AS UBIGINT) % 20 = 0""")
def mechanical_link_pairs(spark, sf):
    """The links of every concept whose id is divisible by 20."""
    c = i.concepts(spark, sf)
    return links.mechanical(c.where(F.conv("id", 16, 10).cast("decimal(20,0)") % 20 == 0), c)


@query("shared_names", f"WITH {i.S_CONCEPTS} SELECT lower(name) AS lc, count(DISTINCT project_id) AS projects FROM cg GROUP BY lower(name) HAVING count(DISTINCT project_id) >= 2")
def shared_names(spark, sf):
    return i.concepts(spark, sf).groupBy(F.lower("name").alias("lc")).agg(F.countDistinct("project_id").alias("projects")).where("projects >= 2")


@query("semantic_links", f"""WITH {i.S_CONCEPTS}, c AS (SELECT id, project_id, CAST(embedding AS DOUBLE[]) AS e FROM cg WHERE embedding IS NOT NULL),
  p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM c a JOIN c b ON a.project_id <> b.project_id WHERE CAST('0x' || a.id AS UBIGINT) % 20 = 0)
  SELECT a, b, round(s, 4) AS score FROM p WHERE s >= 0.78 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5""")
def semantic_links(spark, sf):
    c = i.concepts(spark, sf)
    q = c.where(F.conv("id", 16, 10).cast("decimal(20,0)") % 20 == 0)
    return links.semantic(q, c).withColumn("score", F.round("score", 4))


@query("semantic_top_pairs", f"""WITH {i.S_CONCEPTS}, c AS (SELECT id, project_id, CAST(embedding AS DOUBLE[]) AS e FROM cg WHERE embedding IS NOT NULL),
  p AS (SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM c a JOIN c b ON a.project_id <> b.project_id WHERE CAST('0x' || a.id AS UBIGINT) % 20 = 0)
  SELECT a, b, round(s, 4) AS score FROM p WHERE s >= 0.78 ORDER BY s DESC, a, b LIMIT 200""")
def semantic_top_pairs(spark, sf):
    """The 200 closest pairs across projects in all, of the same query set."""
    c = i.concepts(spark, sf)
    q = c.where(F.conv("id", 16, 10).cast("decimal(20,0)") % 20 == 0)
    return links.closest(q, c).withColumn("score", F.round("score", 4))


@query("link_other_side", f"WITH {i.S_LINKS}, {i.S_CONCEPTS}, o AS (SELECT a AS me, b AS other, kind, score FROM li WHERE a <> b UNION SELECT b, a, kind, score FROM li WHERE a <> b) SELECT o.me, o.other, o.kind, o.score, cg.name, projects.name AS project FROM o JOIN cg ON o.other = cg.id JOIN projects ON cg.project_id = projects.id")
def link_other_side(spark, sf):
    li = i.links(spark, sf).where("a <> b")
    both = li.select(F.col("a").alias("me"), F.col("b").alias("other"), "kind", "score").union(li.select("b", "a", "kind", "score")).distinct()
    c = i.concepts(spark, sf).select(F.col("id").alias("other"), "name", "project_id")
    p = table(spark, sf, "projects").select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    return both.join(c, "other").join(p, "project_id").select("me", "other", "kind", "score", "name", "project")


@query("links_of_projects", f"WITH {i.S_LINKS}, {i.S_CONCEPTS} SELECT cg.project_id, count(DISTINCT {{'a': li.a, 'b': li.b, 'k': li.kind, 's': li.source}}) AS n FROM cg JOIN li ON cg.id = li.a OR cg.id = li.b GROUP BY cg.project_id")
def links_of_projects(spark, sf):
    li = i.links(spark, sf).select("a", "b", "kind", "source").distinct()
    ends = li.select("*", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
    j = ends.join(i.concepts(spark, sf).select("id", "project_id"), "id")
    return j.select("project_id", "a", "b", "kind", "source").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("dangling_links", f"WITH {i.S_LINKS}, {i.S_CONCEPTS} SELECT a, b, kind, source FROM li WHERE a NOT IN (SELECT id FROM cg) OR b NOT IN (SELECT id FROM cg)")
def dangling_links(spark, sf):
    li = i.links(spark, sf).select("a", "b", "kind", "source", "score")
    ids = i.concepts(spark, sf).select("id")
    x = li.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").unionByName(li.join(ids.withColumnRenamed("id", "b"), "b", "left_anti"))
    return x.distinct().select("a", "b", "kind", "source")


@query("project_centroids", f"""WITH {i.S_CONCEPTS}, v AS (SELECT project_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM cg WHERE embedding IS NOT NULL)
  SELECT project_id, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 5) AS x FROM v GROUP BY project_id, pos""")
def project_centroids(spark, sf):
    c = vectors.centroids(i.concepts(spark, sf), "project_id", "embedding")
    return c.select("project_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("nearest_centroids", """WITH v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM v GROUP BY label, pos),
  c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY label), s AS (SELECT e.vec_id, c.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS s FROM embeddings e, c)
  SELECT vec_id, label, round(s, 4) AS score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS INTEGER) AS rank FROM s WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) <= 3""")
def nearest_centroids(spark, sf):
    """Every vector against all centroids, in blocks."""
    e = table(spark, sf, "embeddings")
    c = vectors.centroids(e, "label", "embedding").select(F.col("label").alias("i_id"), F.col("centroid").alias("i_vec"))
    n = vectors.nearest(e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec")), c, 3, 0.2, exclude_self=False)
    return n.select(F.col("q_id").alias("vec_id"), F.col("i_id").alias("label"), F.round("score", 4).alias("score"), "rank")


@query("nearest_vectors", """WITH s AS (SELECT a.vec_id AS q_id, b.vec_id AS i_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT q_id, i_id, round(s, 4) AS score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY s DESC, i_id) AS INTEGER) AS rank FROM s WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s DESC, i_id) <= 5""")
def nearest_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    return vectors.nearest(q, e.select(F.col("vec_id").alias("i_id"), F.col("embedding").alias("i_vec")), 5, 0.1).withColumn("score", F.round("score", 4))


@query("concept_assignment", f"""WITH {i.S_CONCEPTS}, v AS (SELECT project_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM cg WHERE embedding IS NOT NULL),
  m AS (SELECT project_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM v GROUP BY project_id, pos), c AS (SELECT project_id, list(x ORDER BY pos) AS c FROM m GROUP BY project_id),
  s AS (SELECT id, c.project_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.c) AS s FROM cg, c WHERE embedding IS NOT NULL),
  b AS (SELECT id, s, project_id FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, project_id) = 1)
  SELECT cg.id, CASE WHEN b.s >= 0 THEN b.project_id END AS cluster, round(b.s, 4) AS score FROM cg LEFT JOIN b ON cg.id = b.id""")
def concept_assignment(spark, sf):
    """Concepts of all projects to the nearest project centroid, as the scalable clustering step does it."""
    c = i.concepts(spark, sf)
    return co.assign(c, vectors.centroids(c, "project_id", "embedding").select("project_id", "centroid"), "embedding", 0.0).withColumn("score", F.round("score", 4))


@query("concept_fold")
def concept_fold(spark, sf):
    """The exact fold by project: sequential, so it has no SQL; tests hold it against a plain loop."""
    return co.fold(i.concepts(spark, sf), "project_id", "updated_at", "embedding")
