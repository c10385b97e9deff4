"""Queries over the code graph and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import code, graph
from tessera.operators import facts as fa
from tessera.plans import inputs as i
from tessera.plans.registry import query
from tessera.runtime import table
from tessera.sources import tree


def symbols_like(nodes: DataFrame, fragment: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """Symbols whose name holds a fragment, shortest names first."""
    n = nodes.where(text.contains_ci("name", fragment) | text.contains_ci("qualified_name", fragment))
    if kind:
        n = n.where(F.col("kind") == kind)
    return n.orderBy(F.length("name"), "id").limit(limit)


@query("symbol_search", f"WITH {i.S_NODES} SELECT id, kind, name FROM nd WHERE name ILIKE '%cache%' OR qualified_name ILIKE '%cache%' ORDER BY length(name), id LIMIT 10")
def symbol_search(spark, sf):
    return symbols_like(i.nodes(spark, sf), "cache").select("id", "kind", "name")


@query("class_search", f"WITH {i.S_NODES} SELECT id, kind, name FROM nd WHERE kind = 'class' AND (name ILIKE '%ledger%' OR qualified_name ILIKE '%ledger%') ORDER BY length(name), id LIMIT 10")
def class_search(spark, sf):
    return symbols_like(i.nodes(spark, sf), "ledger", "class").select("id", "kind", "name")


@query("symbol_by_name", f"WITH {i.S_NODES} SELECT id, kind, name FROM nd WHERE name = 'log_event' ORDER BY kind, id LIMIT 1")
def symbol_by_name(spark, sf):
    return i.nodes(spark, sf).where("name = 'log_event'").orderBy("kind", "id").limit(1).select("id", "kind", "name")


@query("notable_symbols", f"WITH {i.S_NODES} SELECT DISTINCT name FROM nd WHERE kind IN ('class', 'module', 'table') OR (kind = 'function' AND is_exported) ORDER BY name LIMIT 120")
def notable_symbols(spark, sf):
    n = i.nodes(spark, sf).where(F.col("kind").isin("class", "module", "table") | ((F.col("kind") == "function") & F.col("is_exported")))
    return n.select("name").distinct().orderBy("name").limit(120)


@query("relations_with_names", f"WITH {i.S_NODES}, {i.S_EDGES} SELECT e.source, e.target, e.kind, s.name AS source_title, t.name AS target_title FROM ed e JOIN nd s ON e.source = s.id JOIN nd t ON e.target = t.id WHERE e.kind <> 'contains'")
def relations_with_names(spark, sf):
    n = i.nodes(spark, sf).select("id", "name")
    return graph.with_titles(i.edges(spark, sf).where("kind <> 'contains'").select("source", "target", "kind"), n).select("source", "target", "kind", "source_title", "target_title")


@query("call_resolution", f"""WITH {i.S_NODES}, r AS (SELECT DISTINCT source, json_extract_string(metadata, '$.callee') AS callee FROM edges WHERE kind = 'calls' AND json_extract_string(metadata, '$.callee') IS NOT NULL),
  f AS (SELECT name, count(*) AS n, list_sort(list(id)) AS ids FROM nd WHERE kind IN ('function', 'method') GROUP BY name)
  SELECT r.source AS from_node_id, r.callee AS reference_name, coalesce(f.n, 0) AS n, CASE WHEN f.n = 1 THEN f.ids[1] END AS target, CASE WHEN f.n > 1 THEN array_to_string(f.ids[1:5], ',') END AS candidates FROM r LEFT JOIN f ON r.callee = f.name""")
def call_resolution(spark, sf):
    callee = F.get_json_object("metadata", "$.callee")
    refs = table(spark, sf, "edges").where("kind = 'calls'").select(F.col("source").alias("from_node_id"), callee.alias("reference_name")).where("reference_name is not null").distinct()
    r = graph.resolve_calls(refs, i.nodes(spark, sf))
    return r.withColumn("candidates", F.array_join("candidates", ","))


@query("symbol_resolution", f"""WITH {i.S_FACTS}, {i.S_NODES}, q AS (SELECT DISTINCT upper(json_extract_string(metadata, '$.callee')) AS name FROM edges WHERE kind = 'calls' AND json_extract_string(metadata, '$.callee') IS NOT NULL), s AS (SELECT id, lower(name) AS lc FROM nd WHERE kind NOT IN ('file', 'import'))
  SELECT q.name, s.id AS node_id, CAST(row_number() OVER (PARTITION BY q.name ORDER BY s.id) AS INTEGER) AS rank FROM q JOIN s ON lower(q.name) = s.lc QUALIFY row_number() OVER (PARTITION BY q.name ORDER BY s.id) <= 5""")
def symbol_resolution(spark, sf):
    q = table(spark, sf, "edges").where("kind = 'calls'").select(F.upper(F.get_json_object("metadata", "$.callee")).alias("name")).where("name is not null")
    return fa.resolve_symbols(q, i.nodes(spark, sf))


@query("path_resolution", f"""WITH {i.S_FACTS}, {i.S_FILES}, m AS (SELECT DISTINCT title AS mention FROM kn WHERE kind = 'path_mention' UNION SELECT DISTINCT unnest(target_paths) FROM tool_calls UNION SELECT regexp_extract(path, '([^/]+/[^/]+)$', 1) FROM fi UNION SELECT path FROM fi),
  j AS (SELECT m.mention, fi.path, fi.path = m.mention AS exact FROM m JOIN fi ON suffix(fi.path, m.mention) WHERE length(m.mention) > 0)
  SELECT mention, CASE WHEN bool_or(exact) THEN mention ELSE min(path) END AS path FROM j GROUP BY mention HAVING bool_or(exact) OR count(*) = 1""")
def path_resolution(spark, sf):
    m = i.facts(spark, sf).where("kind = 'path_mention'").select(F.col("title").alias("mention")).unionByName(table(spark, sf, "tool_calls").select(F.explode("target_paths").alias("mention")))
    f = i.files(spark, sf)
    m = m.unionByName(f.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("mention"))).unionByName(f.select(F.col("path").alias("mention")))
    return fa.resolve_paths(m, f)


@query("table_entities", f"""WITH {i.S_NODES}, t AS (SELECT *, coalesce(signature LIKE '(stub)%', false) AS stub FROM nd WHERE kind = 'table')
  SELECT lower(name) AS name_lc, arg_min(id, {{'s': stub, 'i': id}}) AS canonical_id, bool_and(stub) AS external, count(*) AS n FROM t GROUP BY lower(name)""")
def table_entities(spark, sf):
    return graph.entities(i.nodes(spark, sf).where("kind = 'table'")).select("name_lc", "canonical_id", "external", "n")


_FK = f"""WITH {i.S_NODES}, {i.S_EDGES}, t AS (SELECT id, lower(name) AS lc FROM nd WHERE kind IN ('table', 'class', 'interface', 'struct')), u AS (SELECT DISTINCT target AS id, source AS owner FROM ed WHERE kind = 'contains'),
  f AS (SELECT coalesce(d.lc, a.lc) AS source_entity, g.lc AS target_entity, e.line FROM ed e LEFT JOIN t d ON e.source = d.id LEFT JOIN u ON e.source = u.id LEFT JOIN t a ON u.owner = a.id JOIN t g ON e.target = g.id WHERE e.kind = 'references' AND contains(e.metadata, 'foreign_key'))
  """


@query("foreign_keys", _FK + "SELECT source_entity, target_entity, coalesce(min(line), 0) AS line FROM f WHERE source_entity <> target_entity GROUP BY ALL")
def foreign_keys(spark, sf):
    return graph.foreign_keys(i.edges(spark, sf), i.nodes(spark, sf), ("table", "class", "interface", "struct")).withColumn("line", F.coalesce("line", F.lit(0)))


@query("entity_referrers", _FK + "SELECT target_entity AS entity, string_agg(DISTINCT source_entity, ', ' ORDER BY source_entity) AS referrers FROM f WHERE source_entity <> target_entity GROUP BY target_entity")
def entity_referrers(spark, sf):
    fk = graph.foreign_keys(i.edges(spark, sf), i.nodes(spark, sf), ("table", "class", "interface", "struct"))
    names = fk.select(F.col("target_entity").alias("name_lc"), F.lit(True).alias("external")).distinct()
    return graph.external_gaps(names, fk)


@query("central_nodes", f"WITH {i.S_EDGES}, d AS (SELECT unnest(list_distinct([source, target])) AS id FROM ed WHERE kind IN ('references', 'extends')) SELECT id, count(*) AS n FROM d GROUP BY id")
def central_nodes(spark, sf):
    return graph.degrees(i.edges(spark, sf).where(F.col("kind").isin("references", "extends")))


@query("edge_grounding", "SELECT coalesce(CASE WHEN json_valid(metadata) THEN coalesce(json_extract_string(metadata, '$.grounding'), json_extract_string(metadata, '$.from_grounding')) END, 'stated') AS grounding, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.ref_kind') AS ref_kind, count(*) AS n FROM edges GROUP BY ALL")
def edge_grounding(spark, sf):
    return table(spark, sf, "edges").groupBy(graph.metadata_grounding("metadata").alias("grounding"), F.get_json_object("metadata", "$.ref_kind").alias("ref_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("dangling_edges", f"WITH {i.S_EDGES} SELECT source, target, kind FROM ed WHERE source NOT IN (SELECT id FROM nodes) OR target NOT IN (SELECT id FROM nodes)")
def dangling_edges(spark, sf):
    e = i.edges(spark, sf).select("source", "target", "kind")
    ids = table(spark, sf, "nodes").select("id").distinct()
    return e.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").unionByName(e.join(ids.withColumnRenamed("id", "target"), "target", "left_anti")).distinct()


@query("files_by_language", f"WITH {i.S_FILES} SELECT language, count(*) AS n, sum(size)::BIGINT AS bytes FROM fi GROUP BY language")
def files_by_language(spark, sf):
    return i.files(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("detected_languages", r"""SELECT path, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'sql' THEN 'sql' ELSE 'unknown' END AS language FROM (SELECT DISTINCT path FROM files)""")
def detected_languages(spark, sf):
    return table(spark, sf, "files").select("path").distinct().select("path", tree.language_of("path").alias("language"))


@query("file_changes", """WITH o AS (SELECT path, arg_min(content_hash, {'i': indexed_at, 'h': content_hash}) AS h FROM files GROUP BY path), n AS (SELECT path, arg_max(content_hash, {'i': indexed_at, 'h': content_hash}) AS h FROM files GROUP BY path)
  SELECT o.path, CASE WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS state FROM o JOIN n ON o.path = n.path""")
def file_changes(spark, sf):
    f = table(spark, sf, "files").select("path", "content_hash", "indexed_at")
    order = F.struct("indexed_at", "content_hash")
    return tree.changes(f.groupBy("path").agg(F.min_by("content_hash", order).alias("content_hash")), f.groupBy("path").agg(F.max_by("content_hash", order).alias("content_hash")))


@query("content_hashes", "SELECT path, bool_and(content_hash = sha1(content)) AS agrees FROM files WHERE content IS NOT NULL GROUP BY path")
def content_hashes(spark, sf):
    return table(spark, sf, "files").where("content is not null").groupBy("path").agg(F.min(F.col("content_hash") == F.sha1("content")).alias("agrees"))


@query("extracted_symbols")
def extracted_symbols(spark, sf):
    """Symbols read from the sources themselves; parsers, so no SQL."""
    f = table(spark, sf, "files").where("language <> 'unknown'").select("path", "language", "content").distinct()
    return code.extract(f)[0].groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("extracted_table_references")
def extracted_table_references(spark, sf):
    nodes, _, refs = code.extract(table(spark, sf, "files").where("language = 'sql'").select("path", "language", "content").distinct())
    return code.table_references(refs, nodes)[0].groupBy("target").agg(F.count(F.lit(1)).alias("n"))
