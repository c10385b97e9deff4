"""Relations of the code and knowledge graphs: endpoints with titles, resolution, entities, gaps, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lattice, text
from tessera.operators.facts import mentioned


def with_titles(edges: DataFrame, nodes: DataFrame, title: str = "name") -> DataFrame:
    """Edges with the titles of both ends; those with a missing end fall away."""
    s = nodes.select(F.col("id").alias("source"), F.col(title).alias("source_title"))
    t = nodes.select(F.col("id").alias("target"), F.col(title).alias("target_title"))
    return edges.join(s, "source").join(t, "target")


def resolve_calls(refs: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(from_node_id, reference_name, n, target, candidates): a call meets the functions and methods of its name; one match is an edge, more are up to ``most`` candidates, none stays open."""
    f = nodes.where(F.col("kind").isin("function", "method")).select("id", "name").join(refs.select(F.col("reference_name").alias("name")).distinct(), "name", "left_semi")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("id"))  # cut to the first few of a name before the shuffle, too
    first = f.withColumn("r", rank).where(F.col("r") <= most).groupBy("name").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    names = f.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(first, "name")
    j = refs.join(names, refs["reference_name"] == names["name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("from_node_id", "reference_name", "n", F.when(F.col("n") == 1, F.col("ids")[0]).alias("target"), F.when(F.col("n") > 1, F.col("ids")).alias("candidates"))


def entities(tables: DataFrame) -> DataFrame:
    """(name_lc, canonical_id, title, external, n): tables grouped by folded name; a definition wins over stubs, then the smallest id; external where all are stubs."""
    stub = F.coalesce(F.col("signature").startswith("(stub)"), F.lit(False)).cast("int")
    t = tables.withColumn("stub", stub)
    return t.groupBy(F.lower("name").alias("name_lc")).agg(
        F.min_by("id", F.struct("stub", "id")).alias("canonical_id"), F.min_by("name", F.struct("stub", "id")).alias("title"), (F.min("stub") == 1).alias("external"), F.count(F.lit(1)).alias("n")
    )


def foreign_keys(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("table",)) -> DataFrame:
    """(source_entity, target_entity, line): references marked as foreign keys, from the owning table by way of ``contains``; no loops, the first of parallel ones."""
    fk = edges.where((F.col("kind") == "references") & F.col("metadata").contains("foreign_key")).select("source", "target", "line")
    tables = nodes.where(F.col("kind").isin(*kinds)).select("id", F.lower("name").alias("name_lc"))
    up = edges.where("kind = 'contains'").select(F.col("target").alias("source"), F.col("source").alias("owner")).distinct()
    own = fk.join(tables.select(F.col("id").alias("source"), F.col("name_lc").alias("direct")), "source", "left").join(up, "source", "left")
    own = own.join(tables.select(F.col("id").alias("owner"), F.col("name_lc").alias("above")), "owner", "left").withColumn("source_entity", F.coalesce("direct", "above"))
    to = own.join(tables.select(F.col("id").alias("target"), F.col("name_lc").alias("target_entity")), "target")
    return to.where("source_entity is not null and source_entity <> target_entity").groupBy("source_entity", "target_entity").agg(F.min("line").alias("line"))


def reconcile(stated: DataFrame, structural: DataFrame) -> DataFrame:
    """(stated_id, structural_id, key): stated entities meet structural ones by normalised title; the smallest structural id per key."""
    b = structural.withColumn("key", text.normalize_entity("title")).where("key <> ''").groupBy("key").agg(F.min("id").alias("structural_id"))
    return stated.withColumn("key", text.normalize_entity("title")).where("key <> ''").join(b, "key").select(F.col("id").alias("stated_id"), "structural_id", "key")


def corroborate(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both ends of every pair become corroborated, of scope industry."""
    both = pairs.select(F.explode(F.array("stated_id", "structural_id")).alias("id")).distinct().withColumn("_hit", F.lit(True))
    j = facts.join(both, "id", "left")
    return j.withColumns({"grounding": F.when(F.col("_hit"), F.lit("corroborated")).otherwise(F.col("grounding")), "scope": F.when(F.col("_hit"), F.lit("industry")).otherwise(F.col("scope"))}).drop("_hit").select(*facts.columns)


def external_gaps(entities_: DataFrame, fks: DataFrame) -> DataFrame:
    """(entity, referrers): external entities with the names of those that refer to them."""
    r = fks.groupBy(F.col("target_entity").alias("name_lc")).agg(F.array_join(F.array_sort(F.collect_set("source_entity")), ", ").alias("referrers"))
    return entities_.where("external").join(r, "name_lc", "left").select(F.col("name_lc").alias("entity"), F.coalesce("referrers", F.lit("")).alias("referrers"))


def ungoverned(central: DataFrame, rules: DataFrame, title: str = "title") -> DataFrame:
    """Central entities that no rule mentions in title or summary."""
    texts = rules.select(F.explode(F.array("title", "summary")).alias("text")).where("text is not null")
    return central.join(mentioned(central, texts, title).select(title).distinct(), title, "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n): edges that touch a node; a loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def prune_orphans(facts: DataFrame, edges: DataFrame, code_links: DataFrame, below: float = 0.25) -> DataFrame:
    """The facts to remove: little confidence, in no cluster, no edge and no code link."""
    ends = edges.select("source").union(edges.select("target")).toDF("id").distinct()
    return facts.where((F.col("confidence") < below) & F.col("cluster_id").isNull()).join(ends, "id", "left_anti").join(code_links.select(F.col("k_node_id").alias("id")), "id", "left_anti")


#: Kinds of facts that the verifier compares. Fixed values.
VERIFIED = ("decision", "business_rule", "constraint", "pattern")


def verify_pairs(facts: DataFrame, kinds: tuple[str, ...], most: int = 5) -> DataFrame:
    """(cluster_id, kind, a, b): pairs of facts of one kind in one cluster in order of creation, at most ``most`` per cluster.

    Only the first facts of a cluster can be in its first pairs, so the rest is cut before the join."""
    f = facts.where(F.col("cluster_id").isNotNull() & F.col("kind").isin(*kinds)).select("id", "kind", "cluster_id", "created_at")
    pos = F.row_number().over(Window.partitionBy("cluster_id", "kind").orderBy("created_at", "id"))
    f = f.withColumn("i", pos).where(F.col("i") <= most + 1)
    a, b = f.alias("a"), f.alias("b")
    j = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.i") < F.col("b.i")))
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy("kind", "i", "j"))
    return j.select("a.cluster_id", "a.kind", F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.i").alias("i"), F.col("b.i").alias("j")).withColumn("r", r).where(F.col("r") <= most).drop("r")


def supersede(verdicts: DataFrame) -> DataFrame:
    """Edges of accepted verdicts (confidence 0.6 or more): contradicts, or supersedes from the later to the earlier by verdict."""
    v = verdicts.where((F.col("confidence") >= 0.6) & F.col("verdict").isin("contradicts", "a_supersedes_b", "b_supersedes_a"))
    turned = F.col("verdict") == "b_supersedes_a"
    return v.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("target"), F.when(F.col("verdict") == "contradicts", "contradicts").otherwise("supersedes").alias("kind")).distinct()


def metadata_grounding(c: Column | str) -> Column:
    """The grounding that an edge's JSON tells: grounding, else from_grounding, else stated; broken JSON tells nothing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.get_json_object(c, "$.grounding"), F.get_json_object(c, "$.from_grounding"), F.lit("stated"))


def buckets(facts: DataFrame) -> DataFrame:
    """(cluster_id, intents, problems, rules, decisions, solutions): all titles of a cluster's facts by kind, in order."""

    def titles(*kinds: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("title"))))

    return facts.where("cluster_id is not null").groupBy("cluster_id").agg(titles("intent").alias("intents"), titles("problem").alias("problems"), titles("constraint", "business_rule").alias("rules"), titles("decision").alias("decisions"), titles("solution").alias("solutions"))


def scope_counts(facts: DataFrame, column: str, null_as: str) -> DataFrame:
    """(value, n); null has a name of its own but is counted apart from a value of that name."""
    return facts.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(column, F.lit(null_as)).alias("value"), F.col(column).isNull().alias("was_null"), "n")


def industry_scope(facts: DataFrame) -> DataFrame:
    """Entities, relationships and rules without a scope become industry."""
    hit = F.col("kind").isin("entity", "business_rule", "relationship") & (F.col("scope").isNull() | (F.col("scope") == "meta"))
    return facts.withColumn("scope", F.when(hit, F.lit("industry")).otherwise(F.col("scope")))


def learning_targets(facts: DataFrame, limit: int = 40) -> DataFrame:
    return facts.where((F.col("scope") == "industry") & lattice.enrichment()).orderBy(F.desc("grounding"), "title", "id").limit(limit)
