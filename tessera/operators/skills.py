"""Skills and industries aggregated over projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lattice, text

# Weights of evidence. Fixed values.
WEIGHTS = {"skill": 3.0, "tool": 1.0, "dependency": 0.5}


def language_weight(n: Column) -> Column:
    return F.least(F.lit(3.0), 1 + F.log10(n + 1))


def evidence(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(project_id, skill_id, name, weight, grounding, seq): languages by their files, then facts of the kinds with a weight, in this order."""
    langs = files.where("language is not null and language <> 'unknown'").groupBy("project_id", F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    langs = langs.select("project_id", "name", language_weight(F.col("n")).alias("weight"), F.lit("structural").alias("grounding"), F.lit(0).alias("seq"))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    f = facts.where(F.col("kind").isin(*WEIGHTS)).select("project_id", F.col("title").alias("name"), weight[F.col("kind")].alias("weight"), lattice.grounding().alias("grounding"), F.lit(1).alias("seq"))
    key = text.natural_id(F.lit("skill"), F.lit("technical"), text.normalize_skill("name"))
    return langs.unionByName(f).withColumn("skill_id", key)


def last_wins(rows: DataFrame) -> DataFrame:
    """One row per (skill, project, name): the last written."""
    best = rows.groupBy("skill_id", "project_id", "name").agg(F.max_by(F.struct("weight", "grounding"), F.struct("seq", "weight", "grounding")).alias("x"))
    return best.select("skill_id", "project_id", "name", "x.weight", "x.grounding")


def synthesize(rows: DataFrame) -> DataFrame:
    """(skill_id, name, evidence_weight, project_count, grounding) over all projects."""
    return rows.groupBy("skill_id").agg(F.min("name").alias("name"), text.round2(F.round(F.sum("weight"), 9)).alias("evidence_weight"), F.countDistinct("project_id").alias("project_count"), lattice.dominant_grounding().alias("grounding"))


def industries(rows: DataFrame) -> DataFrame:
    """(name_lc, name, projects, confidence) over (name, project_id, confidence)."""
    return rows.groupBy(F.lower("name").alias("name_lc")).agg(F.min("name").alias("name"), F.countDistinct("project_id").alias("projects"), F.avg("confidence").alias("confidence"))


def clean_project(project_id: str, projects: DataFrame, concepts: DataFrame, links: DataFrame, evidence_: DataFrame) -> dict[str, DataFrame]:
    """The global tables without a project: its concepts, the links that touch them and its evidence go; skills follow from what is left."""
    left = projects.where(F.col("id") != project_id)
    c = concepts.where(F.col("project_id") != project_id)
    ids = c.select("id").distinct()
    l = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    l = l.select(*links.columns)
    e = evidence_.where(F.col("project_id") != project_id)
    return {"projects": left, "concepts": c, "links": l, "evidence": e, "skills": synthesize(e)}
