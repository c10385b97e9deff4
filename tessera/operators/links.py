"""Links of concepts across projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors


def _named(concepts: DataFrame) -> DataFrame:
    return concepts.select("id", "project_id", F.lower("name").alias("lc"), "domain").where("lc is not null")


def mechanical_degrees(concepts: DataFrame) -> DataFrame:
    """(id, class_id, n_links, n_same_domain, total_score) of the concepts whose folded name other projects have, too.

    Counts by name, project and domain give every concept's number of links (0.6 each, 0.2
    more where the domains agree); no pair is formed, however common a name is."""
    c = _named(concepts)
    n = F.count(F.lit(1))
    fine = c.groupBy("lc", "project_id", "domain").agg(n.alias("n"), F.min("id").alias("first"))
    name = fine.groupBy("lc").agg(F.sum("n").alias("n_name"), F.min("first").alias("class_id"))
    own = fine.groupBy("lc", "project_id").agg(F.sum("n").alias("n_own"))
    same = fine.groupBy("lc", "domain").agg(F.sum("n").alias("n_domain"))
    per = fine.join(name, "lc").join(own, ["lc", "project_id"]).join(same, ["lc", "domain"], "left")
    links = (F.col("n_name") - F.col("n_own")).alias("n_links")
    agree = F.coalesce(F.col("n_domain") - F.col("n"), F.lit(0)).alias("n_same_domain")
    per = per.select("lc", "project_id", "domain", "class_id", links, agree).where("n_links > 0")
    j = c.alias("c").join(per.alias("p"), (F.col("c.lc") == F.col("p.lc")) & (F.col("c.project_id") == F.col("p.project_id")) & F.col("c.domain").eqNullSafe(F.col("p.domain")))
    return j.select("id", "class_id", "n_links", "n_same_domain", F.round(0.6 * F.col("n_links") + 0.2 * F.col("n_same_domain"), 2).alias("total_score"))


def mechanical(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """(a, b, score): the links of a stated set of concepts to those of the same folded name in other projects; 0.6, and 0.2 more where the domains agree."""
    q, c = _named(queries).alias("a"), _named(concepts).alias("b")
    j = q.join(c, (F.col("a.lc") == F.col("b.lc")) & (F.col("a.project_id") != F.col("b.project_id")))
    score = F.lit(0.6) + F.when(F.col("a.domain") == F.col("b.domain"), 0.2).otherwise(0.0)
    return j.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(score, 2).alias("score"))


def other_side(links: DataFrame, concept_id: Column | str) -> DataFrame:
    """(kind, score, source, other) of the links of a concept, whichever end it is."""
    both = links.select(F.col("a").alias("me"), F.col("b").alias("other"), "kind", "score", "source").unionByName(links.select(F.col("b").alias("me"), F.col("a").alias("other"), "kind", "score", "source"))
    return both.where((F.col("me") == concept_id) & (F.col("other") != F.col("me"))).drop("me").distinct()


def semantic(queries: DataFrame, concepts: DataFrame, min_score: float = 0.78, k: int = 5) -> DataFrame:
    """(a, b, score): for each of a stated set of concepts, its nearest in other projects by exact cosine. All concepts are read in blocks against the set."""
    q = queries.where("embedding is not null").select(F.col("id").alias("q_id"), F.col("embedding").alias("q_vec"), "project_id")
    i = concepts.where("embedding is not null").select(F.col("id").alias("i_id"), F.col("embedding").alias("i_vec"), "project_id")
    return vectors.nearest(q, i, k, min_score, group="project_id").select(F.col("q_id").alias("a"), F.col("i_id").alias("b"), "score")


def closest(queries: DataFrame, concepts: DataFrame, most: int = 200, min_score: float = 0.78) -> DataFrame:
    """(a, b, score), a < b: of all pairs of one of the queries and a concept of another project the ``most`` of the highest cosine."""
    got = vectors.closest_pairs(queries, concepts, 2 * most, min_score, "project_id")  # a pair of two queries comes twice
    return got.select(F.least("q_id", "i_id").alias("a"), F.greatest("q_id", "i_id").alias("b"), F.round("score", 9).alias("score")).dropDuplicates(["a", "b"]).orderBy(F.desc("score"), "a", "b").limit(most)


def judged(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Links of candidate pairs that a judge confirmed at 0.5 or more: score times confidence."""
    v = verdicts.where((F.col("relation") != "none") & (F.col("confidence") >= 0.5))
    return pairs.join(v, ["a", "b"]).select("a", "b", F.col("relation").alias("kind"), (F.col("score") * F.col("confidence")).alias("score"))
