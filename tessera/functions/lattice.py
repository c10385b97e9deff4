"""Grounding and scope: their orders and the aggregates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks of grounding, the strongest highest, and scopes of domains. Fixed values.
RANK = {"structural": 5, "corroborated": 4, "stated": 3, "external": 2, "model": 1}
SCOPE_OF = {"business_logic": "industry", "architecture": "technical", "implementation": "technical", "debugging": "technical", "devops": "technical"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def grounding(c: Column | str = "grounding") -> Column:
    """Null reads as stated."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("stated"))


def rank(c: Column | str = "grounding") -> Column:
    return F.coalesce(F.try_element_at(_map(RANK), grounding(c)), F.lit(0))


def dominant_grounding(c: Column | str = "grounding") -> Column:
    """Aggregate: the strongest grounding of a group."""
    return F.max_by(grounding(c), rank(c))


def scope_from_domain(c: Column | str = "domain") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(_map(SCOPE_OF), F.coalesce(c, F.lit(""))), F.lit("meta"))


def dominant_scope(df, key: str, scope: str = "scope", seq: str = "seq"):
    """(key, scope): the most frequent non-null scope, ties to the one seen first; keys without any have null."""
    n = df.where(F.col(scope).isNotNull()).groupBy(key, scope).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    best = n.groupBy(key).agg(F.min_by(scope, F.struct(-F.col("n"), F.col("first"))).alias(scope))
    return df.select(key).distinct().join(best, key, "left")


def enrichment(c: Column | str = "grounding") -> Column:
    return grounding(c).isin("external", "model")
