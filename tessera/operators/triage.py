"""Triage labels: the rule that keeps or drops a window, routing to extractors, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains that each extractor reads. Fixed values.
ROUTES = {
    "decision": ("architecture", "implementation", "business_logic", "debugging", "devops"),
    "businessLogic": ("business_logic", "architecture"),
    "intent": ("architecture", "implementation", "business_logic", "debugging"),
    "problemSolution": ("debugging", "implementation"),
}


def keep() -> Column:
    """False only for labels at confidence 0.6 or more that say noise, off topic, unrelated or mere chat."""
    noise = (F.col("quality") == "noise") | (F.col("relevance") == "off_topic") | (F.col("linkage") == "unrelated") | ((F.col("domain") == "chitchat") & (F.col("quality") != "decision_grade"))
    return ~F.coalesce((F.col("confidence") >= 0.6) & noise, F.lit(False))


def routes() -> Column:
    """The extractors for a label; only the first looks at quality."""
    d = F.col("domain")
    arms = [F.when(d.isin(*ds) & (F.col("quality").isin("signal", "decision_grade") if a == "decision" else F.lit(True)), F.lit(a)) for a, ds in ROUTES.items()]
    return F.array_compact(F.array(*arms))


def tasks(labels: DataFrame) -> DataFrame:
    """(window_id, agent) for kept windows that no other one duplicates."""
    return labels.where(keep() & F.col("dup_of").isNull()).select("window_id", F.explode(routes()).alias("agent"))


def failed(windows: DataFrame) -> DataFrame:
    """The labels that a window gets when its model call failed: kept, with little confidence."""
    return windows.select(F.col("id").alias("window_id"), F.lit("unknown").alias("relevance"), F.lit("unknown").alias("domain"), F.lit("signal").alias("quality"), F.lit("this_project").alias("linkage"), F.lit(0.1).alias("confidence"))


def audit(labels: DataFrame, windows: DataFrame, dropped_only: bool = False, limit: int = 50) -> DataFrame:
    """Labels with their windows' places and first 600 characters, newest first."""
    l = labels.withColumn("kept", keep())
    if dropped_only:
        l = l.where("not kept")
    w = windows.select(F.col("id").alias("window_id"), "session_id", "start_idx", "end_idx", F.substring("text", 1, 600).alias("excerpt"))
    return l.join(w, "window_id").orderBy(F.desc("produced_at"), "window_id").limit(limit)
