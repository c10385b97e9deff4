"""What a second run may skip: resumed transcripts, new windows, cached calls, stale results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import segment


def new_rows(rows: DataFrame, offsets: DataFrame, key: str = "source_path", position: str = "position") -> DataFrame:
    """Rows beyond the last position of an earlier run, by file."""
    o = offsets.select(key, F.col("last_position"))
    return rows.join(o, key, "left").where(F.col("last_position").isNull() | (F.col(position) > F.col("last_position"))).drop("last_position")


def offsets(rows: DataFrame, key: str = "source_path", position: str = "position") -> DataFrame:
    return rows.groupBy(key).agg(F.max(position).alias("last_position"))


def new_windows(turns: DataFrame, touched: DataFrame, known: DataFrame) -> DataFrame:
    """The windows of touched sessions that weren't there: ids tell content, so unchanged ones fall out."""
    t = turns.join(touched.select("session_id").distinct(), "session_id", "left_semi")
    return segment(t).join(known.select("id"), "id", "left_anti")


def unprocessed(windows: DataFrame, processed: DataFrame, mode: str = "new") -> DataFrame:
    return windows if mode == "full" else windows.join(processed.select(F.col("window_id").alias("id")), "id", "left_anti")


def cache_split(requests: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with ``hit``: whether a good earlier run has the same keys."""
    good = runs.where("ok").select(*keys).distinct().withColumn("_hit", F.lit(True))
    return requests.join(good, keys, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def expired(runs: DataFrame, agent: str, as_of, days: int) -> DataFrame:
    """The runs without those of an agent that are older than so many days at a given time."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return runs.where(~((F.col("agent_name") == agent) & (F.col("produced_at") < cutoff)))
