"""Queries over the audit of runs; events stand for it (event type: agent, user: model, value: milliseconds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import incremental, mutate
from tessera.plans.registry import query
from tessera.runtime import table


def runs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("agent_name"), F.col("user_id").alias("model"), F.get_json_object("props", "$.k").alias("input_hash"), F.col("value").alias("ms"), (F.col("value") >= 5).alias("ok"), F.col("ts").alias("produced_at"))


_RUNS = "WITH r AS (SELECT event_id AS id, event_type AS agent_name, user_id AS model, json_extract_string(props, '$.k') AS input_hash, value AS ms, value >= 5 AS ok, ts AS produced_at FROM events)"


@query("latest_runs", _RUNS + " SELECT agent_name, model, input_hash, id FROM r QUALIFY row_number() OVER (PARTITION BY agent_name, model, input_hash ORDER BY produced_at DESC, id DESC) = 1")
def latest_runs(spark, sf):
    r = runs(spark, sf).groupBy("agent_name", "model", "input_hash").agg(F.max_by("id", F.struct("produced_at", "id")).alias("id"))
    return r


@query("cache_hits", _RUNS + ", g AS (SELECT DISTINCT agent_name, model, input_hash FROM r WHERE ok AND id % 2 = 1) SELECT r.id, g.agent_name IS NOT NULL AS hit FROM r LEFT JOIN g USING (agent_name, model, input_hash) WHERE r.id % 2 = 0")
def cache_hits(spark, sf):
    r = runs(spark, sf)
    return incremental.cache_split(r.where("id % 2 = 0"), r.where("id % 2 = 1"), ["agent_name", "model", "input_hash"]).select("id", "hit")


@query("unexpired_runs", _RUNS + " SELECT id FROM r WHERE NOT (agent_name = 'click' AND produced_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY)")
def unexpired_runs(spark, sf):
    return incremental.expired(runs(spark, sf), "click", "2024-01-20 00:00:00", 5).select("id")


@query("run_times", _RUNS + " SELECT agent_name, count(*) AS n, sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS good, round(avg(ms), 6) AS mean_ms, max(ms) AS max_ms FROM r GROUP BY agent_name")
def run_times(spark, sf):
    return runs(spark, sf).groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("good"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("max_ms"))


@query("resumed_rows", _RUNS + ", o AS (SELECT model, max(id) AS p FROM r WHERE id < 500 GROUP BY model) SELECT r.id, r.model FROM r LEFT JOIN o ON r.model = o.model WHERE o.p IS NULL OR r.id > o.p")
def resumed_rows(spark, sf):
    r = runs(spark, sf).select("id", "model")
    seen = incremental.offsets(r.where("id < 500"), "model", "id")
    return incremental.new_rows(r, seen, "model", "id")


@query("runs_inserted_once", _RUNS + " SELECT agent_name, model, min(id) AS id FROM r GROUP BY agent_name, model")
def runs_inserted_once(spark, sf):
    r = runs(spark, sf).groupBy("agent_name", "model").agg(F.min("id").alias("id"))
    return mutate.insert_absent(r, r, ["agent_name", "model"])
