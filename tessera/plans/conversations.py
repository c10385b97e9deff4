"""Queries over conversations: windows, roles, triage, routing, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import facts as fa
from tessera.operators import enrichment, incremental, triage
from tessera.operators import windows as wi
from tessera.plans import inputs as i
from tessera.plans.registry import query
from tessera.runtime import Scratch, table


@query("turn_windows", f"WITH {i.S_WINDOWS} SELECT id, session_id, start_idx, end_idx, n_turns, text_hash FROM wi")
def turn_windows(spark, sf):
    return i.windows(spark, sf).select("id", "session_id", "start_idx", "end_idx", "n_turns", "text_hash")


@query("window_sizes", f"WITH {i.S_WINDOWS} SELECT n_turns, count(*) AS n, max(length(text)) AS longest FROM wi GROUP BY n_turns")
def window_sizes(spark, sf):
    return i.windows(spark, sf).groupBy("n_turns").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query("next_turn_index", "SELECT session_id, coalesce(max(idx), -1) + 1 AS next_idx FROM turns GROUP BY session_id")
def next_turn_index(spark, sf):
    return wi.next_index(table(spark, sf, "turns"))


@query("session_role_mix", f"WITH {i.S_TURNS} SELECT session_id, role, count(*) AS n FROM tn GROUP BY session_id, role")
def session_role_mix(spark, sf):
    return wi.clean(table(spark, sf, "turns")).groupBy("session_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("triage_keep", f"WITH {i.S_LABELS} SELECT window_id, {i.S_KEEP} AS kept FROM lb")
def triage_keep(spark, sf):
    return i.labels(i.windows(spark, sf)).select("window_id", triage.keep().alias("kept"))


@query(
    "extraction_tasks",
    f"""WITH {i.S_LABELS}, ta AS (SELECT window_id, unnest(list_filter([
      CASE WHEN domain IN ('architecture', 'implementation', 'business_logic', 'debugging', 'devops') AND quality IN ('signal', 'decision_grade') THEN 'decision' END,
      CASE WHEN domain IN ('business_logic', 'architecture') THEN 'businessLogic' END,
      CASE WHEN domain IN ('architecture', 'implementation', 'business_logic', 'debugging') THEN 'intent' END,
      CASE WHEN domain IN ('debugging', 'implementation') THEN 'problemSolution' END], lambda x: x IS NOT NULL)) AS agent FROM lb WHERE {i.S_KEEP}) SELECT window_id, agent FROM ta""",
)
def extraction_tasks(spark, sf):
    return triage.tasks(i.labels(i.windows(spark, sf)))


@query("triage_audit", f"WITH {i.S_LABELS} SELECT l.window_id, w.session_id, w.start_idx, substr(w.text, 1, 600) AS excerpt FROM lb l JOIN wi w ON l.window_id = w.id WHERE NOT ({i.S_KEEP}) ORDER BY l.produced_at DESC, l.window_id LIMIT 50")
def triage_audit(spark, sf):
    w = i.windows(spark, sf)
    return triage.audit(i.labels(w), w, dropped_only=True).select("window_id", "session_id", "start_idx", "excerpt")


@query("triage_axes", f"WITH {i.S_LABELS} SELECT domain, quality, count(*) AS n, sum(CASE WHEN {i.S_KEEP} THEN 1 ELSE 0 END)::BIGINT AS kept FROM lb GROUP BY domain, quality")
def triage_axes(spark, sf):
    return i.labels(i.windows(spark, sf)).groupBy("domain", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum(triage.keep().cast("long")).alias("kept"))


@query("window_evidence")
def window_evidence(spark, sf):
    """Code blocks, commands, URLs, paths, tickets and error lines; the patterns look around, which the other engine's can't."""
    return fa.evidence(i.windows(spark, sf))


@query("ticket_mentions", r"""SELECT turn_key, unnest(list_distinct(regexp_extract_all(t, '\b([A-Z][A-Z0-9]{1,9}-\d+)\b', 1))) AS ticket FROM (SELECT DISTINCT id AS turn_key, text AS t FROM turns WHERE text IS NOT NULL)""")
def ticket_mentions(spark, sf):
    t = table(spark, sf, "turns").where("text is not null").select(F.col("id").alias("turn_key"), "text").distinct()
    return t.select("turn_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(text.TICKET), 1))).alias("ticket"))


@query("fence_languages", r"""SELECT lang, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '```([a-zA-Z0-9_+-]*)\r?\n((?s:.)*?)```', 1)) AS lang FROM (SELECT DISTINCT doc_id, text AS t FROM documents WHERE text IS NOT NULL)) GROUP BY lang""")
def fence_languages(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select(F.explode(F.regexp_extract_all("text", F.lit(text.FENCE), 1)).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("clamped_windows", f"WITH {i.S_WINDOWS} SELECT id, CASE WHEN length(text) <= 600 THEN text ELSE substr(text, 1, 284) || chr(10) || chr(10) || '...[trimmed ' || (length(text) - 568) || ' chars]...' || chr(10) || chr(10) || substr(text, length(text) - 283, 284) END AS clamped FROM wi")
def clamped_windows(spark, sf):
    return i.windows(spark, sf).select("id", text.clamp("text", 600).alias("clamped"))


@query("new_windows", f"WITH {i.S_WINDOWS} SELECT id, session_id FROM wi WHERE id NOT IN (SELECT id FROM wi WHERE end_idx < 10)")
def new_windows(spark, sf):
    """The windows that turns from index 10 on bring, as a second run finds them against the first one's ids."""
    t = wi.clean(table(spark, sf, "turns"))
    first = i.windows(spark, sf).where("end_idx < 10")
    return incremental.new_windows(t, t, first).select("id", "session_id")


@query("raw_window_hashes", "SELECT id, max(CAST(text_hash = sha1(text) AS INTEGER)) = 1 AS hash_agrees FROM pending_windows GROUP BY id")
def raw_window_hashes(spark, sf):
    return table(spark, sf, "pending_windows").groupBy("id").agg((F.max((F.col("text_hash") == F.sha1("text")).cast("int")) == 1).alias("hash_agrees"))


@query("tool_paths", "SELECT path, count(*) AS n FROM (SELECT DISTINCT id, unnest(target_paths) AS path FROM tool_calls) GROUP BY path")
def tool_paths(spark, sf):
    t = table(spark, sf, "tool_calls").select("id", F.explode("target_paths").alias("path")).distinct()
    return t.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("tool_mix", "SELECT name, count(DISTINCT id) AS calls, count(DISTINCT CASE WHEN try_cast(args AS JSON) IS NULL THEN id END) AS broken FROM tool_calls WHERE args IS NOT NULL GROUP BY name")
def tool_mix(spark, sf):
    t = table(spark, sf, "tool_calls").where("args is not null").select("id", "name", F.try_parse_json("args").isNull().alias("bad")).distinct()
    return t.groupBy("name").agg(F.countDistinct("id").alias("calls"), F.countDistinct(F.when(F.col("bad"), F.col("id"))).alias("broken"))


@query("dangling_tool_calls", "SELECT DISTINCT id FROM tool_calls WHERE turn_id NOT IN (SELECT id FROM turns WHERE id IS NOT NULL)")
def dangling_tool_calls(spark, sf):
    c = table(spark, sf, "tool_calls").where("turn_id is not null").select("id", "turn_id")
    return c.join(table(spark, sf, "turns").select(F.col("id").alias("turn_id")).distinct(), "turn_id", "left_anti").select("id").distinct()


@query("near_duplicate_windows")
def near_duplicate_windows(spark, sf):
    """Windows whose id is divisible by 20 against all others, by hashed words; the embedding has no SQL."""
    keep = Scratch(spark)
    t = keep.save(wi.clean(table(spark, sf, "turns")).drop("ts"))  # windows read it twice
    e = keep.save(enrichment.hash_embedding(wi.segment(t), "id", "text"))
    keep.drop(t)
    q = e.where(F.conv("id", 16, 10).cast("decimal(20,0)") % 20 == 0)
    return enrichment.duplicates(q, e).withColumn("score", F.round("score", 4))
