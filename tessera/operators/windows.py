"""Turn windows: each user turn opens one that runs to the next user turn, at most
MOST_TURNS turns or MOST_CHARS characters; windows without a reply fall away.

A conversation may hold a third of all turns, so running sums go by blocks of
consecutive turns: sums of blocks first, then sums inside a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_TURNS, MOST_CHARS, BLOCK = 12, 8000, 4096


def clean(turns: DataFrame) -> DataFrame:
    """One row per (session_id, idx): copies of a turn and repeated ingests collapse; roles trimmed and lower-cased; unknown roles dropped."""
    role = F.lower(F.trim("role"))
    t = turns.where(F.col("session_id").isNotNull() & F.col("idx").isNotNull()).select("session_id", "idx", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "ts")
    return t.where(F.col("role").isin("user", "assistant", "tool", "system")).groupBy("session_id", "idx").agg(F.min(F.struct("role", "text")).alias("x"), F.min("ts").alias("ts")).select("session_id", "idx", "x.role", "x.text", "ts")


def segment(turns: DataFrame, most_turns: int = MOST_TURNS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, session_id, start_idx, end_idx, n_turns, text, text_hash) from clean turns."""
    user = (F.col("role") == "user").cast("int")
    t = turns.withColumn("b", F.floor(F.col("idx") / BLOCK))
    blocks = t.groupBy("session_id", "b").agg(F.sum(user).alias("u"))
    before = blocks.withColumn("u0", F.coalesce(F.sum("u").over(Window.partitionBy("session_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("u")
    inside = F.sum(user).over(Window.partitionBy("session_id", "b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    g = t.withColumn("g", inside).join(before, ["session_id", "b"]).withColumn("g", F.col("g") + F.col("u0")).where("g > 0")
    w = Window.partitionBy("session_id", "g").orderBy("idx")
    g = g.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most_turns)
    chars = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")
    g = g.withColumn("before", chars).where(F.col("before") < most_chars)
    turn = F.concat(F.lit("["), "role", F.lit("] "), "text")
    out = g.groupBy("session_id", "g").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count(F.lit(1)).alias("n_turns"), F.max(F.col("role").isin("assistant", "tool")).alias("replied"),
        F.array_sort(F.collect_list(F.struct("idx", turn.alias("t")))).alias("ts"),
    )
    text = F.regexp_replace(F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    out = out.where("replied").withColumn("text", text).withColumn("text_hash", F.sha1("text"))
    wid = F.substring(F.sha1(F.concat_ws("|", "session_id", "start_idx", "end_idx", "text_hash")), 1, 16)
    return out.select(wid.alias("id"), "session_id", "start_idx", "end_idx", "n_turns", "text", "text_hash")


def next_index(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("next_idx"))
