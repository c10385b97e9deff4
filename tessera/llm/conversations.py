"""Rebuilding conversations from message rows.

Rows are partitioned by conversation key and cut into parts of consecutive sequence
numbers, so that no task ever holds a whole conversation. A deterministic automaton
validates roles, blank turns and missing replies: each part folds its turns, sorted by
sequence number, to the function from entry state to exit state; the functions of the
parts compose to that of the conversation.

Defined results: rows equal in id, role (trimmed, lower-cased) and text are one turn;
null session ids form no conversation; a null idx breaks its conversation; blank means
null or only Unicode white space; ties in idx break a conversation, whatever their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sequence numbers in a part, and parts folded at once.
PART = 1024

#: Unicode white space (all code points with the property White_Space, and the four separators U+001C to U+001F). Fixed values.
BLANK = r"^[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*$"

_WS = BLANK[1:-2]

#: States: 0 only system turns yet, 1 in a run of user turns, 2 run ended but not answered, 3 answered, 4 broken.
STATES = "01234"
#: By kind of turn, the states after each of the states 0 to 4.
MOVES = {
    "system": "01234",
    "user": "11414",
    "reply": "43334",  # an assistant's turn with text
    "other": "42234",  # a tool's turn, or an assistant's without text
    "bad": "44444",
}


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.rlike(BLANK)


def role_of(c: Column | str = "role") -> Column:
    return F.lower(F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", ""))


def _move() -> Column:
    r, full = F.col("role_n"), ~F.col("blank")
    return (
        F.when(r == "system", MOVES["system"]).when(r == "user", MOVES["user"])
        .when((r == "assistant") & full, MOVES["reply"]).when(r.isin("assistant", "tool"), MOVES["other"])
        .otherwise(MOVES["bad"])
    )


def _fold(items: Column) -> Column:
    return F.aggregate(F.transform(F.array_sort(items), lambda x: x["m"]), F.lit(STATES), lambda acc, m: F.call_function("translate", acc, F.lit(STATES), m))


def verdicts(turns: DataFrame) -> DataFrame:
    """(session_id, n_turns, state, dense, has_user, valid) of every conversation."""
    t = turns.where("session_id is not null").select(
        "session_id", "id", F.col("idx").cast("long").alias("idx"), role_of().alias("role_n"), blank("text").alias("blank"),
        F.xxhash64("text").alias("h1"), F.hash(F.reverse("text")).alias("h2"), F.length("text").alias("h3"),
    )
    one = t.groupBy(*t.columns).agg(F.lit(1).alias("_")).drop("_")
    m = _move()
    by_idx = one.groupBy("session_id", "idx").agg(F.min(m).alias("m"), F.count(F.lit(1)).alias("n"), F.max((F.col("role_n") == "user") & ~F.col("blank")).alias("has_user"))
    parts = by_idx.withColumn("part", F.floor(F.col("idx") / PART)).groupBy("session_id", "part").agg(
        _fold(F.collect_list(F.struct(F.col("idx").alias("k"), "m"))).alias("m"), F.max("n").alias("most"), F.sum("n").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"),
        F.max("has_user").alias("has_user"), F.max(F.col("idx").isNull()).alias("no_idx"),
    )

    def merged(df: DataFrame, key: list[str]) -> DataFrame:
        return df.groupBy("session_id", *key).agg(
            _fold(F.collect_list(F.struct(F.col("part").alias("k"), "m"))).alias("m"), F.max("most").alias("most"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.max("has_user").alias("has_user"), F.max("no_idx").alias("no_idx"),
        )

    whole = merged(merged(parts.withColumn("over", F.floor(F.col("part") / PART)), ["over"]).withColumnRenamed("over", "part"), [])
    state = F.substring("m", 1, 1)
    dense = (F.col("most") == 1) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & ~F.col("no_idx")
    return whole.select(
        "session_id", F.col("n").alias("n_turns"), state.alias("state"), F.coalesce(dense, F.lit(False)).alias("dense"), "has_user",
        (F.coalesce(dense, F.lit(False)) & F.coalesce("has_user", F.lit(False)) & (state == "3")).alias("valid"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """The valid conversations in parts of at most PART turns: (session_id, part, n_turns, turns: array of (idx, role, text) in order)."""
    good = verdicts(turns).where("valid").select("session_id", "n_turns")
    t = turns.select("session_id", F.col("idx").cast("long").alias("idx"), role_of().alias("role"), "text")
    kept = t.join(good, "session_id").groupBy("session_id", "idx").agg(F.min(F.struct("role", "text")).alias("x"), F.min("n_turns").alias("n_turns"))
    return (
        kept.withColumn("part", F.floor(F.col("idx") / PART))
        .groupBy("session_id", "part")
        .agg(F.min("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("idx", "x.role", "x.text"))).alias("turns"))
    )
