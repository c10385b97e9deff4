"""The tables as the queries read them: one row per key, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import mutate
from tessera.operators.model import TRIAGE
from tessera.operators.windows import clean, segment
from tessera.runtime import table


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.latest(table(spark, sf, "k_nodes"), ["id"], ["updated_at"])


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.latest(table(spark, sf, "nodes").select("id", "kind", "name", "qualified_name", "file_path", "language", "signature", "is_exported", "updated_at"), ["id"], ["updated_at"])


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "edges").groupBy("source", "target", "kind").agg(F.min("metadata").alias("metadata"), F.min("line").alias("line"))


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.latest(table(spark, sf, "concepts_global"), ["id"], ["updated_at"])


def links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "concept_links").select("a", "b", "kind", "score", "source").distinct()


def files(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.latest(table(spark, sf, "files").select("path", "language", "project_id", "content_hash", "size", "indexed_at"), ["path"], ["indexed_at"])


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return segment(clean(table(spark, sf, "turns")))


def digit(c: Column | str, at: int) -> Column:
    """A hex digit of a text as a number."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(c, at, 1)) - 1


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


AXES = TRIAGE.vocabulary


def labels(windows_: DataFrame) -> DataFrame:
    """Triage labels as a stand-in model gives them: read off the digits of the window's hash."""
    cols = [pick(v, digit("text_hash", i + 1)).alias(k) for i, (k, v) in enumerate(AXES.items())]
    return windows_.select(F.col("id").alias("window_id"), *cols, (digit("text_hash", 5) / 15.0).alias("confidence"), F.lit(None).cast("string").alias("dup_of"), F.concat("session_id", F.lit("-"), F.lpad(F.col("start_idx").cast("string"), 8, "0")).alias("produced_at"))


# The same in SQL.
S_FACTS = "kn AS (SELECT * FROM k_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
S_NODES = "nd AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
S_EDGES = "ed AS (SELECT source, target, kind, min(metadata) AS metadata, min(line) AS line FROM edges GROUP BY source, target, kind)"
S_CONCEPTS = "cg AS (SELECT * FROM concepts_global QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
S_LINKS = "li AS (SELECT DISTINCT a, b, kind, score, source FROM concept_links)"
S_FILES = "fi AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1)"
S_TURNS = "tu AS (SELECT session_id, idx, min({'role': lower(trim(role)), 'text': coalesce(text, '')}) AS x FROM turns WHERE lower(trim(role)) IN ('user', 'assistant', 'tool', 'system') GROUP BY session_id, idx), tn AS (SELECT session_id, idx, x.role AS role, x.text AS text FROM tu)"
S_WINDOWS = (
    S_TURNS
    + """, ga AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS g FROM tn),
  gb AS (SELECT *, row_number() OVER (PARTITION BY session_id, g ORDER BY idx) AS rn, sum(length(text)) OVER (PARTITION BY session_id, g ORDER BY idx) - length(text) AS before FROM ga WHERE g > 0),
  gc AS (SELECT session_id, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_turns, trim(string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY idx), ' ' || chr(9) || chr(10) || chr(13)) AS text
         FROM gb WHERE rn <= 12 AND before < 8000 GROUP BY session_id, g HAVING bool_or(role IN ('assistant', 'tool'))),
  wi AS (SELECT substr(sha1(concat_ws('|', session_id, start_idx, end_idx, sha1(text))), 1, 16) AS id, *, sha1(text) AS text_hash FROM gc)"""
)
_D = "(strpos('0123456789abcdef', substr(text_hash, {i}, 1)) - 1)"
S_LABELS = (
    S_WINDOWS
    + ", lb AS (SELECT id AS window_id, "
    + ", ".join(f"list_extract([{', '.join(repr(x) for x in v)}], CAST({_D.format(i=i + 1)} % {len(v)} + 1 AS INTEGER)) AS {k}" for i, (k, v) in enumerate(AXES.items()))
    + f", {_D.format(i=5)} / 15.0 AS confidence, session_id || '-' || lpad(CAST(start_idx AS VARCHAR), 8, '0') AS produced_at FROM wi)"
)
S_KEEP = "NOT (confidence >= 0.6 AND (quality = 'noise' OR relevance = 'off_topic' OR linkage = 'unrelated' OR (domain = 'chitchat' AND quality <> 'decision_grade')))"
S_GROUNDING = "coalesce(grounding, 'stated')"
S_RANK = "CASE coalesce(grounding, 'stated') WHEN 'structural' THEN 5 WHEN 'corroborated' THEN 4 WHEN 'stated' THEN 3 WHEN 'external' THEN 2 WHEN 'model' THEN 1 ELSE 0 END"


def s_padded(c: str) -> str:
    return f"(' ' || array_to_string(list_filter(string_split_regex(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ')"


def s_match(terms: list[str], columns: tuple[str, ...]) -> str:
    return " AND ".join("(" + " OR ".join(f"contains({s_padded(c)}, ' {t} ')" for c in columns) + ")" for t in terms)
