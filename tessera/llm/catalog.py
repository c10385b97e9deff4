"""Queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversations as conv
from tessera.llm import encode as enc
from tessera.llm import abuse, groups, near, packing, personal, split, syntax
from tessera.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TURN_LIMIT, WINDOW_LIMIT, OVERLAP = 4000, 8000, 200


@query("p2_pieces")
def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every oversized turn and window; copies of a row give its pieces once."""
    out = None
    for name, limit in (("turns", TURN_LIMIT), ("pending_windows", WINDOW_LIMIT)):
        big = table(spark, sf, name).where(F.length("text") > limit).dropDuplicates(["id", "text"])
        x = split.split(big, "id", "text", limit, OVERLAP).withColumn("item_table", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


@query("p2_found", f"""SELECT DISTINCT 'turns' AS item_table, id AS item_id FROM turns WHERE length(text) > {TURN_LIMIT}
  UNION ALL SELECT DISTINCT 'pending_windows', id FROM pending_windows WHERE length(text) > {WINDOW_LIMIT}""")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_pieces(spark, sf).where("n_pieces > 1").select("item_table", "item_id").distinct()


_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"


@query("p3_found", f"""WITH t AS (SELECT DISTINCT session_id, id, idx, lower(trim(role)) AS r, text FROM turns WHERE session_id IS NOT NULL),
  o AS (SELECT *, text IS NULL OR regexp_full_match(text, '{_BLANK}') AS blank FROM t),
  s AS (SELECT session_id, count(idx) = count(*) AND count(DISTINCT idx) = count(*) AND min(idx) = 0 AND max(idx) = count(*) - 1 AS dense, bool_or(r IS NULL OR r NOT IN ('user', 'assistant', 'tool', 'system')) AS odd,
    bool_or(coalesce(r = 'user', false) AND NOT blank) AS asked, arg_min(r, idx) FILTER (WHERE r <> 'system') AS first FROM o GROUP BY session_id),
  l AS (SELECT *, lag(r) OVER (PARTITION BY session_id ORDER BY idx) AS before FROM o WHERE r <> 'system'),
  g AS (SELECT *, sum(CASE WHEN r = 'user' AND before IS DISTINCT FROM 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM l),
  a AS (SELECT session_id, run, bool_or(r = 'assistant' AND NOT blank) AS answered FROM g WHERE run > 0 GROUP BY session_id, run),
  u AS (SELECT DISTINCT session_id FROM a WHERE NOT answered)
  SELECT session_id FROM s WHERE NOT dense OR odd OR NOT asked OR first IS DISTINCT FROM 'user' OR session_id IN (SELECT session_id FROM u)""")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return conv.verdicts(table(spark, sf, "turns")).where("not valid").select("session_id")


@query("p3_conversations")
def p3_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conv.conversations(table(spark, sf, "turns"))


_GROUPS = """WITH RECURSIVE c AS (SELECT DISTINCT id FROM concepts_global),
  e AS (SELECT a, b FROM concept_links WHERE kind = 'same_as' AND a <> b AND a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
  d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(id, other) AS (SELECT a, b FROM d UNION SELECT r.id, d.b FROM r JOIN d ON r.other = d.a)
"""


@query("p5_found", _GROUPS + "SELECT id AS concept_id, least(id, min(other)) AS group_id FROM r GROUP BY id")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.concept_groups(table(spark, sf, "concepts_global"), table(spark, sf, "concept_links"))


@query("p5_groups", _GROUPS + "SELECT c.id AS concept_id, coalesce(least(c.id, min(r.other)), c.id) AS group_id FROM c LEFT JOIN r ON c.id = r.id GROUP BY c.id")
def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups.all_concept_groups(table(spark, sf, "concepts_global"), table(spark, sf, "concept_links"))


@query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return enc.encode(table(spark, sf, "documents"))


@query("p9_containers")
def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(enc.token_counts(table(spark, sf, "documents")))


def _near(spark: SparkSession, sf: str):
    return near.similar({"k_nodes": (table(spark, sf, "k_nodes"), "id", ["title", "summary"]), "concepts_global": (table(spark, sf, "concepts_global"), "id", ["summary"])}, t=0.7, least=20)


def _words(name: str, text: str) -> str:
    return f"SELECT DISTINCT '{name}' AS t, id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {name}"


_SIMILAR = f"""w AS ({_words("k_nodes", "coalesce(title, '') || ' ' || coalesce(summary, '')")} UNION ALL {_words("concepts_global", "coalesce(summary, '')")}),
  n AS (SELECT t, id, count(*) AS n FROM w GROUP BY t, id HAVING count(*) >= 20),
  s AS (SELECT DISTINCT t, id, w FROM w SEMI JOIN n USING (t, id)),
  i AS (SELECT x.t, x.id AS a, y.id AS b, count(*) AS i FROM s x JOIN s y ON x.t = y.t AND x.w = y.w AND x.id < y.id GROUP BY ALL)
  SELECT i.t AS rec_table, a, b FROM i JOIN n p ON p.t = i.t AND p.id = a JOIN n q ON q.t = i.t AND q.id = b WHERE 10 * i >= 7 * (p.n + q.n - i)"""


@query("p7_found", f"WITH {_SIMILAR}")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.pairs_of(*_near(spark, sf))


@query("p7_groups", f"""WITH RECURSIVE p AS (WITH {_SIMILAR}), d AS (SELECT rec_table AS t, a, b FROM p UNION SELECT rec_table, b, a FROM p),
  r(t, id, other) AS (SELECT t, a, b FROM d UNION SELECT r.t, r.id, d.b FROM r JOIN d ON r.t = d.t AND r.other = d.a)
  SELECT t AS rec_table, id, least(id, min(other)) AS group_id FROM r GROUP BY t, id""")
def p7_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near.groups_of(*_near(spark, sf))


_PII = {"turns": {"text": False}, "tool_calls": {"result_excerpt": False, "args": True}}


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "given_names")
    a, b = (personal.found(table(spark, sf, t), t, "id", f, names) for t, f in _PII.items())
    return a.unionByName(b)


@query("p6_masked_turns")
def p6_masked_turns(spark: SparkSession, sf: str) -> DataFrame:
    return personal.masked(table(spark, sf, "turns").select("id", "text"), _PII["turns"], table(spark, sf, "given_names"))


@query("p6_masked_tool_calls")
def p6_masked_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    return personal.masked(table(spark, sf, "tool_calls").select("id", "args", "result_excerpt"), _PII["tool_calls"], table(spark, sf, "given_names"))


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score(table(spark, sf, "documents")).where(F.col("score") >= abuse.threshold()).select("doc_id")


@query("p10_scores")
def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score(table(spark, sf, "documents"), extra=("source",)).withColumn("score", F.round("score", 4))


@query("p10_rates")
def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(abuse.score(table(spark, sf, "documents"), extra=("source",)))


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.checked(table(spark, sf, "files")).where("not valid").select("path")


@query("p4_files")
def p4_files(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.checked(table(spark, sf, "files"))


@query("p4_rates")
def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.rates(syntax.checked(table(spark, sf, "files")))
