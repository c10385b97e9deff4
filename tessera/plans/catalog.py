"""The core's named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy as h
from tessera.plans import code, conversations, knowledge, projects, runs  # noqa: F401  they register their queries
from tessera.plans.registry import QUERIES, SQL, query  # noqa: F401
from tessera.runtime import table

_PARENTS = """
  ids AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL),
  up AS (SELECT target AS id, min(source) AS parent FROM edges
         WHERE kind = 'contains' AND source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) GROUP BY target),
  tree(node_id, root_id, depth) AS (
    SELECT id, id, 0 FROM ids WHERE id NOT IN (SELECT id FROM up)
    UNION ALL SELECT up.id, tree.root_id, tree.depth + 1 FROM up JOIN tree ON up.parent = tree.node_id),
  stray AS (SELECT id, parent FROM up WHERE id NOT IN (SELECT node_id FROM tree)),
  reach(id, anc) AS (SELECT id, parent FROM stray UNION SELECT reach.id, stray.parent FROM reach JOIN stray ON reach.anc = stray.id),
  looped AS (SELECT reach.id AS node_id, min(reach.anc) AS root_id, -1 AS depth FROM reach
             WHERE reach.anc IN (SELECT id FROM reach r WHERE r.id = r.anc) GROUP BY reach.id)
"""


@query("p1_found", f"WITH RECURSIVE {_PARENTS} SELECT node_id, root_id, CAST(depth AS INTEGER) AS depth FROM tree WHERE depth >= 8 UNION ALL SELECT node_id, root_id, CAST(depth AS INTEGER) FROM looped")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    t = h.hierarchy(table(spark, sf, "nodes"), table(spark, sf, "edges"), paths=False)
    return t.where("depth >= 8 or depth < 0").select(F.col("id").alias("node_id"), "root_id", F.col("depth").cast("int").alias("depth"))


_NAMED = _PARENTS.replace("tree(node_id, root_id, depth) AS (", "nm AS (SELECT id, coalesce(arg_max(name, {'u': coalesce(updated_at, TIMESTAMP '0001-01-01'), 'n': coalesce(name, '')}), '') AS name FROM nodes WHERE id IS NOT NULL GROUP BY id),\n  tree(node_id, root_id, depth, path) AS (").replace(
    "SELECT id, id, 0 FROM ids WHERE", "SELECT id, id, 0, name FROM nm WHERE"
).replace("tree.depth + 1 FROM up JOIN tree ON up.parent = tree.node_id)", "tree.depth + 1, tree.path || '.' || nm.name FROM up JOIN tree ON up.parent = tree.node_id JOIN nm ON nm.id = up.id)")
_PAIRS = "pairs(anc, node, d) AS (SELECT parent, id, 1 FROM up WHERE id IN (SELECT node_id FROM tree) UNION ALL SELECT up.parent, pairs.node, pairs.d + 1 FROM pairs JOIN up ON up.id = pairs.anc)"


@query("p1_hierarchy", f"""WITH RECURSIVE {_NAMED}, {_PAIRS},
  n AS (SELECT anc AS id, count(*) AS n FROM pairs GROUP BY anc),
  q AS (SELECT id, arg_max(qualified_name, {{'u': coalesce(updated_at, TIMESTAMP '0001-01-01'), 'n': coalesce(qualified_name, '')}}) AS qn FROM nodes WHERE id IS NOT NULL GROUP BY id),
  a AS (SELECT node_id AS id, root_id, depth, path FROM tree UNION ALL SELECT node_id, root_id, depth, NULL FROM looped)
  SELECT a.id, up.parent AS parent_id, a.root_id, CAST(a.depth AS INTEGER) AS depth, a.path, coalesce(n.n, 0) AS n_descendants, coalesce(a.path = q.qn OR ends_with(a.path, '.' || q.qn), false) AS name_agrees
  FROM a LEFT JOIN up ON up.id = a.id LEFT JOIN n ON n.id = a.id LEFT JOIN q ON q.id = a.id""")
def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "nodes")
    return h.described(nodes, h.hierarchy(nodes, table(spark, sf, "edges")))


@query("p1_descendants", f"WITH RECURSIVE {_PARENTS}, {_PAIRS} SELECT anc AS id, node AS descendant_id, CAST(d AS INTEGER) AS distance FROM pairs")
def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return h.descendants(h.hierarchy(table(spark, sf, "nodes"), table(spark, sf, "edges")))
