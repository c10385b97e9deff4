"""Facts: recall, filters, evidence extraction from text, links to files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lattice, text

RECALL_COLUMNS = ("id", "title", "summary", "evidence_text")
DECISIONS = ("decision", "constraint", "pattern")
BUSINESS = ("business_rule", "entity", "constraint", "pattern")


def indexed(facts: DataFrame) -> DataFrame:
    """Facts with their folded texts beside them, to be written once and searched often: the inverted index's part."""
    return facts.withColumns({f"{c}_padded": text.padded(c) for c in RECALL_COLUMNS})


def recall(facts: DataFrame, query: str, limit: int = 20, kinds: tuple[str, ...] = (), scope: str | None = None, include_enrichment: bool = False) -> DataFrame:
    """The best facts for a query: every term a phrase of some column; enrichment out by default; by confidence, then newest, then id."""
    f = facts
    if kinds:
        f = f.where(F.col("kind").isin(*kinds))
    if scope:
        f = f.where(F.col("scope") == scope)
    if not include_enrichment:
        f = f.where(~lattice.enrichment())
    ready = all(f"{c}_padded" in f.columns for c in RECALL_COLUMNS)
    f = f.where(text.full_text([f"{c}_padded" for c in RECALL_COLUMNS] if ready else RECALL_COLUMNS, query, ready))
    return f.orderBy(F.desc("confidence"), F.desc("updated_at"), "id").limit(limit)


def of_file(facts: DataFrame, links: DataFrame, path: str) -> DataFrame:
    return facts.join(links.where(F.col("code_file") == path).select(F.col("k_node_id").alias("id")).distinct(), "id", "left_semi")


def with_window(facts: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each fact with one window id, the smallest."""
    w = provenance.groupBy(F.col("k_node_id").alias("id")).agg(F.min("window_id").alias("window_id"))
    return facts.join(w, "id", "left")


def evidence(windows: DataFrame, text_col: str = "text") -> DataFrame:
    """(window_id, kind, title, evidence): code blocks, shell commands, URLs, paths, tickets, error lines and stack frames of windows.

    Paths, tickets, URLs and $-commands are looked for outside fenced code, errors and frames everywhere; each distinct once per window. A path's title has no line and column."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    prose = F.regexp_replace(t, text.FENCE, " ")
    no_url = F.regexp_replace(prose, text.URL, " ")
    zipped = F.arrays_zip(F.regexp_extract_all(t, F.lit(text.FENCE), 1).alias("lang"), F.regexp_extract_all(t, F.lit(text.FENCE), 2).alias("body"))

    def rows(kind: str, found: Column, title=lambda x: x) -> Column:
        return F.transform(F.array_distinct(found), lambda x: F.struct(F.lit(kind).alias("kind"), F.substring(title(x), 1, 200).alias("title"), x.alias("evidence")))

    blocks = F.transform(zipped, lambda b: F.struct(F.lit("code_block").alias("kind"), F.when(b["lang"] == "", F.lit("code")).otherwise(b["lang"]).alias("title"), b["body"].alias("evidence")))
    shells = F.filter(zipped, lambda b: F.lower(b["lang"]).isin(*text.SHELLS))
    lines = F.flatten(F.transform(shells, lambda b: F.split(b["body"], r"\r?\n")))
    commands = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^\$\s*", "")), lambda x: x != "")
    found = F.concat(
        blocks, rows("shell_command", F.array_union(commands, F.regexp_extract_all(prose, F.lit(text.COMMAND), 1))), rows("url", F.regexp_extract_all(prose, F.lit(text.URL), 0)),
        rows("path_mention", F.regexp_extract_all(no_url, F.lit(text.PATH), 1), lambda x: F.regexp_replace(x, text.PATH_PLACE, "")), rows("ticket_id", F.regexp_extract_all(prose, F.lit(text.TICKET), 1)),
        rows("error_message", F.regexp_extract_all(t, F.lit(text.ERROR), 0), F.trim), rows("stack_trace", F.regexp_extract_all(t, F.lit(text.STACK_FRAME), 0), F.trim),
    )
    return windows.select(F.col("id").alias("window_id"), F.explode(found).alias("x")).select("window_id", "x.kind", "x.title", "x.evidence")


def syntax_facts(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, provenance) of the evidence of windows; ids by kind, window and the whole evidence."""
    e = evidence(windows).withColumn("id", text.natural_id("kind", "window_id", "evidence"))
    facts = e.select("id", "kind", "title", F.substring("evidence", 1, 1000).alias("evidence_text"), F.lit(1.0).alias("confidence"), F.lit("syntax").alias("source")).dropDuplicates(["id"])
    return facts, e.select(F.col("id").alias("k_node_id"), "window_id").distinct()


def resolve_paths(mentions: DataFrame, files: DataFrame, mention: str = "mention", path: str = "path") -> DataFrame:
    """(mention, path): an exact path, or else the only path that ends with the mention. Suffixes of paths are equi-joined, no pair is tried."""
    m = mentions.select(F.col(mention).alias("mention")).where(F.length("mention") > 0).distinct()
    p = files.select(F.col(path).alias("path")).where("path is not null").distinct()
    n = F.length("path")
    suffix = p.select("path", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("path", i, n))).alias("mention"))
    hit = suffix.join(m, "mention").groupBy("mention").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"), F.max(F.col("path") == F.col("mention")).alias("exact"))
    return hit.where("exact or n = 1").select("mention", F.when(F.col("exact"), F.col("mention")).otherwise(F.col("only")).alias("path"))


def resolve_symbols(names: DataFrame, nodes: DataFrame, name: str = "name", most: int = 5) -> DataFrame:
    """(name, node_id, rank): up to five symbols of that name, case folded, files and imports left out."""
    s = nodes.where(~F.col("kind").isin("file", "import")).select("id", F.lower("name").alias("lc"))
    q = names.select(F.col(name).alias("name"), F.lower(name).alias("lc")).distinct()
    r = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    return q.join(s, "lc").withColumn("rank", r).where(F.col("rank") <= most).select("name", F.col("id").alias("node_id"), "rank")


def _grams(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))


def mentioned(entities: DataFrame, texts: DataFrame, title: str = "title", text_col: str = "text", n: int = 8) -> DataFrame:
    """Distinct entity rows whose title some text holds, case folded.

    A title's first n characters (all of a shorter one) must occur in the text, so titles
    and texts meet by equi-join on such runs and only those pairs are tested. The runs of a
    text travel with its hash; the text itself meets only the titles that may be in it."""
    e = entities.where(F.length(F.trim(title)) > 0).withColumn("_t", F.lower(title))
    e = e.withColumn("_g", F.substring("_t", 1, n)).withColumn("_n", F.length("_g"))
    x = texts.select(F.lower(text_col).alias("_x")).where(F.length("_x") > 0)
    x = x.select(F.xxhash64("_x").alias("_h"), F.hash("_x").alias("_k"), "_x").dropDuplicates(["_h", "_k"])
    titles = e.select("_g", "_n", "_t").distinct()
    sizes = [r[0] for r in e.select("_n").distinct().collect()]  # n values at most
    hits = None
    for k in sizes:
        r = x.where(F.length("_x") >= k).select("_h", "_k", F.explode(F.array_distinct(_grams(F.col("_x"), k))).alias("_g"))
        r = r.join(titles.where(F.col("_n") == k).select("_g", "_t"), "_g").select("_h", "_k", "_t")
        hits = r if hits is None else hits.unionByName(r)
    if hits is None:
        return entities.limit(0)
    found = hits.join(x, ["_h", "_k"]).where(F.col("_x").contains(F.col("_t"))).select("_t").distinct()
    return e.join(found, "_t", "left_semi").select(*entities.columns).distinct()
