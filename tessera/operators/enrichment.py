"""What follows a model's answers: skills that name declared items, industries, items with research, clusterer's actions, duplicates by embedding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text, vectors
from tessera.operators.model import declared_evidence

MOST_ITEMS, ATTACH, DUPLICATE = 15, 0.55, 0.92


def profiled_skills(answers: DataFrame, declared: DataFrame) -> DataFrame:
    """(project_id, name, evidence, confidence): skills whose evidence names something that the project declares; confidence is the share kept."""
    d = declared.groupBy("project_id").agg(F.collect_set("title").alias("declared"))
    x = answers.select("project_id", F.explode("skills").alias("s")).select("project_id", "s.name", "s.evidence")
    j = x.join(d, "project_id", "left").withColumn("ok", F.coalesce(declared_evidence(F.col("evidence"), F.col("declared")), F.lit(False)) & (F.trim(F.coalesce("evidence", F.lit(""))) != ""))
    share = j.groupBy("project_id").agg(F.avg(F.col("ok").cast("double")).alias("confidence"))
    return j.where("ok").join(share, "project_id").select("project_id", "name", "evidence", "confidence")


def industry_facts(answers: DataFrame) -> DataFrame:
    """(id, project_id, title, confidence, grounding) of classified projects: corroborated at 0.7 or more with evidence, else stated; unknown gives none."""
    known = answers.where((F.lower(F.trim("industry")) != "unknown") & (F.trim("industry") != ""))
    sure = (F.col("confidence") >= 0.7) & (F.size(F.filter(F.coalesce("evidence", F.array()), lambda e: F.trim(e) != "")) > 0)
    return known.select(text.natural_id(F.lit("industry"), F.lower("industry")).alias("id"), "project_id", F.col("industry").alias("title"), "confidence", F.when(sure, "corroborated").otherwise("stated").alias("grounding"))


def industry_items(answers: DataFrame, research: DataFrame | None = None) -> DataFrame:
    """(id, industry, title, summary, grounding, source_url): up to fifteen proposed items per industry with title, description and basis; grounding is model, or external where research found a page."""
    items = answers.select("industry", F.posexplode("items").alias("n", "i")).select("industry", "n", "i.*")
    full = items
    for c in ("title", "description", "basis"):
        full = full.where(F.trim(F.coalesce(c, F.lit(""))) != "")
    full = full.where(F.col("n") < MOST_ITEMS)
    out = full.select(text.natural_id(F.lit("industry-std"), F.lit("industry"), F.lower("title")).alias("id"), "industry", "title", F.col("description").alias("summary"), F.sha1("title").alias("query_hash"))
    if research is None:
        return out.select("id", "industry", "title", "summary", F.lit("model").alias("grounding"), F.lit(None).cast("string").alias("source_url"))
    r = research.where("source_url is not null").groupBy("query_hash").agg(F.max_by("source_url", "fetched_at").alias("source_url"))
    return out.join(r, "query_hash", "left").select("id", "industry", "title", "summary", F.when(F.col("source_url").isNotNull(), "external").otherwise("model").alias("grounding"), "source_url")


class Research(Protocol):
    def lookup(self, query: str) -> tuple[str, str] | None: ...


def research(queries: DataFrame, cache: DataFrame, backend: Research | None, as_of) -> DataFrame:
    """The cache with the answers (source_url, snippet of at most 600 characters) to queries it lacked; without a backend it stays as it is."""
    q = queries.where("query is not null").select("query").distinct().withColumn("query_hash", F.sha1("query"))
    miss = q.join(cache.select("query_hash"), "query_hash", "left_anti")
    if backend is None:
        return cache

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, t, *(backend.lookup(t) or (None, None))) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["query_hash", "query", "source_url", "snippet"])

    got = miss.select("query_hash", "query").mapInArrow(ask, "query_hash string, query string, source_url string, snippet string")
    got = got.select("query_hash", "query", "source_url", F.substring("snippet", 1, 600).alias("snippet"), F.lit(as_of).cast("timestamp").alias("fetched_at"))
    return cache.unionByName(got.select(*cache.columns))


def cluster_actions(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fact_id, action, cluster_id, other_id): attach and merge only where the named concepts were offered, else create; a failed answer creates."""
    offered = candidates.groupBy("fact_id").agg(F.collect_set("cluster_id").alias("offered"))
    j = answers.join(offered, "fact_id", "left").withColumn("offered", F.coalesce("offered", F.array().cast("array<string>")))
    a = F.array_contains("offered", F.coalesce("cluster_id", F.lit("")))
    b = F.array_contains("offered", F.coalesce("other_id", F.lit(""))) & (F.col("cluster_id") != F.col("other_id"))
    action = F.when((F.col("action") == "attach") & a, "attach").when((F.col("action") == "merge") & a & b, "merge").otherwise("create")
    return j.select("fact_id", action.alias("action"), F.when(action != "create", F.col("cluster_id")).alias("cluster_id"), F.when(action == "merge", F.col("other_id")).alias("other_id"))


def hash_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding): words hashed to signed positions; stands in where no embedding model is configured. Texts without a word have null."""
    import re

    words = re.compile(r"[^\W_]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}  # a word's position, those that subtract after those that add
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                n = []
                for w in words.findall((t or "").lower()):
                    if (p := at.get(w)) is None:
                        h = zlib.crc32(w.encode())
                        p = at[w] = h % dim + (0 if h >> 31 else dim)
                    n.append(p)
                c = np.bincount(np.array(n, np.int64), minlength=2 * dim)
                v = (c[:dim] - c[dim:]).astype(np.float32)
                out.append(v if v.any() else None)
                if len(at) > 200_000:
                    at = {}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    return df.select(F.col(id_col).cast("string").alias("id"), text_col).mapInArrow(run, "id string, embedding array<float>")


def duplicates(batch: DataFrame, all_windows: DataFrame, min_score: float = DUPLICATE) -> DataFrame:
    """(window_id, dup_of, score): windows of a batch whose nearest window outside the batch is at ``min_score`` or above."""
    q = batch.select(F.col("id").alias("q_id"), F.col("embedding").alias("q_vec"))
    rest = all_windows.join(batch.select("id"), "id", "left_anti").select(F.col("id").alias("i_id"), F.col("embedding").alias("i_vec"))
    return vectors.nearest(q, rest, 1, min_score).select(F.col("q_id").alias("window_id"), F.col("i_id").alias("dup_of"), "score")


def mark_duplicates(labels: DataFrame, dups: DataFrame) -> DataFrame:
    """Labels with dup_of set; the marker in the rationale is rendered only for display."""
    d = dups.select("window_id", F.col("dup_of").alias("_d"))
    return labels.join(d, "window_id", "left").withColumn("dup_of", F.coalesce("_d", "dup_of")).drop("_d").select(*labels.columns)


def rationale(labels: DataFrame) -> DataFrame:
    return labels.withColumn("rationale", F.concat_ws(" ", "rationale", F.when(F.col("dup_of").isNotNull(), F.concat(F.lit("[dup_of:"), "dup_of", F.lit("]")))))
