"""Source trees: files with language, hash and size; what changed since the last run."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names never entered, and languages by extension. Fixed values.
IGNORED = (".git", "node_modules", "dist", "build", "out", "target", "vendor", ".venv", "venv", "__pycache__", ".next", ".cache", "coverage")
LANGUAGE_OF = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "dart": "dart", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "sql": "sql", "ddl": "sql",
}


def language_of(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]), ext), F.lit("unknown"))


def ignore_pattern(root: str) -> str | None:
    """The root's .gitignore as one regular expression over relative paths: names, folders and wildcards; no negation."""
    name = os.path.join(root, ".gitignore")
    if not os.path.exists(name):
        return None
    out = []
    for line in open(name, encoding="utf-8", errors="replace"):
        p = line.strip()
        if not p or p[0] in "#!":
            continue
        body = fnmatch.translate(p.strip("/")).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z").replace(".*", "[^/]*")
        out.append(("^" if p.startswith("/") else "(?:^|/)") + body + "(?:/|$)")
    return "|".join(out) or None


def walk(spark: SparkSession, root: str, languages: tuple[str, ...] = ()) -> DataFrame:
    """(path, content_hash, language, size, modified_at, content) of the text files under a root, relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.strip("/")) + "/", "")
    f = raw.select(rel.alias("path"), "modificationTime", "length", "content")
    f = f.where(~F.exists(F.split("path", "/"), lambda x: x.isin(*IGNORED)))
    if ignored := ignore_pattern(root):
        f = f.where(~F.col("path").rlike(ignored))
    f = f.select("path", F.sha1("content").alias("content_hash"), language_of("path").alias("language"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.try_validate_utf8("content").cast("string").alias("content"))
    return f.where(F.col("language").isin(*languages)) if languages else f.where("language <> 'unknown'")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, changed, gone or same, by content hash."""
    o, n = old.select("path", F.col("content_hash").alias("h0")), new.select("path", F.col("content_hash").alias("h1"))
    j = o.join(n, "path", "full_outer")
    return j.select("path", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "gone").when(F.col("h0") == F.col("h1"), "same").otherwise("changed").alias("state"))
