"""Table changes as pure functions: upsert, insert-if-absent, patch, delete, cascade, replace. Each is idempotent."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by order, then by the hash of the row. A hash aggregate, no sort; null keys are kept apart as one key."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order, F.xxhash64(*df.columns))).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: Iterable[str] = (), fill: Iterable[str] = ()) -> DataFrame:
    """New rows replace old ones by key. Columns in ``keep`` stay as they were where the key existed; those in ``fill`` take the old value where the new one is null."""
    keep, fill = set(keep), set(fill)
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_o"), F.lit(True).alias("_was"))
    n = new.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_n"), F.lit(True).alias("_is"))
    j = o.join(n, keys, "full_outer")

    def value(c: str) -> Column:
        a, b = F.col(f"_o.`{c}`"), F.col(f"_n.`{c}`")
        if c in keep:
            return F.when(F.col("_was"), a).otherwise(b)
        if c in fill:
            return F.coalesce(b, a)
        return F.when(F.col("_is"), b).otherwise(a)

    return j.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key isn't there yet, one per key."""
    fresh = latest(new, keys, keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def patch(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Non-null values of the changes replace those of the rows with the same key."""
    cols = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *[F.col(x).alias("_p_" + x) for x in cols])
    return df.join(c, keys, "left").select(*[F.coalesce("_p_" + x, x).alias(x) if x in cols else F.col(x) for x in df.columns])


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    return df.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti")


def cascade(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """The child rows whose parent is left."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Whole groups (a file, a project) change at once: old rows of any key that the new rows hold go."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))
