"""Vectors as array<float>: cosine, centroids, nearest neighbours."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.runtime import Scratch, rows_of


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 where lengths differ, a vector is empty or null, or a norm is 0."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / F.nullif(na * nb, F.lit(0.0))).otherwise(F.lit(0.0))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n_members, centroid): the mean of each position over the vectors of the dominant length (the largest, on ties the longer)."""
    v = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, F.col(vector).alias("v"), F.size(vector).alias("d"))
    dims = v.groupBy(key, "d").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max_by("d", F.struct("n", "d")).alias("d"))
    parts = v.join(dims, [key, "d"]).select(key, F.posexplode("v").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"))
    return counts.join(means, key, "left")


#: Vectors of one block: two of 256 dimensions with what is made of them take about 40 MB. Query blocks that a task holds, and queries that meet a block at once.
BLOCK, HELD, STRIP = 2048, 16, 256


def blocks(df: DataFrame, id_col: str, vector: str, group: str | None = None, size: int | None = None) -> DataFrame:
    """Rows of up to ``size`` vectors of one length: d, ids and groups, and the vectors in a row."""
    import pyarrow as pa

    size, kinds = size or BLOCK, dict(df.dtypes)
    number = "float" if kinds[vector] == "array<float>" else "double"
    names = ["d", "ids", "v"] + (["groups"] if group else [])

    def run(batches):
        held: dict[int, list[list]] = {}

        def out(d: int):
            parts = held.pop(d)
            cols = [pa.array([d], pa.int32())]
            for c in (0, 1, 2)[: len(names) - 1]:
                flat = pa.concat_arrays([x[c] for x in parts])
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            v = b.column(1)
            d = np.where(v.is_valid(), np.asarray(v.value_lengths().fill_null(0)), 0)
            if v.values.null_count:  # a vector with a gap doesn't count
                at = np.repeat(np.arange(len(v)), d)
                d[at[np.asarray(v.flatten().is_null())]] = 0
            for n in np.unique(d[d > 0]).tolist():
                rows = np.flatnonzero(d == n)
                while len(rows):
                    parts = held.setdefault(n, [])
                    now, rows = np.split(rows, [size - sum(len(x[0]) for x in parts)])
                    take = pa.array(now)
                    more = [b.column(2).take(take)] if group else []
                    number_ = pa.float32() if number == "float" else pa.float64()
                    parts.append([b.column(0).take(take), v.take(take).flatten().cast(number_), *more])
                    if sum(len(x[0]) for x in parts) >= size:
                        yield out(n)
        for n in list(held):
            yield out(n)

    more = [group] if group else []
    schema = f"d int, ids array<{kinds[id_col]}>, v array<{number}>" + (f", groups array<{kinds[group]}>" if group else "")
    return df.select(id_col, F.col(vector), *more).mapInArrow(run, schema)


def _pairs_of_blocks(queries: DataFrame, items: DataFrame, k: int, min_score: float, exclude_self: bool, group: bool, per_query: bool, kq: str, ki: str) -> DataFrame:
    """(q_id, i_id, score) that may be among the k best, by query or in all, of every pair of blocks of equal length.

    Blocks are dealt to the cells of a grid, each the work of one task: parts of the items by parts of the queries. A task holds
    the query blocks of its cell and reads the item blocks one by one. Products in single precision leave the pairs that may count
    within their error; these are computed again in double precision, each by itself, so equal vectors have equal scores."""
    import pyarrow as pa

    keep, strip, alone = Scratch(queries.sparkSession), STRIP, not per_query
    q, i = keep.save(queries), keep.save(items)
    n_q, n_i, tasks = rows_of(q), rows_of(i), int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ways = max(1, -(-n_q // HELD))
    parts = max(1, min(-(-n_i // 4), -(-4 * tasks // ways)))
    part, both = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int"), ["d", "v"] + (["groups"] if group else [])
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = q.select(part(ways).alias("w"), F.col("ids").alias("q"), F.lit(None).cast(f"array<{ki}>").alias("i"), *both, all_of(parts).alias("p"))
    b = i.select(part(parts).alias("p"), F.lit(None).cast(f"array<{kq}>").alias("q"), F.col("ids").alias("i"), *both, all_of(ways).alias("w"))
    j = a.unionByName(b).select((F.col("p") * ways + F.col("w")).alias("cell"), "q", "i", *both)
    j = j.repartitionById(parts * ways, F.col("cell")).sortWithinPartitions("cell", F.col("q").isNull())

    def run(batches):
        cell, held, code = None, {}, {}

        def best(x, y, gx, gy, rows, ids):
            """(row, column, score) of one pair of blocks."""
            n, m, lo = len(y[0]), (x[0].shape[1] + 8) * 1.2e-7, min_score  # m: the error of a product in single precision is less
            gone = [(r, c) for c, z in enumerate(ids) for r in rows.get(z, ())] if exclude_self else []
            gone = np.array(sorted(gone), np.int64).reshape(-1, 2)
            for at in range(0, len(x[0]), strip):
                s = x[1][at : at + strip] @ y[1].T
                s[x[2][at : at + strip]] = -2.0
                s[:, y[2]] = -2.0
                if group:
                    s[gx[at : at + strip, None] == gy[None, :]] = -2.0
                g = gone[(gone[:, 0] >= at) & (gone[:, 0] < at + strip)]
                s[g[:, 0] - at, g[:, 1]] = -2.0
                may = s >= lo - m
                if np.count_nonzero(may) > 8 * k * (1 if alone else len(s)):  # then only those near the k-th best
                    t = s.reshape(1, -1) if alone else s
                    near = min(k, t.shape[1])
                    t = t.max(axis=1) if near == 1 else np.partition(t, t.shape[1] - near, axis=1)[:, t.shape[1] - near]
                    may &= s >= (t - 2 * m)[:, None]
                r, c = np.divmod(np.flatnonzero(may), n)
                step = max(1, 4_000_000 // x[0].shape[1])
                exact = [(x[0][r[z : z + step] + at] * y[0][c[z : z + step]]).sum(axis=1) for z in range(0, len(r), step)]
                if exact:
                    e = np.concatenate(exact)
                    ok = (e >= lo) & (s[r, c] > -2.0)
                    yield r[ok] + at, c[ok], e[ok]

        for b in batches:
            for z, (at, d, q, i) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cell", "d", "q", "i")))):
                if at != cell:
                    cell, held, code = at, {}, {}
                v = np.asarray(b.column("v")[z].values, np.float64).reshape(-1, d)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
                bad = ~np.isfinite(v).all(axis=1)
                me = (v, np.where(bad[:, None], 0, v).astype(np.float32), bad)
                g = np.array([code.setdefault(x, len(code)) for x in b.column("groups")[z].as_py()]) if group else None
                if i is None:
                    rows: dict = {}
                    for r, x in enumerate(q):
                        rows.setdefault(x, []).append(r)
                    held.setdefault(d, []).append((q, me, g, rows))
                    continue
                for q_, x, gx, rows in held.get(d, ()):
                    got = list(best(x, me, gx, g, rows, i))
                    if not sum(len(r[0]) for r in got):
                        continue
                    r, c, e = (np.concatenate(y) for y in zip(*got))
                    f = pd.DataFrame({"a": r, "q": [q_[y] for y in r], "b": [i[y] for y in c], "s": e}).sort_values(["s", "q", "b"], ascending=[False, True, True])
                    f = f.head(k) if alone else f.groupby("a").head(k)
                    yield pa.RecordBatch.from_arrays([pa.array(f["q"].tolist(), b.schema.field("q").type.value_type), pa.array(f["b"].tolist(), b.schema.field("i").type.value_type), pa.array(f["s"].to_numpy())], names=["q_id", "i_id", "score"])

    return j.mapInArrow(run, f"q_id {kq}, i_id {ki}, score double")


def nearest(queries: DataFrame, items: DataFrame, k: int, min_score: float, q_id: str = "q_id", q_vec: str = "q_vec", i_id: str = "i_id", i_vec: str = "i_vec", exclude_self: bool = True, group: str | None = None) -> DataFrame:
    """(q_id, i_id, score, rank): the k nearest items by exact cosine at or above min_score, ties by id.
    With ``group`` (a column of both sides) only items of other groups count; vectors of unequal lengths don't meet.

    Both sides are packed into blocks, and blocks meet blocks, so the driver holds none and
    a task about HELD of them; each pair of blocks keeps k per query."""
    kq, ki = dict(queries.dtypes)[q_id], dict(items.dtypes)[i_id]
    got = _pairs_of_blocks(blocks(queries, q_id, q_vec, group), blocks(items, i_id, i_vec, group), k, min_score, exclude_self, group is not None, True, kq, ki)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "i_id"))
    out = got.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("q_id").alias(q_id), F.col("i_id").alias(i_id), "score", "rank")


def closest_pairs(queries: DataFrame, items: DataFrame, most: int, min_score: float, group: str, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(q_id, i_id, score): of all pairs of a query and an item of another group the ``most`` of the highest cosine, at min_score or above."""
    k = dict(items.dtypes)[id_col]
    got = _pairs_of_blocks(blocks(queries, id_col, vector, group), blocks(items, id_col, vector, group), most, min_score, True, True, False, k, k)
    return got.orderBy(F.desc("score"), "q_id", "i_id").limit(most)


def encode_vector(v: list[float]) -> bytes:
    return b"\xe1\x01" + struct.pack(f"<{len(v)}f", *v)


def decode_vector(b: bytes | None) -> list[float] | None:
    """None for a missing value, a wrong header or a broken length."""
    if b is None or b[:2] != b"\xe1\x01" or (len(b) - 2) % 4:
        return None
    return list(struct.unpack(f"<{(len(b) - 2) // 4}f", b[2:]))


@F.pandas_udf(ArrayType(FloatType()))
def decode_vectors(s: pd.Series) -> pd.Series:
    return s.map(decode_vector)
