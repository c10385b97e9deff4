"""Concepts: clusters of facts with centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lattice, vectors


def summary(facts: DataFrame) -> DataFrame:
    """(cluster_id, member_count, scope, grounding): size, most frequent scope (first seen on ties) and strongest grounding of every cluster."""
    f = facts.where("cluster_id is not null")
    n = f.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("member_count"), lattice.dominant_grounding().alias("grounding"))
    return n.join(lattice.dominant_scope(f.withColumn("seq", F.struct("created_at", "id")), "cluster_id"), "cluster_id")


def members(facts: DataFrame, most: int = 25) -> DataFrame:
    """Up to ``most`` facts of every cluster, newest first."""
    r = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("created_at"), "id"))
    return facts.where("cluster_id is not null").withColumn("rank", r).where(F.col("rank") <= most)


def uncategorized(facts: DataFrame, with_vector: DataFrame) -> DataFrame:
    """(id, bucket): facts without a vector go to the bucket of their kind."""
    return facts.join(with_vector.select("id"), "id", "left_anti").select("id", F.concat("kind", F.lit(" (uncategorized)")).alias("bucket"))


class _Clusters:
    """Clusters of one group and vector length: names, sums of members and, kept beside them, centroids with their lengths."""

    def __init__(self, dim: int):
        self.names: list[str] = []
        self.counts: list[int] = []
        self.sums, self.means, self.norms = np.zeros((16, dim)), np.zeros((16, dim)), np.zeros(16)

    def put(self, name: str, x: np.ndarray, attach: float) -> str:
        k = len(self.names)
        if k:
            d = self.norms[:k] * np.linalg.norm(x)
            s = np.divide(self.means[:k] @ x, d, out=np.zeros(k), where=d > 0)
            at = int(s.argmax())
            if s[at] >= attach:
                self.counts[at] += 1
                self.sums[at] += x
                self._move(at)
                return self.names[at]
        if k == len(self.norms):
            self.sums, self.means, self.norms = (np.concatenate([a, np.zeros_like(a)]) for a in (self.sums, self.means, self.norms))
        self.names.append(name)
        self.counts.append(1)
        self.sums[k] = x
        self._move(k)
        return name

    def _move(self, at: int) -> None:
        self.means[at] = self.sums[at] / self.counts[at]
        self.norms[at] = np.linalg.norm(self.means[at])


def fold(df: DataFrame, group: str, order: str, vector: str, attach: float = 0.55) -> DataFrame:
    """(group, id, cluster): facts in order join the nearest centroid at ``attach`` or above, else found a cluster named by themselves; centroids move with each.

    The fold is sequential by nature: a group is one task, which reads its sorted facts as a stream and holds only the clusters, so groups may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        for b in batches:
            out = []
            for g, i, v in zip(*(c.to_pylist() for c in b.columns)):
                if g != last:
                    last, held = g, {}
                x = np.asarray(v, np.float64)
                if len(x) not in held:
                    held[len(x)] = _Clusters(len(x))
                out.append(held[len(x)].put(i, x, attach))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=[group, "id", "cluster"])

    g = dict(df.dtypes)[group]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number, else adaptive execution puts small groups into one task
    f = df.where(F.col(vector).isNotNull()).select(group, "id", order, vector).repartition(tasks, group)
    f = f.sortWithinPartitions(group, F.asc_nulls_last(order), F.asc_nulls_last("id"))
    return f.select(group, F.col("id").cast("string").alias("id"), vector).mapInArrow(run, f"`{group}` {g}, id string, cluster string")


def nearest_concepts(queries: DataFrame, centroids: DataFrame, k: int = 5, min_score: float = 0.55) -> DataFrame:
    return vectors.nearest(queries, centroids, k, min_score, exclude_self=False)


def assign(facts: DataFrame, centroids: DataFrame, vector: str, attach: float = 0.55) -> DataFrame:
    """(id, cluster, score): the scalable step: every fact and its nearest fixed centroid, which it joins at ``attach`` or above. Facts meet centroids in blocks."""
    name = centroids.columns[0]
    near = vectors.nearest(facts.select(F.col("id").alias("q_id"), F.col(vector).alias("q_vec")), centroids.select(F.col(name).cast("string").alias("i_id"), F.col("centroid").alias("i_vec")), 1, -1.5, exclude_self=False)
    j = facts.select("id").join(near.select(F.col("q_id").alias("id"), "i_id", "score").distinct(), "id", "left")
    return j.select("id", F.when(F.col("score") >= attach, F.col("i_id")).alias("cluster"), "score")
