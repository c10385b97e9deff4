"""Session settings and scratch tables shared by the operators."""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_counter = itertools.count()


def session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local runs that leave it unset a temporary one."""
    got = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Parquet tables in the shared folder that cut the lineage of iterative operators.

    Each survives the loss of executors. ``drop`` removes tables no longer needed;
    the rest goes when the process ends, since results may still read them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}"
        self.live: dict[int, str] = {}
        atexit.register(self._at_exit)

    def path(self, name: str = "t") -> str:
        return f"{self.root}/{name}-{next(_counter)}"

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = self.path()
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.parquet(path) if partition_by else self.spark.read.schema(df.schema).parquet(path)
        self.live[id(out)] = path
        out._scratch = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_scratch", None)
            if path:
                _delete(self.spark, path)

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # the context has ended; a local folder can still be removed
            if self.root.startswith("file:"):
                import shutil

                shutil.rmtree(self.root.split(":", 1)[1].replace("//", "/"), ignore_errors=True)


def local_path(path: str) -> str:
    """A file: URI as a path of the shared file system."""
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path


def rows_of(df: DataFrame, predicate=None) -> int:
    return (df if predicate is None else df.where(predicate)).agg(F.count(F.lit(1))).first()[0]


def env(name: str, default: str) -> str:
    return os.environ.get(name, default)
