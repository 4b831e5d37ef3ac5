"""Session helpers: table access, and stages written to the shared folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a session on one machine (tests, a laptop) gets one temporary folder; on a cluster, whose
    machines would each have their own, that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


class Stages:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs one stage only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back with its own schema."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Remove stages that nothing reads any more."""
        for df in dfs:
            path = getattr(df, "_stage_path", None)
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def kept_path(spark: SparkSession, source: str, name: str) -> str:
    """Where something made from ``source`` is kept: its name depends on the source's files, their sizes and times, so that
    what was made from older files is never read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    return f"{shared_dir(spark)}/kept/{name}-{hashlib.sha256(repr(seen).encode()).hexdigest()[:24]}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def join_hot(left: DataFrame, right: DataFrame, lkey: str, rkey: str, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``rkey``) where few keys may hold most of ``left``.

    Rows with a null key meet nothing, so they never travel to one task; adaptive execution splits the partitions of
    very frequent keys, whose right side is one row. Rows of ``left`` with a null key are kept for ``how='left'``.
    """
    some = left.where(F.col(lkey).isNotNull()).join(right, F.col(lkey) == F.col(rkey), how)
    if how != "left":
        return some
    none = left.where(F.col(lkey).isNull()).select(*left.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    return some.unionByName(none)
