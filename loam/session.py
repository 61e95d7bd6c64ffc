"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "loam") -> SparkSession:
    """Session with AQE on (coalescing, skew-join splitting) and the UI off."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # a join on more keys than its tables are bucketed by still needs no shuffle
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    When the setting is absent, a session in a single local process (tests) gets a
    scratch folder; on a cluster that is an error, as no other folder is shared.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not conf:
        existing = spark.sparkContext.getCheckpointDir()
        if existing:
            return existing
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="loam-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", conf)
        except Exception:  # noqa: BLE001 - a session may treat it as a static setting
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))


#: Folders written by ``materialize`` in this process, for ``release``.
_WRITTEN: list[str] = []


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of this library's own, in whatever store the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def forget_later(path: str) -> None:
    """Have ``release`` delete this folder too."""
    _WRITTEN.append(path)


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Used where later steps read a stage's output several times: the stage runs once,
    lineage is cut, and later filters reach the Parquet scan as pushed filters. The
    folder stays until ``release``, as any DataFrame may still read it.
    """
    import uuid

    path = os.path.join(checkpoint_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)  # first, so that a write that fails is deleted too
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this process wrote for its own use: what ``materialize`` wrote or tried to, folders named
    to ``forget_later``, and the session's checkpoints. Call it when no result that was built on them is
    read any more. Returns the number of folders that were there."""
    gone = 0
    while _WRITTEN:
        gone += remove_path(spark, _WRITTEN.pop())
    if checkpoints := spark.sparkContext.getCheckpointDir():
        gone += remove_path(spark, checkpoints)
    return gone
