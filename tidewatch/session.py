"""Session settings and lineage control shared by tests, bench and jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "tidewatch") -> SparkSession:
    """A local session for tests and bench; clusters bring their own session."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a local session (tests, bench) takes a folder of its own, once; a
    cluster has to name one.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    Iterative operators call this once per few rounds so that a lost executor
    is recovered from shared storage and the plan does not grow with rounds.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """Marks a side of a join that grows with the input: both sides are shuffled and merged.

    Without it the planner may choose a broadcast before anything has run: it takes the size of
    the table's files as the size of what is made from them, also after rows are exploded or texts
    computed, and AQE does not take such a broadcast back.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the same folder, read back: lineage ends there, and later
    readers take only the columns they need."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows that lie in ``n`` partitions by the keys, stored like that: groupings that hold these keys read
    them back without a shuffle."""
    name = f"stored_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/{name}"
    df.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
