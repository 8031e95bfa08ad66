"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leave sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(app: str = "knownwhen", cpus: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Cut a lineage that several branches read, through the cluster's shared checkpoint folder.

    Only a local[*] master, as in tests, may do without a named folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors all see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder.

    For loops of joins: unlike a checkpoint, which keeps the estimate of its plan, a table has its true size, so
    estimates don't multiply from round to round.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A side table of a join, with a broadcast hint only if a count shows that it is small.

    The side is written to the checkpoint folder once, so the count and the join read it
    back instead of computing it again. Above the bound the join is left to a shuffle.
    """
    df = materialise(df)
    return F.broadcast(df) if df.count() <= rows else df
