"""Session helpers: where intermediate results go, how small tables are recognised."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lodestone", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster, the given session is used instead."""
    b = SparkSession.builder.appName(app).config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where the setting is absent, a temporary folder is used in local mode only;
    on a cluster that is an error, as a folder of one machine would be lost with it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    where = spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def plain_unions(spark: SparkSession) -> None:
    """Turn off unions that zip their sides' partitions.

    With adaptive execution the sides can end with different numbers of
    partitions, and the query then fails ("Can't zip RDDs").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again.

    This cuts lineage in a way that survives the loss of executors and keeps
    column pruning and size statistics. The folder's path is on the result as
    ``staged_at``; drop_stage removes it once nothing reads it any more.
    """
    spark = df.sparkSession
    plain_unions(spark)
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Remove a staged table that is no longer read."""
    path = getattr(df, "staged_at", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rows_within(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must."""
    return df.limit(most + 1).count() <= most
