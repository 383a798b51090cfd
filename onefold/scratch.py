"""Scratch tables in the folder that the cluster names in ``spark.checkpoint.dir``, which every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a finished query's shuffle files go.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder. A local one is set only where the session names none (tests, one machine)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not (found := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="onefold-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that no other run uses."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the scratch folder, or in `folder`, read back. It survives lost executors and is computed once.

    The shuffle files that it took are deleted when it is written.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._onefold_path = path
    return found


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that grow, never by a broadcast: Spark takes a compressed file for as small as it is on disk, and would send many times that through the driver."""
    return left.join(right.hint("merge"), on, how)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
