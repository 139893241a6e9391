"""Written intermediates: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset on one machine
    (tests) a temporary folder, which is then set on the context. A cluster has to name one."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftline-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found.rstrip("/")


def fresh(spark: SparkSession, kind: str = "driftline") -> str:
    """A new path in that folder; what is written there goes when Python ends."""
    path = f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is scratch
        return


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing.

    The table goes when Python ends; release() drops it earlier. The shuffle files of the job go at its
    end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftline_path = path
    return out


def release(df: DataFrame) -> None:
    """Drops a table made by written() of which nothing that is still to run depends."""
    if path := getattr(df, "_driftline_path", None):
        delete(df.sparkSession, path)
