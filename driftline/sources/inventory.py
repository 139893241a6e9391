"""Inventories: listings of files as rows, from paths that Spark reads and find's output; blobs in chunks and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, location: str) -> DataFrame:
    """Files under a location of any store that Spark reads. Contents aren't read; there are no rows
    for directories nor, since Spark leaves them out of its scans, for empty files and for names that
    begin with _ or a dot, so it is no ground for deletes: stores.inventory() has all of them. mode and etag
    are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(location)
    inner_root = location.rstrip("/").split("://")[-1].lstrip("/")
    inner = F.substring("path", F.instr("path", F.lit(inner_root)) + F.lit(len(inner_root) + 1), F.length("path"))
    return files.select(inner.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(False).alias("is_dir"), F.lit(None).cast("int").alias("mode"), F.lit(None).cast("string").alias("etag"))


def blobs(spark: SparkSession, location: str) -> DataFrame:
    """path, content of every file under a location."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(location).select("path", "content")


def from_find(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """Rows of `find -printf '%y\\t%s\\t%T@\\t%m\\t%P\\n'`. Short lines go, bad numbers are 0, modes are
    octal, times of 0 or less are null. An empty listing is an error unless it is allowed: with
    deletes on, a failed listing would empty the other side."""
    lines = spark.read.text(path)
    f = F.split("value", "\t", 5)
    rows = lines.where(F.size(f) == 5).select(f.alias("f"))
    at = F.coalesce(F.col("f")[2].try_cast("double"), F.lit(0.0))
    out = rows.select(
        F.col("f")[4].alias("path"), F.coalesce(F.col("f")[1].try_cast("long"), F.lit(0)).alias("size"), F.when(at > 0, F.timestamp_micros((at * 1_000_000).cast("long"))).alias("mtime"),
        (F.col("f")[0] == "d").alias("is_dir"), F.coalesce(F.conv(F.col("f")[3], 8, 10).cast("int"), F.lit(0)).alias("mode"), F.lit(None).cast("string").alias("etag"),
    ).where("path <> ''")
    if not allow_empty and out.isEmpty():
        raise ValueError(f"{path}: the listing is empty")
    return out


def chunks(blobs: DataFrame, size: int) -> DataFrame:
    """path, chunk_index, offset, data: a blob in chunks of `size` bytes; an empty one has none."""
    n = F.octet_length("content")
    rows = blobs.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("i"))
    return rows.select("path", F.col("i").cast("long").alias("chunk_index"), (F.col("i").cast("long") * size).alias("offset"), F.substring("content", F.col("i") * size + 1, F.lit(size)).alias("data"))


def padded_range(content, start: int, size: int):
    """`size` bytes from `start`; those beyond the end of the blob are 0."""
    return F.rpad(F.substring(content, start + 1, size), size, F.lit(b"\0"))


def byte_range(content, start: int, end: int):
    """Bytes start..end, both included, counted from 0; short at the end of the blob."""
    return F.substring(content, start + 1, end - start + 1)
