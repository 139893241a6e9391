"""Inventories, blobs and logs derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 in microseconds.
START = 1_704_067_200_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dir, path, lang, old, new (texts) and t (microseconds) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, half = F.concat_ws("/", "source", "lang"), F.floor(F.length("text") / 2).cast("int")
    new = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" tail"))).when(F.col("doc_id") % 4 == 2, F.concat(F.substring("text", F.lit(1), half), F.lit("#"), F.substring("text", half + 1, F.length("text")))).otherwise(F.col("text"))
    return docs.select("doc_id", "lang", folder.alias("dir"), F.concat(folder, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path"), F.col("text").alias("old"), new.alias("new"), (F.lit(START) + F.col("doc_id") * 60_000_000).alias("t"))


def _files(rows: DataFrame, text: str, t) -> DataFrame:
    tag = F.when(F.col("doc_id") % 13 != 0, F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32))
    return rows.select("path", F.octet_length(text).cast("long").alias("size"), F.timestamp_micros(t).alias("mtime"), F.lit(False).alias("is_dir"), F.lit(420).alias("mode"), tag.alias("etag"))


def _folders(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("dir").alias("path")).distinct().select("path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(True).alias("is_dir"), F.lit(493).alias("mode"), F.lit(None).cast("string").alias("etag"))


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    t = F.col("t") + F.when(F.col("doc_id") % 4 == 3, 90_000_000).otherwise(0)
    return _files(rows.where("doc_id % 11 <> 0"), "new", t).unionByName(_folders(rows))


def dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    t = F.when(F.col("doc_id") % 17 != 0, F.col("t"))
    return _files(rows.where("doc_id % 7 <> 0"), "old", t).unionByName(_folders(rows.where("lang <> 'fr'")))


def blobs(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """path, content of the old or new blobs."""
    return documents(spark, sf_dir).select("path", F.encode(text, "utf-8").alias("content"))


SQL = """
b AS (SELECT doc_id, lang, source || '/' || lang AS dir, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path, text AS old,
  CASE doc_id % 4 WHEN 1 THEN text || ' tail' WHEN 2 THEN substr(text, 1, length(text) // 2) || '#' || substr(text, length(text) // 2 + 1) ELSE text END AS new,
  1704067200000000 + doc_id * 60000000 AS t FROM documents),
s AS (SELECT path, CAST(strlen(new) AS BIGINT) AS size, CASE WHEN doc_id % 4 = 3 THEN t + 90000000 ELSE t END AS mt, false AS is_dir, 420 AS mode,
  CASE WHEN doc_id % 13 <> 0 THEN substr(sha256(new), 1, 32) END AS etag FROM b WHERE doc_id % 11 <> 0
  UNION ALL SELECT DISTINCT dir, 0, CAST(NULL AS BIGINT), true, 493, CAST(NULL AS VARCHAR) FROM b),
d AS (SELECT path, CAST(strlen(old) AS BIGINT) AS size, CASE WHEN doc_id % 17 <> 0 THEN t END AS mt, false AS is_dir, 420 AS mode,
  CASE WHEN doc_id % 13 <> 0 THEN substr(sha256(old), 1, 32) END AS etag FROM b WHERE doc_id % 7 <> 0
  UNION ALL SELECT DISTINCT dir, 0, CAST(NULL AS BIGINT), true, 493, CAST(NULL AS VARCHAR) FROM b WHERE lang <> 'fr')
"""


def diff_sql(o) -> str:
    """The CTEs up to `a` (path, size, mt, is_dir, mode, etag, action): the decision table in SQL."""
    if o.checksum:
        same = "coalesce(s.etag = d.etag, false)"
    elif o.size_only:
        same = "true"
    else:
        same = f"coalesce(abs(s.mt - d.mt) // 1000000 <= {o.window}, true)"
    newer = f"OR coalesce(d.mt - s.mt > {abs(o.modify_window) * 1_000_000}, false)" if o.update else ""
    big = f"s.size >= {o.delta_threshold}" if not (o.whole_file or o.no_sidecar) else "false"
    limits = f"s.is_dir OR (({o.max_size} = 0 OR s.size <= {o.max_size}) AND ({o.min_size} = 0 OR s.size >= {o.min_size}))"
    gone = " UNION ALL SELECT d.*, 'delete' FROM d WHERE path NOT IN (SELECT path FROM s)" if o.delete else ""
    return f"""{SQL},
a AS (SELECT * FROM (SELECT s.*, CASE WHEN s.is_dir THEN CASE WHEN d.path IS NULL THEN 'mkdir' END
    WHEN d.path IS NULL THEN {"NULL" if o.existing else "'upload'"} {"WHEN true THEN 'skip'" if o.ignore_existing else ""}
    WHEN (s.size = d.size AND {same}) {newer} THEN 'skip' WHEN {big} THEN 'delta' ELSE 'upload' END AS action
  FROM s LEFT JOIN d ON s.path = d.path WHERE {limits}) x WHERE action IS NOT NULL{gone}),
p AS (SELECT *, CASE WHEN action = 'delta' THEN size // 5 WHEN action IN ('upload', 'download') AND NOT is_dir THEN size ELSE 0 END AS estimated_bytes,
  CASE WHEN action = 'delta' THEN size - size // 5 ELSE 0 END AS bytes_saved,
  CASE action WHEN 'mkdir' THEN 0 WHEN 'upload' THEN 1 WHEN 'download' THEN 1 WHEN 'delta' THEN 2 WHEN 'skip' THEN 3 ELSE 4 END AS rank FROM a)"""
