"""Conflicts, retries, resumed uploads and rate limits as relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conflicts(expected: DataFrame, current: DataFrame) -> DataFrame:
    """path, conflict (none, remote_created, remote_deleted, remote_modified) and what differs, by a
    full join of the rows that were expected with those there now. Equal checksums don't excuse
    different sizes."""
    e = expected.select("path", F.col("size").alias("e_size"), F.col("etag").alias("e_etag"), F.lit(True).alias("e"))
    c = current.select("path", F.col("size").alias("c_size"), F.col("etag").alias("c_etag"), F.lit(True).alias("c"))
    tags = F.coalesce(F.col("e_etag") != F.col("c_etag"), F.lit(False))
    sizes = F.col("e_size") != F.col("c_size")
    both = e.join(c, "path", "full")
    kind = F.when(F.col("e").isNull(), "remote_created").when(F.col("c").isNull(), "remote_deleted").when(tags | sizes, "remote_modified").otherwise("none")
    size = lambda x: F.concat(F.lit("size:"), F.col(x).cast("string"))
    was = F.when(kind == "remote_modified", F.when(tags, F.col("e_etag")).otherwise(size("e_size")))
    now = F.when(kind == "remote_modified", F.when(tags, F.col("c_etag")).otherwise(size("c_size")))
    return both.select("path", kind.alias("conflict"), was.alias("was"), now.alias("now"))


def conflict_action(conflict: Column, strategy: Column) -> Column:
    """proceed, skip, retry or error; an unknown strategy is retry."""
    known = F.when(strategy == "fail", "error").when(strategy == "overwrite", "proceed").when(strategy == "skip", "skip").otherwise("retry")
    return F.when(conflict == "none", "proceed").otherwise(known)


# Parts of messages of errors that may pass.
SERVICE_HINTS = ("throttl", "timeout", "connection", "503", "500", "429")
IO_HINTS = ("reset", "aborted", "timed out", "interrupted")


def retryable(kind: Column, message: Column) -> Column:
    hint = lambda words: F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(words))
    return F.coalesce(kind.isin("network", "multipart_upload") | ((kind == "aws") & hint(SERVICE_HINTS)) | ((kind == "io") & hint(IO_HINTS)), F.lit(False))


def retryable_kind(kind: Column) -> Column:
    """The narrower rule, by the kind of an error alone."""
    return F.coalesce(kind.isin("network", "multipart_upload"), F.lit(False))


def backoff(attempt: Column, base_ms: int = 1000, max_ms: int = 30_000) -> Column:
    """Delay before a further attempt in ms, without jitter."""
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt), F.lit(float(max_ms))).cast("long")


def retry_schedule(failures: DataFrame, max_retries: int = 3, base_ms: int = 1000, max_ms: int = 30_000) -> DataFrame:
    """attempt, delay_ms and starts_at_ms of every retry of each failed task (id, kind, message)."""
    tries = failures.where(retryable(F.col("kind"), F.col("message"))).select("id", F.explode(F.sequence(F.lit(0), F.lit(max_retries - 1))).alias("attempt"))
    tries = tries.withColumn("delay_ms", backoff(F.col("attempt"), base_ms, max_ms))
    return tries.withColumn("starts_at_ms", F.sum("delay_ms").over(Window.partitionBy("id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)))


def state_key(local: Column, remote: Column) -> Column:
    """16 hex digits of a hash of both paths."""
    return F.substring(F.md5(F.concat(local, F.lit("\n"), remote).cast("binary")), 1, 16)


def valid_states(states: DataFrame, local: DataFrame) -> DataFrame:
    """Saved uploads with `valid`: the local file is there, of the saved size, and its time differs
    by a second at most."""
    there = local.where(~F.col("is_dir")).select(F.col("path").alias("local_path"), F.col("size").alias("_size"), F.floor(F.unix_micros("mtime") / 1_000_000).alias("_mtime"))
    ok = (F.col("_size") == F.col("local_size")) & (F.abs(F.col("_mtime") - F.col("local_mtime")) <= 1)
    return states.join(there, "local_path", "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_size", "_mtime")


def stale_states(states: DataFrame, now: int, max_age: int) -> DataFrame:
    return states.where(F.lit(now) - F.col("started_at") > max_age)


def remaining_parts(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned parts (path, part_number) that no completed part matches."""
    return planned.join(done.select("path", "part_number"), ["path", "part_number"], "left_anti")


def token_bucket(requests: DataFrame, kib_per_second: int) -> DataFrame:
    """granted_at (seconds) of each request (stream, seq, at, bytes) of a stream under its rate.

    A bucket starts with one second of tokens and holds two; a request of more can never be granted
    (null). A stream's requests pass one task in order, which holds the bucket alone; streams are the unit
    of parallel work.
    """
    rate = float(kib_per_second * 1024)
    kind = requests.schema["stream"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, then, left = None, 0.0, rate
        for batch in batches:
            granted = []
            for this, at, need in zip(batch["stream"], batch["at"].astype(float), batch["bytes"].astype(float), strict=True):
                if this != stream:
                    stream, then, left = this, 0.0, rate
                if need > 2 * rate:
                    granted.append(None)
                    continue
                now = max(then, at)
                have = min(left + (now - then) * rate, 2 * rate)
                wait = max(need - have, 0.0) / rate
                then, left = now + wait, have + wait * rate - need
                granted.append(then)
            yield pd.DataFrame({"stream": batch["stream"], "seq": batch["seq"], "granted_at": pd.array(granted, "Float64")})

    rows = requests.select("stream", F.col("seq").cast("long").alias("seq"), "at", "bytes").repartition("stream").sortWithinPartitions("stream", "seq", "at", "bytes")
    return rows.mapInPandas(run, f"stream {kind}, seq long, granted_at double")
