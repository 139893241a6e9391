"""Plans carried out on stores that all executors see: one task works on many paths, a path at a time.

Every act on a path can be repeated with the same outcome, so a lost executor's task runs again: files
are written beside their place and moved there, a directory that is there stays, and a path that is
gone is deleted already.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import timezone
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.config import Options
from driftline.functions import locations as L
from driftline.operators.diff import diff
from driftline.operators.plan import ratio
from driftline.scratch import written
from driftline.sources.stores import inventory, opened

LOG = "path string, action string, bytes long, backup string, error string"
CHUNK, TEMPORARY = 1 << 20, ".driftline_tmp"


def _local(store: fs.FileSystem) -> bool:
    return isinstance(store, fs.LocalFileSystem)


def _put(store: fs.FileSystem, path: str, chunks: Iterator[bytes], mode: int | None = None, at: float | None = None) -> int:
    """Writes a file so that it is there whole or not at all; bytes written."""
    n = 0
    if not _local(store):
        with store.open_output_stream(path) as f:
            for x in chunks:
                n += f.write(x)
        return n
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{os.getpid()}{TEMPORARY}"
    try:
        with open(beside, "wb") as f:
            for x in chunks:
                n += f.write(x)
            f.flush()
            os.fsync(f.fileno())
        if mode is not None:
            os.chmod(beside, mode)
        if at is not None:
            os.utime(beside, (at, at))
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)
    return n


def _read(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path) as f:
        while data := f.read(CHUNK):
            yield data


def _delete(store: fs.FileSystem, path: str, folder: bool) -> None:
    try:
        if folder:
            store.delete_dir(path)
        else:
            store.delete_file(path)
    except FileNotFoundError:
        return


def _seconds(value) -> float | None:
    return None if pd.isna(value) else value.replace(tzinfo=timezone.utc).timestamp()


def put(rows: DataFrame, location: str) -> DataFrame:
    """Writes rows (path, content, and if there are is_dir, mode, mtime) under a location; LOG, written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(location)
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if r.get("is_dir"):
                    store.create_dir(f"{root}/{r['path']}", recursive=True)
                    out.append((r["path"], "mkdir", 0, None, None))
                else:
                    n = _put(store, f"{root}/{r['path']}", iter([bytes(r["content"])]), None if pd.isna(r.get("mode")) else int(r["mode"]), _seconds(r.get("mtime")))
                    out.append((r["path"], "upload", n, None, None))
            yield pd.DataFrame(out, columns=LOG_COLUMNS)

    return written(rows.mapInPandas(run, LOG))


LOG_COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def apply(actions: DataFrame, source: str, dest: str, o: Options | None = None) -> DataFrame:
    """Carries out actions (rows of diff) from one location to another; LOG of all of them, written.

    Directories are made first and what is to go goes last. With o.backup, a file that is
    overwritten or deleted is kept at its backup path. An action that fails is a row with its error. A
    dry run is a log without effects.
    """
    o = o or Options()
    old = F.when(F.lit(o.backup) & ~F.col("is_dir"), L.backup_path(F.col("path"), o.backup_dir, o.backup_suffix))
    rows = actions.select("path", "action", "size", "mtime", "mode", "is_dir", old.alias("backup"))
    if o.dry_run:
        return written(rows.select("path", "action", F.when(F.col("action").isin("upload", "download", "delta"), F.col("size")).otherwise(0).cast("long").alias("bytes"), F.lit(None).cast("string").alias("backup"), F.lit(None).cast("string").alias("error")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (here, top), (there, root) = opened(source), opened(dest)

        def act(r: dict) -> tuple[int, str | None]:
            path, kept = f"{root}/{r['path']}", None
            if r["backup"] and r["action"] != "skip" and there.get_file_info(path).type == fs.FileType.File:
                _put(there, f"{root}/{r['backup']}" if not r["backup"].startswith("/") else r["backup"], _read(there, path))
                kept = r["backup"]
            if r["action"] == "mkdir":
                there.create_dir(path, recursive=True)
            elif r["action"] == "delete":
                _delete(there, path, r["is_dir"])
            elif r["action"] != "skip":
                return _put(there, path, _read(here, f"{top}/{r['path']}"), None if pd.isna(r["mode"]) else int(r["mode"]), _seconds(r["mtime"])), kept
            return 0, kept

        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    out.append((r["path"], r["action"], *act(r), None))
                except OSError as e:
                    out.append((r["path"], r["action"], 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=LOG_COLUMNS)

    gone = F.col("action") == "delete"
    passes = (F.col("action") == "mkdir", (F.col("action") != "mkdir") & ~gone, gone & ~F.col("is_dir"), gone & F.col("is_dir"))
    parts = int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reduce(DataFrame.unionByName, [written(rows.where(p).repartition(parts, "path").mapInPandas(run, LOG)) for p in passes])


def observed(log: DataFrame, seconds: float = 0.0) -> DataFrame:
    """One row of what a log's acts did: files by kind, directories, bytes, errors, bytes a second."""
    fine, kind = F.col("error").isNull(), F.col("action")
    row = log.agg(
        *(F.count_if(fine & (kind == a)).alias(n) for a, n in (("upload", "files_uploaded"), ("delta", "files_delta"), ("skip", "files_skipped"), ("delete", "files_deleted"), ("mkdir", "dirs_made"))),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_transferred"), F.count_if(F.col("backup").isNotNull()).alias("files_kept"), F.count_if(~fine).alias("errors"),
    )
    return row.withColumn("bytes_per_second", ratio(F.col("bytes_transferred"), F.lit(seconds), 1.0).cast("double"))


def write_itemized(lines: DataFrame, path: str) -> None:
    """Adds the lines of itemized() to a log of text files."""
    lines.orderBy("path").select("line").write.mode("append").text(path)


def sync(spark: SparkSession, source: str, dest: str, o: Options | None = None) -> DataFrame:
    """Lists both locations, compares them and applies the plan; its log."""
    there = written(inventory(spark, dest))
    return apply(written(diff(inventory(spark, source), there, o)), source, dest, o)


def progress(spark: SparkSession) -> list[dict]:
    """Stages that run just now: name, tasks and how many of them are done."""
    tracker = spark.sparkContext.statusTracker()
    found = [tracker.getStageInfo(x) for x in tracker.getActiveStageIds()]
    return [{"name": x.name, "tasks": x.numTasks, "done": x.numCompletedTasks} for x in found if x]


def cancellable(spark: SparkSession, group: str, work):
    """work() as a job group that cancel() ends."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def retried(work, max_retries: int = 3, base_ms: int = 1000, max_ms: int = 30_000, passes=lambda e: isinstance(e, (ConnectionError, TimeoutError, InterruptedError)), sleep=time.sleep):
    """work() with up to max_retries further attempts where the error may pass, each after a longer delay."""
    for attempt in range(max_retries + 1):
        try:
            return work()
        except Exception as e:
            if attempt == max_retries or not passes(e):
                raise
            sleep(min(base_ms * 2**attempt, max_ms) / 1000)


