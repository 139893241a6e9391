"""Plans: estimates, order, counts and statistics of a diff's actions; modes, itemised lines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DELTA_THRESHOLD, SMALL_FILE
from driftline.schema import ACTIONS, RANK
from driftline.scratch import written

TRANSFERS = ("upload", "download", "delta")


def rank(action: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, place in RANK.items():
        out = out.when(action == name, place)
    return out


def estimated(actions: DataFrame) -> DataFrame:
    """A delta is estimated at a fifth of its file; other transfers at all of it."""
    part = F.expr("size div 5")
    moves = F.col("action").isin(*TRANSFERS) & ~F.col("is_dir")
    estimate = F.when(F.col("action") == "delta", part).when(moves, F.col("size")).otherwise(F.lit(0))
    saved = F.when(F.col("action") == "delta", F.col("size") - part).otherwise(F.lit(0))
    return actions.withColumns({"estimated_bytes": estimate.cast("long"), "bytes_saved": saved.cast("long")})


def ordered(actions: DataFrame) -> DataFrame:
    """The plan in its order: by rank, then by the bytes of the path."""
    return estimated(actions).withColumn("rank", rank(F.col("action"))).orderBy("rank", "path")


def positions(actions: DataFrame) -> DataFrame:
    """The plan with its place in the plan's order, from 1, and `implied` for deletes below a deleted directory.

    Rows are dealt by ranges of the order and written; a row's place is that in its range behind the sizes of
    the ranges before, of which there are as many as partitions.
    """
    plan = estimated(actions).withColumn("rank", rank(F.col("action")))
    gone = plan.where("action = 'delete' AND is_dir").select(F.concat("path", F.lit("/")).alias("_dir"))
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.concat(F.array_join(F.slice(F.split("path", "/"), 1, i), "/"), F.lit("/")))
    below = plan.where("action = 'delete' AND path LIKE '%/%'").select("path", F.explode(ups).alias("_dir")).join(gone, "_dir").select("path").distinct().withColumn("implied", F.lit(True))
    out = plan.join(below, "path", "left").withColumn("implied", F.coalesce("implied", F.lit(False)))
    parts = int(actions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = out.repartitionByRange(parts, "rank", "path").sortWithinPartitions("rank", "path").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged = written(ranged)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn("place", (F.col("_start") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_start")


def counts(actions: DataFrame) -> DataFrame:
    """Rows and bytes per action."""
    return estimated(actions).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"), F.sum("estimated_bytes").cast("long").alias("estimated_bytes"), F.sum("bytes_saved").cast("long").alias("bytes_saved"))


def counts_row(actions: DataFrame) -> DataFrame:
    """One row: a count for each action."""
    return actions.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS))


def totals(actions: DataFrame) -> DataFrame:
    plan = estimated(actions)
    return plan.agg(F.coalesce(F.sum("estimated_bytes"), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).cast("long").alias("bytes_saved"))


def ratio(part: Column, whole: Column, times: float = 100.0) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * times)


def run_stats(actions: DataFrame, seconds: float = 1.0) -> DataFrame:
    """One row of what a run of the plan transfers, with savings in percent and bytes a second."""
    plan, kind = estimated(actions), F.col("action")
    moved = kind.isin("upload", "delta")
    total = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0)).cast("long")
    row = plan.agg(
        *(F.count_if(kind == a).alias(n) for a, n in (("upload", "files_uploaded"), ("delta", "files_delta"), ("skip", "files_skipped"), ("delete", "files_deleted"))),
        total("size", moved).alias("bytes_total"), total("estimated_bytes", moved).alias("bytes_transferred"), total("bytes_saved", kind == "delta").alias("bytes_saved"),
    )
    rate = F.col("bytes_transferred") / F.lit(seconds) if seconds else F.lit(0.0)
    return row.withColumns({"savings_percent": ratio(F.col("bytes_saved"), F.col("bytes_total")), "bytes_per_second": rate.cast("double")})


def scan_stats(source: DataFrame) -> DataFrame:
    return source.agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if("is_dir").alias("dirs_scanned"), F.sum("size").cast("long").alias("bytes_scanned"))


def execution_modes(actions: DataFrame, source_local: bool, dest_local: bool, dest_part_copy: bool, threshold: int = DELTA_THRESHOLD, small: int = SMALL_FILE, known: DataFrame | None = None) -> DataFrame:
    """How each action would run, and whether the object needs a signature afterwards.

    known (path, has_signature, beneficial, local_size): what is found out about the delta's files. A
    delta without a signature on the other side, one that saves nothing, and one to a local file
    that is not there or small are full transfers.
    """
    kind, pays = F.col("action"), F.lit(True)
    if known is not None:
        facts = known.select("path", "has_signature", "beneficial", "local_size")
        actions = actions.join(facts, "path", "left")
        pays = F.coalesce("has_signature", F.lit(False)) & (F.coalesce("beneficial", F.lit(False)) if source_local else F.coalesce(F.col("local_size") >= small, F.lit(False)))
    if source_local:
        delta = F.when(pays & F.lit(dest_part_copy), "delta_upload").otherwise("full_upload")
    else:
        delta = F.when(pays, "delta_download").otherwise("full_download") if dest_local else F.lit("full_transfer")
    direct = F.lit("kernel_copy") if source_local and dest_local else F.when(F.col("size") < small, "memory").otherwise("put_file" if source_local else "stream")
    mode = F.when(kind == "delta", delta).when(kind.isin("upload", "download"), direct).otherwise(kind)
    out = actions.withColumns({"mode": mode, "needs_signature": kind.isin(*TRANSFERS) & ~F.col("is_dir") & (F.col("size") >= threshold)})
    return out if known is None else out.drop("has_signature", "beneficial", "local_size")


def itemized(actions: DataFrame, dest: DataFrame) -> DataFrame:
    """path, line: an itemised line per action in the manner of rsync."""
    kind = F.col("action")
    there = dest.select("path", F.col("size").alias("d_size"), F.col("mtime").alias("d_mtime"), F.col("mode").alias("d_mode"), F.lit(True).alias("d_there"))
    both = F.coalesce("d_there", F.lit(False))
    sized = ~both | (F.col("size") != F.col("d_size"))
    timed = ~both | F.coalesce(F.col("mtime") != F.col("d_mtime"), F.lit(False))
    moded = ~both | ~F.col("mode").eqNullSafe(F.col("d_mode"))
    flag = lambda c, x: F.when(c, x).otherwise(".")
    flags = F.concat(flag(sized, "c"), flag(sized, "s"), flag(timed, "t"), flag(moded, "p"), flag(~both, "o"), flag(~both, "g"), F.lit("..."))
    update = F.when(kind.isin("upload", "delta"), "<").when(kind == "download", ">").when(kind == "mkdir", "c").otherwise(".")
    line = F.when(kind == "delete", F.concat(F.lit("*deleting   "), "path")).otherwise(F.concat(update, F.when(F.col("is_dir"), "d").otherwise("f"), flags, F.lit(" "), "path"))
    return actions.join(there, "path", "left").select("path", "action", line.alias("line"))


def report(stats: dict, dry_run: bool = False) -> str:
    """The text of a one-row result of run_stats."""
    from driftline.functions.text import size_text

    verb = "would be " if dry_run else ""
    lines = [f"{stats[k]} files {verb}{w}" for k, w in (("files_uploaded", "uploaded"), ("files_delta", "sent as deltas"), ("files_skipped", "skipped"), ("files_deleted", "deleted")) if stats.get(k)]
    lines.append(f"{size_text(stats['bytes_transferred'])} of {size_text(stats['bytes_total'])} transferred")
    if stats["bytes_saved"]:
        lines.append(f"{size_text(stats['bytes_saved'])} saved ({stats['savings_percent']:.1f}%)")
    return "\n".join(lines)
