"""Comparison of a source and a destination inventory by path: one action a path."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import SIDECAR, Options
from driftline.functions.locations import backup_path

_OWN = ("size", "mtime", "is_dir", "mode", "etag")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c))


def within_limits(o: Options) -> Column:
    """Directories, and files within the size limits (0: none)."""
    low = F.col("size") >= o.min_size if o.min_size else F.lit(True)
    high = F.col("size") <= o.max_size if o.max_size else F.lit(True)
    return F.col("is_dir") | (low & high)


def dest_newer(o: Options) -> Column:
    """The destination is newer by more than the window, at full precision; never with a time missing."""
    return F.coalesce(_micros("d_mtime") - _micros("mtime") > abs(o.modify_window) * 1_000_000, F.lit(False))


def unchanged(o: Options) -> Column:
    """Checksum before size only before time and size. Whole seconds count between times; a missing
    time matches, a missing checksum doesn't."""
    same = F.col("size") == F.col("d_size")
    if o.checksum:
        return same & F.coalesce(F.col("etag") == F.col("d_etag"), F.lit(False))
    if o.size_only:
        return same
    apart = F.floor(F.abs(_micros("mtime") - _micros("d_mtime")) / 1_000_000)
    return same & F.coalesce(apart <= o.window, F.lit(True))


def wants_delta(o: Options) -> Column:
    return F.lit(not o.whole_file and not o.no_sidecar) & (F.col("size") >= o.delta_threshold)


def glob(pattern: str) -> str:
    """A path pattern as a regular expression: ** crosses directories, * and ? do not."""
    parts = re.split(r"(\*\*/?|\*|\?)", pattern)
    named = {"**": ".*", "**/": "(?:.*/)?", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(named.get(x) or re.escape(x) for x in parts) + "$"


def selected(o: Options) -> Column:
    """Extension: paths that an include pattern matches, or that no exclude pattern does."""
    hit = lambda patterns: reduce(lambda a, b: a | b, [F.col("path").rlike(glob(p)) for p in patterns], F.lit(False))
    return hit(o.include) | ~hit(o.exclude)


def diff(source: DataFrame, dest: DataFrame, o: Options | None = None) -> DataFrame:
    """The inventory row and the action of every path that needs one. Paths are unique in each input.

    One left join decides for the source's rows and one anti join finds what only the destination
    has, against the unfiltered source: a file that the limits leave out protects its copy.
    """
    o = o or Options()
    if o.include or o.exclude:
        source, dest = source.where(selected(o)), dest.where(selected(o))
    there = dest.select("path", *(F.col(c).alias(f"d_{c}") for c in _OWN), F.lit(True).alias("d_there"))
    absent, nothing = F.col("d_there").isNull(), F.lit(None).cast("string")
    rules = F.when(F.col("is_dir"), F.when(absent, "mkdir")).when(absent, nothing if o.existing else F.lit("upload"))
    if o.ignore_existing:
        rules = rules.otherwise("skip")
    else:
        stays = unchanged(o) | dest_newer(o) if o.update else unchanged(o)
        rules = rules.when(stays, "skip").when(wants_delta(o), "delta").otherwise("upload")
    actions = source.where(within_limits(o)).join(there, "path", "left").withColumn("action", rules).where("action IS NOT NULL").select("path", *_OWN, "action")
    if o.delete:
        if o.keep_sidecars:
            dest = dest.where(~F.col("path").endswith(SIDECAR))
        actions = actions.unionByName(dest.join(source, "path", "left_anti").select("path", *_OWN, F.lit("delete").alias("action")))
    return actions


def backups(actions: DataFrame, dest: DataFrame, directory: str | None = None, suffix: str = "~") -> DataFrame:
    """path, backup of every file of the destination that an action overwrites or deletes."""
    gone = actions.where(F.col("action").isin("upload", "download", "delta", "delete") & ~F.col("is_dir"))
    return gone.join(dest.where(~F.col("is_dir")).select("path"), "path", "left_semi").select("path", backup_path(F.col("path"), directory, suffix).alias("backup"))


def one_row_a_path(inventory: DataFrame) -> DataFrame:
    """The newest row of each path, for listings that may hold a path twice."""
    row = F.max_by(F.struct(*_OWN), F.struct(F.coalesce(_micros("mtime"), F.lit(-1)), "size", F.coalesce("etag", F.lit(""))))
    return inventory.groupBy("path").agg(row.alias("r")).select("path", "r.*")


def heads(inventory: DataFrame, paths: DataFrame) -> DataFrame:
    """For every wanted path its row, with `found` false where there is none."""
    return paths.select("path").distinct().join(inventory.withColumn("_f", F.lit(True)), "path", "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_f")
