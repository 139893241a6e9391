"""Stores by location: file trees, and object stores that pyarrow opens, listed in parallel."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftline.schema import INVENTORY
from driftline.sources import inventory as I

#: Directories that the driver opens at most, so that the rest is dealt to tasks.
OPENED = 256
#: Bytes of contents that are passed on together; a larger file goes alone.
HELD = 4 << 20
_SCHEME = re.compile(r"^([A-Za-z0-9]+)://")


def scheme(location: str) -> str:
    """file, s3, gs, az or ssh: the same rule as the column function `location`."""
    if location.startswith("file:"):
        return "file"
    if found := _SCHEME.match(location):
        name = found[1].lower()
        return {"azure": "az"}.get(name, name)
    return "ssh" if ":" in location and not location.startswith("/") else "file"


def opened(location: str) -> tuple[fs.FileSystem, str]:
    """The store of a location and the root within it."""
    kind = scheme(location)
    if kind == "file":
        return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//)?", "", location))
    if kind not in ("s3", "gs", "az"):
        raise ValueError(f"{location}: no store of this kind can be opened; give a listing of it")
    found, root = fs.FileSystem.from_uri(_SCHEME.sub("abfs://" if kind == "az" else f"{kind}://", location))
    return found, root.rstrip("/")


class _Part(InputPartition):
    def __init__(self, top: str, deep: bool) -> None:
        self.top, self.deep = top, deep


class _Reader(DataSourceReader):
    def __init__(self, location: str) -> None:
        self.location = location

    def partitions(self) -> list[_Part]:
        """Folders near the root one by one, those below as whole subtrees."""
        store, root = opened(self.location)
        done, level = [], [root]
        while level and len(done) + len(level) < OPENED:
            below = [x.path for top in level for x in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.type == fs.FileType.Directory and not os.path.islink(x.path)]
            done += [_Part(top, False) for top in level]
            level = below
        return done + [_Part(top, True) for top in level]

    def read(self, partition: _Part) -> Iterator[tuple]:
        store, root = opened(self.location)
        if isinstance(store, fs.LocalFileSystem):
            yield from self._tree(partition, root)
            return
        for x in store.get_file_info(fs.FileSelector(partition.top, allow_not_found=True, recursive=partition.deep)):
            folder = x.type == fs.FileType.Directory
            at = x.mtime.astimezone(timezone.utc).replace(tzinfo=None) if x.mtime and not folder else None
            yield x.path[len(root) + 1 :], 0 if folder else x.size or 0, at, folder, None, None

    def _tree(self, partition: _Part, root: str) -> Iterator[tuple]:
        """Hidden and empty files and directories too; links aren't followed, unreadable entries go."""
        tops = os.walk(partition.top) if partition.deep else [next(os.walk(partition.top), (partition.top, [], []))]
        for top, folders, files in tops:
            for name in [*folders, *files]:
                try:
                    s = os.lstat(path := os.path.join(top, name))
                except OSError:
                    continue
                folder = stat.S_ISDIR(s.st_mode)
                yield os.path.relpath(path, root), 0 if folder else s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc).replace(tzinfo=None), folder, stat.S_IMODE(s.st_mode), None


class Store(DataSource):
    """A store as a data source: its files and directories, a partition per folder or subtree."""

    @classmethod
    def name(cls) -> str:
        return "store_listing"

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["location"])


def inventory(spark: SparkSession, location: str, listing: str | None = None, allow_empty: bool = False) -> DataFrame:
    """The rows of a location of any kind: path, size, mtime, is_dir, mode, etag. A host's (user@host:path)
    come from `listing`, the output of find there. A location that is not there has no rows."""
    if scheme(location) == "ssh":
        if listing is None:
            raise ValueError(f"{location}: a listing is needed")
        return I.from_find(spark, listing, allow_empty)
    spark.dataSource.register(Store)
    return spark.read.format("store_listing").option("location", location).load()


def contents(files: DataFrame, location: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, content of the files (path) under a location, after it the columns to keep; content is null
    where there is none. What it will hold can't be told from its input: a join to it may be made by a
    broadcast of all contents, so digests and columns to keep belong before joins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(location)
        for batch in batches:
            begin, held, size = 0, [], 0
            for end, path in enumerate(batch["path"], 1):
                try:
                    with store.open_input_stream(f"{root}/{path}") as f:
                        held.append(f.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= HELD or end == len(batch):
                    yield batch[begin:end].assign(content=held)
                    begin, held, size = end, [], 0

    rows = files.select("path", *keep)
    kept = "".join(f", `{x.name}` {x.dataType.simpleString()}" for x in rows.schema[1:])
    return rows.mapInPandas(run, f"path string, content binary{kept}")


def exists(paths: DataFrame, listed: DataFrame) -> DataFrame:
    """The paths that an inventory has."""
    return paths.join(listed.select("path"), "path", "left_semi")


def with_etags(files: DataFrame, location: str) -> DataFrame:
    """Files with an etag of their content, 32 hex digits, for stores that list none."""
    from driftline.operators.signature import etag

    found = contents(files.where(~F.col("is_dir")), location).select("path", etag(F.col("content")).alias("_e"))
    return files.join(found, "path", "left").withColumn("etag", F.coalesce("etag", "_e")).drop("_e")
