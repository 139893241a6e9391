"""Uploads in parts: parts lie beside the destination until the upload is completed or aborted.

A task puts its parts one after another into a file for each lot, and names them in an index once all are
there, as a file for every part would take a block of disk each. A path's lot is a hash of the path: lots are
completed and dropped in turn, so that parts and whole files are there twice for one lot at a time.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.scratch import written
from driftline.sinks.apply import CHUNK, LOG, LOG_COLUMNS, TEMPORARY, _local, _put
from driftline.sources.stores import opened

PART = "path string, part_number int, etag string, size long"
#: Where a part's bytes are: in a file (its name begins with the time of the upload) of the path's lot.
PLACE = "path string, part_number int, lot int, file string, at long, size long"
#: Lots of an upload, and files that a task keeps open.
LOTS, OPEN = 8, 64


def create(location: str) -> str:
    """An upload id: the folder of an upload's parts."""
    store, root = opened(location)
    upload = f".parts-{uuid.uuid4().hex}"
    store.create_dir(f"{root}/{upload}/index", recursive=True)
    return upload


def upload_parts(parts: DataFrame, location: str, upload: str) -> DataFrame:
    """Writes parts (path, part_number, data); path, part_number, etag and size of each, written. Of a part
    that is written again the later one counts. What a task that fails has written is in no index."""
    began = time.time_ns()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(location)
        name, files, index = f"{began:020d}-{uuid.uuid4().hex}", {}, []
        ends: dict[int, int] = {}
        try:
            for batch in batches:
                out = []
                for path, number, data in zip(batch["path"], batch["part_number"], batch["data"], strict=True):
                    data, lot = bytes(data), zlib.crc32(path.encode()) % LOTS
                    if lot not in files:
                        store.create_dir(f"{root}/{upload}/{lot}", recursive=True)
                        files[lot] = store.open_output_stream(f"{root}/{upload}/{lot}/{name}", buffer_size=CHUNK)
                    files[lot].write(data)
                    index.append((path, number, lot, name, ends.get(lot, 0), len(data)))
                    ends[lot] = ends.get(lot, 0) + len(data)
                    out.append((path, number, hashlib.md5(data).hexdigest(), len(data)))
                yield pd.DataFrame(out, columns=["path", "part_number", "etag", "size"])
        finally:
            for f in files.values():
                f.close()
        if index:
            for lot in files if _local(store) else ():
                _synced(f"{root}/{upload}/{lot}/{name}")
            table = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_pandas(pd.DataFrame(index, columns=_PLACE), preserve_index=False), table, compression="zstd")
            _put(store, f"{root}/{upload}/index/{name}", iter([table.getvalue().to_pybytes()]))

    return written(parts.select("path", "part_number", "data").mapInPandas(run, PART))


_PLACE = [c.split()[0] for c in PLACE.split(", ")]


def _synced(path: str) -> None:
    f = os.open(path, os.O_RDONLY)
    try:
        os.fsync(f)
    finally:
        os.close(f)


def _places(done: DataFrame, location: str, upload: str) -> DataFrame:
    """PLACE of all parts of an upload that indexes name; of a part that was written again, the later place."""
    store, root = opened(location)
    names = [(x.path,) for x in store.get_file_info(fs.FileSelector(f"{root}/{upload}/index", allow_not_found=True)) if not x.path.endswith(TEMPORARY)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = opened(location)
        for batch in batches:
            for name in batch["name"]:
                with store.open_input_file(name) as f:
                    yield pq.read_table(f).to_pandas()

    spark = done.sparkSession
    found = spark.createDataFrame(names, "name string").mapInPandas(run, PLACE)
    last = found.groupBy("path", "part_number").agg(F.max(F.struct("file", "at", "size", "lot")).alias("p"))
    return last.select("path", "part_number", "p.*")


def complete(done: DataFrame, location: str, upload: str) -> DataFrame:
    """Puts each path together from its parts in their order and drops them; LOG, written. A path whose
    numbers have a gap, or whose parts are not there, is a row with an error and stays as it is; then no
    parts are dropped from there on. Can be repeated: a path whose lot is dropped is there already."""
    wanted = done.select("path", "part_number").distinct().join(_places(done, location, upload).hint("merge"), ["path", "part_number"], "left")
    lists = wanted.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part_number", "file", "at", "size"))).alias("parts"))
    gap = F.col("parts.part_number") != F.sequence(F.lit(1), F.size("parts"))
    lists = written(lists.select("path", (F.crc32("path") % LOTS).cast("int").alias("lot"), "parts", (gap | F.exists("parts", lambda p: p["file"].isNull())).alias("lacks")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(location)
        files: dict[str, pa.NativeFile] = {}

        def opened_part(name: str) -> pa.NativeFile:
            f = files[name] = files.pop(name, None) or store.open_input_file(name)
            if len(files) > OPEN:
                files.pop(next(iter(files))).close()
            return f

        def act(path: str, lot: int, parts) -> tuple[int, str | None]:
            top, place = f"{root}/{upload}/{lot}", f"{root}/{path}"
            try:
                for p in parts:  # before anything is written
                    if opened_part(f"{top}/{p['file']}").size() < p["at"] + p["size"]:
                        raise FileNotFoundError(p["file"])
                bits = ((f"{top}/{p['file']}", p["at"] + i, min(CHUNK, p["size"] - i)) for p in parts for i in range(0, p["size"], CHUNK))
                return _put(store, place, (opened_part(name).read_at(n, at) for name, at, n in bits)), None
            except FileNotFoundError:
                size, there = sum(p["size"] for p in parts), store.get_file_info([top, place])
                if there[0].type == fs.FileType.NotFound and there[1].type == fs.FileType.File and there[1].size == size:
                    return size, None
                return 0, "parts are missing"

        try:
            for batch in batches:
                out = []
                for path, lot, parts, lacks in zip(batch["path"], batch["lot"], batch["parts"], batch["lacks"], strict=True):
                    n, error = (0, "parts are missing") if lacks else act(path, lot, parts)
                    out.append((path, "upload", n, None, error))
                yield pd.DataFrame(out, columns=LOG_COLUMNS)
        finally:
            for f in files.values():
                f.close()

    store, root = opened(location)
    spark = done.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    logs, fine = [spark.createDataFrame([], LOG)], lists.where("lacks").isEmpty()
    for lot in sorted(r["lot"] for r in lists.select("lot").distinct().collect()):
        logs.append(written(lists.where(F.col("lot") == lot).repartition(n, "path").mapInPandas(run, LOG)))
        fine = fine and logs[-1].where("error IS NOT NULL").isEmpty()
        if fine:
            _drop(store, f"{root}/{upload}/{lot}")
    if fine:
        abort(location, upload)
    return reduce(DataFrame.unionByName, logs)


def abort(location: str, upload: str) -> None:
    """Drops an upload's parts; one that is gone is aborted already."""
    store, root = opened(location)
    _drop(store, f"{root}/{upload}")


def _drop(store: fs.FileSystem, folder: str) -> None:
    try:
        store.delete_dir(folder)
    except FileNotFoundError:
        return
