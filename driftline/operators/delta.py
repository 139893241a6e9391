"""Deltas: which parts of a new blob its old signature already holds, at any byte offset."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import MIN_BLOCK
from driftline.operators.signature import rolling, rolling_all, rolling_parts
from driftline.schema import OPS


def greedy(data: bytes, block: int, index: dict[int, dict[str, int]], part: int = 1 << 20) -> list[tuple[str, int, int | None, int]]:
    """(op, target offset, source offset, length): left to right, a window that equals a whole block
    is copied and skipped, bytes between are inserted. index: rolling -> strong -> lowest block.

    Checksums are made for `part` windows at a time; with large blocks, none are where one block follows another.
    """
    known, view = np.fromiter(index, np.uint32, len(index)), memoryview(data)
    out, at, done, begin, sums, places = [], 0, 0, 0, np.empty(0, np.uint32), np.empty(0, np.int64)

    def match(checksum: int, place: int) -> int | None:
        strongs = index.get(checksum)
        return strongs.get(hashlib.sha256(view[place : place + block]).hexdigest()) if strongs else None

    while at + block <= len(data):
        place, hit = at, None
        if not begin <= at < begin + len(sums):
            hit = match(rolling(view[at : at + block]), at) if block >= MIN_BLOCK else None
            if hit is None:
                begin, sums = at, rolling_all(view[at : at + part + block - 1], block)
                places = np.flatnonzero(np.isin(sums, known)) + begin
        if hit is None:
            for i in range(int(np.searchsorted(places, at)), len(places)):
                place = int(places[i])
                if (hit := match(int(sums[place - begin]), place)) is not None:
                    break
            else:
                at = begin + len(sums)
                continue
        if place > done:
            out.append(("insert", done, None, place - done))
        out.append(("copy", place, hit * block, block))
        at = done = place + block
    if done < len(data) or not data:
        out.append(("insert", done, None, len(data) - done))
    return out


def delta(new: DataFrame, signature: DataFrame, block: int) -> DataFrame:
    """The ops that rebuild every new blob (path, content) from the old ones' blocks.

    Only whole blocks can match. A path's block table travels with its blob, so a task holds one blob
    and its table at a time; what a signature lacks is one insert.
    """
    whole = signature.where(F.col("size") == block).groupBy("path").agg(F.collect_list(F.struct("block_index", "rolling", "strong")).alias("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data, table in zip(batch["path"], batch["content"], batch["blocks"], strict=True):
                index: dict[int, dict[str, int]] = {}
                for row in sorted(table if table is not None else [], key=lambda r: r["block_index"]):
                    index.setdefault(row["rolling"], {}).setdefault(row["strong"], row["block_index"])
                out += [(path, i, *op) for i, op in enumerate(greedy(bytes(data), block, index))]
            yield pd.DataFrame(out, columns=["path", "seq", "op", "target_offset", "source_offset", "length"]).astype({"source_offset": "Int64"})

    return new.select("path", "content").join(whole, "path", "left").mapInPandas(run, OPS)


def simple_delta(new: DataFrame, signature: DataFrame, block: int) -> DataFrame:
    """The same ops but for an empty blob, which has none."""
    return delta(new, signature, block).where("length > 0")


def matches(new: DataFrame, signature: DataFrame, block: int) -> DataFrame:
    """The relational form of the match: path, place, block_index (lowest) of every window of a new
    blob that equals a whole block. One row a byte before the join: for small inputs and cross-checks."""
    spans = new.where(F.octet_length("content") >= block).select("path", "content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - block)).alias("place"))
    windows = spans.select("path", "place", F.sha2(F.substring("content", F.col("place") + 1, F.lit(block)), 256).alias("strong"))
    table = signature.where(F.col("size") == block).groupBy("path", "strong").agg(F.min("block_index").alias("block_index"))
    return windows.join(table, ["path", "strong"]).select("path", F.col("place").cast("long").alias("place"), "block_index")


def relational(new: DataFrame, signature: DataFrame, block: int) -> DataFrame:
    """path, place, block_index of the copies that the greedy rule takes, by a fold over matches."""
    found = matches(new, signature, block).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "block_index"))).alias("m"))
    kind = "struct<next:bigint,out:array<struct<place:bigint,block_index:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<place:bigint,block_index:bigint>>").alias("out")).cast(kind)
    take = lambda s, x: F.when(x["place"] >= s["next"], F.struct((x["place"] + block).alias("next"), F.array_append(s["out"], x).alias("out")).cast(kind)).otherwise(s)
    return found.select("path", F.inline(F.aggregate("m", start, take, lambda s: s["out"])))


def totals(ops: DataFrame) -> DataFrame:
    """Per path: bytes reused and new, ops, size, savings in percent, and whether a delta pays."""
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("op") == k, F.col("length"))), F.lit(0)).cast("long")
    rows = ops.groupBy("path").agg(kind("copy").alias("bytes_reused"), kind("insert").alias("bytes_new"), F.count(F.lit(1)).alias("n_ops"), F.sum("length").cast("long").alias("target_size"))
    percent = F.when(F.col("target_size") == 0, F.lit(0.0)).otherwise(F.col("bytes_reused") / F.col("target_size") * 100)
    return rows.withColumns({"savings_percent": percent, "beneficial": F.col("bytes_new") < F.col("target_size")})


def download_ranges(local: DataFrame, remote_signature: DataFrame, block: int) -> DataFrame:
    """Per remote block: whether the local blob holds it anywhere (place) or it has to be requested.

    Blocks of the remote side meet the windows of the local one. Short last blocks match only as the
    local blob's end.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data, table in zip(batch["path"], batch["content"], batch["blocks"], strict=True):
                data = bytes(data) if data is not None else b""
                places: dict[str, int] = {}
                wanted = np.array(sorted({r["rolling"] for r in table if r["size"] == block}), np.uint32)
                for begin, sums in rolling_parts(data, block):
                    for place in (np.flatnonzero(np.isin(sums, wanted)) + begin).tolist():
                        places.setdefault(hashlib.sha256(data[place : place + block]).hexdigest(), place)
                for r in sorted(table, key=lambda r: r["block_index"]):
                    place = places.get(r["strong"]) if r["size"] == block else None
                    if place is None and len(data) >= r["size"] and hashlib.sha256(data[len(data) - r["size"] :]).hexdigest() == r["strong"]:
                        place = len(data) - r["size"]
                    out.append((path, r["block_index"], r["offset"], r["size"], place))
            yield pd.DataFrame(out, columns=["path", "block_index", "offset", "size", "local_offset"]).astype({"local_offset": "Int64"})

    table = remote_signature.groupBy("path").agg(F.collect_list(F.struct("block_index", "offset", "size", "rolling", "strong")).alias("blocks"))
    return table.join(local.select("path", "content"), "path", "left").select("path", "content", "blocks").mapInPandas(run, "path string, block_index long, offset long, size int, local_offset long")


def download_totals(ranges: DataFrame) -> DataFrame:
    """Per path: bytes reused and downloaded, and requests (adjoining missing blocks are one)."""
    asked = F.col("local_offset").isNull()
    w = Window.partitionBy("path").orderBy("block_index")
    opens = asked & ~F.coalesce(F.lag(asked).over(w), F.lit(False))
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    return ranges.withColumn("opens", opens).groupBy("path").agg(size(F.col("local_offset").isNotNull()).alias("bytes_reused"), size(F.col("local_offset").isNull()).alias("bytes_downloaded"), F.count_if("opens").alias("range_requests"))
