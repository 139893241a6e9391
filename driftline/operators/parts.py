"""Delta ops merged, packed into parts of a least size, split at a largest size, and applied."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import FULL_PART, MIN_PART
from driftline.schema import PARTS


def merged(ops: DataFrame) -> DataFrame:
    """Adjoining copies whose sources adjoin become one, and so do adjoining inserts."""
    w = Window.partitionBy("path").orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    joins = (before("op") == F.col("op")) & ((F.col("op") == "insert") | (before("source_offset") + before("length") == F.col("source_offset")))
    marked = ops.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(w))
    out = marked.groupBy("path", "run").agg(F.first("op").alias("op"), F.min("target_offset").alias("target_offset"), F.min("source_offset").alias("source_offset"), F.sum("length").cast("long").alias("length"))
    return out.select("path", (F.col("run") - 1).cast("int").alias("seq"), "op", "target_offset", "source_offset", "length")


def packed(ops: DataFrame, least: int = MIN_PART) -> DataFrame:
    """Parts of each path's ops: copies of `least` bytes or more stay copies; the rest is uploaded in
    parts of that size at least, the last one apart. A copy's head fills up the bytes that wait.

    A path's ops pass one task in order, which holds the bytes that wait and no list; paths are the unit
    of parallel work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, held, number, at = None, 0, 0, 0
        for batch in batches:
            out = []

            def part(kind: str, source: int | None, n: int) -> None:
                nonlocal number, at
                number += 1
                out.append((path, number, kind, source, at, n))  # noqa: B023
                at += n

            for this, op, source, n in zip(batch["path"], batch["op"], batch["source_offset"], batch["length"], strict=True):
                if this != path:
                    if held:
                        part("upload", None, held)
                    path, held, number, at = this, 0, 0, 0
                if op == "insert":
                    held += n
                    if held >= least:
                        part("upload", None, held)
                        held = 0
                    continue
                need = least - held if held else 0
                if held and n < need:
                    held += n
                    continue
                if held:
                    part("upload", None, least)
                held, rest = 0, n - need
                if rest >= least:
                    part("copy", int(source) + need, rest)
                else:
                    held = rest
            yield _parts(out)
        if held:
            yield _parts([(path, number + 1, "upload", None, at, held)])

    rows = ops.select("path", "seq", "op", "source_offset", "length").repartition("path").sortWithinPartitions("path", "seq")
    return rows.mapInPandas(run, PARTS)


def _parts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "part_number", "kind", "source_offset", "target_offset", "length"]).astype({"source_offset": "Int64"})


def meets_least(length: Column, least: int = MIN_PART) -> Column:
    """Whether an op is large enough for a part of its own."""
    return length >= least


def split(ops: DataFrame, most: int) -> DataFrame:
    """Every op cut at `most` bytes, numbered through each path from 1."""
    rows = ops.where("length > 0").select("path", "seq", "op", "target_offset", "source_offset", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / most))).alias("i"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("seq", "i"))
    return rows.select("path", number.alias("part_number"), F.col("op").alias("kind"), (F.col("source_offset") + F.col("i") * most).alias("source_offset"), (F.col("target_offset") + F.col("i") * most).alias("target_offset"), F.least(F.lit(most), F.col("length") - F.col("i") * most).cast("long").alias("length"))


def whole_parts(files: DataFrame, size: int = FULL_PART) -> DataFrame:
    """Parts of a full upload of each file (path, size)."""
    one = files.select("path", F.lit(0).alias("seq"), F.lit("upload").alias("op"), F.lit(0).cast("long").alias("target_offset"), F.lit(None).cast("long").alias("source_offset"), F.col("size").alias("length"))
    return split(one, size)


def part_totals(parts: DataFrame) -> DataFrame:
    size = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("length"))), F.lit(0)).cast("long")
    return parts.groupBy("path").agg(size("upload").alias("bytes_transferred"), size("copy").alias("bytes_reused"), F.count_if(F.col("kind") == "upload").alias("parts_uploaded"), F.count_if(F.col("kind") == "copy").alias("parts_copied"))


def applied(parts: DataFrame, old: DataFrame, new: DataFrame, kind: str = "kind") -> DataFrame:
    """path, content rebuilt from ops or parts: copies from the old blob, other bytes from the new."""
    order = parts.groupBy("path").agg(F.collect_list(F.struct("target_offset", F.col(kind).alias("kind"), "source_offset", "length")).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, a, b, p in zip(batch["path"], batch["old"], batch["new"], batch["p"], strict=True):
                bits = []
                for r in sorted(p if p is not None else [], key=lambda r: (r["target_offset"], r["length"])):
                    data, at = (a, r["source_offset"]) if r["kind"] == "copy" else (b, r["target_offset"])
                    bits.append(bytes(data[int(at) : int(at) + int(r["length"])]))
                out.append((path, b"".join(bits)))
            yield pd.DataFrame(out, columns=["path", "content"])

    both = new.select("path", F.col("content").alias("new")).join(old.select("path", F.col("content").alias("old")), "path", "left").join(order, "path", "left")
    return both.select("path", "old", "new", "p").mapInPandas(run, "path string, content binary")


def verified(rebuilt: DataFrame, new: DataFrame) -> DataFrame:
    """path, ok: whether what was rebuilt is the new blob."""
    a, b = rebuilt.select("path", F.sha2("content", 256).alias("a")), new.select("path", F.sha2("content", 256).alias("b"))
    return b.join(a, "path", "left").select("path", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))
