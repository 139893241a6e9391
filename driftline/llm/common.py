"""Pieces that the corpus operators share: words, inputs and written intermediates."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.scratch import release, scratch_dir, written

__all__ = ["WHITE", "let", "release", "scratch_dir", "shrink", "slices", "table", "tidy", "unused", "words", "written"]

#: A word is a maximal run of characters other than these.
WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE, -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: a lambda variable of a one-element array.

    A plain reference inside another lambda may be inlined by the optimizer and then be evaluated
    again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of docs is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run):
    """run (a function of iterators for mapInPandas or mapInArrow) that hands freed memory back to the
    system at its end: a worker is kept for later tasks, beside which it should be small."""

    @wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            shrink()

    return out


def shrink() -> None:
    """Hands this process's freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """The batches in parts of about so many characters of their column text, so that what is made of
    a part stays small; at least a row each."""
    for batch in batches:
        part = batch["text"].str.len().cumsum() // chars
        yield from (rows for _, rows in batch.groupby(part.to_numpy(), sort=False))
