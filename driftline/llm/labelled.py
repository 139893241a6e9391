"""What the two classifiers share: folds by checksum, and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import written


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, most: int) -> DataFrame:
    """About `rows` labelled documents (doc_id, text, y) of about `most` bytes together at most, one row
    an id (of several texts the least, of several labels the largest); written.

    Labels are drawn by a hash of the id against a threshold alone, so the draw is the same on every run,
    no text is left out for its length, and no task gathers the candidates. The drawn ids, whose number
    the threshold bounds, are broadcast; the documents are not shuffled.
    """
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    total, place = known.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    cut = min(1_000_000, int(1_000_000 * rows / max(total, 1)))
    text = F.coalesce("text", F.lit(""))
    drawn = docs.select("doc_id", text.alias("text")).join(F.broadcast(known.where(place < cut)), "doc_id")
    drawn = written(drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")))
    size = drawn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return drawn if size <= most else drawn.where(place < int(cut * most / size))
