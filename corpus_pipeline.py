"""From documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents. In every stage null texts count as empty, rows of equal ids or
texts are rows of their own unless said otherwise, very long texts are read whole, an empty table gives
an empty result, and further columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import mixing, near_duplicates, sentencepieces, substrings, toxicity
from driftline.llm.common import table, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    The machine is learnt from the labels outside the held-out fold, and the decision is the score's
    alone, row by row: repeated rows go or stay together. Null and empty texts score the bias, and stay
    unless the labels make most texts toxic; without labels all do alike.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out())
    return docs.mapInArrow(toxicity.below(spark, machine), docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest id, of equal ids one of them; a
    null id is the largest. Texts without words stay, as they are nobody's duplicates."""
    row = unused(docs, "_row")
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates.near_duplicates(kept, row_col=row)
    return kept.join(groups.where("stands").select(F.col("row").alias(row)), row, "left_semi").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller id has; a document of which nothing is
    left goes, one that loses nothing keeps its text to the character, null and empty ones included.
    Rows of one id lose nothing by each other."""
    cut = unused(docs, "_cut")
    rows = substrings.removals(docs, out_col=cut)
    n = F.col(f"{cut}.n_removed")
    left = rows.where((n == 0) | (n < F.col(f"{cut}.n_words"))).withColumn("text", F.when(n > 0, F.col(f"{cut}.kept_text")).otherwise(F.col("text")))
    return left.withColumn("n_chars", F.when(n > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights, a row per document and pass that takes words of it; a document
    without words has none. A null source is one of its own."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with an end id, and digests of the ids, their decoding and their spans in the text."""
    return sentencepieces.encode(docs, sentencepieces.model_file(), ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeats),
    ("mixing", mix_sources),
    ("sentencepieces", encode),
]

#: Classifiers, keyed permutations and the tokenizer are beyond SQL; tests/llm hold each stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
