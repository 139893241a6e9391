"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure sets one bit of a long and the measurements
that it used are stored beside it. A policy is a version and a mask of the rules it applies, so a
new policy, or an ablation of an old one, is a bitwise operation over the ledger and never reads
the texts again. All of it runs in the JVM, on one pass over the texts, without a shuffle.

Defined results: a null text counts as empty; an empty or blank text has measurements of 0 and
fails only `too_few_words`. Rows are independent, so ties, repeated rows and repeated ids give
equal output rows. Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import let, table, words

SYMBOLS = "[#*$%&|<>]"

#: name -> condition under which a document fails, over the measurements. The bit of a rule is its
#: place in this list: append only.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("short_words_mean", "word_chars < 2 * n_words"),
    ("long_words_mean", "word_chars > 15 * n_words"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named version of the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[x] for x in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(x for x, _ in RULES))


def repeated_words(tokens: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more, the first one included.

    A sort of longs (44 bits of a window's hash, 20 of its position) finds the few windows that can
    be repeated; those are compared by the whole 64-bit hash. A text of 2^20 windows or more skips
    the first step. The work is n log n at any length.
    """
    count = F.size(tokens) - 2
    whole = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    no = F.lit(False)

    def settled(w: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(w) - 3)

        def equal_neighbours(s: Column) -> Column:
            head = lambda x: F.shiftright(x, 20)
            hit = F.filter(s, lambda x, j: F.coalesce(head(F.get(s, j + 1)) == head(x), no) | F.coalesce(head(F.get(s, j - 1)) == head(x), no))
            return F.transform(hit, lambda x: x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int"))

        packed = F.sort_array(F.transform(every, lambda i: F.shiftleft(whole(w, i), 20).bitwiseOR(i.cast("long"))))
        possible = F.when(F.size(w) - 2 < 1 << 20, let(packed, equal_neighbours)).otherwise(every)

        def flagged(s: Column) -> Column:
            hit = F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], no) | F.coalesce(F.get(s, j - 1)["h"] == x["h"], no))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def reach(p: Column) -> Column:
            own = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda total, x: total + x)

        pairs = lambda c: F.sort_array(F.transform(c, lambda i: F.struct(whole(w, i).alias("h"), i.alias("i"))))
        return let(possible, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(let(let(pairs(c), flagged), reach)))

    return F.when(count < 2, F.lit(0).cast("long")).otherwise(settled(tokens))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every document: one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def numbers(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return docs.select(
        F.col(id_col).alias("doc_id"),
        let(words(F.col(text_col)), numbers).alias("_w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
    ).select("doc_id", "_w.*", "n_symbols", "_l.*")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and fail_bits (long) of every document."""
    bits = sum((F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)), F.lit(0).cast("long"))
    return measures(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with base_failed and the policy's verdict, kept."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")) != 0
    return book.withColumns({"base_failed": failed(BASE), "kept": ~failed(policy), "policy": F.lit(policy.version)})


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only this rule rejects.

    The ledger is first reduced to a count per bit pattern (at most 2^rules rows).
    """
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).count()
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(1 << BIT[x]).cast("long").alias("bit")) for x in policy.rules))).alias("r")
    return patterns.select("bits", "count", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents")), STANDARD).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS c FROM tri),
hit AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep WHERE c > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN hit USING (rid)),
f AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'standard-1' AS policy FROM f
"""
