"""Mixing sources to target weights.

The words of each source are laid end to end and cut into blocks of a fixed length. A source's
target (its share by weight, at most twice its size, the excess shared anew) becomes a number of
slots: whole passes over all its blocks, then as many further slots as the rest needs, the last one
cut to the word. Every slot falls on an output shard by a pseudorandom draw, so the counts of a
source over the shards are multinomial given its total (`counts`), and the totals stay on target; `blocks`
is the mix itself, shard by shard. Slot j of a
pass reads block perm(j), where perm is a swap-or-not shuffle keyed by source and pass: a bijection
of the block indexes that each row computes alone. Slots and blocks meet in a join by index.

Offsets are prefix sums in two levels (within hashed buckets of about sqrt(rows) rows, then over the
buckets of a source), so no task holds a source; slots are made in runs of RUN. Rows are laid out by a
hash of id and text. Rows that repeat both more often than a bucket has rows, and rows without words,
are dealt by row number instead, so no repeated row fills a bucket. Only DataFrame functions are used.

Defined results: a null or blank text has size 0 and takes 0; a null source is a source of its own,
the last in order; a source of size 0 has target 0. Repeated rows and ids are separate rows, each
laid out and taken on its own. The same rows give the same mix in whatever order and files they stand;
only rows dealt by number, and those that differ in other columns alone, go by their place in the files.
An empty table gives an empty result. Columns other than the id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import let, table, unused, words, written

BLOCK = 256
RUN = 1024
SHARD_SLOTS = 4096
ROUNDS = 24
WEIGHTS = (3, 1, 2)


@dataclass(frozen=True)
class Mix:
    """rows: _row, doc_id, size, source_size, target, _source, _start; slots: _source, shard, pass,
    block, n_words; parts: _row, doc_id, pass, shard, block, begin, end (words of the document)."""

    rows: DataFrame
    slots: DataFrame
    parts: DataFrame


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target of every source: min(most * size, level * weight), the level such that all targets
    add up to share * all sizes. One row a source; capped sources come first in order of
    most * size / weight, so the level is the first that the next source's cap does not undercut."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    every, order = Window.partitionBy(), Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped = ranked.withColumns({"cap": most * F.col("source_size"), "ratio": most * F.col("source_size") / F.col("weight")})
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = capped.withColumns({"own": level, "place": F.row_number().over(order)})
    first = F.min(F.when(F.col("own") <= F.col("ratio"), F.struct("place", "own"))).over(every)
    levels = levels.withColumn("level", first["own"])
    return levels.select("source", "_source", "source_size", F.least("cap", F.coalesce("level", F.col("ratio")) * F.col("weight")).alias("target"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Image of x under a keyed permutation of 0..n-1 (swap-or-not, ROUNDS rounds)."""

    def one(x: Column, i: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, i, F.lit("turn")), n) - x, n)
        swap = F.xxhash64(*key, i, F.greatest(x, mirror)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, one)


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: str = "mix-1", shard_slots: int = SHARD_SLOTS) -> Mix:
    """The mix of rows (as measured() gives them, _row unique and stable). weights go round the sources
    in order of code points, null last; a shard has about shard_slots slots."""
    sized = sized.withColumns({"_source": F.coalesce(F.concat(F.lit("s:"), "source"), F.lit("n")), "size": F.col("size").cast("long")})
    count = sized.count()
    per_bucket = max(512, int(count**0.5))
    # at most count / per_bucket keys, so sqrt(count): a bounded broadcast
    often = sized.where("size > 0").groupBy("_key").agg(F.count(F.lit(1)).alias("_often")).where(F.col("_often") > per_bucket)
    dealt = F.when((F.col("size") == 0) | F.col("_often").isNotNull(), F.col("_row")).otherwise(F.col("_key"))
    sized = sized.join(F.broadcast(often), "_key", "left").withColumn("_bucket", F.pmod(F.xxhash64(dealt), F.lit(max(1, count // per_bucket)))).repartition("_bucket")
    totals = sized.groupBy("_bucket", "_source", "source").agg(F.sum("size").alias("_sum"))
    sources = _targets(totals.groupBy("_source", "source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_bucket", "_source", F.coalesce(F.sum("_sum").over(ahead(Window.partitionBy("_source").orderBy("_bucket"))), F.lit(0)).alias("_base"))
    bases = bases.join(sources.drop("source"), "_source")
    within = F.coalesce(F.sum("size").over(ahead(Window.partitionBy("_bucket", "_source").orderBy("_key", "_row"))), F.lit(0))
    rows = sized.withColumn("_within", within).join(bases, ["_bucket", "_source"])
    rows = rows.select("_row", "doc_id", "size", "source_size", "target", "_source", (F.col("_base") + F.col("_within")).alias("_start"))

    size, b, key = F.col("source_size"), F.lit(block), (F.col("_source"), F.col("pass"), F.lit(seed))
    spread = sources.where("source_size > 0").select("_source", "source_size", F.round("target").cast("long").alias("_take"))
    spread = spread.withColumns({"_passes": F.expr("_take div source_size"), "_rest": F.expr("_take % source_size"), "_blocks": F.expr(f"(source_size + {block - 1}) div {block}")})
    spread = spread.withColumn("_slots", F.expr(f"_passes * _blocks + (_rest + {block - 1}) div {block}"))
    spread = spread.withColumn("_shards", F.ceil(F.sum("_slots").over(Window.partitionBy()) / shard_slots)).where("_slots > 0")
    # by a number, else few small runs would be put into one task, which then makes all slots
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = spread.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_slots - 1) div {RUN})"))).repartition(parts, "_source", "_run")
    slot = runs.withColumn("_slot", F.explode(F.expr(f"sequence(_run * {RUN}, least(_slots, (_run + 1) * {RUN}) - 1)")))
    slot = slot.withColumns({"pass": F.expr("_slot div _blocks"), "_place": F.expr("_slot % _blocks")})
    full = F.expr(f"source_size div {block}")
    slot = slot.withColumn("block", F.when(F.col("_place") < full, permuted(F.col("_place"), full, *key)).otherwise(F.col("_place")))
    slot = slot.withColumn("n_words", F.when(F.col("pass") < F.col("_passes"), F.least(b, size - F.col("block") * block)).otherwise(F.least(b, F.col("_rest") - F.col("_place") * block)))
    slots = slot.select("_source", F.pmod(F.xxhash64("_source", "_slot", F.lit(seed)), F.col("_shards")).alias("shard"), F.col("pass").cast("int").alias("pass"), "block", "n_words")

    pieces = rows.where("size > 0").select("_row", "doc_id", "_source", "_start", "size", F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})")).alias("block"))
    # both sides grow with the input, which the optimizer can't see through explode: never broadcast
    met = pieces.join(slots.hint("merge"), ["_source", "block"])
    begin = F.greatest(F.col("block") * block - F.col("_start"), F.lit(0))
    end = F.least(F.col("block") * block + F.col("n_words") - F.col("_start"), F.col("size"))
    parts = met.select("_row", "doc_id", "pass", "shard", "block", begin.alias("begin"), end.alias("end")).where("begin < end")
    return Mix(rows, slots, parts)


def measured(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_row, doc_id, source, _key (hash of id and text), size (words) of every row."""
    return docs.select(row.alias("_row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(id_col, text_col).alias("_key"), F.size(words(F.col(text_col))).alias("size"))


def sizes(docs: DataFrame, **columns) -> DataFrame:
    """measured(), written, so that _row stays."""
    return written(measured(docs, F.monotonically_increasing_id(), **columns))


def counts(mixed: Mix) -> DataFrame:
    """shard, _source, n_slots, n_words: what each output shard draws from each source."""
    return mixed.slots.groupBy("shard", "_source").agg(F.count(F.lit(1)).alias("n_slots"), F.sum("n_words").cast("long").alias("n_words"))


def pieces(text: Column) -> Column:
    """Array of the words of a text, each with the white space before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))


def _sliced(all_pieces: Column, begin: Column, end: Column) -> Column:
    return F.slice(all_pieces, begin.cast("int") + 1, (end - begin).cast("int"))


def blocks(docs: DataFrame, **settings) -> DataFrame:
    """The mix as blocks: shard, source, pass, block, n_words, text of every slot, a block's words as
    they stand in their documents, those of different documents with a line break between."""
    kept = written(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", "text"))
    mixed = mix(measured(kept, F.col("_row")), **settings)
    starts = mixed.rows.select("_row", "_start")
    cut = mixed.parts.join(kept.select("_row", "source", "text"), "_row").join(starts, "_row").select(
        "shard", "source", "pass", "block", "_start", (F.col("end") - F.col("begin")).alias("n"), F.regexp_replace(F.array_join(_sliced(pieces(F.col("text")), F.col("begin"), F.col("end")), ""), r"^[\x20\x09-\x0D]+", "").alias("text")
    )
    said = F.transform(F.sort_array(F.collect_list(F.struct("_start", "text"))), lambda x: x["text"])
    return cut.groupBy("shard", "source", "pass", "block").agg(F.sum("n").cast("long").alias("n_words"), F.array_join(said, "\n").alias("text"))


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: per document and pass that takes words of it one row, whose text is
    those words with the white space between them, the whole text unchanged where all are taken; all
    other columns stay, but n_chars follows the text."""
    row, spans_ = (unused(docs, x) for x in ("_row", "_spans"))
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()))
    sized = written(measured(kept, F.col(row)))
    mixed = mix(sized, **settings)
    spans = mixed.parts.groupBy("_row", "pass").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.sum(F.col("end") - F.col("begin")).alias("n"))
    spans = spans.join(sized.select("_row", "size"), "_row").select(F.col("_row").alias(row), F.struct("spans", (F.col("n") == F.col("size")).alias("whole")).alias(spans_))
    said = let(pieces(F.col("text")), lambda p: F.array_join(F.flatten(F.transform(F.col(spans_)["spans"], lambda s: _sliced(p, s["begin"], s["end"]))), ""))
    text = F.when(F.col(spans_)["whole"], F.col("text")).otherwise(F.regexp_replace(said, r"^[\x20\x09-\x0D]+", ""))
    out = kept.join(spans, row).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(sizes(table(spark, sf_dir, "documents")))
    taken = mixed.parts.groupBy("_row").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"), F.size(F.collect_set("shard")).alias("n_shards"))
    out = mixed.rows.join(taken, "_row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"))
