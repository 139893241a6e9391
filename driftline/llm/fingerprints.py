"""Document fingerprints: threshold-scaled sketches of word shingles.

A fingerprint keeps every hash of a document's 3-word shingles that lies in the lowest SHARE of the
hash range. Which hashes are kept depends on the hash alone, so fingerprints merge by union and give
the containment of a short text in a very long one as well as the likeness of two texts. Where fewer
than FEW hashes fall in that range, the FEW smallest are kept (a union keeps that rule), so a short
text has a fingerprint too. Such a fingerprint covers the range up to its largest hash, or all of it
with fewer than FEW; two are compared over the range that both cover. Only DataFrame functions are used.

Defined results: null counts as empty; a text without words has the empty fingerprint, which is like
another empty one (1) and unlike all others (0); one or two words are one shingle. Equal texts have
equal fingerprints. In descending order of ids a null id is the last, and rows with one id follow by
a hash of their texts, then by text. A table of one row is followed by itself; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import let, table, words

SHINGLE = 3
SHARE = 1 / 8
FEW = 8
#: Sampled places of rows to a cut.
FOURTH = 4
_BOUND = -(1 << 63) + int(SHARE * (1 << 64))
_NONE = -(1 << 63)


def sketch(text: Column) -> Column:
    """Sorted array of the kept hashes (longs)."""
    nothing = F.array().cast("array<long>")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
        return F.when(n == 0, nothing).when(n < SHINGLE, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(runs)

    return let(let(words(text), hashes), _kept)


def _kept(h: Column) -> Column:
    fewest = lambda: F.slice(F.sort_array(F.array_distinct(h)), 1, FEW)
    return let(F.filter(h, lambda x: x < _BOUND), lambda x: let(F.sort_array(F.array_distinct(x)), lambda y: F.when(F.size(y) >= FEW, y).otherwise(fewest())))


def merged(one: Column, other: Column) -> Column:
    """The sketch of both texts together: the same rule over the union."""
    return let(F.array_union(one, other), _kept)


def _reach(s: Column) -> Column:
    """The largest hash up to which a sketch has all of its text's."""
    last = F.get(s, F.size(s) - 1)
    return F.when(F.size(s) < FEW, F.lit((1 << 63) - 1)).when(last < _BOUND, F.lit(_BOUND - 1)).otherwise(last)


def _shared(one: Column, other: Column, body) -> Column:
    """body of the parts of both sketches in the range that both cover."""
    pair = F.struct(one.alias("a"), other.alias("b"), F.least(_reach(one), _reach(other)).alias("top"))
    return let(pair, lambda p: body(F.filter(p["a"], lambda x: x <= p["top"]), F.filter(p["b"], lambda x: x <= p["top"])))


def likeness(one: Column, other: Column) -> Column:
    """Share of common hashes among all of two sketches, where both cover; 1 for two empty ones."""

    def body(a: Column, b: Column) -> Column:
        every = F.size(F.array_union(a, b))
        return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)

    return _shared(one, other, body)


def containment(part: Column, whole: Column) -> Column:
    """Share of the first sketch's hashes that the second has, where both cover; 1 where the first is
    empty, null where none of its hashes lies there: then the sketches do not tell."""

    def body(a: Column, b: Column) -> Column:
        return F.when(F.size(part) == 0, F.lit(1.0)).when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))

    return _shared(part, whole, body)


def printed(hashes: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("text",)) -> DataFrame:
    """Every row with next_<column> of the row that follows it in descending order of ids, rows of one id
    in descending order of a hash of their texts, then by text; the first follows the last.

    Rows are cut at about sqrt(rows) of their places (id, hash), which are places of rows: every FOURTH of a
    sample that a hash draws. A row whose place is a cut, the largest of its group, is also put behind the
    group above, so each group finds its last row's successor within, and one shuffle by group does it.
    An id of a third of all rows falls into many groups. Only the sample's places reach the driver.
    """
    key, mark = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    place = F.struct(key.alias("k"), mark.alias("h"))
    count = docs.count()
    if count == 0:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in carry))
    places = docs.select(place.alias("p"))
    step = max(1, count // (FOURTH * max(1, math.isqrt(count))))
    drawn = sorted((r["p"]["k"], r["p"]["h"]) for r in places.where(F.pmod(F.xxhash64("p.k", "p.h"), F.lit(step)) == 0).distinct().collect())
    top = places.agg(F.max("p").alias("top")).first()["top"]
    cuts = sorted({*drawn[FOURTH - 1 :: FOURTH], (top["k"], top["h"])})
    last = len(cuts) - 1
    # two literals, not one array of structs, which would be made anew for every row
    ids, marks = F.lit([k for k, _ in cuts]), F.lit([h for _, h in cuts])
    below = lambda i: (F.get(ids, i) < F.col("_place.k")) | ((F.get(ids, i) == F.col("_place.k")) & (F.get(marks, i) < F.col("_place.h")))
    # the number of cuts below the place, by halving
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
        below(middle(s)), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))
    ).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
    start = F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi"))
    rows = docs.withColumn("_place", place).withColumn("_group", F.aggregate(F.sequence(F.lit(0), F.lit(last.bit_length() + 1)), start, halve, lambda s: s["lo"]))
    own = F.struct(F.col("_group").alias("group"), F.lit(False).alias("guest"), F.lit(0).alias("turn"))
    above = F.when(F.col("_group") == last, 0).otherwise(F.col("_group") + 1)
    guest = F.struct(above.cast("int").alias("group"), F.lit(True).alias("guest"), F.when(F.col("_group") == last, 1).otherwise(0).alias("turn"))
    placed = rows.withColumn("_at", F.explode(F.when((F.get(ids, F.col("_group")) == F.col("_place.k")) & (F.get(marks, F.col("_group")) == F.col("_place.h")), F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.group").orderBy("_at.turn", F.col("_place").desc(), "_at.guest", text_col)
    placed = placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry}).where("NOT _at.guest")
    return placed.drop("_place", "_group", "_at")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = followed(docs.withColumn("own", sketch(F.col("text"))), carry=("text", "own"))
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(F.substring("text", 1, n - tail), F.substring("next_text", 1, tail)).alias("edited"))
    pairs = pairs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next_own", sketch(F.col("edited")).alias("new"))
    return pairs.select("doc_id", "n_chars", "edited_sha256", printed("own").alias("fingerprint"), printed("new").alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
