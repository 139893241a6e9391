"""Substring deduplication on the De Bruijn graph of word k-mers.

Every run of K words is an edge from its first to its last K-1 words, the nodes. An edge's source is its
first occurrence: the smallest document that has it, and the place there; an edge met again in a later
document is a repeated one. `hits` is the table of repeated edges with their sources.

Repeated edges at consecutive places of a document and of one source are a run. Where a run ends and
another begins at the next place, a join of runs gives the link between the two edges; a node is
branching where its links lead to several edges or come from several ones, or where the source's own
next or previous edge is repeated too. Runs are compacted over the links
of nonbranching nodes into paths, maximal repeated ones of a document.

Edges meet as 64-bit hashes, but words decide: the distinct ranges of source words that runs name are
digested (128 bits) where they stand, the digests joined back to the runs, and a word goes if it is
covered by a run whose own words have the same digest. Other places of a document with the words of a
removed window go with it.

In each slice of an Arrow batch equal edges meet first: later ones have found a source there, and one
row per distinct edge goes on, so an edge that a third of all documents share reaches the shuffle at
most once a slice. A slice's edges for one bucket of the hash space are one compressed row of about 8
bytes an edge. The number of buckets grows with the text; beyond FAN of them, slices are dealt to FAN
ranges of buckets first, and only merged slices to buckets. Ranges of a source that very many runs name
are digested in groups of RANGES.

Defined results: a null, empty or short text (fewer than K words) loses nothing. A null id is larger
than all others. Rows with one id are one document's age and lose nothing by each other; equal rows lose
alike. Empty tables give empty results; columns other than the id and the text are not read and kept
as they are. A very long text is one row of words in a task, and its runs are put in order in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import release, shrink, slices, table, tidy, unused, written

K = 13
#: Text whose edges one bucket holds: some 1.5 million, 40 MB in a task.
BUCKET_BYTES = 10 << 20
#: Buckets, or ranges of buckets, to which a slice is dealt at most; edges that are merged before they are
#: dealt on; and ranges of one source that are digested together.
FAN, MERGED, RANGES = 512, 2_000_000, 10_000
NO_ID = (1 << 63) - 1
SLICE = 4 << 20
_WORDS = 200_000
_PRESS = zstandard.ZstdCompressor(level=1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two adjoining runs from theirs."""
    out = left * np.uint64(0x9E3779B97F4A7C15)
    out += right
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def windows(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of every k consecutive words, put together from runs of 1, 2, 4, ... words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, run, size = None, 0, hashes, 1
    while True:
        if k & size:
            part = run[at : at + n]
            out = _joined(out, part) if out is not None else part * np.uint64(0x94D049BB133111EB)
            at += size
        if 2 * size > k:
            break
        run, size = _joined(run[:-size], run[size:]), 2 * size
    return out ^ (out >> np.uint64(29))


def _cut(edges: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of hashes."""
    return edges >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _edges(part: pd.DataFrame, words: WordHashes, k: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """(edge, document, row, place) by edge, document, row and place, once per edge and row."""
    edges, docs, rows, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for doc, row, text in sorted(zip(part["doc"], part["row"], part["text"], strict=True)):
        h = _cut(windows(words.of(text.encode().split()), k), bits)
        edges.append(h)
        docs.append(np.full(len(h), doc, np.int64))
        rows.append(np.full(len(h), row, np.int64))
        places.append(np.arange(len(h), dtype=np.int32))
    edge = np.concatenate(edges)
    order = np.argsort(edge, kind="stable")
    edge, doc, row, place = edge[order], np.concatenate(docs)[order], np.concatenate(rows)[order], np.concatenate(places)[order]
    first = np.ones(len(edge), bool)
    first[1:] = (edge[1:] != edge[:-1]) | (row[1:] != row[:-1])
    return edge[first], doc[first], row[first], place[first]


def _planes(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: high bytes cost next to nothing."""
    return _PRESS.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _values(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(edge: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> bytes:
    """Sorted edges with their documents, rows and places, about 8 bytes each."""
    known, which = np.unique(row, return_inverse=True)
    ids = np.empty(len(known), np.int64)
    ids[which] = doc
    parts = [_planes(np.diff(edge, prepend=np.uint64(0))), _planes(which.astype(np.uint32)), _planes(place.astype(np.uint32)), _planes(np.concatenate([ids, known]))]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    which, known = _values(parts[1], np.uint32), _values(parts[3], np.int64).reshape(2, -1)
    return np.cumsum(_values(parts[0], np.uint64), dtype=np.uint64), known[0][which], known[1][which], _values(parts[2], np.uint32).astype(np.int32)


def _ordered(*parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Edges of several parts by edge, document, row and place."""
    edge, doc, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, row, doc, edge))
    return edge[order], doc[order], row[order], place[order]


def _later(edge: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted edges: whether a row's document is its edge's smallest, and the place in the arrays of
    its edge's first row."""
    opens = np.ones(len(edge), bool)
    opens[1:] = edge[1:] != edge[:-1]
    head = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(edge) else np.empty(0, np.int64)
    return doc == doc[head], head


def _dealt(edges: tuple[np.ndarray, ...], begin: int, end: int, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed edges) of sorted edges in the buckets begin..end-1 of the evenly cut hash space."""
    cuts = np.searchsorted(edges[0], np.array([(b << 64) // buckets for b in range(begin + 1, end)], np.uint64))
    bounds = [0, *cuts.tolist(), len(edges[0])]
    return [(b, _packed(*(e[x:y] for e in edges))) for b, x, y in zip(range(begin, end), bounds[:-1], bounds[1:], strict=True) if y > x]


_PACKS = ["bucket", "asked", "settled"]


def _redealt(batches: Iterator[pd.DataFrame], first: int, many: int) -> Iterator[pd.DataFrame]:
    """Rows of `first` ranges, those of a range one after another, merged to some MERGED edges and dealt to
    the range's `many` buckets."""
    held, size, at = [], 0, None
    for batch in batches:
        for number, asked, settled in zip(batch["bucket"], batch["asked"], batch["settled"], strict=True):
            if held and (number != at or size >= MERGED):
                yield pd.DataFrame([(b, x, None) for b, x in _dealt(_ordered(*held), at * many, (at + 1) * many, first * many)], columns=_PACKS)
                held, size = [], 0
            at = number
            if asked is not None:
                held.append(_unpacked(bytes(asked)))
                size += len(held[-1][0])
            if settled is not None:
                yield pd.DataFrame([(at * many + len(settled) % many, None, settled)], columns=_PACKS)
    if held:
        yield pd.DataFrame([(b, x, None) for b, x in _dealt(_ordered(*held), at * many, (at + 1) * many, first * many)], columns=_PACKS)


HITS = "row long, at int, source_row long, source_at int"
_HIT = ["row", "at", "source_row", "source_at"]


def hits(base: DataFrame, k: int = K, bits: int = 64) -> DataFrame:
    """row, at, source_row, source_at of every repeated edge of a row (row, doc, text), once per edge and
    row; written. A slice settles what it can, a bucket's rows meet in one group. Edges are told apart by so
    many bits of their hashes."""
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, size // BUCKET_BYTES + 1)
    first = min(buckets, FAN)
    buckets = -(-buckets // first) * first

    @tidy
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for part in slices(batches, SLICE):
            edge, doc, row, place = _edges(part, words, k, bits)
            asks, head = _later(edge, doc)
            found = np.stack([row, place, row[head], place[head]], 1)[~asks].astype(np.int64)
            rows = [(b, x, None) for b, x in _dealt((edge[asks], doc[asks], row[asks], place[asks]), 0, first, first)]
            for n, x in enumerate(range(0, len(found), 100_000)):
                rows.append(((int(edge[0] >> np.uint64(8)) + n) % first, None, _planes(found[x : x + 100_000].ravel())))
            if rows:
                yield pd.DataFrame(rows, columns=_PACKS)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        out = [_values(bytes(x), np.int64).reshape(-1, 4) for x in rows["settled"] if x is not None]
        asked = [_unpacked(bytes(x)) for x in rows["asked"] if x is not None]
        if len(asked) > 1:
            edge = np.concatenate([x[0] for x in asked])
            order = np.argsort(edge, kind="stable")
            edge = edge[order]
            shared = np.zeros(len(edge), bool)
            shared[1:] = edge[1:] == edge[:-1]
            shared[:-1] |= shared[1:]
            order, edge = order[shared], edge[shared]
            edge, doc, row, place = _ordered((edge, *(np.concatenate([x[i] for x in asked])[order] for i in (1, 2, 3))))
            own, head = _later(edge, doc)
            out.append(np.stack([row, place, row[head], place[head]], 1)[~own].astype(np.int64))
        del asked
        made = pd.DataFrame(np.concatenate(out) if out else np.empty((0, 4), np.int64), columns=_HIT).astype({"at": np.int32, "source_at": np.int32})
        shrink()
        return made

    kind = "bucket long, asked binary, settled binary"
    rows = base.select("row", "doc", "text").mapInPandas(pack, kind)
    if buckets > first:
        many = buckets // first

        @tidy
        def redeal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return _redealt(batches, first, many)

        rows = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInPandas(redeal, kind)
    return written(rows.groupBy("bucket").applyInPandas(meet, HITS))


def runs(found: DataFrame) -> DataFrame:
    """Hits compacted: row, first, last (places of edges), source_row, source_first of every maximal run at
    consecutive places of the row and of one source; written."""
    in_row = Window.partitionBy("row").orderBy("at")
    before = lambda c: F.lag(c).over(in_row)
    follows = (before("at") + 1 == F.col("at")) & (before("source_row") == F.col("source_row")) & (before("source_at") + 1 == F.col("source_at"))
    chains = found.withColumn("opens", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("opens").over(in_row))
    return written(chains.groupBy("row", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("source_row").alias("source_row"), F.min("source_at").alias("source_first")).drop("run"))


def paths(made: DataFrame) -> DataFrame:
    """The runs with `path`, the first place of the maximal nonbranching path of the row that each is a part of."""
    source_last = F.col("source_first") + F.col("last") - F.col("first")
    a = made.select("row", (F.col("last") + 1).alias("first"), F.col("source_row").alias("from_row"), source_last.alias("from_at"))
    b = made.select("row", "first", F.col("source_row").alias("to_row"), F.col("source_first").alias("to_at"))
    links = written(a.join(b, ["row", "first"]))
    leave, enter = ["from_row", "from_at"], ["to_row", "to_at"]
    # nodes, by the edge that enters or leaves them, with one link each way
    one = lambda by, to: links.groupBy(*by).agg(F.min(F.struct(*to)).alias("low"), F.max(F.struct(*to)).alias("high")).where("low = high").select(*by)
    # and whose source's own next, or previous, edge is not repeated: no run reaches it
    reach = made.groupBy(F.col("source_row").alias("r"), F.col("source_first").alias("at")).agg(F.max(source_last).alias("reach"))
    asked = links.select(F.col("from_row").alias("r"), (F.col("from_at") + 1).alias("at")).unionByName(links.select(F.col("to_row").alias("r"), (F.col("to_at") - 1).alias("at"))).distinct()
    marks = reach.unionByName(asked.withColumn("reach", F.lit(None).cast("int")))
    so_far = F.max("reach").over(Window.partitionBy("r").orderBy("at", F.col("reach").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    straight = marks.withColumn("far", so_far).where("reach IS NULL AND far >= at").select("r", "at")
    after, ahead = (straight.select(F.col("r").alias(r), (F.col("at") + step).alias(at)) for (r, at), step in ((leave, -1), (enter, 1)))
    simple = links.join(one(leave, enter), leave, "left_semi").join(one(enter, leave), enter, "left_semi").join(after, leave, "left_anti").join(ahead, enter, "left_anti")
    marked = made.join(simple.select("row", "first", F.lit(1).alias("goes_on")), ["row", "first"], "left")
    start = F.last(F.when(F.col("goes_on").isNull(), F.col("first")), ignorenulls=True)
    return marked.withColumn("path", start.over(Window.partitionBy("row").orderBy("first"))).drop("goes_on")


def _digest(words: list[bytes], begin: int, end: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[begin:end]))


def digests(ranges: DataFrame, base: DataFrame) -> DataFrame:
    """The distinct ranges (row, begin, n) of words with their digests; written."""
    wanted = ranges.select("row", "begin", "n").distinct()
    large = wanted.groupBy("row").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > RANGES)
    part = F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("begin", "n"), F.ceil(F.col("many") / RANGES)))
    asked = wanted.join(large, "row", "left").withColumn("part", part).groupBy("row", "part").agg(F.collect_list("begin").alias("begins"), F.collect_list("n").alias("sizes"))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(batches, SLICE):
            out = []
            for row, text, begins, sizes in zip(part["row"], part["text"], part["begins"], part["sizes"], strict=True):
                words = text.encode().split()
                out += [(row, b, n, _digest(words, b, b + n)) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["row", "begin", "n", "digest"])

    return written(base.select("row", "text").join(asked, "row").select("row", "text", "begins", "sizes").mapInPandas(run, "row long, begin int, n int, digest binary"))


def removals(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", out_col: str = "cut", bits: int = 64) -> DataFrame:
    """Every row of docs with its own columns and out_col, a struct of n_words, n_removed, n_paths and
    longest_path (words) of the paths removed, kept_text (the words that stay, joined by one space) and
    kept_sha256. With fewer bits of hashes some repeats are missed, but no other word goes."""
    number = unused(docs, "_row")
    whole = written(docs.withColumn(number, F.monotonically_increasing_id()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = whole.select(F.col(number).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"))
    found = hits(base, k, bits)
    made = runs(found)
    release(found)
    walked = written(paths(made).withColumn("n", (F.col("last") - F.col("first") + k).cast("int")))
    release(made)
    sources = digests(walked.select(F.col("source_row").alias("row"), F.col("source_first").alias("begin"), "n"), base)
    named = sources.select(F.col("row").alias("source_row"), F.col("begin").alias("source_first"), "n", "digest")
    spans = walked.join(named, ["source_row", "source_first", "n"])
    spans = written(spans.groupBy("row").agg(*(F.collect_list(c).alias(c) for c in ("first", "n", "path", "digest"))))
    release(walked)
    release(sources)
    hashes = WordHashes()

    def kept(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        try:
            for columns in batches:
                named = dict(zip(("text", "first", "n", "path", "digest"), columns, strict=True))
                for part in slices(iter([pd.DataFrame(named)]), SLICE // 4):
                    rows = [_kept(x.encode().split(), *more, hashes, k) for x, *more in part.itertuples(index=False)]
                    yield pd.DataFrame(rows, columns=["n_words", "n_removed", "n_paths", "longest_path", "kept_text", "kept_sha256"])
        finally:
            shrink()

    kept.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    apply = F.pandas_udf(kept, "n_words long, n_removed long, n_paths long, longest_path long, kept_text string, kept_sha256 string")
    mine = unused(docs, "_spans")
    rows = whole.join(spans.select(F.col("row").alias(number), F.struct("first", "n", "path", "digest").alias(mine)), number, "left")
    return rows.withColumn(out_col, apply(text, *(F.col(mine)[c] for c in ("first", "n", "path", "digest")))).select(*docs.columns, out_col)


def _kept(words: list[bytes], firsts, sizes, owners, wanted, hashes: WordHashes, k: int) -> tuple:
    """n_words, n_removed, n_paths, longest_path, kept_text, kept_sha256 of a text's words."""
    goes, lengths = np.zeros(len(words), bool), {}
    if firsts is not None and len(firsts):
        single = hashes.of(words)
        edge, hit = windows(single, k), np.zeros(max(len(words) - k + 1, 0), bool)
        for first, n, path, digest in zip(firsts.tolist(), sizes.tolist(), owners.tolist(), wanted, strict=True):
            if _digest(words, first, first + n) == bytes(digest):
                hit[first : first + n - k + 1] = True
                lengths[path] = max(lengths.get(path, 0), first + n - path)
        # an edge is named once a row: its other places there, if they have its words, go with it
        places = np.flatnonzero(hit)
        places = places[np.argsort(edge[places], kind="stable")]
        if len(places):
            other = np.flatnonzero(~hit)
            like = places[np.minimum(np.searchsorted(edge[places], edge[other]), len(places) - 1)]
            other, like = other[edge[like] == edge[other]], like[edge[like] == edge[other]]
            for x in range(0, len(other), 1 << 16):
                part = slice(x, x + (1 << 16))
                same = (single[other[part, None] + np.arange(k)] == single[like[part, None] + np.arange(k)]).all(1)
                hit[other[part][same]] = True
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(hit), 1)
        np.add.at(cover, np.flatnonzero(hit) + k, -1)
        goes = np.cumsum(cover)[:-1] > 0
    said = b" ".join([w for w, g in zip(words, goes.tolist(), strict=True) if not g]) if goes.any() else b" ".join(words)
    return len(words), int(goes.sum()), len(lengths), max(lengths.values(), default=0), said.decode(), hashlib.sha256(said).hexdigest()


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = removals(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM p),
f AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (g) WHERE m < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
k AS (SELECT x.doc_id, count(*) FILTER (WHERE c.j IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY x.j) FILTER (WHERE c.j IS NULL) AS kept
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.j GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
