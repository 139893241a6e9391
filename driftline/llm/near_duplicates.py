"""Near-duplicate documents by SetSketch registers.

A document's set holds the distinct runs of 5 of its words, A-Z lower-cased. Each of REGISTERS
registers keeps floor(1 - log_B(m / A)), truncated to 0..LIMIT, of the smallest of its exponentially
distributed hash values m: exponentially spaced, truncated minima. A register of a union is the
larger of the two, so sketches merge, and two sets agree in a register with a chance close to their
similarity. Registers are banded; documents that share a band are candidates. A candidate pair's
similarity is estimated by likelihood from its registers jointly (how many are larger, smaller and
equal, and both set sizes); pairs not far below the threshold are verified on their whole sets.

Sets that are equal form a class at once, and one member stands for it. Links are found in rounds of
stars: in each bucket one member is the centre, another one each round, and the members that are not
yet in its component are compared with it, so a round costs a pair a member at most. Members that no
centre has joined are then compared with all members of other components in their buckets, by their
registers, in blocks, and pairs that pass are verified in the same blocks, unless links found there
already join them; only links are rows. So no link between components is left untested, and a bucket
of near copies costs a few verifications a member. At 0.75, a pair shares none of the bands
with a chance of about 5e-6, and fails the estimates with one of about 1e-4; there is no cap on
buckets or pairs.

Texts stay in a written table, of which those with a shared band are read once more as sets of hashes.
What is compared with a centre travels in groups of at most GROUP members beside one copy of the centre.

Defined results: null, empty and blank texts have an empty set and link with nothing, each its own
component. A null id counts as larger than all others. Rows with one id are separate rows. Empty
tables give empty results; columns other than the id and the text are not read. A very long text is
one set of 8 bytes a shingle in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import release, slices, table, tidy, written
from driftline.llm.components import components
from driftline.llm.substrings import NO_ID, WordHashes, windows

SHINGLE = 5
REGISTERS, ROWS = 128, 4
B, A, LIMIT = 1.01, 20.0, (1 << 16) - 2
#: Estimates (standard error 0.04) below this are not verified.
CANDIDATE = 0.6
#: Least share of registers in which a pair of a bucket agrees (standard error 0.04), and the members of
#: a bucket that are compared in one group.
AGREE = 0.6
BLOCK, BLOCK_ITEMS = 4096, 1 << 20
#: Members that travel with one copy of their centre, and characters of text that a task holds at a time.
GROUP, PART_CHARS = 256, 1 << 21
#: Rounds of stars at most, and the pairs a member left over above which a further one pays.
TURNS, PAYS = 4, 1000
#: In place of a member, a centre; row numbers are not negative.
NOBODY = -1
_PAIR = ["key", "i", "j"]

_RULE = np.random.Generator(np.random.Philox(20260101))
_XOR = _RULE.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_ODD = _RULE.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer than k words, of all of them."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(windows(hashes.of(words), k))


def registers(items: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes; of the empty set, all 0."""
    if not len(items):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        least = np.minimum(least, ((items[None, at : at + 1024] ^ _XOR[:, None]) * _ODD[:, None]).min(1))
    m = -np.log1p(-np.minimum((least.astype(float) + 0.5) / 2.0**64, 1 - 1e-16))
    return np.clip(np.floor(1 - np.log(m / A) / np.log(B)), 0, LIMIT + 1).astype(np.uint16)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(one, other)


def likeliest(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, steps: int = 60) -> np.ndarray:
    """Similarity of largest likelihood, per pair of sketches (rows) with known set sizes."""
    more, less = (left > right).sum(1)[:, None], (left < right).sum(1)[:, None]
    equal = left.shape[1] - more - less
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps + 1)[None] * np.minimum(u / v, v / u)
    larger = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    up, down = np.clip(larger(u - v * j), 1e-12, 1), np.clip(larger(v - u * j), 1e-12, 1)
    fit = more * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def based(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row (unique), doc, text of every row; written, so that row stays, unless docs brings stable rows."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    plain = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain if row_col else written(plain)


def sketches(base: DataFrame) -> DataFrame:
    """row, doc, n_shingles, class (of equal sets; null for empty ones), registers; written."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in slices(batches, PART_CHARS):
            sizes, classes, made = [], [], []
            for text in part["text"]:
                items = shingles(text, hashes)
                sizes.append(len(items))
                classes.append(xxhash.xxh3_128_hexdigest(items.tobytes()) if len(items) else None)
                made.append(registers(items).tobytes())
            yield pd.DataFrame({"row": part["row"].to_numpy(), "doc": part["doc"].to_numpy(), "n_shingles": sizes, "class": classes, "registers": made})

    return written(base.select("row", "doc", "text").mapInPandas(run, "row long, doc long, n_shingles long, class string, registers binary"))


def _starred(pairs: DataFrame, held: DataFrame, keeps) -> DataFrame:
    """The pairs a, b that `keeps` keeps: a function of a frame of held's columns, the places of members
    in it and those of their centres. held: node and columns of what is compared.

    Pairs are dealt by b, the centre, in groups of about GROUP; a group's first row is the centre's.
    """
    what = [c for c in held.columns if c != "node"]
    large = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    dealt = pairs.join(large, "b", "left").select("a", "b", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / GROUP))).cast("long").alias("part"))
    members = dealt.join(held.withColumnRenamed("node", "a"), "a").select("a", "b", "part", *what)
    centres = dealt.select("b", "part").distinct().join(held.withColumnRenamed("node", "b"), "b").select(F.lit(NOBODY).cast("long").alias("a"), "b", "part", *what)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = centres.unionByName(members).repartition(parts, "b", "part").sortWithinPartitions("b", "part", "a")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            frame = batch if last is None else pd.concat([last, batch], ignore_index=True)
            a = frame["a"].to_numpy(np.int64)
            heads = np.flatnonzero(a == NOBODY)
            mine = np.flatnonzero(a != NOBODY)
            last = frame.iloc[heads[-1:]]
            if len(mine):
                mine = mine[keeps(frame, mine, heads[np.searchsorted(heads, mine) - 1])]
                yield pd.DataFrame({"a": a[mine], "b": frame["b"].to_numpy(np.int64)[mine]})

    return rows.mapInPandas(run, "a long, b long")


def _by_registers(frame: pd.DataFrame, mine: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Keeps members whose estimated similarity to their centre reaches CANDIDATE."""
    made, sizes = np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(-1, REGISTERS), frame["n_shingles"].to_numpy(float)
    return likeliest(made[mine], made[centres], sizes[mine], sizes[centres]) >= CANDIDATE


def _near(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    both = np.count_nonzero(one.take(np.searchsorted(one, other), mode="clip") == other)
    return 100 * both >= percent * (len(one) + len(other) - both)


def _by_sets(percent: int):
    """Keeps members that are links of their centre."""

    def keeps(frame: pd.DataFrame, mine: np.ndarray, centres: np.ndarray) -> np.ndarray:
        items = [np.frombuffer(x, np.uint64) for x in frame["items"]]
        return np.array([_near(items[c], items[x], percent) for x, c in zip(mine.tolist(), centres.tolist(), strict=True)], bool)

    return keeps


def _items(base: DataFrame, met: DataFrame) -> DataFrame:
    """node, items: the whole sets of the nodes in met; written."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in slices(batches, PART_CHARS):
            yield pd.DataFrame({"node": part["node"].to_numpy(), "items": [shingles(x, hashes).tobytes() for x in part["text"]]})

    return written(base.select(F.col("row").alias("node"), "text").join(met, "node", "left_semi").mapInPandas(run, "node long, items binary"))


def _links(pairs: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that are links: likely by their registers, then verified; written."""
    likely = written(_starred(pairs, held, _by_registers))
    out = written(_starred(likely, sets, _by_sets(percent)))
    release(likely)
    return out


def _grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted batches, each whole."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        open_ = (held[by] == held[by].iloc[-1]).all(axis=1)
        yield from (g for _, g in held[~open_].groupby(by, sort=False))
        held = held[open_]
    if held is not None and len(held):
        yield held


def _likely(rest: DataFrame, held: DataFrame) -> DataFrame:
    """Candidates of different labels in the buckets of rest: key, i, j (two blocks of a bucket), node,
    label, partners (nodes as packed longs, the most similar first; empty for a node that only is one).

    Buckets beyond BLOCK members or BLOCK_ITEMS shingles are cut into blocks, every two of which meet in one
    group; groups are read in sorted order and compared in numpy, by the registers' low bytes (a share
    of 1/256 of unlike ones agrees too), then by likelihood. A pair counts in the first band it shares.
    """
    rows = rest.join(held, "node")
    sizes = rows.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_ITEMS)).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.withColumn("with", F.explode(other)).select("band", "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "label", "n_shingles", "registers")
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *_PAIR).sortWithinPartitions(*_PAIR)
    width = 2 * ROWS

    def pairs(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Place of a node and places of its partners."""
        node, label, block, size = (group[c].to_numpy() for c in ("node", "label", "block", "n_shingles"))
        raw = b"".join(group["registers"])
        full, words = np.frombuffer(raw, np.uint8).reshape(len(group), -1), np.frombuffer(raw, np.uint16).reshape(len(group), -1)
        bands, bytes_, number = full.reshape(len(group), -1, width), np.ascontiguousarray(full[:, ::2]), size.astype(float)
        apart, band = group["i"].iloc[0] != group["j"].iloc[0], group["band"].iloc[0]
        for x in range(len(group) - 1):
            if label[x] == label[-1]:
                break
            later = slice(x + 1, None)
            near = (label[later] != label[x]) & (np.minimum(size[later], size[x]) >= 0.7 * np.maximum(size[later], size[x]))
            if apart:
                near &= block[later] != block[x]
            at = np.flatnonzero(near) + x + 1
            at = at[(bytes_[at] == bytes_[x]).sum(1) >= AGREE * REGISTERS]
            # shared bands of the survivors: keep those whose first is this bucket's
            at = at[(bands[at] == bands[x]).all(2).argmax(1) == band] if len(at) else at
            if len(at):
                like = likeliest(words[at], np.broadcast_to(words[x], (len(at), REGISTERS)), number[at], np.full(len(at), number[x]))
                order = np.argsort(-like, kind="stable")
                at = at[order][like[order] >= CANDIDATE]
            if len(at):
                yield x, at

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        for group in _grouped(batches, _PAIR):
            # labels by size, each in one run, the largest last: its members need not meet each other
            order = np.lexsort((group["label"], group["label"].map(group["label"].value_counts())))
            group = group.iloc[order]
            found = dict(pairs(group)) if group["label"].iloc[0] != group["label"].iloc[-1] else {}
            if found:
                at, nodes = np.unique(np.concatenate([[*found], *found.values()]).astype(np.int64)), group["node"].to_numpy()
                made.append(group.iloc[at][[*_PAIR, "node", "label"]].assign(partners=[nodes[found.get(x, [])].astype(np.int64).tobytes() for x in at.tolist()]))
            if sum(map(len, made)) >= 1000:
                yield pd.concat(made)
                made = []
        if made:
            yield pd.concat(made)

    return rows.mapInPandas(run, "key long, i int, j int, node long, label long, partners binary")


def _across(rest: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between the labels of rest, enough of them to join all labels that links join; written.

    A group's candidates are verified on whole sets, unless the links found before in that group join
    the two labels already.
    """
    likely = written(_likely(rest, held))
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = likely.join(sets, "node").repartition(parts, *_PAIR).sortWithinPartitions(*_PAIR)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches, _PAIR):
            nodes, up = group["node"].tolist(), {x: x for x in group["label"].tolist()}
            place = {n: k for k, n in enumerate(nodes)}
            label, items, found = group["label"].tolist(), [np.frombuffer(x, np.uint64) for x in group["items"]], []

            def top(x: int) -> int:
                while up[x] != x:  # noqa: B023
                    up[x] = x = up[up[x]]  # noqa: B023
                return x

            for x, partners in enumerate(group["partners"]):
                for node in np.frombuffer(partners, np.int64).tolist():
                    y = place[node]
                    one, other = top(label[x]), top(label[y])
                    if one != other and _near(items[x], items[y], percent):
                        up[one] = other
                        found.append((nodes[x], node))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    out = written(rows.mapInPandas(run, "a long, b long"))
    release(likely)
    return out


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets with several components, with their labels; written."""
    rows = members.join(labels, "node", "left").select("band", "key", "node", "doc", F.coalesce("label", "node").alias("label"))
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return written(rows.join(several, "key", "left_semi"))


def _stars(rest: DataFrame, turn: int) -> DataFrame:
    """A pair (member, centre) for every member of a bucket that is not of its centre's component. The
    centre is the smallest document, in later turns another one for each."""
    rank = F.struct("doc", "node", "label") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label")
    centres = rest.groupBy("key").agg(F.min(rank).alias("c")).select("key", F.col("c.node").alias("b"), F.col("c.label").alias("own"))
    return rest.join(centres, "key").where("label <> own").select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept (the id is its component's smallest) and stands (the
    one row of its component that does). row: row_col, unique and stable, or else numbers given here."""
    base = based(docs, id_col, text_col, row_col)
    drawn = sketches(base)
    classes = written(drawn.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc", "row")).alias("m")).select("class", F.col("m.row").alias("node"), F.col("m.doc").alias("doc")))
    nodes = drawn.select(F.col("row").alias("node"), "n_shingles", "registers").join(classes.select("node", "doc"), "node")
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(REGISTERS // ROWS)))
    bands = nodes.select("node", "doc", F.posexplode(keys).alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = written(bands.join(shared, "key", "left_semi").select("band", "key", "node", "doc"))
    met = members.select("node").distinct()
    held = written(nodes.select("node", "n_shingles", "registers").join(met, "node", "left_semi"))
    sets = _items(base, met)
    if not row_col:
        release(base)

    links, rest, labels = [], members.withColumn("label", F.col("node")), None
    for turn in range(TURNS):
        links.append(_links(_stars(rest, turn), held, sets, percent))
        for old in [labels] * (labels is not None) + [rest] * (turn > 0):
            release(old)
        labels = components(reduce(DataFrame.unionByName, links))
        rest = _labelled(members, labels)
        # the pairs that are left to be compared: where they are many a member, another turn leaves fewer
        sizes = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        n, pairs = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
        if not n or pairs <= PAYS * n:
            break
    if n:
        links.append(_across(rest, held, sets, percent))
        release(labels)
        labels = components(reduce(DataFrame.unionByName, links))
    for done in (*links, rest, members, held, sets):
        release(done)

    owned = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = owned.groupBy("label").agg(F.min(F.struct("doc", "node")).alias("least"))
    owned = owned.join(smallest, "label").select("class", F.col("least.doc").alias("least_doc"), F.col("least.node").alias("least_row"))
    out = drawn.select("row", "doc", "n_shingles", "class").join(owned, "class", "left")
    least = F.coalesce("least_doc", "doc")
    back = lambda c: F.when(c < NO_ID, c).cast(docs.schema[id_col].dataType)
    return out.select("row", back(F.col("doc")).alias("doc_id"), "n_shingles", back(least).alias("component_id"), (F.col("doc") == least).alias("kept"), (F.coalesce("least_row", "row") == F.col("row")).alias("stands"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""
