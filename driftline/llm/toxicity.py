"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased terms, words and beginnings of words, each hashed into
one of 2^18 buckets. The score is
sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>): the pair part learns interactions, such
as an insult together with the mention of a group, that an additive model cannot hold. Only buckets
whose label counts in the sample differ from chance have parameters, alone or in a pair: every pair
of buckets that are common or differ alone is counted, and both get parameters where the pair's share
of label 1 is beyond those of either alone and of both added. All others count as 0, so
the length of a document does not drown its few telling terms.

The model is fitted in numpy on a sample of at most about TRAIN_ROWS labelled documents and TRAIN_BYTES
bytes together (both parameters), whole texts of any length; executors send hashed terms, not texts.
Scoring reads every whole text in Arrow batches and shuffles nothing.

Defined results: null and empty texts have no terms and score the bias, sigmoid(w0). Without labels,
or with one class only, every document scores the smoothed share of label 1. Repeated rows and ids
score alike; of rows of one id, one is learnt from. A null id is never held out, nor learnt from. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import shrink, slices, table, tidy
from driftline.llm.labelled import fold, sample

BUCKETS = 1 << 18
TRAIN_ROWS = 12_000
TRAIN_BYTES = 96 << 20
RANK = 4
#: Buckets with parameters, and the least evidence for one in standard deviations.
FEATURES, EVIDENCE = 4_000, 3.0
#: Share of the sample's documents from which a bucket's pairs are counted whatever its own label counts,
#: the least evidence for a pair, and the buckets counted at once.
COMMON, PAIR_EVIDENCE, COUNTED = 0.01, 6.5, 400
#: A word's first characters, so many, are terms too: inflected forms share them.
BEGINNINGS = (4, 5)
THRESHOLD = 0.3
_EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_/\\"
#: Characters of words that a worker remembers, and of text that it holds terms of at a time.
_MEMO_CHARS, PART_CHARS = 4 << 20, 1 << 21


class Terms:
    """Hashed terms of texts, with a memo of words of bounded size."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def of(self, text: str) -> np.ndarray:
        memo, found = self.memo, []
        if self.chars > _MEMO_CHARS:
            memo.clear()
            self.chars = 0
        for word in set(text.lower().split()):
            buckets = memo.get(word)
            if buckets is None:
                term = word.strip(_EDGES)
                parts = (term, *("^" + term[:n] for n in BEGINNINGS if len(term) > n))
                buckets = memo[word] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in parts)
                self.chars += len(word)
            found += buckets
        return np.unique(np.array(found, dtype=np.int32))


@dataclass
class Machine:
    """Parameters: the place of each bucket (-1: none), bias, weights and factors."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, docs: list[np.ndarray]) -> np.ndarray:
        kept = [p[p >= 0] for p in (self.place[x] for x in docs)]
        flat, owner = np.concatenate([*kept, np.empty(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(kept)), [len(x) for x in kept])
        v = self.factors[flat]
        linear = np.bincount(owner, self.weights[flat], len(kept))
        sums = np.stack([np.bincount(owner, v[:, f], len(kept)) for f in range(v.shape[1])], 1)
        squares = np.bincount(owner, (v * v).sum(1), len(kept))
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(docs), -30, 30)))


def _chosen(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Place of each bucket among those whose share of label 1, alone or in a pair, is far from chance."""
    n, ones, share = np.zeros(BUCKETS), np.zeros(BUCKETS), y.mean()
    for at in range(0, len(docs), 500):
        part = docs[at : at + 500]
        flat = np.concatenate(part)
        n += np.bincount(flat, minlength=BUCKETS)
        ones += np.bincount(flat, np.repeat(y[at : at + 500], [len(x) for x in part]), BUCKETS)
    z = np.abs(ones - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share) + 0.5)
    best = np.argsort(-z, kind="stable")[:FEATURES]
    best = best[(z[best] >= EVIDENCE) & (n[best] >= 3)]
    met = np.union1d(best, np.flatnonzero((n >= 3) & (n >= COMMON * len(docs))))
    best = np.concatenate([best, np.setdiff1d(_paired(docs, y, met, n[met], ones[met]), best)])
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))
    return place


def _paired(docs: list[np.ndarray], y: np.ndarray, met: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The buckets of met (with their counts) that have a pair in met whose share of label 1 lies beyond
    the sample's, those of both buckets and that of their log odds added. All pairs are counted."""
    at, size = np.full(BUCKETS, -1, np.int32), len(docs)
    at[met] = np.arange(len(met))
    # one number a term of a document, column * documents + row, sorted in place: the driver holds no more
    kind = np.uint32 if len(met) * size < 1 << 32 else np.int64
    cells, end = np.empty(int(n.sum()), kind), 0
    for row, x in enumerate(docs):
        places = at[x]
        places = places[places >= 0].astype(kind)
        begin, end = end, end + len(places)
        cells[begin:end] = places * kind(size) + kind(row)
    cells.sort()
    share, rates = y.mean(), ((ones + y.mean()) / (n + 1)).astype(np.float32)
    odds, base, positive = np.log(rates / (1 - rates)), np.float32(np.log(share / (1 - share))), np.flatnonzero(y)

    def dense(begin: int) -> np.ndarray:
        end = min(begin + COUNTED, len(met))
        part = cells[slice(*np.searchsorted(cells, np.array([begin * size, end * size], kind)))]
        out = np.zeros((end - begin, size), np.float32)
        out.ravel()[part - kind(begin * size)] = 1
        return out

    def counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return left @ right.T, left[:, positive] @ right[:, positive].T

    found = np.zeros(len(met), bool)
    for i in range(0, len(met), COUNTED):
        left = dense(i)
        for j in range(i, len(met), COUNTED):
            right = left if i == j else dense(j)
            together, both = counted(left, right)
            # no pair closer to the sample's share than that can be far from the rates below
            a, b = np.nonzero((together >= 3) & (np.abs(both - np.float32(share) * together) >= 0.7 * PAIR_EVIDENCE))
            c, p, x, y_ = together[a, b], both[a, b], a + i, b + j
            added = 1 / (1 + np.exp(base - odds[x] - odds[y_]))
            high = np.maximum(np.maximum(rates[x], rates[y_]), np.maximum(added, share))
            low = np.minimum(np.minimum(rates[x], rates[y_]), np.minimum(added, share))
            spread = lambda e: np.sqrt(c * e * (1 - e) + 0.5)
            far = (x != y_) & (((p - c * high) >= PAIR_EVIDENCE * spread(high)) | ((c * low - p) >= PAIR_EVIDENCE * spread(low)))
            found[x[far]] = found[y_[far]] = True
    return met[found]


def fit(docs: list[np.ndarray], y: np.ndarray, rank: int = RANK, epochs: int = 30, seed: int = 7) -> Machine:
    """Adam on the logistic loss with L2, in batches. docs: arrays of distinct buckets."""
    y = np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Machine(np.full(BUCKETS, -1, np.int32), start, np.zeros(0), np.zeros((0, rank)))
    place, rng = _chosen(docs, y), np.random.default_rng(seed)
    size = int(place.max()) + 1
    theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, rank))], 1)
    bias, m, s, step = np.array([start, 0.0, 0.0]), np.zeros_like(theta), np.zeros_like(theta), 0
    kept = [p[p >= 0].astype(np.int64) for p in (place[x] for x in docs)]
    for _ in range(epochs):
        order = rng.permutation(len(kept))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            flat, owner = np.concatenate([kept[i] for i in part]), np.repeat(np.arange(len(part)), [len(kept[i]) for i in part])
            v = theta[flat, 1:]
            sums = np.stack([np.bincount(owner, v[:, f], len(part)) for f in range(rank)], 1)
            z = bias[0] + np.bincount(owner, theta[flat, 0], len(part)) + 0.5 * ((sums * sums).sum(1) - np.bincount(owner, (v * v).sum(1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gr = g[owner]
            each = np.concatenate([gr[:, None], gr[:, None] * (sums[owner] - v)], 1)
            grad = np.stack([np.bincount(flat, each[:, f], size) for f in range(rank + 1)], 1) + np.array([1e-5] + [3e-4] * rank) * theta
            step += 1
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
            theta -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            bias[1], bias[2] = 0.9 * bias[1] + 0.1 * g.sum(), 0.999 * bias[2] + 0.001 * g.sum() ** 2
            bias[0] -= 0.01 * (bias[1] / (1 - 0.9**step)) / (np.sqrt(bias[2] / (1 - 0.999**step)) + 1e-8)
    return Machine(place, float(bias[0]), theta[:, 0], theta[:, 1:])


@tidy
def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    terms = Terms()
    for batch in slices(batches, PART_CHARS):
        yield pd.DataFrame({"doc_id": batch["doc_id"], "terms": [terms.of(x).tobytes() for x in batch["text"]], "y": batch["y"]})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Machine:
    """A machine for labels.<label>, learnt from the rows of labels for which `learn` holds."""
    learn = F.lit(True) if learn is None else learn
    drawn = sample(docs, labels, label, learn, rows, most).mapInPandas(_hashed, "doc_id long, terms binary, y int")
    got = sorted(((r["doc_id"], np.frombuffer(r["terms"], np.int32), r["y"]) for r in drawn.collect()), key=lambda r: r[0])
    machine = fit([x for _, x, _ in got], np.array([y for _, _, y in got]))
    del got
    shrink()
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @tidy
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, machine = Terms(), model.value
        for batch in slices(batches, PART_CHARS):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": machine.scores([terms.of(x) for x in batch["text"]])})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(scored, f"doc_id {kind}, score double")


def below(spark: SparkSession, machine: Machine, limit: float = THRESHOLD, text_col: str = "text"):
    """A function for mapInArrow that keeps the rows which score below the limit, untouched."""
    model = spark.sparkContext.broadcast(machine)

    @tidy
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = Terms(), model.value
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            scores = machine.scores([terms.of(x or "") for x in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(scores < limit))

    return kept


def held_out():
    return F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
