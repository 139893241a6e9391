"""Quality by a byte-level convolutional network in numpy.

Every byte is embedded, learned filters of WIDTH bytes slide over the document byte by byte (in
steps of STRIDE, from each of the first STRIDE bytes),
each filter keeps its maximum over the whole document, and the maxima combine into one probability.
Long documents are cut into chunks that overlap by WIDTH bytes, so each window lies in one
chunk and the maximum over chunks is that over the document: memory is bounded by a block of chunks
however long a text is, and no byte is left out.

The network is fitted on about TRAIN_ROWS labelled documents of about TRAIN_BYTES bytes together at most
(both parameters), whole texts of any length. Scoring is one pass in Arrow batches without a shuffle.

Defined results: null and empty texts are one window of padding and get a score like any other.
Without labels, or with one class only, every score is the smoothed share of label 1. Repeated rows
and ids score alike; of rows of one id, one is learnt from. A null id is never held out, nor learnt from.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import slices, table, tidy
from driftline.llm.labelled import fold, sample

TRAIN_ROWS = 2_000
TRAIN_BYTES = 16 << 20
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 4, 24
CHUNK, BLOCK = 1 << 13, 1 << 16
THRESHOLD = 0.3
PART_CHARS = 1 << 21
_SYMBOLS = 257  # bytes, and padding


@dataclass
class Network:
    """Embedding (257 x EMBED), filters as two halves (STRIDE * EMBED x FILTERS), their bias, output weights and bias."""

    embed: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        pooled = np.maximum(pool(self, texts)[0], 0)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30)))


def _padded(piece: bytes, last: bool) -> np.ndarray:
    """Symbols of a chunk; a text's end is padded to whole steps and by one more step, so that it has a window."""
    n = max(1, -(-len(piece) // STRIDE)) + last
    found = np.full(n * STRIDE, 256, np.int16)
    found[: len(piece)] = np.frombuffer(piece, np.uint8)
    return found


def _blocks(texts: list[bytes]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Chunks of the texts, with the places of their texts, in blocks of bounded size."""
    owners, chunks, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - (WIDTH - STRIDE), 1), CHUNK):
            chunks.append(_padded(text[at : at + CHUNK + WIDTH], at + CHUNK + WIDTH >= len(text)))
            owners.append(i)
            held += len(chunks[-1])
            if held >= BLOCK:
                yield owners, chunks
                owners, chunks, held = [], [], 0
    if chunks:
        yield owners, chunks


def pool(net: Network, texts: list[bytes], places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Maximum of every filter over every text; with places, the symbols of the window that has it."""
    best = np.full((len(texts), FILTERS), -np.inf, np.float32)
    windows = np.full((len(texts), FILTERS, WIDTH), 256, np.int16) if places else None
    for owners, chunks in _blocks(texts):
        symbols = np.concatenate(chunks)
        ends = np.cumsum([len(c) // STRIDE for c in chunks])
        begins, owned = np.concatenate([[0], ends[:-1]]), np.array(owners)
        for phase in range(STRIDE):
            steps = net.embed[symbols[phase : len(symbols) - (STRIDE - phase) % STRIDE]].reshape(-1, STRIDE * EMBED)
            hidden = steps[:-1] @ net.first
            hidden += steps[1:] @ net.second
            hidden += net.bias
            # a chunk's windows end one step before it does, those of later phases two
            some = ends - begins > 1 + (phase > 0)
            starts, stops, own = begins[some], (ends - 1 - (phase > 0))[some], owned[some]
            if places:
                for i, a, b in zip(own, starts, stops, strict=True):
                    at = hidden[a:b].argmax(0)
                    top = hidden[a + at, np.arange(FILTERS)]
                    better = top > best[i]
                    best[i][better] = top[better]
                    windows[i][better] = symbols[((a + at[better]) * STRIDE + phase)[:, None] + np.arange(WIDTH)]
            elif len(own):
                # the odd segments are the steps between
                cuts = np.stack([starts, stops], 1).ravel()
                tops = np.maximum.reduceat(hidden, cuts[cuts < len(hidden)], axis=0)[::2]
                np.maximum.at(best, own, tops)
    return best, windows


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 12, seed: int = 11) -> Network:
    """Adam on the logistic loss in batches; only the windows that hold a maximum get a gradient."""
    y, rng = np.asarray(y, float), np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    f32 = np.float32
    net = Network(rng.normal(0, 0.5, (_SYMBOLS, EMBED)).astype(f32), rng.normal(0, 0.15, (STRIDE * EMBED, FILTERS)).astype(f32), rng.normal(0, 0.15, (STRIDE * EMBED, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.1, FILTERS).astype(f32), float(np.log(share / (1 - share))))
    net.embed[256] = 0
    if len(y) == 0 or y.min() == y.max():
        net.out[:] = 0
        return net
    names = ("embed", "first", "second", "bias", "out")
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    shift, step, half = [0.0, 0.0], 0, STRIDE * EMBED
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    for epoch in range(epochs):
        rate, order = 0.01 * (1 - 0.9 * epoch / epochs), rng.permutation(len(texts))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            raw, windows = pool(net, [texts[i] for i in part], True)
            act = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.shift, -30, 30)))
            g = ((p - y[part]) * weight[part] / len(part)).astype(f32)
            back = g[:, None] * net.out * (raw > 0)  # documents x filters
            seen = net.embed[windows]  # documents x filters x WIDTH x EMBED
            flat = seen.reshape(len(part), FILTERS, WIDTH * EMBED)
            kernel = np.einsum("df,dfw->wf", back, flat)
            full = np.concatenate([net.first, net.second]).T.reshape(FILTERS, WIDTH, EMBED)
            to_embed = np.zeros_like(net.embed)
            np.add.at(to_embed, windows.reshape(-1), (back[:, :, None, None] * full[None]).reshape(-1, EMBED))
            to_embed[256] = 0
            grads = {"embed": to_embed, "first": kernel[:half] + 1e-4 * net.first, "second": kernel[half:] + 1e-4 * net.second, "bias": back.sum(0), "out": g @ act + 1e-4 * net.out}
            step += 1
            a, b = 1 - 0.9**step, 1 - 0.999**step
            for k in names:
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                getattr(net, k)[...] -= (rate * (m / a) / (np.sqrt(s / b) + 1e-8)).astype(f32)
            shift[0] += 0.1 * (g.sum() - shift[0])
            shift[1] += 0.001 * (g.sum() ** 2 - shift[1])
            net.shift -= rate * (shift[0] / a) / (np.sqrt(shift[1] / b) + 1e-8)
    # the loss weighed both classes alike; the scores are to be shares of the sample
    net.shift += float(np.log(share / (1 - share)))
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Network:
    """A network for labels.<label>, learnt from the rows of labels for which `learn` holds."""
    learn = F.lit(True) if learn is None else learn
    got = sorted((r["doc_id"], r["text"].encode(), r["y"]) for r in sample(docs, labels, label, learn, rows, most).collect())
    return fit([x for _, x, _ in got], np.array([y for _, _, y in got]))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    @tidy
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, PART_CHARS):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.value.scores([x.encode() for x in batch["text"]]).astype(float)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(scored, f"doc_id {kind}, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    network = train(docs, table(spark, sf_dir, "labels"), learn=~held)
    return score(docs, network).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
