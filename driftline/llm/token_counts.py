"""Token counts under a unigram vocabulary, over a trie of pre-tokens.

A text's pre-tokens are its words, each with a mark for the space before it. The count of a
pre-token is that of its segmentation of largest total score (ties: fewest tokens). The distinct
pre-tokens of a part of a batch are walked in sorted order, which is the depth-first order of their trie: the
forward scores of a prefix are computed once, stay on a stack while pre-tokens share it, and the
count at each terminal is stored. A worker keeps the counts of the pre-tokens it met, up to a bound.

A character outside the vocabulary costs one token a byte, at the vocabulary's lowest score. The
vocabulary and its scores are read from a SentencePiece model file; nothing is trained. No unigram model
is among the public files: the query reads the merge ranks of a BPE model as scores, so its counts are
those of that vocabulary's best segmentation and of no tokenizer in use.

Defined results: null, empty and blank texts have no words and no tokens. Rows are independent, so
ties and repeated rows give equal rows; other columns are not read. An empty table gives an empty result.
A very long text is split whole in a task, and so is a very long word. One Arrow pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import slices, table, tidy
from driftline.llm.sentencepieces import SPACE, model_file

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of words whose counts a worker keeps, and of text that it splits at a time.
_MEMO_CHARS, PART_CHARS = 4 << 20, 1 << 20


class Unigrams:
    """Pieces with scores; scores below `least` (pieces that are never to be joined) count as least."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=0)
        self.unknown = min(scores.values(), default=0.0) - 1.0

    @classmethod
    def load(cls, path: str, least: float = -1e8) -> Unigrams:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return cls({x.piece: x.score for x in model.pieces if x.type in (1, 4) and x.score > least})

    def counts(self, tokens: list[str]) -> tuple[dict[str, int], int]:
        """Count of every distinct pre-token, and the number of trie nodes whose scores were computed."""
        scores, longest, unknown = self.scores, self.longest, self.unknown
        get, out, nodes = scores.get, {}, 0
        score, length = [0.0], [0]  # of the prefix of each size of the current path
        before = ""
        for token in sorted(set(tokens)):
            shared = 0
            for x, y in zip(before, token):  # noqa: B905
                if x != y:
                    break
                shared += 1
            del score[shared + 1 :], length[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                best, fewest = None, 0
                for begin in range(max(0, end - longest), end):
                    s = get(token[begin:end])
                    if s is not None:
                        s += score[begin]
                        n = length[begin] + 1
                        if best is None or s > best or s == best and n < fewest:
                            best, fewest = s, n
                if token[end - 1] not in scores:
                    size = len(token[end - 1].encode())
                    s, n = score[end - 1] + unknown * size, length[end - 1] + size
                    if best is None or s > best or s == best and n < fewest:
                        best, fewest = s, n
                score.append(best)
                length.append(fewest)
                nodes += 1
            out[token] = length[len(token)]
            before = token
        return out, nodes


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Unigrams, dict[str, int], list[int]]:
    """A worker's vocabulary, and the counts it has met and their characters, for all its tasks."""
    return Unigrams.load(path), {}, [0]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, max_word_tokens (tokens of the costliest word) of every row."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, memo, held = _worker(model_path)
        for rows in slices(batches, PART_CHARS):
            split = [_WORD.findall(x) for x in rows["text"]]
            if held[0] > _MEMO_CHARS:
                memo.clear()
                held[0] = 0
            new = {w for x in split for w in x if w not in memo}
            if new:
                found, _ = vocabulary.counts([SPACE + w for w in new])
                memo.update((w[len(SPACE) :], n) for w, n in found.items())
                held[0] += sum(map(len, new))
            counts = [[memo[w] for w in x] for x in split]
            yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "n_words": [len(x) for x in counts], "n_tokens": [sum(x) for x in counts], "max_word_tokens": [max(x, default=0) for x in counts]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, n_words long, n_tokens long, max_word_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_file())
