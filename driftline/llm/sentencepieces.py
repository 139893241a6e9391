"""SentencePiece encoding and decoding that keeps the byte offsets of the original text.

A text is normalised by longest-prefix matches in the model's compiled character map (a
double-array trie followed by its replacement strings); for every normalised byte the place of its
source byte is recorded. The normalised text is segmented by the model, whole, a part of an Arrow
batch at a time, and each piece's range of normalised bytes is projected through that record onto the
original bytes. Where the model has no character map and keeps its spaces, a space of one byte becomes
a mark of three and nothing else changes; the record is then made by numpy from the text's bytes.

Defined results: null counts as empty; an empty text has no pieces and, with an end id, that id
alone. Rows are independent, so ties and repeated rows give equal rows; columns other than the id and
the text are not read. An empty table gives an empty result. A very long text is segmented whole: a
task holds the ids and offsets of PART_CHARS characters, or of one text if that is longer. One Arrow
pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import slices, table, tidy

SPACE = "▁"
_MARK = len(SPACE.encode())
#: Characters whose ids are held at a time, unless one text has more.
PART_CHARS = 1 << 20


class CharacterMap:
    """The compiled character map: longest-prefix matches from source bytes to replacement bytes."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at data[at], and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        node = offset(units[0])
        for n, byte in enumerate(data[at:], 1):
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = n, self.strings[start : self.strings.index(b"\0", start)]
        return found


@dataclass
class Settings:
    """The part of a model's normaliser that decides the normalised text."""

    character_map: CharacterMap
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool

    @property
    def identity(self) -> bool:
        return not self.character_map.units and not self.remove_extra_whitespaces


def normalise(data: bytes, settings: Settings) -> tuple[bytes, list[int]]:
    """Normalised bytes, and for each of them and for the end the place of its source byte."""
    out, source, mark = bytearray(), [], SPACE.encode()

    def put(piece: bytes, at: int) -> None:
        out.extend(piece)
        source.extend([at] * len(piece))

    steps, at = [], 0
    while at < len(data):
        if hit := settings.character_map.longest(data, at):
            n, new = hit
        else:
            n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            new = data[at : at + n]
        steps.append((at, n, new))
        at += n
    squeeze = settings.remove_extra_whitespaces
    first = 0
    if squeeze:
        while first < len(steps) and steps[first][2].strip(b" ") == b"":
            first += 1
    steps, end = steps[first:], len(data)
    if not steps:
        return b"", [len(data)]
    if settings.add_dummy_prefix:
        put(mark, steps[0][0])
    blank = squeeze
    for at, _, new in steps:
        if squeeze and blank:
            new = new.lstrip(b" ")
        for k in range(len(new)):
            put(mark if new[k : k + 1] == b" " else new[k : k + 1], at)
        if new:
            blank = new.endswith(b" ")
    if squeeze:
        while out.endswith(mark):
            end = source[len(out) - len(mark)]
            del out[-len(mark) :], source[-len(mark) :]
    return bytes(out), [*source, end]


class Codec:
    """A SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that do not escape spaces, or put them last, are not supported")
        self.settings = Settings(CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        self.end, self.unknown = model.trainer_spec.eos_id, model.trainer_spec.unk_id
        self.names = [str(i) for i in range(len(model.pieces))]
        # normalised bytes of every piece: a byte piece has one, a control piece none
        self.widths = np.array([1 if x.type == 6 else 0 if x.type == 3 else len(x.piece.encode()) for x in model.pieces], np.int32)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # segmentation alone: what is fed is normalised already
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.name = b"", False, False, "identity"
        self.segment = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def normal(self, text: str) -> tuple[str, list[int] | None]:
        """The normalised text, and the record of source places (None: to be made by `record`)."""
        if self.settings.identity:
            return (SPACE if self.settings.add_dummy_prefix and text else "") + text.replace(" ", SPACE), None
        data, source = normalise(text.encode(), self.settings)
        return data.decode("utf-8", "replace"), source

    def record(self, text: str) -> np.ndarray:
        """The source place of every normalised byte and of the end, where only spaces change."""
        data = np.frombuffer(text.encode(), np.uint8)
        place = np.repeat(np.arange(len(data), dtype=np.int32), np.where(data == 32, _MARK, 1))
        return np.concatenate([np.zeros(_MARK if self.settings.add_dummy_prefix and text else 0, np.int32), place, np.array([len(data)], np.int32)])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str, list[int] | None]]:
        """(ids without an end id, normalised text, record) of every text."""
        normal = [self.normal(x) for x in texts]
        found = self.segment.encode([x for x, _ in normal], return_type="numpy", num_threads=1)
        return [(ids, full, source) for ids, (full, source) in zip(found, normal, strict=True)]

    def project(self, text: str, ids: np.ndarray, full: str, source: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of every piece in bytes of the original text."""
        widths = self.widths[ids]
        if self.unknown in ids:  # an unknown piece is as wide as what it stands for
            widths = np.array([len(x.surface.encode()) for x in self.segment.encode(full, return_type="proto").pieces], np.int32)
        ends = np.cumsum(widths, dtype=np.int64)
        place = self.record(text) if source is None else np.array(source, np.int32)
        return place[ends - widths], place[ends]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece, in bytes of the original text."""
        ids, full, source = self.encode([text])[0]
        begins, ends = self.project(text, ids, full, source)
        return [*zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts that ids stand for."""
        return self.whole.decode(ids, num_threads=1)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """A worker's codec of a model file."""
    return Codec(path)


#: Columns of encode() and their types.
COLUMNS = {"ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string", "n_tokens": "long", "n_bytes_spanned": "long", "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string"}


def encode(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("ids", "begins", "ends", "decoded"), end_id: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and any of COLUMNS. begins and ends are the source bytes of every id;
    the end id spans nothing at the end. n_bytes_spanned adds up the spans; spans_sha256 is the digest of
    all pairs (begin, end) as little-endian 32-bit integers."""
    decoding = bool({"decoded", "decoded_sha256"} & {*columns})

    @tidy
    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(model_path)
        tail = np.array([codec.end] * end_id, np.int32)
        for part in slices(batches, PART_CHARS):
            texts, out = part["text"].tolist(), {c: [] for c in columns}
            found = codec.encode(texts)
            said = codec.decode([np.concatenate([ids, tail]).tolist() for ids, _, _ in found]) if decoding else [None] * len(texts)
            for text, (ids, full, source), decoded in zip(texts, found, said, strict=True):
                size = np.array([len(text.encode())] * end_id, np.int32)
                begins, ends = (np.concatenate([x, size]).astype(np.int32) for x in codec.project(text, ids, full, source))
                ids = np.concatenate([ids, tail])
                made = {
                    "ids": lambda: ids,  # noqa: B023
                    "begins": lambda: begins,  # noqa: B023
                    "ends": lambda: ends,  # noqa: B023
                    "decoded": lambda: decoded,  # noqa: B023
                    "n_tokens": lambda: len(ids),  # noqa: B023
                    "n_bytes_spanned": lambda: int((ends - begins).sum(dtype=np.int64)),  # noqa: B023
                    "ids_sha256": lambda: _digest(" ".join([codec.names[i] for i in ids.tolist()]).encode()),  # noqa: B023
                    "decoded_sha256": lambda: _digest(decoded.encode()),  # noqa: B023
                    "spans_sha256": lambda: _digest(np.stack([begins, ends], 1).astype("<i4").tobytes()),  # noqa: B023
                }
                for c in columns:
                    out[c].append(made[c]())
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), **out})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} {COLUMNS[c]}" for c in columns)])
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(encoded, schema)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_file(), ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes_spanned", "spans_sha256"))
