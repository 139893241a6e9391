"""Block signatures: blobs in blocks of a fixed length with a rolling checksum and a strong hash."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from driftline.config import SIDECAR
from driftline.schema import SIGNATURE


def rolling(data: bytes) -> int:
    """Sum of bytes in the low half, sum of its prefix sums in the high half, 16 bits each."""
    if not len(data):
        return 0
    sums = np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint32)  # modulo 2^32, of which 16 bits count
    return int(sums.sum(dtype=np.uint32) & 0xFFFF) << 16 | int(sums[-1] & 0xFFFF)


def rolling_all(data: bytes, n: int) -> np.ndarray:
    """The rolling checksum of every window of n bytes, from prefix sums."""
    x = np.frombuffer(data, np.uint8)
    if n <= 0 or len(x) < n:
        return np.empty(0, np.uint32)
    # all arithmetic is modulo 2^32, of which 16 bits count
    sums, deep = np.zeros(len(x) + 1, np.uint32), np.zeros(len(x) + 1, np.uint32)
    np.cumsum(x, dtype=np.uint32, out=sums[1:])
    np.cumsum(sums[1:], dtype=np.uint32, out=deep[1:])  # sums of prefix sums
    high = deep[n:] - deep[:-n]
    high -= np.uint32(n & 0xFFFFFFFF) * sums[:-n]
    high <<= np.uint32(16)
    low = sums[n:] - sums[:-n]
    low &= np.uint32(0xFFFF)
    high |= low
    return high


def rolling_parts(data: bytes, n: int, part: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, rolling checksums) of a blob's windows of n bytes, `part` of them at a time:
    some 20 bytes of memory a byte of a part and a window."""
    view = memoryview(data)
    for at in range(0, max(len(data) - n + 1, 0), part):
        yield at, rolling_all(view[at : at + part + n - 1], n)


def rolling_blocks(data: bytes, n: int, part: int = 1 << 20) -> np.ndarray:
    """The rolling checksum of every block of n bytes, the last one maybe short, `part` bytes of them at a time."""
    whole, step = len(data) // n, max(part // n, 1)
    if step == 1:
        return np.array([rolling(data[i : i + n]) for i in range(0, len(data), n)], np.int64)
    out = np.empty(-(-len(data) // n), np.int64)
    cut, deep = np.frombuffer(data, np.uint8, whole * n).reshape(whole, n), np.arange(n, 0, -1, dtype=np.uint32)
    for i in range(0, whole, step):  # modulo 2^32, of which 16 bits count
        x = cut[i : i + step].astype(np.uint32)
        out[i : i + len(x)] = (x @ deep & np.uint32(0xFFFF)).astype(np.int64) << 16 | (x.sum(axis=1, dtype=np.uint32) & np.uint32(0xFFFF))
    if whole < len(out):
        out[-1] = rolling(data[whole * n :])
    return out


def quick_blocks(data: bytes, n: int) -> np.ndarray:
    """XXH3 of 64 bits of every block, as longs: tells most different blocks apart before their strong hashes are compared."""
    return np.array([xxhash.xxh3_64_intdigest(data[i : i + n]) for i in range(0, len(data), n)], np.uint64).view(np.int64)


@pandas_udf(LongType())
def rolling_checksum(data: pd.Series) -> pd.Series:
    return data.map(lambda x: rolling(bytes(x)))


def by_block(of: Callable[[bytes, int], np.ndarray], size: int) -> Callable[..., Column]:
    """of(blob, size) of a column of blobs: an array with a long for each block. Blobs go to Python before
    they are cut, as a function of cut blocks would queue the whole blob once for every block of it."""

    @pandas_udf(ArrayType(LongType()))
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: of(bytes(x), size))

    return run


def rolling_checksum_sql(data: Column) -> Column:
    """The same by a fold over the bytes, in the JVM; for short values and cross-checks."""
    at = F.sequence(F.lit(1), F.octet_length(data))
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    fold = F.aggregate(at, start, lambda s, i: F.struct((s["a"] + byte(i)).alias("a"), (s["b"] + s["a"] + byte(i)).alias("b")), lambda s: F.shiftleft(s["b"].bitwiseAND(0xFFFF), 16).bitwiseOR(s["a"].bitwiseAND(0xFFFF)))
    return F.when(F.octet_length(data) == 0, F.lit(0).cast("long")).otherwise(fold)


def blocks(blobs: DataFrame, size: int) -> DataFrame:
    """path, block_index, offset, size, data; the last block may be short, an empty blob has none."""
    n = F.octet_length("content")
    rows = blobs.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("i"))
    data = F.substring("content", F.col("i") * size + 1, F.lit(size))
    return rows.select("path", F.col("i").cast("long").alias("block_index"), (F.col("i").cast("long") * size).alias("offset"), F.octet_length(data).alias("size"), data.alias("data"))


def signature(blobs: DataFrame, size: int, quick: bool = False) -> DataFrame:
    """The signature rows of every blob, if asked for with a quick hash. The strong hash is SHA-256."""
    hashes = {"rolling": rolling_blocks} | ({"quick_hash": quick_blocks} if quick else {})
    n, i = F.octet_length("content"), F.col("i").cast("long")
    rows = blobs.where(n > 0).select("path", "content", n.alias("n"), *(by_block(of, size)("content").alias(k) for k, of in hashes.items()))
    cut = rows.select("path", "content", "n", *hashes, F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("i"))
    return cut.select("path", i.alias("block_index"), (i * size).alias("offset"), F.least(F.lit(size), F.col("n") - i * size).cast("int").alias("size"), *(F.col(k)[F.col("i")].alias(k) for k in hashes), F.sha2(F.substring("content", F.col("i") * size + 1, F.lit(size)), 256).alias("strong"))


def etag(content: Column) -> Column:
    """32 hex digits of the whole blob's hash; none for an empty blob."""
    return F.when(F.octet_length(content) > 0, F.substring(F.sha2(content, 256), 1, 32))


def headers(blobs: DataFrame, size: int) -> DataFrame:
    n = F.octet_length("content").cast("long")
    return blobs.select("path", n.alias("file_size"), etag(F.col("content")).alias("source_etag"), F.floor((n + size - 1) / size).alias("n_blocks"))


def stale(source_etag: Column, now: Column) -> Column:
    return ~F.coalesce(source_etag == now, F.lit(False))


# Fixed values of a signature file: its first bytes, version, and largest data.
MAGIC, VERSION, MOST_DATA = b"DLSIG\x01", 1, 100 << 20
_HEAD = len(MAGIC) + 1 + 8
_BLOCK = np.dtype([("size", "<u4"), ("rolling", "<u4"), ("strong", "S32")])


def pack(block: int, file_size: int, sizes: list[int], rollings: list[int], strongs: list[str]) -> bytes:
    """A signature file: magic, version, length, then block and file size and the blocks, compressed."""
    rows = np.array([(n, r, bytes.fromhex(h)) for n, r, h in zip(sizes, rollings, strongs, strict=True)], _BLOCK)
    data = zstandard.compress(struct.pack("<QQQ", block, file_size, len(rows)) + rows.tobytes(), 3)
    return MAGIC + bytes([VERSION]) + struct.pack("<Q", len(data)) + data


def unpack(data: bytes) -> tuple[int, int, np.ndarray]:
    """Block size, file size and blocks of a signature file; ValueError where it is none."""
    if len(data) < _HEAD:
        raise ValueError("too short")
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("bad magic")
    if data[len(MAGIC)] != VERSION:
        raise ValueError(f"version {data[len(MAGIC)]}")
    size = struct.unpack_from("<Q", data, _HEAD - 8)[0]
    if size > MOST_DATA:
        raise ValueError("too large")
    if len(data) < _HEAD + size:
        raise ValueError("truncated")
    try:
        plain = zstandard.decompress(data[_HEAD : _HEAD + size])
        block, file_size, n = struct.unpack_from("<QQQ", plain)
        return block, file_size, np.frombuffer(plain, _BLOCK, n, 24)
    except (zstandard.ZstdError, struct.error, ValueError) as e:
        raise ValueError("not readable") from e


def sidecars(blobs: DataFrame, size: int) -> DataFrame:
    """path (of the sidecar), content: the signature file of every blob; a task holds one blob's blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                cut = [data[i : i + size] for i in range(0, len(data), size)]
                out.append((path + SIDECAR, pack(size, len(data), [len(x) for x in cut], [rolling(x) for x in cut], [hashlib.sha256(x).hexdigest() for x in cut])))
            yield pd.DataFrame(out, columns=["path", "content"])

    return blobs.select("path", "content").mapInPandas(run, "path string, content binary")


def read_sidecars(files: DataFrame) -> DataFrame:
    """Signature rows of signature files (path, content) by the path of their blob, and `problem`: a file
    that is none is one row with the reason and no block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                path = path.removesuffix(SIDECAR)
                try:
                    block, _, rows = unpack(bytes(data))
                except ValueError as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, str(e))], columns=_READ)
                    continue
                at = np.arange(len(rows), dtype=np.int64)
                if not len(rows):
                    continue
                yield pd.DataFrame({"path": path, "block_index": at, "offset": at * block, "size": rows["size"].astype(np.int32), "rolling": rows["rolling"].astype(np.int64), "strong": [bytes(x).ljust(32, b"\0").hex() for x in rows["strong"]], "problem": None})

    return files.select("path", "content").mapInPandas(run, f"{SIGNATURE}, problem string")


_READ = ["path", "block_index", "offset", "size", "rolling", "strong", "problem"]


def write_signature(rows: DataFrame, path: str) -> None:
    """Signature rows as a table; spark.read.parquet reads it back."""
    rows.write.option("compression", "zstd").parquet(path)


def window_checksums(blobs: DataFrame, n: int) -> DataFrame:
    """path, n_windows, sum, min and max of the rolling checksums of a blob's windows of n bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                parts = [(len(w), int(w.sum(dtype=np.uint64)), int(w.min()), int(w.max())) for _, w in rolling_parts(bytes(data), n)]
                out.append((path, sum(p[0] for p in parts), sum(p[1] for p in parts), min((p[2] for p in parts), default=None), max((p[3] for p in parts), default=None)))
            yield pd.DataFrame(out, columns=["path", "n_windows", "total", "low", "high"]).astype({"low": "Int64", "high": "Int64"})

    return blobs.select("path", "content").mapInPandas(run, "path string, n_windows long, total long, low long, high long")
