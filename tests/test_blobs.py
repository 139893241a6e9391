"""Signatures, deltas, merged and packed ops, rebuilt blobs, and ranges of a download."""

import hashlib
import random

import pytest
import xxhash

from driftline.operators import delta as D
from driftline.operators import parts as P
from driftline.operators import signature as S
from driftline.schema import OPS


def blobs(spark, **content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")


def ops(spark, *rows):
    at, out = 0, []
    for i, (op, source, n) in enumerate(rows):
        out.append(("p", i, op, at, source, n))
        at += n
    return spark.createDataFrame(out, OPS)


def plain_rolling(data):
    a = b = 0
    for x in data:
        a += x
        b += a
    return (b & 0xFFFF) << 16 | a & 0xFFFF


def test_rolling_checksums():
    assert S.rolling(b"") == 0
    assert S.rolling(b"a") == 97 * 65536 + 97
    assert S.rolling(b"hello world") == 436208732
    rng = random.Random(3)
    for n in (15, 16, 255, 256, 5000):
        data = rng.randbytes(n + 40)
        assert S.rolling(data[:n]) == plain_rolling(data[:n])
        assert S.rolling_all(data, n).tolist() == [plain_rolling(data[i : i + n]) for i in range(41)]
    assert len(S.rolling_all(b"abc", 4)) == 0


def test_blocks_and_headers(spark):
    b = blobs(spark, a=b"hello world, this is a test", e=b"", z=bytes(50))
    rows = S.signature(b, 10).orderBy("path", "block_index").collect()
    assert [(r["path"], r["offset"], r["size"]) for r in rows] == [("a", 0, 10), ("a", 10, 10), ("a", 20, 7), *(("z", i, 10) for i in range(0, 50, 10))]
    assert rows[2]["strong"] == hashlib.sha256(b"is a test"[2:]).hexdigest()
    assert {r["path"]: (r["file_size"], r["n_blocks"], r["source_etag"] is None) for r in S.headers(b, 10).collect()} == {"a": (27, 3, False), "e": (0, 0, True), "z": (50, 5, False)}
    same = S.blocks(b, 10).select(S.rolling_checksum("data").alias("x"), S.rolling_checksum_sql(S.F.col("data")).alias("y"))
    assert same.where("x <> y").count() == 0


def test_checksums_are_made_before_blobs_are_cut(spark):
    """Else the whole blob is queued, and spilled, once for each of its blocks."""
    data = random.Random(5).randbytes(70_001)
    for n in (1, 7, 256, 70_000, 80_000):
        for part in (1, 512, 1 << 20):
            assert S.rolling_blocks(data, n, part).tolist() == [S.rolling(data[i : i + n]) for i in range(0, len(data), n)]
    assert S.rolling_blocks(b"\xff" * (3 << 20), 1 << 19).tolist() == [S.rolling(b"\xff" * (1 << 19))] * 6
    rows = S.signature(blobs(spark, a=data, e=b""), 256, quick=True).select("path", "block_index", "size", "rolling", "quick_hash").cache()
    want = [(i, len(x), S.rolling(x), xxhash.xxh3_64_intdigest(x)) for i in range(274) for x in [data[256 * i : 256 * i + 256]]]
    assert [(r["block_index"], r["size"], r["rolling"], r["quick_hash"] % 2**64) for r in rows.orderBy("block_index").collect()] == want
    plan = S.signature(blobs(spark, a=data), 256).select("path", "rolling")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("ArrowEvalPython")


def test_quick_hashes(spark):
    rows = S.signature(blobs(spark, a=b"hello world, this is a test"), 10, quick=True).orderBy("block_index").collect()
    assert [r["quick_hash"] % 2**64 for r in rows] == [xxhash.xxh3_64_intdigest(b"hello world, this is a test"[i : i + 10]) for i in (0, 10, 20)]


@pytest.fixture(scope="module")
def pair(spark):
    rng = random.Random(11)
    olds, news = {}, {}
    for i in range(40):
        old = rng.randbytes(rng.randrange(0, 900)) if i % 3 else bytes(rng.randrange(0, 300))
        new = bytearray(old)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(new) + 1)
            new[at : at + rng.randrange(0, 9)] = rng.randbytes(rng.randrange(0, 70))
        olds[f"p{i}"], news[f"p{i}"] = bytes(old), bytes(new)
    news["fresh"] = b"only new"
    return blobs(spark, **olds), blobs(spark, **news), news


def plain_delta(old, new, n):
    index = {}
    for i in range(len(old) // n):
        index.setdefault(old[i * n : i * n + n], i)
    out, at, start = [], 0, 0
    while at + n <= len(new):
        i = index.get(new[at : at + n])
        if i is None:
            at += 1
            continue
        if at > start:
            out.append(("insert", start, None, at - start))
        out.append(("copy", at, i * n, n))
        at = start = at + n
    if start < len(new) or len(new) < n:
        out.append(("insert", start, None, len(new) - start))
    return out


def test_delta_is_the_plain_greedy_scan(spark, pair):
    old, new, _ = pair
    found = D.delta(new, S.signature(old, 16), 16)
    texts = {r["path"]: bytes(r["content"]) for r in old.collect()}
    for r in new.collect():
        mine = found.where(f"path = '{r['path']}'").orderBy("seq").collect() if r["path"] in ("p1", "p2", "p3", "fresh") else None
        if mine is not None:
            assert [(x["op"], x["target_offset"], x["source_offset"], x["length"]) for x in mine] == plain_delta(texts.get(r["path"], b""), bytes(r["content"]), 16)
    copies = {(r["path"], r["target_offset"], r["source_offset"] // 16) for r in found.where("op = 'copy'").collect()}
    assert copies == {(r["path"], r["place"], r["block_index"]) for r in D.relational(new, S.signature(old, 16), 16).collect()}


def test_every_form_rebuilds_the_new_blob(spark, pair):
    old, new, news = pair
    found = D.delta(new, S.signature(old, 16), 16)
    merged = P.merged(found)
    for rows, kind in ((found, "op"), (merged, "op"), (P.packed(merged, 100), "kind"), (P.split(merged, 30), "kind")):
        assert P.verified(P.applied(rows, old, new, kind), new).where("NOT ok").count() == 0
    totals = {r["path"]: r for r in D.totals(found).collect()}
    for path, data in news.items():
        r = totals[path]
        assert r["bytes_reused"] + r["bytes_new"] == r["target_size"] == len(data)
    by = {}
    for r in P.packed(merged, 100).orderBy("path", "part_number").collect():
        by.setdefault(r["path"], []).append(r)
    for path, rows in by.items():
        assert [r["part_number"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(r["length"] >= 100 for r in rows[:-1])
        assert sum(r["length"] for r in rows) == len(news[path])


def test_cases_of_the_delta(spark):
    one = lambda old, new, n: [(r["op"], r["source_offset"], r["length"]) for r in D.delta(blobs(spark, p=new), S.signature(blobs(spark, p=old), n), n).orderBy("seq").collect()]
    text = b"x" * 3 + bytes(range(49))
    assert [x[0] for x in one(text, text, 10)] == ["copy"] * 5 + ["insert"]
    assert one(b"ABCDEFGH" * 2, b"ABCDEFGH12345678", 8) == [("copy", 0, 8), ("insert", None, 8)]
    zeros = bytes(20 * 512)
    assert one(zeros, zeros[:-512] + b"\1" * 512, 512) == [("copy", 0, 512)] * 19 + [("insert", None, 512)]
    assert one(b"", b"", 8) == [("insert", None, 0)]


def test_merge_pack_and_split(spark):
    form = lambda df: [(r[df.columns[2]], r["source_offset"], r["length"]) for r in df.orderBy(df.columns[1]).collect()]
    assert form(P.merged(ops(spark, ("copy", 0, 10), ("copy", 10, 20), ("copy", 30, 30)))) == [("copy", 0, 60)]
    assert form(P.merged(ops(spark, ("copy", 0, 20), ("insert", None, 3), ("insert", None, 3), ("copy", 50, 30)))) == [("copy", 0, 20), ("insert", None, 6), ("copy", 50, 30)]
    assert len(form(P.merged(ops(spark, ("copy", 0, 10), ("copy", 50, 10))))) == 2
    assert form(P.split(ops(spark, ("copy", 0, 25)), 10)) == [("copy", 0, 10), ("copy", 10, 10), ("copy", 20, 5)]
    assert form(P.packed(ops(spark, ("insert", None, 3), ("copy", 0, 10)), 100)) == [("upload", None, 13)]
    assert form(P.packed(ops(spark, ("insert", None, 3), ("copy", 5, 30)), 10)) == [("upload", None, 10), ("copy", 12, 23)]
    assert form(P.packed(ops(spark, ("insert", None, 12), ("copy", 5, 4), ("insert", None, 2)), 10)) == [("upload", None, 12), ("upload", None, 6)]
    assert form(P.packed(ops(spark, ("copy", 0, 0)), 10)) == []


def test_download_asks_for_what_local_lacks(spark):
    local, remote = b"abcdefgh" * 4 + b"tail", b"abcdefgh" + b"ZZZZZZZZ" * 2 + b"efghabcd" + b"tail"
    ranges = D.download_ranges(blobs(spark, p=local), S.signature(blobs(spark, p=remote, q=b"12345678"), 8), 8)
    assert [r["local_offset"] is None for r in ranges.where("path = 'p'").orderBy("block_index").collect()] == [False, True, True, False, False]
    totals = {r["path"]: (r["bytes_reused"], r["bytes_downloaded"], r["range_requests"]) for r in D.download_totals(ranges).collect()}
    assert totals == {"p": (20, 16, 1), "q": (0, 8, 1)}
