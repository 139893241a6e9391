"""Scalar functions, conflicts, retries, readers, streams, and the contract's queries on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from driftline import catalog
from driftline.functions import locations as L
from driftline.functions import text as X
from driftline.operators import reliability as R
from driftline.schema import INVENTORY
from driftline.sources import inventory as I
from driftline.sources import stores
from driftline.streaming import watch

SMALL = "/root/testdata/sf0.001"


def column(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_locations(spark):
    found = column(spark, L.location, "/path/to", "./rel", "s3://my-bucket/path/to", "s3://only", "GS://b/p", "azure://c/x", "user@host:/p", "server:/data", "s3", "a/b:c", "/a:b")
    assert [tuple(x) for x in found] == [
        ("file", None, None, None, "/path/to"), ("file", None, None, None, "./rel"), ("s3", "my-bucket", None, None, "path/to"), ("s3", "only", None, None, ""), ("gs", "b", None, None, "p"),
        ("az", "c", None, None, "x"), ("ssh", None, "user", "host", "/p"), ("ssh", None, None, "server", "/data"), ("file", None, None, None, "s3"), ("ssh", None, None, "a/b", "c"), ("file", None, None, None, "/a:b"),
    ]
    assert column(spark, lambda v: L.to_uri(L.location(v)), "s3://b/p", "s3://b", "u@h:/p", "/x") == ["s3://b/p", "s3://b", "u@h:/p", "/x"]


def test_small_functions(spark):
    assert column(spark, L.parse_size, "", "7", "2k", "3MB", "10B", "1.5M", "x") == [0, 7, 2048, 3 << 20, None, None, None]
    assert column(spark, L.parent, "a/b/c", "c") == ["a/b", None]
    assert column(spark, L.file_name, "a/b/c", "c") == ["c", "c"]
    assert column(spark, lambda v: L.backup_path(v, "/backups/"), "dir/f.txt") == ["/backups/dir/f.txt~"]
    assert column(spark, lambda v: L.strip_prefix(F.lit("pre/"), v), "pre/x", "prex", "y") == ["x", "prex", "y"]
    assert column(spark, L.shell_quoted, "it's") == ["'it'\\''s'"]
    assert [X.duration_text(x) for x in (0.5, 45, 90, 3700)] == ["500ms", "45.0s", "1m 30s", "1h 1m"]
    assert [X.short_duration_text(x) for x in (45, 90, 5400)] == ["45.0s", "1.5m", "1.5h"]
    assert (X.size_text(512), X.size_text(1536), X.count_text(1, "file"), X.count_text(2, "file")) == ("512 B", "1.50 KiB", "1 file", "2 files")
    assert X.shortened("a-long-name.txt", 10) == "...ame.txt"
    assert X.shortened("ééééééé", 8) == "...éé"


def test_retries_conflicts_and_limits(spark):
    rows = spark.createDataFrame([("io", "operation timed out"), ("aws", "ThrottlingException"), ("aws", "denied"), ("config", "timeout"), ("network", None), (None, None)], "k string, m string")
    assert [r[0] for r in rows.select(R.retryable(F.col("k"), F.col("m"))).collect()] == [True, True, False, False, True, False]
    assert [r[0] for r in spark.range(6).select(R.backoff(F.col("id"))).collect()] == [1000, 2000, 4000, 8000, 16000, 30000]
    row = lambda *r: spark.createDataFrame([x + (None,) * (2 - len(x) + 1) for x in r], "path string, size long, etag string")
    found = R.conflicts(row(("a", 1), ("b", 1, "x"), ("c", 1), ("d", 1, "x")), row(("b", 1, "y"), ("c", 2), ("d", 1, "x"), ("e", 1)))
    assert {r["path"]: (r["conflict"], r["was"], r["now"]) for r in found.collect()} == {"a": ("remote_deleted", None, None), "b": ("remote_modified", "x", "y"), "c": ("remote_modified", "size:1", "size:2"), "d": ("none", None, None), "e": ("remote_created", None, None)}
    act = spark.createDataFrame([("none", "fail"), ("remote_modified", "fail"), ("remote_modified", "skip"), ("remote_modified", "overwrite"), ("remote_created", None)], "c string, s string")
    assert [r[0] for r in act.select(R.conflict_action(F.col("c"), F.col("s"))).collect()] == ["proceed", "error", "skip", "proceed", "retry"]
    asks = spark.createDataFrame([("s", 1, 0.0, 1024), ("s", 2, 0.0, 1024), ("s", 3, 0.0, 9999), ("s", 4, 10.0, 2048)], "stream string, seq long, at double, bytes long")
    assert {r["seq"]: r["granted_at"] for r in R.token_bucket(asks, 1).collect()} == {1: 0.0, 2: 1.0, 3: None, 4: 10.0}


def test_readers(spark, tmp_path):
    (tmp_path / "t/sub/deep").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_bytes(b"abc")
    (tmp_path / "t/sub/b.txt").write_bytes(b"hello")
    (tmp_path / "t/sub/deep/c.txt").write_bytes(b"")
    rows = {r["path"]: (r["size"], r["is_dir"]) for r in stores.inventory(spark, str(tmp_path / "t")).collect()}
    assert rows == {"a.txt": (3, False), "sub": (0, True), "sub/b.txt": (5, False), "sub/deep": (0, True), "sub/deep/c.txt": (0, False)}
    assert {r["path"]: r["size"] for r in I.listed(spark, str(tmp_path / "t")).collect()} == {"a.txt": 3, "sub/b.txt": 5}
    (tmp_path / "find.txt").write_text("f\t12\t1700000000.5\t644\ta b\td\nd\t0\t0\t755\tx\nbad\nf\tz\t-1\t9\tq\nd\t1\t1\t755\t\n")
    found = {r["path"]: r for r in I.from_find(spark, str(tmp_path / "find.txt")).collect()}
    assert (found["a b\td"]["size"], found["a b\td"]["mode"], found["x"]["is_dir"], found["x"]["mtime"], found["q"]["size"]) == (12, 0o644, True, None, 0)
    (tmp_path / "none.txt").write_text("")
    with pytest.raises(ValueError, match="empty"):
        I.from_find(spark, str(tmp_path / "none.txt"))
    cut = I.chunks(I.blobs(spark, str(tmp_path / "t")), 2).orderBy("path", "chunk_index").collect()
    assert [bytes(r["data"]) for r in cut] == [b"ab", b"c", b"he", b"ll", b"o"]
    assert [bytes(r[0]) for r in I.blobs(spark, str(tmp_path / "t/a.txt")).select(I.byte_range(F.col("content"), 1, 9)).collect()] == [b"bc"]


def test_arrivals(spark, tmp_path):
    row = lambda p, n: spark.createDataFrame([(p, n, None, False, None, None)], INVENTORY)
    row("a", 1).write.mode("append").parquet(str(tmp_path / "in"))
    row("a", 2).write.mode("append").parquet(str(tmp_path / "in"))
    q = watch.plan_arrivals(watch.arrivals(spark, str(tmp_path / "in")), row("b", 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [(r["path"], r["action"], r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "upload", 2)]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_oracle(spark, oracle, name):
    found = catalog.queries()[name](spark, SMALL)
    want = oracle.sql(catalog.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    tidy = lambda rows: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    assert tidy(tuple(r) for r in found.select(*columns).collect()) == tidy(tuple(r[i] for i in place) for r in want.fetchall())


def test_flagship_counts(spark):
    rows = {r["action"]: (r["n"], r["bytes"]) for r in catalog.queries()["plan_counts"](spark, SMALL).collect()}
    assert rows == {"delete": (16, 43613), "delta": (46, 231813), "mkdir": (13, 0), "skip": (39, 85386), "upload": (96, 131282)}
