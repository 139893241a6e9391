"""Plans applied to trees, uploads in parts, saved uploads, signature files, and the commands."""

import os
import struct
import threading
import time
import tracemalloc

import numpy as np
import pytest
import zstandard

from driftline.__main__ import main
from driftline.catalog import multipart_restored
from driftline.config import Options, load, merge, save
from driftline.operators import delta as D
from driftline.operators import signature as S
from driftline.schema import INVENTORY, RESUME
from driftline.sinks import apply as K
from driftline.sinks import multipart
from driftline.sinks.resume import Uploads
from driftline.sources import stores


@pytest.fixture
def trees(tmp_path):
    """Two folders, and a function that writes files (path, content) into one of them."""
    for name in ("a", "b"):
        (tmp_path / name).mkdir()

    def write(side, **files):
        for path, data in files.items():
            target = tmp_path / side / path.replace("__", "/").replace("_txt", ".txt")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)

    return str(tmp_path / "a"), str(tmp_path / "b"), write


def read(root):
    return {os.path.relpath(os.path.join(top, x), root): open(os.path.join(top, x), "rb").read() for top, _, names in os.walk(root) for x in names}


def stats(log):
    return K.observed(log, 2.0).first().asDict()


def test_new_files(spark, trees):
    a, b, write = trees
    write("a", file1_txt=b"hello world", file2_txt=b"goodbye world", subdir__file3_txt=b"nested file")
    os.chmod(f"{a}/file1.txt", 0o640)
    os.utime(f"{a}/file1.txt", (1_700_000_000, 1_700_000_000.5))
    s = stats(K.sync(spark, a, b))
    assert read(b) == read(a)
    assert (s["files_uploaded"], s["dirs_made"], s["bytes_transferred"], s["errors"], s["bytes_per_second"]) == (3, 1, 35, 0, 17.5)
    assert os.stat(f"{b}/file1.txt").st_mode & 0o777 == 0o640
    assert os.stat(f"{b}/file1.txt").st_mtime == 1_700_000_000.5
    # a second run has nothing to do
    assert {r["action"] for r in K.sync(spark, a, b).collect()} == {"skip"}


def test_modified_and_identical_files(spark, trees):
    a, b, write = trees
    write("a", file_txt=b"this is the new updated content", same_txt=b"same content")
    write("b", file_txt=b"old", same_txt=b"same content")
    s = stats(K.sync(spark, a, b))
    assert read(b)["file.txt"] == b"this is the new updated content"
    assert (s["files_uploaded"], s["files_skipped"]) == (1, 1)


def test_dry_run(spark, trees):
    a, b, write = trees
    write("a", file_txt=b"content")
    s = stats(K.sync(spark, a, b, Options(dry_run=True)))
    assert read(b) == {}
    assert (s["files_uploaded"], s["bytes_transferred"]) == (1, 7)


def test_deletes_and_hidden_files(spark, trees):
    a, b, write = trees
    write("a", keep_txt=b"k", **{".hid": b"h", "empty": b""})
    write("b", keep_txt=b"k", extra_txt=b"x", old__deep__gone_txt=b"g", **{".hid": b"h", "empty": b"", "x.blocksig": b"s"})
    s = stats(K.sync(spark, a, b, Options(delete=True)))
    assert read(b) == {**read(a), "x.blocksig": b"s"}
    assert not os.path.exists(f"{b}/old")
    assert (s["files_deleted"], s["errors"]) == (4, 0)


def test_backups_errors_and_logs(spark, trees, tmp_path):
    a, b, write = trees
    write("a", dir__f_txt=b"new one", g_txt=b"1")
    write("b", dir__f_txt=b"old", gone_txt=b"bye")
    s = stats(K.sync(spark, a, b, Options(delete=True, backup=True, backup_suffix=".bak")))
    assert read(b) == {**read(a), "dir/f.txt.bak": b"old", "gone.txt.bak": b"bye"}
    assert s["files_kept"] == 2
    # a file that is gone before it is read is a row with an error, and the others go on
    rows = spark.createDataFrame([("nowhere.txt", 1, None, False, None, None, "upload"), ("g.txt", 1, None, False, None, None, "upload"), ("never.txt", 1, None, False, None, None, "delete")], INVENTORY + ", action string")
    log = {r["path"]: r["error"] for r in K.apply(rows, a, b).collect()}
    assert log["nowhere.txt"].startswith("FileNotFoundError")
    assert (log["g.txt"], log["never.txt"]) == (None, None)
    assert not [x for x in read(b) if K.TEMPORARY in x]
    lines = spark.createDataFrame([("b", "second"), ("a", "first")], "path string, line string")
    K.write_itemized(lines, str(tmp_path / "log"))
    K.write_itemized(lines, str(tmp_path / "log"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["first", "first", "second", "second"]


def test_inventories_by_location(spark, trees, tmp_path, monkeypatch):
    a, _, write = trees
    write("a", x__y__z__file_txt=b"1", **{"_u": b"", "it's": b"22"})
    os.symlink(a, f"{a}/x/loop")
    rows = {r["path"]: (r["size"], r["is_dir"]) for r in stores.inventory(spark, "file://" + a).collect() if r["path"] != "x/loop"}
    want = {"x": (0, True), "x/y": (0, True), "x/y/z": (0, True), "x/y/z/file.txt": (1, False), "_u": (0, False), "it's": (2, False)}
    assert rows == want
    monkeypatch.setattr(stores, "OPENED", 2)
    assert {r["path"]: (r["size"], r["is_dir"]) for r in stores.inventory(spark, a).collect() if r["path"] != "x/loop"} == want
    assert stores.inventory(spark, f"{a}/none").count() == 0
    (tmp_path / "find.txt").write_text("f\t12\t1700000000.5\t644\tq\n")
    assert [r["path"] for r in stores.inventory(spark, "user@host:/p", str(tmp_path / "find.txt")).collect()] == ["q"]
    with pytest.raises(ValueError, match="listing"):
        stores.inventory(spark, "user@host:/p")
    assert [stores.scheme(x) for x in ("s3://b/p", "AZURE://c", "gs://b", "/a:b", "h:p", "rel/x", "file:/x")] == ["s3", "az", "gs", "file", "ssh", "file", "file"]
    tagged = stores.with_etags(stores.inventory(spark, a).where("path = '_u' OR path LIKE 'it%'"), a).orderBy("path").collect()
    assert [(r["path"], r["etag"] is None) for r in tagged] == [("_u", True), ("it's", False)]


def test_parts(spark, tmp_path):
    where = str(tmp_path)
    parts = spark.createDataFrame([("f", 2, bytearray(b"two")), ("f", 1, bytearray(b"one")), ("g/h", 1, bytearray(b"x"))], "path string, part_number int, data binary")
    upload = multipart.create(where)
    done = multipart.upload_parts(parts, where, upload)
    assert {(r["path"], r["part_number"], r["size"]) for r in done.collect()} == {("f", 1, 3), ("f", 2, 3), ("g/h", 1, 1)}
    assert multipart.complete(done.where("part_number = 2"), where, upload).first()["error"] == "parts are missing"
    assert multipart.complete(done, where, upload).agg({"bytes": "sum"}).first()[0] == 7
    assert read(where) == {"f": b"onetwo", "g/h": b"x"}
    upload = multipart.create(where)
    multipart.upload_parts(parts, where, upload)
    multipart.abort(where, upload)
    multipart.abort(where, upload)
    assert read(where) == {"f": b"onetwo", "g/h": b"x"}


def test_parts_share_files_and_are_dropped_in_turn(spark, tmp_path):
    where = str(tmp_path)
    rows = [(f"d{i % 3}/{i}", n, f"{i}:{n};".encode()) for i in range(40) for n in range(1, 8)]
    parts = spark.createDataFrame(rows, "path string, part_number int, data binary").coalesce(2)
    whole = {f"d{i % 3}/{i}": "".join(f"{i}:{n};" for n in range(1, 8)).encode() for i in range(40)}
    upload = multipart.create(where)
    done = multipart.upload_parts(parts.withColumn("data", S.F.expr("CASE WHEN part_number = 2 THEN CAST('spoilt' AS BINARY) ELSE data END")), where, upload)
    assert len(read(where)) <= 2 * (multipart.LOTS + 1) < done.count()  # not a block of disk a part
    done = done.where("part_number <> 2").unionByName(multipart.upload_parts(parts.where("part_number = 2"), where, upload))
    # without the file of a lot, its paths stay as they are, and the parts of later lots stay
    store = os.path.join(where, upload)
    lots = sorted(x for x in os.listdir(store) if x != "index")
    lost = [os.path.join(store, lots[3], x) for x in os.listdir(os.path.join(store, lots[3]))]
    for x in lost:
        os.rename(x, x + ".away")
    log = multipart.complete(done, where, upload).collect()
    failed = {r["path"] for r in log if r["error"] == "parts are missing"}
    assert failed and {k: v for k, v in read(where).items() if not k.startswith(upload)} == {k: v for k, v in whole.items() if k not in failed}
    assert sorted(x for x in os.listdir(store) if x != "index") == lots[3:]
    for x in lost:
        os.rename(x + ".away", x)
    log = multipart.complete(done, where, upload)
    assert log.where("error IS NOT NULL").isEmpty() and {r["path"]: r["bytes"] for r in log.collect()} == {k: len(v) for k, v in whole.items()}
    assert read(where) == whole


def test_contents_are_read_without_a_join(spark, tmp_path):
    """A join's estimate is that of the listing, so that all contents could be broadcast."""
    (tmp_path / "f").write_bytes(b"one")
    (tmp_path / "large").write_bytes(bytes(stores.HELD + 1))
    files = spark.createDataFrame([("large", 7), ("f", 8), ("none", None), ("f", 9)], "path string, n long").coalesce(1)
    found = [(r["path"], r["n"], None if r["content"] is None else len(r["content"])) for r in stores.contents(files, str(tmp_path), ("n",)).collect()]
    assert found == [("large", 7, stores.HELD + 1), ("f", 8, 3), ("none", None, None), ("f", 9, 3)]
    documents = spark.createDataFrame([(i, "words " * 700, "en", "s", 4200) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    restored = multipart_restored(spark, str(tmp_path))
    assert "Join" not in restored._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["size"] for r in restored.collect()) == [4200] * 5 + [4201] * 2 + [4205] * 2


def test_saved_uploads(spark, tmp_path):
    store = Uploads(spark, str(tmp_path / "u"))
    assert store.pending().count() == 0
    row = lambda p, size, at: (p, f"s3://b/{p}", "id", size, at, at, [(1, "e", 5)])
    store.save(spark.createDataFrame([row("a", 5, 100), row("b", 6, 200)], RESUME))
    store.save(spark.createDataFrame([row("a", 7, 100)], RESUME))
    assert {r["local_path"]: r["local_size"] for r in store.pending().collect()} == {"a": 7, "b": 6}
    local = spark.sql("SELECT 'a' AS path, 7L AS size, timestamp_seconds(101) AS mtime, false AS is_dir, 1 AS mode, 'x' AS etag UNION ALL SELECT 'b', 6L, timestamp_seconds(202), false, 1, 'x'")
    assert [r["local_path"] for r in store.load(local).collect()] == ["a"]
    assert [(r["local_path"], r["completed_parts"][0]["etag"]) for r in store.pending().collect()] == [("a", "e")]
    assert store.clean_up(200, 100) == 0
    assert store.clean_up(201, 100) == 1
    assert store.pending().count() == 0


def test_signature_files(spark, tmp_path):
    blobs = spark.createDataFrame([("e", bytearray()), ("f", bytearray(b"hello world, this is a test")), ("z", bytearray(1000))], "path string, content binary")
    files = S.sidecars(blobs, 10)
    back = S.read_sidecars(files).drop("problem")
    assert sorted(back.collect()) == sorted(S.signature(blobs, 10).collect())
    S.write_signature(S.signature(blobs, 10), str(tmp_path / "s"))
    assert sorted(spark.read.parquet(str(tmp_path / "s")).collect()) == sorted(back.collect())
    good = bytes(files.where("path = 'f.blocksig'").first()["content"])
    assert S.unpack(good)[:2] == (10, 27)
    long = struct.pack("<Q", S.MOST_DATA + 1)
    bad = {good[:14]: "too short", b"X" + good[1:]: "bad magic", good[:6] + b"\7" + good[7:]: "version 7", good[:7] + long + good[15:]: "too large", good[:-1]: "truncated", good[:7] + struct.pack("<Q", 3) + b"abc": "not readable", good[:7] + struct.pack("<Q", len(x := zstandard.compress(b"1"))) + x: "not readable"}
    for data, reason in bad.items():
        with pytest.raises(ValueError, match=reason):
            S.unpack(data)
    rows = spark.createDataFrame([(str(i), bytearray(x)) for i, x in enumerate(bad)], "path string, content binary")
    assert [r["problem"] for r in S.read_sidecars(rows).orderBy("path").collect()] == list(bad.values())


def test_a_large_pair_in_little_memory():
    block, rng = 5 << 20, np.random.default_rng(7)
    old = rng.integers(0, 256, 200 << 20, dtype=np.uint8).tobytes()
    new = old[: 100 << 20] + bytes(2 << 20) + old[102 << 20 :]
    index = {}
    for i in range(len(old) // block):
        one = old[i * block : (i + 1) * block]
        index.setdefault(S.rolling_all(one, block)[0].item(), {}).setdefault(__import__("hashlib").sha256(one).hexdigest(), i)
    tracemalloc.start()
    found = D.greedy(new, block, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for op, _, _, n in found if op == "copy") >= 0.9 * len(new)
    assert sum(n for *_, n in found) == len(new)
    assert peak < 300 << 20


def test_options_are_saved_and_merged(tmp_path):
    o = merge(Options(), archive=True, delta_threshold_mb=3, block_size_kb=1, include=(), exclude=("*.o", 'a"b'), backup_dir="/b")
    assert (o.links, o.delta_threshold, o.block_size) == (True, 3 << 20, 64 << 10)
    save(o, str(tmp_path / "o.toml"))
    assert load(str(tmp_path / "o.toml")) == o


def test_retries_and_cancellation(spark):
    slept, tries = [], []

    def fails():
        tries.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        K.retried(fails, 3, sleep=slept.append)
    assert (len(tries), slept) == (4, [1.0, 2.0, 4.0])
    with pytest.raises(KeyError):
        K.retried(lambda: {}["x"], sleep=slept.append)
    assert len(slept) == 3
    seen = []

    def stop():
        for _ in range(100):
            time.sleep(0.1)
            if found := K.progress(spark):
                seen.extend(found)
                K.cancel(spark, "long")
                return

    thread = threading.Thread(target=stop)
    thread.start()
    with pytest.raises(Exception, match="(?i)cancel"):
        K.cancellable(spark, "long", lambda: spark.range(0, 1 << 42, 1, 8).selectExpr("sum(hash(id))").collect())
    thread.join()
    assert seen[0]["tasks"] >= 1
    assert spark.range(3).count() == 3


def test_commands(spark, trees, tmp_path, capsys):
    a, b, write = trees
    write("a", one_txt=b"1", two_txt=b"22")
    write("b", old_txt=b"x")
    assert main(["sync", a, b, "--delete", "--dry-run"]) == 0
    assert "2 files would be sent" in capsys.readouterr().out
    assert main(["sync", a, b, "--delete", "--max-size", "1", "--itemize-to", str(tmp_path / "log")]) == 0
    assert "1 files sent, 0 skipped, 1 deleted" in capsys.readouterr().out
    assert read(b) == {"one.txt": b"1"}
    assert main(["sign", f"{a}/two.txt", "--block-size", "64"]) == 0
    with open(f"{a}/two.txt.blocksig", "rb") as f:
        assert S.unpack(f.read())[1] == 2
    assert main(["config", "--init", str(tmp_path / "c.toml")]) == 0
    assert main(["config"]) == 0
    assert main(["providers"]) == 0
    out = capsys.readouterr().out
    assert "minio (minio): a server's own endpoint is needed" in out
    assert load(str(tmp_path / "c.toml")) == Options()
