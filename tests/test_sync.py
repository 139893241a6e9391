"""Rule-level cases on literal rows: the expected actions of each comparison rule."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from driftline.config import MIB, Options, block_size, load, merge, parse_size
from driftline.operators import plan as plans
from driftline.operators.diff import diff, glob, heads, one_row_a_path
from driftline.schema import INVENTORY

T = datetime(2024, 1, 1)


def inv(spark, *rows):
    """rows: path, size, and by name mtime, is_dir, mode, etag."""
    full = [(r[0], r[1], *(dict(mtime=T, is_dir=False, mode=420, etag=None) | (r[2] if len(r) > 2 else {})).values()) for r in rows]
    return spark.createDataFrame(full, INVENTORY)


def acts(spark, source, dest, **options):
    return {r["path"]: r["action"] for r in diff(inv(spark, *source), inv(spark, *dest), Options(**options)).collect()}


BIG, LESS = 100 * MIB, 99 * MIB


@pytest.mark.parametrize(
    ("source", "dest", "options", "expected"),
    [
        ([("a", 100)], [], {}, {"a": "upload"}),
        ([("a", 100)], [("a", 100)], {}, {"a": "skip"}),
        ([], [("old", 50)], {"delete": True}, {"old": "delete"}),
        ([], [("old", 50)], {}, {}),
        ([("l", BIG)], [("l", LESS)], {}, {"l": "delta"}),
        ([("l", BIG)], [], {}, {"l": "upload"}),
        ([("l", BIG)], [("l", LESS)], {"whole_file": True}, {"l": "upload"}),
        ([("l", BIG)], [("l", LESS)], {"no_sidecar": True}, {"l": "upload"}),
        ([("a", 100)], [("a", 50)], {"ignore_existing": True}, {"a": "skip"}),
        ([("a", 100)], [], {"existing": True}, {}),
        ([("a", 100, {"mtime": datetime(1970, 1, 1)})], [("a", 100)], {"size_only": True}, {"a": "skip"}),
        ([("a", 100, {"etag": "abc"})], [("a", 100, {"etag": "abc"})], {"checksum": True}, {"a": "skip"}),
        ([("a", 100, {"etag": "abc"})], [("a", 100, {"etag": "def"})], {"checksum": True}, {"a": "upload"}),
        ([("a", 100)], [("a", 100, {"etag": "def"})], {"checksum": True}, {"a": "upload"}),
        ([("l", BIG)], [], {"max_size": 50 * MIB}, {}),
        ([("t", 100)], [], {"min_size": 1024}, {}),
        ([("l", BIG)], [("l", 5)], {"max_size": 50 * MIB, "delete": True}, {}),
        ([("k", 100)], [("k", 100), ("x", 200)], {"delete": True}, {"k": "skip", "x": "delete"}),
        ([("a", 9)], [("a", 8, {"mtime": T + timedelta(seconds=5)})], {"update": True}, {"a": "skip"}),
        ([("a", 9)], [("a", 8, {"mtime": T - timedelta(seconds=5)})], {"update": True}, {"a": "upload"}),
        ([("a", 9)], [("a", 8, {"mtime": None})], {"update": True}, {"a": "upload"}),
        ([("a", 9)], [("a", 9, {"mtime": None})], {}, {"a": "skip"}),
        ([("a", 9)], [("a", 9, {"mtime": T + timedelta(seconds=1.999)})], {}, {"a": "skip"}),
        ([("a", 9)], [("a", 9, {"mtime": T + timedelta(seconds=2)})], {}, {"a": "upload"}),
        ([("a", 9)], [("a", 9, {"mtime": T + timedelta(seconds=90)})], {"modify_window": 90}, {"a": "skip"}),
        ([("d", 0, {"is_dir": True})], [], {}, {"d": "mkdir"}),
        ([("d", 0, {"is_dir": True})], [("d", 0, {"is_dir": True})], {}, {}),
        ([], [("d", 0, {"is_dir": True})], {"delete": True}, {"d": "delete"}),
        ([], [("a.blocksig", 3)], {"delete": True}, {}),
        ([("a.blocksig", 3)], [("a.blocksig", 3)], {"delete": True}, {"a.blocksig": "skip"}),
        ([], [("a.blocksig", 3)], {"delete": True, "keep_sidecars": False}, {"a.blocksig": "delete"}),
        ([("x/a.txt", 1), ("x/a.md", 1)], [], {"exclude": ("**/*.md",)}, {"x/a.txt": "upload"}),
        ([("x/a.txt", 1), ("x/a.md", 1)], [], {"exclude": ("**",), "include": ("x/*.md",)}, {"x/a.md": "upload"}),
    ],
)
def test_one_action_a_rule(spark, source, dest, options, expected):
    assert acts(spark, source, dest, **options) == expected


def test_plan_order_estimates_and_totals(spark):
    source = inv(spark, ("b", 5), ("a", 5), ("d", 0, {"is_dir": True}), ("l", 1004), ("s", 7))
    dest = inv(spark, ("l", 1), ("s", 7), ("z", 3))
    found = diff(source, dest, Options(delete=True, delta_threshold=1000))
    rows = plans.ordered(found).collect()
    assert [(r["path"], r["action"]) for r in rows] == [("d", "mkdir"), ("a", "upload"), ("b", "upload"), ("l", "delta"), ("s", "skip"), ("z", "delete")]
    assert [r["estimated_bytes"] for r in rows] == [0, 5, 5, 200, 0, 0]
    assert plans.totals(found).first().asDict() == {"total_bytes": 210, "bytes_saved": 804}
    stats = plans.run_stats(found, 2.0).first()
    assert (stats["bytes_total"], stats["bytes_transferred"], stats["bytes_per_second"]) == (1014, 210, 105.0)
    assert "2 files would be uploaded" in plans.report(stats.asDict(), dry_run=True)
    assert plans.run_stats(found.limit(0), 0).first()["savings_percent"] == 0.0


def test_children_of_a_deleted_directory_are_implied(spark):
    found = diff(inv(spark), inv(spark, ("d", 0, {"is_dir": True}), ("d/x", 1), ("dx", 1)), Options(delete=True))
    assert {r["path"]: r["implied"] for r in plans.positions(found).collect()} == {"d": False, "d/x": True, "dx": False}


def test_itemized_lines(spark):
    source = inv(spark, ("new", 1), ("same", 1), ("chg", 2, {"mode": 493}), ("d", 0, {"is_dir": True}))
    dest = inv(spark, ("same", 1), ("chg", 1), ("gone", 1))
    lines = {r["path"]: r["line"] for r in plans.itemized(diff(source, dest, Options(delete=True)), dest).collect()}
    assert lines == {"new": "<fcstpog... new", "same": ".f......... same", "chg": "<fcs.p..... chg", "d": "cdcstpog... d", "gone": "*deleting   gone"}


def test_modes(spark):
    found = diff(inv(spark, ("a", 10), ("l", 5000)), inv(spark, ("l", 1)), Options(delta_threshold=1000))
    mode = lambda *a: {r["path"]: r["mode"] for r in plans.execution_modes(found, *a, 1000, 100).collect()}
    assert mode(True, False, True) == {"a": "memory", "l": "delta_upload"}
    assert mode(True, False, False)["l"] == "full_upload"
    assert mode(False, True, False)["l"] == "delta_download"
    assert mode(False, False, False)["l"] == "full_transfer"
    assert mode(True, True, False)["a"] == "kernel_copy"


def test_newest_row_and_heads(spark):
    twice = inv(spark, ("a", 1), ("a", 2, {"mtime": T + timedelta(1)}), ("b", 1))
    assert {r["path"]: r["size"] for r in one_row_a_path(twice).collect()} == {"a": 2, "b": 1}
    assert {r["path"]: r["found"] for r in heads(twice.where("size = 1"), inv(spark, ("a", 0), ("c", 0))).collect()} == {"a": True, "c": False}


def test_options(tmp_path):
    assert [parse_size(x) for x in ("", "10", " 4k", "2MB", "1g", "3TB")] == [0, 10, 4096, 2 * MIB, 1 << 30, 3 << 40]
    for bad in ("10B", "1.5M", "K", "-1", "x"):
        with pytest.raises(ValueError, match="not a size"):
            parse_size(bad)
    assert (block_size(1), block_size(1024), block_size(99999)) == (64 << 10, MIB, 5 * MIB)
    (tmp_path / "o.toml").write_text('checksum = true\ninclude = ["a"]\nunknown = 1\n')
    o = load(str(tmp_path / "o.toml"))
    assert o == replace(Options(), checksum=True, include=("a",))
    assert merge(o, include=(), delete=True) == replace(o, delete=True)
    assert Options().window == 1
    assert Options(modify_window=5).window == 5
    assert glob("a/*.t?t") == r"^a/[^/]*\.t[^/]t$"
