"""Commands: sync, sign, config, providers.

    python -m driftline sync SOURCE DESTINATION [--delete] [--dry-run] ...
    python -m driftline sign FILE [--output FILE] [--block-size KIB]
    python -m driftline config [--init FILE]
    python -m driftline providers
"""

from __future__ import annotations

import argparse
import sys

from driftline.config import Options, block_size, load, merge, parse_size, save
from driftline.functions import locations as L
from driftline.functions.text import size_text


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("driftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    sync = commands.add_parser("sync", help="make the destination like the source")
    sync.add_argument("source")
    sync.add_argument("destination")
    sync.add_argument("--config", help="a TOML file of options")
    for flag in ("checksum", "size-only", "update", "existing", "ignore-existing", "delete", "whole-file", "no-sidecar", "dry-run", "backup", "archive"):
        sync.add_argument(f"--{flag}", action="store_true", default=None)
    for value in ("modify-window", "delta-threshold-mb", "block-size-kb", "jobs"):
        sync.add_argument(f"--{value}", type=int)
    for size in ("max-size", "min-size"):
        sync.add_argument(f"--{size}", type=parse_size)
    for text in ("backup-dir", "backup-suffix", "itemize-to"):
        sync.add_argument(f"--{text}")
    for many in ("include", "exclude"):
        sync.add_argument(f"--{many}", action="append", default=[])
    sign = commands.add_parser("sign", help="write a file's signature")
    sign.add_argument("file")
    sign.add_argument("--output")
    sign.add_argument("--block-size", type=int, default=5 * 1024, help="KiB")
    config = commands.add_parser("config", help="show the options, or write them to a file")
    config.add_argument("--init")
    commands.add_parser("providers", help="list storage providers and their regions")
    return top


def _sync(given: argparse.Namespace) -> int:
    from driftline.operators.diff import diff
    from driftline.operators.plan import itemized
    from driftline.scratch import written
    from driftline.sinks.apply import apply, observed, write_itemized
    from driftline.sources.stores import inventory

    known = Options.__dataclass_fields__.keys() | {"delta_threshold_mb", "block_size_kb"}
    base = load(given.config) if given.config else Options()
    o = merge(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in vars(given).items() if k in known and v is not None})
    spark = _session()
    there = written(inventory(spark, given.destination))
    actions = written(diff(inventory(spark, given.source), there, o))
    if given.itemize_to:
        write_itemized(itemized(actions, there), given.itemize_to)
    stats = observed(apply(actions, given.source, given.destination, o)).first().asDict()
    verb = "would be " if o.dry_run else ""
    print(f"{stats['files_uploaded'] + stats['files_delta']} files {verb}sent, {stats['files_skipped']} skipped, {stats['files_deleted']} {verb}deleted, {size_text(stats['bytes_transferred'])}, {stats['errors']} errors")
    return 1 if stats["errors"] else 0


def _sign(given: argparse.Namespace) -> int:
    from driftline.operators.signature import sidecars

    size, out = block_size(given.block_size), given.output or given.file + ".blocksig"
    with open(given.file, "rb") as f:
        blob = f.read()
    row = sidecars(_session().createDataFrame([(given.file, bytearray(blob))], "path string, content binary"), size).first()
    with open(out, "wb") as f:
        f.write(row["content"])
    print(f"{out}: {-(-len(blob) // size)} blocks of {size} bytes")
    return 0


def main(words: list[str]) -> int:
    given = _arguments().parse_args(words)
    if given.command == "sync":
        return _sync(given)
    if given.command == "sign":
        return _sign(given)
    if given.command == "config":
        if given.init:
            save(Options(), given.init)
        else:
            print("\n".join(f"{k} = {getattr(Options(), k)}" for k in Options.__dataclass_fields__))
        return 0
    for name, aliases, regions, url in L.PROVIDERS:
        print(f"{name} ({', '.join(aliases)}): {', '.join(regions) or url}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
