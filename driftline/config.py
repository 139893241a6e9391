"""Options of a sync, resolved on the driver. They choose expressions and never become columns."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, fields, replace

KIB, MIB = 1 << 10, 1 << 20

# Limits and defaults that decide results.
DELTA_THRESHOLD = 50 * MIB
MIN_BLOCK, MAX_BLOCK = 64 * KIB, 5 * MIB
MIN_PART, FULL_PART, STREAM_CHUNK = 5 * MIB, 16 * MIB, 16 * MIB
SMALL_FILE = 8 * MIB
SIDECAR = ".blocksig"


@dataclass(frozen=True)
class Options:
    checksum: bool = False
    size_only: bool = False
    update: bool = False
    modify_window: int = 0
    existing: bool = False
    ignore_existing: bool = False
    delete: bool = False
    whole_file: bool = False
    no_sidecar: bool = False
    max_size: int = 0
    min_size: int = 0
    delta_threshold: int = DELTA_THRESHOLD
    block_size: int = MAX_BLOCK
    jobs: int = 0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    keep_sidecars: bool = True
    dry_run: bool = False
    backup: bool = False
    backup_dir: str | None = None
    backup_suffix: str = "~"
    archive: bool = False
    links: bool = False

    @property
    def window(self) -> int:
        """Seconds by which equal modification times may differ."""
        return self.modify_window if self.modify_window > 0 else 1

    @property
    def effective_jobs(self) -> int:
        return self.jobs or os.cpu_count() or 1


def parse_size(text: str) -> int:
    """Bytes of "10", "4K", "2MB", ...; an empty text is 0 and anything else an error."""
    found = re.fullmatch(r"(\d*)(?:([KMGT])B?)?", text.strip().upper())
    if not found or (found[2] and not found[1]):
        raise ValueError(f"not a size: {text!r}")
    return int(found[1] or 0) * KIB ** ("KMGT".index(found[2]) + 1 if found[2] else 0)


def block_size(kib: int) -> int:
    """A block size in KiB as bytes, within the limits."""
    return max(MIN_BLOCK, min(MAX_BLOCK, kib * KIB))


def load(path: str) -> Options:
    """Options from a TOML file; keys that it leaves out keep their defaults, unknown ones are ignored."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    known = {x.name for x in fields(Options)}
    return replace(Options(), **{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known})


def merge(base: Options, **given) -> Options:
    """base with the values given on a command line; empty patterns don't replace those of base. Sizes may
    be given as delta_threshold_mb and block_size_kb; archive implies links."""
    found = {k: v for k, v in given.items() if not (k in ("include", "exclude") and not v)}
    if "delta_threshold_mb" in found:
        found["delta_threshold"] = found.pop("delta_threshold_mb") * MIB
    if "block_size_kb" in found:
        found["block_size"] = block_size(found.pop("block_size_kb"))
    if found.get("archive", base.archive):
        found["links"] = True
    return replace(base, **found)


def save(options: Options, path: str) -> None:
    """Options as a TOML file that load() reads; those that are not set are left out."""

    def text(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, tuple):
            return f"[{', '.join(map(text, v))}]"
        return json.dumps(v, ensure_ascii=False)

    with open(path, "w") as f:
        f.writelines(f"{x.name} = {text(v)}\n" for x in fields(Options) if (v := getattr(options, x.name)) is not None)
