"""Schemas of the relations and the closed domains of their string columns."""

from __future__ import annotations

INVENTORY = "path string, size long, mtime timestamp, is_dir boolean, mode int, etag string"
SIGNATURE = "path string, block_index long, offset long, size int, rolling long, strong string"
OPS = "path string, seq int, op string, target_offset long, source_offset long, length long"
PARTS = "path string, part_number int, kind string, source_offset long, target_offset long, length long"
RESUME = "local_path string, remote_path string, upload_id string, local_size long, local_mtime long, started_at long, completed_parts array<struct<part_number:int,etag:string,size:long>>"

ACTIONS = ("mkdir", "upload", "download", "delta", "skip", "delete")
#: Order of actions in a plan.
RANK = {"mkdir": 0, "upload": 1, "download": 1, "delta": 2, "skip": 3, "delete": 4}
