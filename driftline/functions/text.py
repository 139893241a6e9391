"""Texts of sizes, durations, rates, percentages and counts, for reports on the driver."""

from __future__ import annotations


def size_text(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024


def rate_text(bytes_per_second: float) -> str:
    return f"{size_text(bytes_per_second)}/s"


def percent_text(x: float) -> str:
    return f"{x:.1f}%"


def count_text(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def duration_text(seconds: float) -> str:
    if seconds < 1:
        return f"{round(seconds * 1000)}ms"
    if seconds < 60:
        return f"{seconds:.1f}s"
    whole = int(seconds)
    if whole < 3600:
        return f"{whole // 60}m {whole % 60}s"
    return f"{whole // 3600}h {whole % 3600 // 60}m"


def short_duration_text(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f}s"
    return f"{seconds / 60:.1f}m" if seconds < 3600 else f"{seconds / 3600:.1f}h"


def shortened(name: str, most: int) -> str:
    """The end of a name, on whole characters, behind an ellipsis."""
    data = name.encode()
    return name if len(data) <= most else "..." + data[-(most - 3) :].decode("utf-8", "ignore")
