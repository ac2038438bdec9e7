"""Scores and number formats, the same whatever the machine's language."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

VERIFIED_AT = 0.9


def rounded(x: float, places: int) -> float:
    """x rounded half up on its exact binary value, as the written number reads."""
    return float(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def percent(share: float, places: int) -> str:
    return f"{Decimal(share * 100).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)}%"


def thousands(n: int) -> str:
    return f"{n:,}"


def score(resolve: float, token: bool, name: bool, suffix: bool) -> float:
    """Confidence: mostly what was measured, a little for how the target was found; never certain."""
    return rounded(min(0.70 * resolve + 0.20 * token + 0.05 * name + 0.05 * suffix, 0.99), 3)


def share_text(x: float) -> str:
    """A share in the pages: whole at the ends, one place in between, two near the ends."""
    if x in (0, 1):
        return percent(x, 0)
    return percent(x, 1 if 0.001 <= x <= 0.999 else 2)


def page_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{int(n):,} B" if unit == "B" else f"{n:,.1f} {unit}"
        n /= 1024
    return f"{n:,.1f} GB"


def log_bytes(n: float) -> str:
    return f"{n / 1e9:,.1f} GB" if n >= 1e9 else f"{n / 1e6:,.1f} MB"


def duration(seconds: float) -> str:
    s = int(seconds)
    if s >= 3600:
        return f"{s // 3600}h {s % 3600 // 60:02d}m"
    return f"{s // 60}m {s % 60:02d}s" if s >= 60 else f"{s}s"
