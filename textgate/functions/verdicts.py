"""Probabilities, verdicts and interval estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("SAFE", "UNCERTAIN", "SCAM")
Z95 = 1.959963984540054
TINY = 2.2250738585072014e-308


def softmax(scores: list[Column], temperature: float = 1.0) -> list[Column]:
    top = F.greatest(*scores)
    e = [F.exp((s - top) / F.lit(float(temperature))) for s in scores]
    return [x / sum(e[1:], e[0]) for x in e]


def verdict(safe: Column, scam: Column, scam_at: float, safe_at: float, safe_max_scam: float | None = None) -> Column:
    """SCAM first, then SAFE (below the cap on SCAM where there is one), else UNCERTAIN."""
    for x in (scam_at, safe_at, safe_max_scam):
        if x is not None and not 0 <= x <= 1:
            raise ValueError("thresholds must be in [0, 1]")
    allowed = safe >= safe_at if safe_max_scam is None else (safe >= safe_at) & (scam < safe_max_scam)
    return F.when(scam >= scam_at, F.lit("SCAM")).when(allowed, F.lit("SAFE")).otherwise(F.lit("UNCERTAIN"))


def top_label(safe: Column, uncertain: Column, scam: Column) -> Column:
    """The most probable label; earlier labels win ties."""
    return F.when((safe >= uncertain) & (safe >= scam), F.lit("SAFE")).when(uncertain >= scam, F.lit("UNCERTAIN")).otherwise(F.lit("SCAM"))


def margin(*probabilities: Column) -> Column:
    ordered = F.sort_array(F.array(*probabilities), asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def blend(left: list[Column], right: list[Column], weight: Column, method: str) -> list[Column]:
    """Arithmetic or log-linear blend of two probability vectors, normalised again."""
    if method == "arithmetic":
        raw = [(1 - weight) * a + weight * b for a, b in zip(left, right, strict=True)]
    elif method == "log_linear":
        safe = lambda p: F.log(F.least(F.greatest(p, F.lit(TINY)), F.lit(1.0)))
        logs = [(1 - weight) * safe(a) + weight * safe(b) for a, b in zip(left, right, strict=True)]
        raw = [F.exp(x - F.greatest(*logs)) for x in logs]
    else:
        raise ValueError(f"unsupported blend method: {method}")
    return [x / sum(raw[1:], raw[0]) for x in raw]


def _wilson(hits: Column, total: Column) -> tuple[Column, Column, Column]:
    p, n, z2 = hits / total, total.cast("double"), Z95 * Z95
    centre = (p + z2 / (n * 2)) / (z2 / n + 1)
    half = F.sqrt(p * (1 - p) / n + z2 / (n * n * 4)) * Z95 / (z2 / n + 1)
    return centre, half, total > 0


def wilson_interval(hits: Column, total: Column) -> tuple[Column, Column]:
    """Clamped bounds: 0 and 1 exactly at no and at all hits, and [0, 1] without trials."""
    centre, half, some = _wilson(hits, F.when(total > 0, total))
    low = F.when(~some | some.isNull(), 0.0).when(hits == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(~some | some.isNull(), 1.0).when(hits == total, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def wilson_lower(hits: Column, total: Column) -> Column:
    """The unclamped lower bound; null without trials."""
    centre, half, _ = _wilson(hits, F.when(total > 0, total))
    return centre - half


def ratio(a: Column, b: Column) -> Column:
    """Null on an empty denominator."""
    return F.when(b > 0, a / b)


def count_of(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
