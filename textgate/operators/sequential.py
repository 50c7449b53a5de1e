"""Small decisions that are sequential by definition, on bounded inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What placeholders stand for.
PLACEHOLDERS = {
    "URL": "https://secure-check.example/verify", "PHONE": "the number shown in the message", "PHONE_NUMBER": "the number shown in the message",
    "ACCOUNT_NUMBER": "the account reference shown in the message", "US_BANK_NUMBER": "account ending 0199", "EMAIL": "support@example.org",
    "EMAIL_ADDRESS": "support@example.org", "NAMED_ENTITY": "Northstar Services", "LOCATION": "Riverton", "DATE_TIME": "today at 2:30 PM", "DATE": "today",
    "TIME": "2:30 PM", "US_DRIVER_LICENSE": "reference number AB-0199", "NRP": "customer reference 0199", "UK_NHS": "NHS reference 0199",
    "IP_ADDRESS": "192.0.2.10", "US_PASSPORT": "passport ending 0199", "IBAN_CODE": "IBAN ending 0199", "US_SSN": "SSN ending 0199",
    "MEDICAL_LICENSE": "medical licence 0199", "IC": "identity number ending 0199", "NO_KERETA": "vehicle number 0199", "CREDIT_CARD": "card ending 0199",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def least_loaded(rows: DataFrame, family: str, speaker: str, seed: str, id_col: str = "id") -> DataFrame:
    """One row per family, always of the speaker chosen least often so far.

    Every choice depends on all earlier ones, so one task walks the families in hash order. They come
    to it sorted, as a stream: it holds one family's candidates (one a speaker) and the speakers' loads.
    """
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col)).cast("binary"), 256)
    first = rows.groupBy(family, speaker).agg(F.min(F.struct(rank.alias("h"), F.col(id_col).alias("id"))).alias("b"))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(family)).cast("binary"), 256)
    first = first.select(place.alias("place"), F.col(family).alias("family"), F.col(speaker).alias("speaker"), "b.h", "b.id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load: dict[str, int] = {}
        rows_ = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("family", "speaker", "h", "id")), strict=True))
        out: list[tuple[str, str, str]] = []
        for f, members in groupby(rows_, key=lambda r: r[0]):
            _, s, _, i = min(members, key=lambda r: (load.get(r[1], 0), r[2]))
            load[s] = load.get(s, 0) + 1
            out.append((f, s, i))
            if len(out) == 10_000:
                yield _choices(out)
                out = []
        if out:
            yield _choices(out)

    return first.repartition(1).sortWithinPartitions("place", "family").mapInArrow(walk, "family string, speaker string, id string")


def _choices(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["family", "speaker", "id"])


def nearest_subset(sizes: dict[str, int], share: float, salt: str) -> set[str]:
    """Components whose rows come nearest to a share: all subsets of up to 20, else greedily by hash."""
    if len(sizes) < 2:
        raise ValueError("one component cannot be split")
    names = sorted(sizes, key=lambda n: sha(f"{salt}:{n}"))
    target = round(sum(sizes.values()) * share)
    least, most = 3 if len(names) >= 5 else 1, len(names) - 2 if len(names) >= 4 else len(names) - 1
    if len(names) <= 20:
        found = ((abs(sum(sizes[names[i]] for i in c) - target), ":".join(map(str, c)), c) for k in range(least, most + 1) for c in combinations(range(len(names)), k))
        return {names[i] for i in min(found)[2]}
    picked, count = set(), 0
    for n in names:
        if len(picked) < least or abs(count + sizes[n] - target) < abs(count - target):
            picked.add(n)
            count += sizes[n]
    return picked


def stable_threshold(observed: float, below: float | None, above: float, ulps: int = 16) -> float:
    """A threshold between the greatest excluded and the least included score, where they are at least
    ``ulps`` float32 steps apart; else the observed one."""
    if below is None:
        return observed
    gap = (np.float32(above).view(np.int32) - np.float32(below).view(np.int32)).item()
    middle = below + (above - below) / 2
    return middle if gap >= ulps and below < middle <= above else observed


def temperature(scores: DataFrame, truth: str, columns: dict[str, str], low: float = 0.05, high: float = 10.0, rounds: int = 4, points: int = 17) -> float:
    """The temperature of least negative log likelihood: rounds of a grid, each one aggregation."""
    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]

        def loss(t: float) -> Column:
            z = {k: F.col(c) / F.lit(math.exp(t)) for k, c in columns.items()}
            top = F.greatest(*z.values())
            total = sum((F.exp(v - top) for v in list(z.values())[1:]), F.exp(list(z.values())[0] - top))
            own = F.coalesce(*[F.when(F.col(truth) == k, v) for k, v in z.items()])
            return F.avg(F.log(total) - (own - top))

        found = scores.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        best = min(range(points), key=lambda i: found[i])
        a, b = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return math.exp((a + b) / 2)


def materialized(text: Column) -> Column:
    """Placeholders in angle brackets replaced by what they stand for; unknown ones stay."""
    out = text
    for key, value in PLACEHOLDERS.items():
        out = F.regexp_replace(out, f"<{re.sub('_', '[_ ]', key)} *>", value)
    return out


def placeholders(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit("<([A-Z][A-Z0-9_ -]*)>"), 1), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("_")))
    return F.filter(found, lambda x: x.isin(*PLACEHOLDERS))
