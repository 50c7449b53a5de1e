"""Windows over a call: as many whole lines from one end as fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, clean

WINDOW_CHARS = 425
LEAST_CHARS = 80


def _clipped(text: Column, limit: Column, recent: bool) -> Column:
    """The end (or start) of a text without the word that the cut goes through."""

    def cut(t: Column) -> Column:
        if recent:
            return F.trim(F.when(F.contains(t, F.lit(" ")), F.regexp_replace(t, "^[^ ]* ", "")).otherwise(t))
        return F.trim(F.regexp_replace(t, " [^ ]*$", ""))

    part = F.substring(text, F.length(text) - limit + 1, limit) if recent else F.substring(text, F.lit(1), limit)
    return F.when(F.length(text) <= limit, text).otherwise(bound(part, cut))


def rendered(segments: Column, recent: bool, limit: int = WINDOW_CHARS) -> Column:
    """Lines ``ROLE: text`` of segments (structs of role and text) from the start or the end, up to ``limit``
    characters. Empty segments are left out; a first line that is too long is clipped at a word."""
    said = F.transform(segments, lambda s: F.struct(F.concat(F.upper(s["role"]), F.lit(": ")).alias("head"), clean(s["text"]).alias("body")))
    said = F.filter(said, lambda s: s["body"] != "")
    said = F.reverse(said) if recent else said
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("total"), F.lit(False).alias("full"))

    def step(state: Column, s: Column) -> Column:
        first = F.size(state["lines"]) == 0
        line = F.concat(s["head"], F.when(first, _clipped(s["body"], F.lit(limit) - F.length(s["head"]), recent)).otherwise(s["body"]))
        total = state["total"] + F.length(line) + F.when(first, 0).otherwise(1)
        full = state["full"] | (~first & (total > limit))
        lines = F.when(full, state["lines"]).otherwise(F.concat(state["lines"], F.array(line)))
        return F.struct(lines.alias("lines"), F.when(full, state["total"]).otherwise(total).alias("total"), full.alias("full"))

    lines = F.aggregate(said, start, step, lambda state: state["lines"])
    return F.array_join(F.reverse(lines) if recent else lines, "\n")


def call_windows(segments: Column, limit: int = WINDOW_CHARS, least: int = LEAST_CHARS) -> Column:
    """The early and the recent window of a call, as structs of kind and text; short ones are left out."""
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), rendered(segments, kind == "recent", limit).alias("text")) for kind in ("early", "recent")])
    return F.filter(both, lambda w: F.length(w["text"]) >= least)
