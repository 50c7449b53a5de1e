"""Operator 5: document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle of five words is hashed once. The top bits of the hash choose one of 256 bins, and a
bin keeps its least hash. A sorted array of all hashes and of one sentinel per bin gives all minima
in one pass: the first entry of each bin is its minimum, and a bin whose first entry is its own
sentinel is empty. Empty bins are filled by optimal densification: each probes the other bins in a
pseudo-random order of its own (double hashing, the same for every text) and takes the value of
the first one that is not empty. The low 8 bits of each bin are packed, eight bins a long; likeness is the
share of equal bins, corrected for the 2**-8 that differ and agree by chance.

Defined cases: words are the runs without blanks; a text of one to four words is one shingle; a
null text is empty, and a text without a word has the shingle of nothing, so that all such texts
are alike; equal texts have equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks, text_or_empty, written

BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
WORDS = 5
PROBES = 12
#: A range of ids that is sorted by itself has about so many rows at most.
RANGE_ROWS = 200_000
_SHIFT = 64 - BIN_BITS
_REST = (1 << _SHIFT) - 1


def _probe(i: int, t: int) -> int:
    """The t-th bin that the empty bin i probes: an odd step goes through all bins."""
    x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return ((x >> 8) + t * (x >> 40 << 1 | 1)) % BINS


def _longs(values: list[int]) -> Column:
    """A constant array, as one literal text that the optimizer turns into numbers once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def with_fingerprint(df: DataFrame, text: Column, out: str) -> DataFrame:
    """``df`` with the packed fingerprint of ``text``, eight bins a long, in column ``out``."""
    a, b, c, d, e = (f"__{out}_{x}" for x in ("words", "hashes", "first", "bins", "full"))
    df = df.withColumn(a, F.split(F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " ")), " ", -1))
    w, n = F.col(a), F.size(a)
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]),
    )
    sentinels = F.array(*[F.lit(((v - BINS // 2) << _SHIFT) | _REST) for v in range(BINS)])
    df = df.withColumn(b, F.sort_array(F.concat(shingles, sentinels)))
    h = F.col(b)
    bin_of = lambda x: F.shiftright(x, _SHIFT)
    firsts = F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))
    df = df.withColumn(c, F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(_REST)) != F.lit(_REST), x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))))
    v = F.col(c)
    probes = [F.array(*[F.lit(_probe(i, t)) for i in range(BINS)]) for t in range(PROBES)]
    back = F.array(*[F.lit(pow(_probe(i, 1) - _probe(i, 0), -1, BINS)) for i in range(BINS)])
    # after some probes: the turn at which a bin is probed is known, so the full bins are asked for the first of theirs
    df = df.withColumn(e, F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(v, i).isNotNull()))
    full = F.col(e)

    def filled(x: Column, i: Column) -> Column:
        turns = F.transform(full, lambda j: F.pmod((j - F.get(probes[0], i)) * F.get(back, i), F.lit(BINS)) * BINS + j)
        return F.coalesce(x, *[F.get(v, F.get(p, i)) for p in probes], F.get(v, F.array_min(turns) % BINS))

    df = df.withColumn(d, F.transform(v, filled))
    bins = F.col(d)

    def long_of(j: Column) -> Column:
        parts = [F.shiftleft(F.get(bins, j * 8 + k), 8 * k) for k in range(8)]
        return reduce(lambda x, y: x.bitwiseOR(y), parts)

    df = df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), long_of))
    return df.drop(a, b, c, d, e)


def as_hex(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1; null where one is null."""

    def differ(j: Column) -> Column:
        """How many of eight bins differ: the bits of each byte of the exclusive or, or-ed together."""
        x = F.get(left, j).bitwiseXOR(F.get(right, j))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 4))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    unequal = F.aggregate(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), F.lit(0), lambda n, j: n + differ(j))
    chance = 2.0**-LOW_BITS
    share = F.when(left == right, F.lit(1.0)).otherwise((F.lit(BINS) - unequal) / F.lit(BINS))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - F.lit(chance)) / F.lit(1 - chance)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint, one row per row of ``docs``; a narrow map."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return with_fingerprint(rows, F.col("text"), "packed").select("doc_id", as_hex(F.col("packed")).alias("fingerprint"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    The next document in order of id is found without one global sort: ids are cut into ranges by
    approximate percentiles. Each range is sorted by itself, and the
    rows of a range's first id are copied to the range before it as its last neighbours (those of
    the first id to the last range). Null ids come first; equal ids are ordered by text.

    An id that fills a range or more (null, say) is cut further by the starts of its texts, and its
    equal texts are one row with a number until their neighbours are known.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = max(4 * tasks(spark), -(-docs.count() // RANGE_ROWS))
    found = rows.select(key.alias("k")).agg(F.min("k"), F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()
    points = found[1] or []
    bounds = sorted({(k, 0) for k in (found[0], *points)}) if found[0] is not None else [(0, 0)]
    often = {k: c for k, c in Counter(points).items() if c > 1} if len(bounds) < n else {}
    rows = rows.withColumn("k", key).withColumn("p", F.lit(0).cast("long")).withColumn("times", F.lit(1).cast("long"))
    if often:
        rows, bounds = _cut_further(rows, bounds, often, n)
    # percentiles are rounded where numbers are large: a range starts with its first row
    firsts = _with_range(rows.select("k", "p"), bounds).groupBy("range").agg(F.min(F.struct("k", "p")).alias("first")).collect()  # a row a range
    bounds = sorted((r.first.k, r.first.p) for r in firsts) or [(0, 0)]
    rows = with_fingerprint(rows, F.col("text"), "fingerprint")
    rows = _with_range(rows, bounds)
    last = len(bounds) - 1
    opens = (F.col("k") == F.get(_longs([k for k, _ in bounds]), F.col("range"))) & (F.col("p") == F.get(_longs([p for _, p in bounds]), F.col("range")))
    home = F.struct(F.col("range").alias("range"), F.lit(False).alias("copy"))
    before = F.struct(
        F.when(F.col("range") == 0, F.lit(last)).otherwise(F.col("range") - 1).alias("range"), F.lit(True).alias("copy")
    )
    placed = rows.select(
        "doc_id", "text", "k", "fingerprint", "times", F.explode(F.when(opens, F.array(home, before)).otherwise(F.array(home))).alias("place")
    ).select("doc_id", "text", "k", "fingerprint", "times", "place.range", "place.copy")
    order = Window.partitionBy("range").orderBy("copy", "k", "text")
    near = placed.select(
        "doc_id", "text", "fingerprint", "copy", "times", F.lead("text").over(order).alias("next"), F.lead("fingerprint").over(order).alias("next_fingerprint")
    ).where(~F.col("copy"))
    if often:  # of equal texts, all but the last are followed by their own
        near = near.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        near = near.withColumns({c: F.when(F.col("nth") < F.col("times"), F.col(own)).otherwise(F.col(c)) for c, own in (("next", "text"), ("next_fingerprint", "fingerprint"))})
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    near = near.select(
        "doc_id", chars.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next"), F.lit(1), half)).alias("edited"),
    )
    near = with_fingerprint(near, F.col("edited"), "edited_packed")
    own = F.col("fingerprint")
    near = near.select(
        "doc_id", "n_chars", "edited", F.col("fingerprint").alias("packed"), "edited_packed",
        likeness(own, F.col("edited_packed")).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )
    return near.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("packed")).alias("fingerprint"), as_hex(F.col("edited_packed")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def _cut_further(rows: DataFrame, bounds: list[tuple[int, int]], often: dict[int, int], n: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows and bounds, where rows of frequent ids have the first seven bytes of their text as a number ``p``.

    ``often`` says of how many percentiles an id is; it gets as many ranges.
    """
    bytes_ = F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0")
    is_often = F.col("k").isin(list(often))
    hot = rows.where(is_often).groupBy("doc_id", "text", "k").agg(F.sum("times").alias("times"))
    hot = written(hot.withColumn("p", F.conv(bytes_, 16, 10).cast("long")), "frequent")
    m = min(max(often.values()) + 1, max(64, 4 * n // len(often)))
    cuts = hot.groupBy("k").agg(F.min("p").alias("least"), F.percentile_approx("p", [i / m for i in range(1, m)], 20 * m).alias("p")).collect()  # a row an id
    more = {(k, 0) for k, _ in bounds if k not in often}
    for r in cuts:
        step = -(-len(r.p) // often[r.k])
        more |= {(r.k, p) for p in (r.least, *r.p[::step])}
    return rows.where(~is_often).unionByName(hot), sorted(more)


def _with_range(df: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Column range: how many of the ascending bounds are at most the row's (k, p), less 1, in two small steps."""
    step = math.isqrt(len(bounds)) + 1
    own = F.struct(F.col("k").alias("k"), F.col("p").alias("p"))

    def listed(some: list[tuple[int, int]]) -> Column:
        return F.arrays_zip(_longs([k for k, _ in some]).alias("k"), _longs([p for _, p in some]).alias("p"))

    if any(p for _, p in bounds):
        at_most = lambda values: F.size(F.filter(values, lambda b: (b["k"] < own["k"]) | ((b["k"] == own["k"]) & (b["p"] <= own["p"]))))
    else:
        listed = lambda some: _longs([k for k, _ in some])
        at_most = lambda values: F.size(F.filter(values, lambda b: b <= F.col("k")))
    df = df.withColumn("__coarse", F.greatest(at_most(listed(bounds[::step])) - 1, F.lit(0)) * step)
    fine = F.slice(listed(bounds), F.col("__coarse") + 1, F.lit(step))
    return df.withColumn("range", F.greatest(F.col("__coarse") + at_most(fine) - 1, F.lit(0))).drop("__coarse")
