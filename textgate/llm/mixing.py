"""Operator 7: mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 and 1 and the shares are
normalised anew. The exponent is bisected (in sections of several points at once, each round one
aggregation over the table of sources): with a repetition limit it is the least exponent under
which no source is repeated more often than the limit; with a target entropy it is the greatest
exponent whose weights reach that entropy; with both, the repetition limit comes first.

The weights are realised as budgeted block permutations. A source's budget is its weight times the
total budget. Each pass over a source is a permutation of its rows by a hash, cut into blocks of
about ``block_tokens``; whole passes use all blocks, and the last pass stops in the block in which
the budget ends. ``position`` (0 to 1) orders all occurrences so that every stretch of the stream
has the sources in their weights. Without a given budget, the total is the least with which every
row of every source is used at least once.

Defined cases: tokens are words between blanks, and each character of a script that is written
without blanks; a row without any counts as one token; a null
source is a source of its own; rows that repeat entirely are used equally often; with a single
source nothing changes; an empty table gives no rows; other columns are carried along whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discarded, text_or_empty, written

REPEAT_LIMIT = 1.5
BLOCK_TOKENS = 1 << 20
POINTS = 32
ROUNDS = 8
#: Up to so many sources, their table is sent to all executors; beyond that, it is joined.
SENT_SOURCES = 20_000
UNIT = 1 << 52
#: So many blocks of a source are summed before their order is looked at, so that no task sorts them all.
BLOCKS_AT_ONCE = 4096
#: Thai, Lao, Burmese, Khmer, Kana and Han: scripts that are written without blanks between words.
UNSPACED = "[\\u0e00-\\x{323af}&&[\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{323af}]]"


def tokens(text: Column) -> Column:
    """Words between blanks and single characters of scripts without blanks; one for a text without any."""
    words = lambda x: F.size(F.split(F.trim(F.regexp_replace(x, "[ \\t-\\r]+", " ")), " ", -1))
    spaced = F.regexp_replace(text, UNSPACED, " ")
    single = F.length(text) - F.length(F.regexp_replace(text, UNSPACED, ""))
    apart = single + F.when(F.trim(F.regexp_replace(spaced, "[ \\t-\\r]+", " ")) == "", 0).otherwise(words(spaced))
    other = (F.length(text) < F.octet_length(text)) & text.rlike(UNSPACED)
    return F.when(other, apart).otherwise(words(text)).cast("long")


def chance(key: Column, turn: Column, seed: int) -> Column:
    """A number from 0 to 1 for a row's place in a pass."""
    return F.pmod(F.xxhash64(F.lit(seed), turn.cast("long"), key), F.lit(UNIT)) / F.lit(float(UNIT))


def exponent(
    shares: DataFrame, repeat_limit: float | None, target_entropy: float | None, budget: float | None, total: float
) -> tuple[float, float]:
    """The exponent, and the budget. shares: column p, one row per source."""

    def measured(points: list[float]) -> list[tuple[float, float, float, float]]:
        """For each point: entropy, greatest and least weight per share, and the sum of powers."""
        grid = F.explode(F.array(*[F.lit(float(a)) for a in points])).alias("a")
        powers = shares.select(F.log("p").alias("l"), grid).select("a", "l", F.exp(F.col("a") * F.col("l")).alias("x"))
        rows = powers.groupBy("a").agg(
            F.sum("x").alias("z"), F.sum(F.col("x") * F.col("a") * F.col("l")).alias("e"),
            F.max((F.col("a") - 1) * F.col("l")).alias("hi"), F.min((F.col("a") - 1) * F.col("l")).alias("lo"),
        ).collect()  # one row a point
        rows = {r.a: r for r in rows}
        return [(math.log(r.z) - r.e / r.z, math.exp(r.hi), math.exp(r.lo), r.z) for r in (rows[float(a)] for a in points)]

    def spent(hi: float, lo: float, z: float) -> tuple[float, float]:
        """Greatest number of passes, and the budget."""
        whole = budget if budget is not None else total * z / lo
        return whole * hi / z / total, whole

    def least_meeting(ok) -> float:  # noqa: ANN001
        """The least exponent that meets a condition which holds from some exponent on."""
        low, high = 0.0, 1.0
        if ok(measured([0.0])[0]):
            return 0.0
        for _ in range(ROUNDS):
            points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
            if points[0] <= low or points[-1] >= high:
                break
            met = [ok(m) for m in measured(points)]
            first = met.index(True) if True in met else POINTS
            low, high = (points[first - 1] if first else low), (points[first] if first < POINTS else high)
        return high

    found = 1.0 if repeat_limit is None and target_entropy is None else 0.0
    if target_entropy is not None:  # entropy falls with the exponent: the first that misses it is the bound
        found = least_meeting(lambda m: m[0] < target_entropy)
    if repeat_limit is not None:
        needed = least_meeting(lambda m: spent(*m[1:])[0] <= repeat_limit)
        found = max(found, needed)
    m = measured([found])[0]
    return found, spent(*m[1:])[1]


def _plan(
    rows: DataFrame, repeat_limit: float | None, target_entropy: float | None, budget: float | None, block_tokens: int, seed: int
) -> DataFrame:
    """Of each source: its weight, passes, number of blocks, and where its last pass ends.

    rows: (source, key, n) of all rows; written before, as it is read several times.
    """
    stats = written(rows.groupBy("source").agg(F.sum("n").alias("tokens")), "sources")
    total = stats.agg(F.sum("tokens")).first()[0]
    shares = stats.select("source", "tokens", (F.col("tokens") / F.lit(float(total or 1))).alias("p"))
    if not total:
        none = {"weight": 0.0, "whole": 0, "passes": 0.0, "blocks": 0, "end_block": 0, "end_chance": 0.0}
        return shares.select("source", *[F.lit(v).cast("double" if isinstance(v, float) else "long").alias(c) for c, v in none.items()])
    a, spent = exponent(shares, repeat_limit, target_entropy, budget, float(total))
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    plan = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z)).withColumn("passes", F.col("weight") * F.lit(spent) / F.col("tokens"))
    # rounding must not make a pass that is whole end just before its last row
    plan = plan.withColumn("passes", F.when(F.abs(F.col("passes") - F.round("passes")) < 1e-9, F.round("passes")).otherwise(F.col("passes")))
    plan = plan.withColumn("whole", F.floor("passes").cast("long")).withColumn("rest", (F.col("passes") - F.col("whole")) * F.col("tokens"))
    plan = written(plan.withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long")), "plan")
    last = _joined(rows, plan.select("source", "whole", "blocks", "rest")).where("rest > 0")
    last = last.withColumn("u", chance(F.col("key"), F.col("whole"), seed)).withColumn("block", F.floor(F.col("u") * F.col("blocks")))
    sums = last.groupBy("source", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    sums = written(sums.withColumn("some", F.floor(F.col("block") / F.lit(BLOCKS_AT_ONCE))), "blocks")
    # first the stretch of blocks, then the block in it, in which the rest is used up
    stretch = _ended(sums.groupBy("source", "some").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), "some")
    within = _joined(sums.drop("rest"), stretch.select("source", F.col("at").alias("end_some"), F.col("left").alias("rest"))).where("some = end_some")
    ends = written(_ended(within, "block").select("source", F.col("at").alias("end_block"), "left"), "ends")
    inside = _joined(last.select("source", "block", "u", "n"), ends).where("block = end_block")
    within = Window.partitionBy("source").orderBy("u")  # the rows of one block
    cut = inside.withColumn("upto", F.sum("n").over(within)).where(F.col("upto") <= F.col("left"))
    cut = cut.groupBy("source").agg(F.max("u").alias("end_chance"))
    first = plan
    plan = _joined(_joined(first, ends, "left"), cut, "left")
    plan = written(
        plan.select(
            "source", "weight", "whole", "passes", "blocks", F.coalesce("end_block", F.lit(0).cast("long")).alias("end_block"),
            F.coalesce("end_chance", F.lit(-1.0)).alias("end_chance"),
        ),
        "plan",
    )
    discarded(stats, first, sums, ends)
    return plan


def _ended(sums: DataFrame, by: str) -> DataFrame:
    """(source, at, left): where ``rest`` is used up in order of ``by``, and what is left of it there."""
    upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= F.col("rest"))
    ends = ends.groupBy("source").agg(F.min(F.struct(F.col(by).alias("at"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
    return ends.select("source", "e.at", "e.left")


def _joined(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the table of sources, null sources included."""
    right = sources.withColumnRenamed("source", "__source")
    right = F.broadcast(right) if sources.count() <= SENT_SOURCES else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", repeat_limit: float | None = REPEAT_LIMIT,
    target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17,
) -> DataFrame:
    """One row per use of a row of ``docs``: column ``row`` with all its columns, and source, n_tokens,
    weight, epoch, block, position.

    The rows are read twice and never shuffled with their texts; shuffled are sums and, of each
    source, the numbers of the one block in which its budget ends.
    """
    text = text_or_empty(text_col)
    key = F.xxhash64(F.col(id_col), text)
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = F.col(source_col).cast(T.StringType())
    numbers = written(docs.select(source.alias("source"), key.alias("key"), tokens(text).alias("n")), "rows")
    plan = _plan(numbers, repeat_limit, target_entropy, budget, block_tokens, seed)
    discarded(numbers)
    rows = docs.select(whole_row.alias("row"), source.alias("source"), key.alias("key"), tokens(text).alias("n_tokens"))
    rows = _joined(rows, plan)
    u = chance(F.col("key"), F.col("whole"), seed)
    block = F.floor(u * F.col("blocks"))
    in_last = (F.col("passes") > F.col("whole")) & (
        (block < F.col("end_block")) | ((block == F.col("end_block")) & (u <= F.col("end_chance")))
    )
    uses = F.col("whole") + F.when(in_last, 1).otherwise(0)
    rows = rows.withColumn("uses", uses).where("uses > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)).alias("epoch"))
    at = chance(F.col("key"), F.col("epoch"), seed)
    rows = rows.withColumn("at", at)
    return rows.select(
        "row", "source", "n_tokens", "weight", "epoch", F.floor(F.col("at") * F.col("blocks")).alias("block"),
        F.least((F.col("epoch") + F.col("at")) / F.greatest("passes", F.lit(1e-9)), F.lit(1.0)).alias("position"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """``docs`` with every row as often as the mixture uses it, its columns as they were."""
    return mix(docs, **options).select("row.*")
