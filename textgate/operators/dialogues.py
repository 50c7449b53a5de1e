"""Conversations as rows of turns: quality, role changes, contexts, the strongest turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized


def quality(turns: DataFrame, key: str, order: str, role: str, text: str, roles: tuple[str, str], least: int = 6, most: int = 32) -> DataFrame:
    """Keys of conversations with enough turns of both roles, distinct utterances, words and changes.

    One row per conversation from one aggregation; only the role changes need the turns in order.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = turns.withColumn("changed", (F.col(role) != F.lag(role).over(w)).cast("int")).withColumn("norm", normalized(F.col(text)))
    words = F.size(F.regexp_extract_all(F.col(text), F.lit(r"(\w+)"), 1))
    said = F.when(F.col("norm") != "", F.col("norm"))
    found = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct(order).alias("orders"), F.count(F.when(F.col(role) == roles[0], 1)).alias("first"),
        F.count(F.when(F.col(role) == roles[1], 1)).alias("second"), F.count(said).alias("said"), F.count_distinct(said).alias("distinct"),
        F.sum(words).alias("words"), F.sum("changed").alias("changes"),
    )
    c = F.col
    return found.withColumn(
        "good",
        c("turns").between(least, most) & (c("orders") == c("turns")) & (c("first") >= 2) & (c("second") >= 2) & (c("said") >= least)
        & (c("distinct") >= 0.6 * c("said")) & (c("words") >= 35) & (c("changes") >= 0.65 * (c("turns") - 1)),
    )


def role_changes(turns: DataFrame, key: str, order: str, role: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    rows = turns.withColumn("changed", (F.col(role) != F.lag(role).over(w)).cast("int"))
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(n.alias("turns"), F.when(n > 1, F.sum("changed") / (n - 1)).alias("change_ratio"))


def speaker_ordinals(turns: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """A, B, ... by first appearance."""
    first = turns.groupBy(key, role).agg(F.min(order).alias("at"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return first.select(key, role, F.char(F.lit(64) + n).alias("speaker"))


def strongest(turns: DataFrame, key: str, order: str, score: Column) -> DataFrame:
    """Per conversation the turn of the greatest score, the earliest on ties."""
    rank = F.struct(score.alias("score"), (-F.col(order)).alias("at"))
    return turns.groupBy(key).agg(F.max(rank).alias("best")).select(key, (-F.col("best.at")).alias(order), F.col("best.score").alias("score"))


def shaped_contexts(rows: DataFrame, group: str, state: str, text: str, after: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of siblings whose texts differ in one line: group, state and the text up to that line with the last
    ``after`` lines; and the groups that break the rule, with the problem.

    Lines are counted per group and place, so no group's texts are gathered.
    """
    lines = F.split(F.col(text), "\n")
    rows = rows.select(group, state, lines.alias("lines"), F.size(lines).alias("n"))
    sizes = rows.groupBy(group).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    places = rows.select(group, F.posexplode("lines").alias("at", "line")).groupBy(group, "at").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    changing = places.where("a <> b").groupBy(group).agg(F.count(F.lit(1)).alias("changes"), F.min("at").alias("first"), F.max("at").alias("decisive"))
    found = sizes.join(changing, group, "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    problem = (
        F.when(F.col("least") != F.col("most"), "line counts differ")
        .when(F.col("changes") != 1, F.concat(F.col("changes").cast("string"), F.lit(" lines change")))
        .when(F.col("least") - after <= F.col("decisive"), "no lines after the decisive one")
    )
    found = found.withColumn("problem", problem)
    good = rows.join(found.where("problem IS NULL").select(group, "decisive"), group)
    kept = F.concat(F.slice("lines", F.lit(1), F.col("decisive") + 1), F.slice("lines", F.col("n") - after + 1, F.lit(after)))
    return good.select(group, state, F.array_join(kept, "\n").alias("text")), found.where("problem IS NOT NULL").select(group, "problem")
