"""One table of everything that is wrong with a data set: rule, split, id, detail."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# What rows must have, and what their fields may be.
REQUIRED = ("id", "text", "label", "category", "source", "source_label", "license", "split", "family_id")
LABELS = ("SAFE", "UNCERTAIN", "SCAM")
CORE_CATEGORIES = ("CREDENTIAL_THEFT", "DELIVERY_TOLL", "FINANCIAL", "IDENTITY_IMPERSONATION", "OPPORTUNITY", "RELATIONSHIP")
CATEGORIES = (*CORE_CATEGORIES, "NONE", "UNKNOWN")
LICENSES = ("Apache-2.0", "CC-BY-4.0", "CC0-1.0", "CDLA-Permissive-1.0", "MIT")
PERSONAL = r"\d{10,}|\b\d{3}-\d{2}-\d{4}\b|\b(?:\d[ -]*?){13,16}\b|\b[A-Za-z0-9._%+-]+@(?!example\b)[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def row_rules() -> dict[str, Column]:
    """Rules that a row breaks by itself."""
    scam = F.col("label") == "SCAM"
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    return {
        **{f"missing {c}": blank(c) for c in REQUIRED},
        "missing is_synthetic": F.col("is_synthetic").isNull(),
        "invalid label": ~F.col("label").isin(*LABELS),
        "invalid category": ~F.col("category").isin(*CATEGORIES),
        "unexpected license": ~F.col("license").isin(*LICENSES),
        "scam without category": scam & (F.col("category") == "NONE"),
        "category without scam": ~scam & (F.col("category") != "NONE"),
        "personal value": F.col("text").rlike(PERSONAL),
    }


def violations(
    rows: DataFrame, manifest: DataFrame, splits: tuple[str, ...] = ("train", "dev", "test"), near: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """rule, split, id, detail: one row per broken rule and row, id, text, family, split or count.

    ``manifest`` has split and n as they were recorded. ``near`` finds pairs of near rows of different
    splits (``near.split_leaks``); without it that rule is left out.
    """
    of = lambda rule, split, id_, detail: [x.alias(n) for x, n in ((rule, "rule"), (split, "split"), (id_, "id"), (detail, "detail"))]
    none = F.lit(None).cast("string")
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in row_rules().items()]))
    found = [rows.select(F.explode(broken).alias("rule"), "split", "id", none.alias("detail"))]

    def repeated(key: str, rule: str) -> DataFrame:
        groups = rows.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("split"), F.min("id").alias("id")).where("n > 1 AND k IS NOT NULL")
        return groups.select(*of(F.lit(rule), F.col("split"), F.col("id"), F.col("n").cast("string")))

    rows = rows.withColumn("__text", tx.normalized_words(F.col("text")))
    found += [repeated("id", "repeated id"), repeated("__text", "repeated text")]
    families = rows.where(F.col("split").isin(*splits)).groupBy("family_id").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.min("id").alias("id"))
    found.append(families.where("a <> b").select(*of(F.lit("family leak"), F.col("a"), F.col("id"), F.col("family_id"))))
    names = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    have = rows.groupBy("split").agg(
        F.collect_set(F.when(F.col("label").isin("SAFE", "SCAM"), F.col("label"))).alias("labels"),
        F.collect_set(F.when((F.col("label") == "SCAM") & F.col("category").isin(*CORE_CATEGORIES), F.col("category"))).alias("categories"),
        F.count(F.lit(1)).alias("n"),
    )  # a few constants at most
    per = names.join(have, "split", "left")
    lacks = lambda column, all_: F.explode(F.array_except(F.array(*map(F.lit, all_)), F.coalesce(column, F.array().cast("array<string>"))))
    for rule, column, all_ in (("no rows of label", "labels", ("SAFE", "SCAM")), ("no scam of category", "categories", CORE_CATEGORIES)):
        found.append(per.select("split", lacks(column, all_).alias("what")).select(*of(F.lit(rule), F.col("split"), none, F.col("what"))))
    both = manifest.select("split", F.col("n").alias("said")).join(have.select("split", "n"), "split", "full")
    wrong = both.where(~F.coalesce("said", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0))))
    detail = F.concat(F.coalesce("said", F.lit(0)).cast("string"), F.lit(" recorded, "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" found"))
    found.append(wrong.select(*of(F.lit("manifest count"), F.col("split"), none, detail)))
    if near:
        pairs = near(rows.where(F.col("split").isin(*splits)).select("id", "text", "split"))
        found.append(pairs.select(*of(F.lit("near leak"), F.col("split_a"), F.col("id_a"), F.col("id_b"))).distinct())
    return reduce(DataFrame.unionByName, found)


def near_leaks(rows: DataFrame, links: Callable[[DataFrame, tuple[str, ...]], DataFrame], splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """The rule on near rows of different splits without its pairs: rule, split, id, and as detail the row's class and how
    many rows of other splits are near (``near.split_links``), one row per row with such."""
    detail = F.concat("class_id", F.lit(": "), F.col("links").cast("string"), F.lit(" near rows of other splits"))
    return links(rows.select("id", "text", "split"), splits).select(F.lit("near leak").alias("rule"), "split", "id", detail.alias("detail"))
