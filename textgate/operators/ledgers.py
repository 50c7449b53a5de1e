"""Prediction ledgers: contracts, strict joins, transitions, routing, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verdicts import LABELS, count_of, margin

PROBABILITIES = ("p_safe", "p_uncertain", "p_scam")


def close(a: Column, b: Column, rel: float, abs_: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def violations(ledger: DataFrame) -> DataFrame:
    """(rule, split, id): what breaks the ledger contract. One scan for the row rules, one count per key."""
    p = [F.col(c) for c in PROBABILITIES]
    total = p[0] + p[1] + p[2]
    rules = {
        "label": ~(F.col("truth").isin(*LABELS) & F.col("verdict").isin(*LABELS) & F.col("argmax").isin(*LABELS)),
        "range": reduce(lambda a, b: a | b, [x.isNull() | F.isnan(x) | (x < 0) | (x > 1) for x in p]), "sum": ~close(total, F.lit(1.0), 1e-5, 1e-6),
        "missing": F.col("id").isNull() | F.col("split").isNull() | F.col("source").isNull(),
    }
    found = ledger.select("split", "id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    twice = ledger.groupBy("split", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("split", "id", F.lit("duplicate key").alias("rule"))
    return found.unionByName(twice).select("rule", "split", "id")


def strict_join(left: DataFrame, right: DataFrame, keys: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """Joined rows, and the keys that lack a side or differ in a column that must agree."""
    a = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("a"))
    b = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("b"))
    both = a.join(b, keys, "full_outer")
    differ = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same], F.lit(False))
    rule = F.when(F.col("a").isNull(), "missing left").when(F.col("b").isNull(), "missing right").when(differ, "metadata differs")
    return both.where("a IS NOT NULL AND b IS NOT NULL"), both.select(*keys, rule.alias("rule")).where("rule IS NOT NULL")


def outcome(before: Column, after: Column) -> Column:
    return F.when(before & after, "retained_correct").when(before, "regressed").when(after, "improved").otherwise("retained_wrong")


def transitions(joined: DataFrame) -> DataFrame:
    """Verdict changes from side a to side b and whether they help."""
    change = F.concat_ws("->", "a.verdict", "b.verdict")
    right = lambda s: F.col(f"{s}.verdict") == F.col(f"{s}.truth")
    return joined.groupBy(change.alias("change"), outcome(right("a"), right("b")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def routed(joined: DataFrame, margin_max: Column | float) -> DataFrame:
    """The router's verdict, or the specialist's where the router is UNCERTAIN or too close."""
    m = margin(*[F.col(f"a.{c}") for c in PROBABILITIES])
    escalated = (F.col("a.verdict") == "UNCERTAIN") | (m <= margin_max)
    return joined.select(
        *[c for c in joined.columns if c not in ("a", "b")], F.col("a.truth").alias("truth"), F.col("a.category").alias("category"), m.alias("margin"), escalated.alias("escalated"),
        F.when(escalated, F.col("b.verdict")).otherwise(F.col("a.verdict")).alias("verdict"),
    )


def routed_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    from .evaluation import macro_f1

    c = F.col
    cells = [count_of((c("truth") == t) & (c("verdict") == v)).alias(f"n_{t}_{v}".lower()) for t in LABELS for v in LABELS]
    found = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), count_of(c("escalated")).alias("escalations"), *cells)
    safe = c("n_safe_safe") + c("n_safe_uncertain") + c("n_safe_scam")
    scam = c("n_scam_safe") + c("n_scam_uncertain") + c("n_scam_scam")
    return found.select(
        *(by or []), "n", F.round(c("escalations") / c("n"), 9).alias("escalation_rate"), F.round(c("n_safe_scam") / F.greatest(safe, F.lit(1)), 9).alias("fpr"),
        F.round(F.when(scam > 0, c("n_scam_scam") / scam).otherwise(0.0), 9).alias("recall"), F.round(macro_f1(True), 9).alias("macro_f1"),
    )


def fit_policy(joined: DataFrame, margins: list[float], max_escalation: float, max_fpr: float) -> DataFrame:
    """The best margin among the given candidates, each evaluated as a group of one aggregation."""
    grid = joined.withColumn("margin_max", F.explode(F.array(*[F.lit(float(m)) for m in margins])))
    found = routed_metrics(routed(grid, F.col("margin_max")), ["margin_max"])
    under = F.col("escalation_rate") <= max_escalation
    ok = under & (F.col("fpr") <= max_fpr)
    rank = F.struct("recall", "macro_f1", (-F.col("escalation_rate")).alias("e"), (-F.col("margin_max")).alias("m"))
    least = F.struct("fpr", (-F.col("recall")).alias("r"), (-F.col("macro_f1")).alias("f"), "escalation_rate", F.col("margin_max").alias("m"))
    picked = found.agg(F.max(F.when(ok, rank)).alias("best"), F.min(F.when(under, least)).alias("fallback"))
    return picked.select(F.coalesce(-F.col("best.m"), F.col("fallback.m")).alias("margin_max"), F.col("best").isNotNull().alias("feasible"))


def parity(candidate: DataFrame, reference: DataFrame, samples: int = 20) -> DataFrame:
    """Greatest probability error and verdict mismatches of two ledgers, with a few of their ids."""
    a = candidate.select("id", F.col("verdict").alias("va"), *[F.col(c).alias(f"a_{c}") for c in PROBABILITIES])
    both = a.join(reference.select("id", "verdict", *PROBABILITIES), "id")
    error = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(c)) for c in PROBABILITIES])
    wrong = F.col("va") != F.col("verdict")
    ranked = both.where(wrong).select("id").orderBy("id").limit(samples).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("sample"))
    found = both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(error), 9).alias("max_error"), count_of(wrong).alias("mismatches"))
    return found.join(F.broadcast(ranked))


def gates(metrics: dict[str, Column], rules: list[tuple[str, str, float]], source: DataFrame) -> DataFrame:
    """One row a gate: name, actual, operator, threshold, passed (null actuals fail)."""
    one = source.agg(*[v.alias(k) for k, v in metrics.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("actual"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold")) for n, op, t in rules])
    table = one.select(F.explode(rows).alias("g")).select("g.*")
    passed = F.when(F.col("op") == ">=", F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    return table.withColumn("passed", F.coalesce(passed, F.lit(False)))

