"""Queries on prediction ledgers: metrics, sweeps, joins, routing, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import verdicts as vd
from ..operators import evaluation as ev
from ..operators import ledgers as lg
from ..operators import sampling
from .fixtures import MESSAGES, hex8, ledger, with_
from .registry import query

L = with_(MESSAGES, ledger())
LB = "y AS (SELECT *, CAST(truth = 'SCAM' AS INT) AS y FROM l WHERE truth IN ('SAFE', 'SCAM'))"
TWO = with_(MESSAGES, ledger(), ledger("r", "b"), "j AS (SELECT l.id, l.split, l.truth, l.category, l.verdict AS va, r.verdict AS vb, l.p_safe, l.p_uncertain, l.p_scam, r.p_safe AS q_safe, r.p_uncertain AS q_uncertain, r.p_scam AS q_scam FROM l JOIN r USING (split, id))")
Z = "1.959963984540054"


def joined(t):
    return lg.strict_join(t.l("a"), t.l("b"), ["split", "id"], ["truth", "source", "category"])[0]


def p(prefix=""):
    return [F.col(f"{prefix}p_{k}") for k in ("safe", "uncertain", "scam")]


@query("p02_binary_subset", with_(MESSAGES, ledger(), LB) + "SELECT id, y, round(p_scam, 12) AS p FROM y")
def p02(t):
    return ev.binary_subset(t.l()).select("id", "y", F.round("p_scam", 12).alias("p"))


@query("m01_softmax", L + "SELECT id, round(exp((p_safe - greatest(p_safe, p_uncertain, p_scam)) / 0.5) / (exp((p_safe - greatest(p_safe, p_uncertain, p_scam)) / 0.5) + exp((p_uncertain - greatest(p_safe, p_uncertain, p_scam)) / 0.5) + exp((p_scam - greatest(p_safe, p_uncertain, p_scam)) / 0.5)), 9) AS s FROM l")
def m01(t):
    return t.l().select("id", F.round(vd.softmax(p(), 0.5)[0], 9).alias("s"))


@query("m03_verdicts", L + "SELECT id, verdict, argmax, CASE WHEN p_scam >= 0.6 THEN 'SCAM' WHEN p_safe >= 0.3 AND p_scam < 0.25 THEN 'SAFE' ELSE 'UNCERTAIN' END AS capped FROM l")
def m03(t):
    return t.l().select("id", "verdict", "argmax", vd.verdict(F.col("p_safe"), F.col("p_scam"), 0.6, 0.3, 0.25).alias("capped"))


@query("m04_blend", TWO + """, x AS (SELECT id, 0.7 * p_safe + 0.3 * q_safe AS a, exp(0.7 * ln(p_safe) + 0.3 * ln(q_safe)) AS s, exp(0.7 * ln(p_uncertain) + 0.3 * ln(q_uncertain)) AS u, exp(0.7 * ln(p_scam) + 0.3 * ln(q_scam)) AS c FROM j)
SELECT id, round(a, 9) AS arithmetic, round(s / (s + u + c), 9) AS log_linear FROM x""")
def m04(t):
    j = joined(t)
    w = F.lit(0.3)
    return j.select("id", F.round(vd.blend(p("a."), p("b."), w, "arithmetic")[0], 9).alias("arithmetic"), F.round(vd.blend(p("a."), p("b."), w, "log_linear")[0], 9).alias("log_linear"))


@query("w17_margin", L + "SELECT id, round(list_sort([p_safe, p_uncertain, p_scam], 'DESC')[1] - list_sort([p_safe, p_uncertain, p_scam], 'DESC')[2], 12) AS margin FROM l")
def w17(t):
    return t.l().select("id", F.round(vd.margin(*p()), 12).alias("margin"))


BINARY = """c AS (SELECT {by} count(*) AS n, count(*) FILTER (y = 0 AND p_scam < 0.5) AS tn, count(*) FILTER (y = 0 AND p_scam >= 0.5) AS fp, count(*) FILTER (y = 1 AND p_scam < 0.5) AS fn,
  count(*) FILTER (y = 1 AND p_scam >= 0.5) AS tp, avg((p_scam - y) * (p_scam - y)) AS brier FROM y {group})"""
WILSON = """CASE WHEN {n} <= 0 THEN {empty} WHEN {k} = {edge} THEN {at} ELSE {f}({bound}, ({k} / ({n})::DOUBLE + {z} * {z} / (2.0 * ({n}))) / (1 + {z} * {z} / ({n}))
  {sign} {z} * sqrt({k} / ({n})::DOUBLE * (1 - {k} / ({n})::DOUBLE) / ({n}) + {z} * {z} / (4.0 * ({n}) * ({n}))) / (1 + {z} * {z} / ({n}))) END"""


def wilson(k, n):
    low = WILSON.format(k=k, n=n, empty="0.0", edge="0", at="0.0", f="greatest", bound="0.0", sign="-", z=Z)
    high = WILSON.format(k=k, n=n, empty="1.0", edge=n, at="1.0", f="least", bound="1.0", sign="+", z=Z)
    return low, high


def binary_sql(by):
    (rl, rh), (fl, fh) = wilson("tp", "(tp + fn)"), wilson("fp", "(fp + tn)")
    return with_(MESSAGES, ledger(), LB, BINARY.format(by=f"{by}," if by else "", group=f"GROUP BY {by}" if by else "")) + f"""
SELECT {by + ',' if by else ''} n, tn, fp, fn, tp, round(brier, 9) AS brier, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) AS scam_precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 9) AS scam_recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 9) AS scam_f1,
  round(fp / greatest(fp + tn, 1)::DOUBLE, 9) AS false_positive_rate, round({rl}, 9) AS recall_low, round({rh}, 9) AS recall_high, round({fl}, 9) AS fpr_low, round({fh}, 9) AS fpr_high FROM c"""


@query("a08_binary_metrics", binary_sql(""))
def a08(t):
    return ev.binary_metrics(ev.binary_subset(t.l()), 0.5)


@query("a38_binary_metrics_by_source", binary_sql("source"))
def a38(t):
    return ev.binary_metrics(ev.binary_subset(t.l()), 0.5, ["source"])


@query("a09_calibration_error", with_(MESSAGES, ledger(), LB, "g AS (SELECT count(*) AS n, avg(y) AS a, avg(p_scam) AS c FROM y GROUP BY least(floor(p_scam * 15), 14))") + "SELECT round(sum(n * abs(a - c)) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM g")
def a09(t):
    return ev.calibration_error(ev.binary_subset(t.l()))


TOP = "greatest(p_safe, p_uncertain, p_scam)"


@query("a10_reliability", with_(MESSAGES, ledger(), f"g AS (SELECT least(floor({TOP} * 15), 14) AS bin, count(*) AS n, avg({TOP}) AS c, avg((argmax = truth)::INT) AS a FROM l GROUP BY 1)") + "SELECT r.bin, coalesce(n, 0) AS n, round(c, 9) AS confidence, round(a, 9) AS accuracy FROM range(15) r(bin) LEFT JOIN g ON g.bin = r.bin")
def a10r(t):
    return ev.reliability(t.l())


@query("a10_multiclass_calibration", with_(MESSAGES, ledger(), f"""g AS (SELECT least(floor({TOP} * 15), 14) AS bin, count(*) AS n, avg({TOP}) AS c, avg((argmax = truth)::INT) AS a,
  sum(power(p_safe - (truth = 'SAFE')::INT, 2) + power(p_uncertain - (truth = 'UNCERTAIN')::INT, 2) + power(p_scam - (truth = 'SCAM')::INT, 2)) AS b, sum(nll) AS l FROM l GROUP BY 1)""") + """
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(c - a)) / sum(n), 9) AS ece, round(max(abs(c - a)), 9) AS mce, round(sum(b) / sum(n), 9) AS brier, round(sum(l) / sum(n), 9) AS nll FROM g""")
def a10(t):
    return ev.multiclass_calibration(t.l())


@query("a11_wilson", with_(MESSAGES, ledger(), "c AS (SELECT source, count(*) AS n, count(*) FILTER (verdict = 'SCAM') AS k FROM l GROUP BY source)") + f"SELECT source, round({wilson('k', 'n')[0]}, 9) AS low, round({wilson('k', 'n')[1]}, 9) AS high FROM c")
def a11(t):
    c = t.l().groupBy("source").agg(F.count(F.lit(1)).alias("n"), vd.count_of(F.col("verdict") == "SCAM").alias("k"))
    low, high = vd.wilson_interval(F.col("k"), F.col("n"))
    return c.select("source", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("a12_alert_metrics", L + """SELECT count(*) FILTER (verdict = 'SCAM') AS alerts, count(*) FILTER (verdict = 'SCAM' AND truth = 'SAFE') AS n_safe_scam, count(*) FILTER (verdict = 'SCAM' AND truth = 'UNCERTAIN') AS n_uncertain_scam,
  count(*) FILTER (verdict = 'SCAM' AND truth = 'SCAM') AS n_scam_scam, round(count(*) FILTER (verdict = 'SCAM' AND truth = 'SCAM') / count(*) FILTER (verdict = 'SCAM')::DOUBLE, 9) AS scam_fraction,
  round(count(*) FILTER (verdict = 'SCAM' AND truth = 'SCAM') / count(*) FILTER (verdict = 'SCAM' AND truth <> 'UNCERTAIN')::DOUBLE, 9) AS binary_precision,
  round(count(*) FILTER (verdict = 'SCAM' AND truth = 'UNCERTAIN') / count(*) FILTER (truth = 'UNCERTAIN')::DOUBLE, 9) AS uncertain_to_scam_rate FROM l""")
def a12(t):
    return ev.alert_metrics(t.l())


CELLS = ", ".join(f"count(*) FILTER (truth = '{a}' AND verdict = '{b}') AS n_{a.lower()}_{b.lower()}" for a in vd.LABELS for b in vd.LABELS)


def f1_sql(k, table=""):
    t = " + ".join(f"n_{k}_{x}" for x in ("safe", "uncertain", "scam"))
    c = " + ".join(f"n_{x}_{k}" for x in ("safe", "uncertain", "scam"))
    return f"(CASE WHEN {t} + {c} > 0 THEN 2 * n_{k}_{k} / ({t} + {c})::DOUBLE ELSE 0 END)", f"(({t} + {c}) > 0)::INT"


F1S = [f1_sql(k) for k in ("safe", "uncertain", "scam")]
ACTIVE = f"({' + '.join(x[0] for x in F1S)}) / ({' + '.join(x[1] for x in F1S)})"
ALL3 = f"({' + '.join(x[0] for x in F1S)}) / 3"
ALLN = " + ".join(f"n_{a}_{b}" for a in ("safe", "uncertain", "scam") for b in ("safe", "uncertain", "scam"))
ACC = f"(n_safe_safe + n_uncertain_uncertain + n_scam_scam) / ({ALLN})::DOUBLE"


@query("a13_confusion", L + f"SELECT source, {CELLS} FROM l GROUP BY source")
def a13(t):
    return ev.confusion(t.l(), ["source"])


@query("a13_macro_f1", with_(MESSAGES, ledger(), f"c AS (SELECT split, {CELLS} FROM l GROUP BY split)") + f"SELECT split, round({ACTIVE}, 9) AS active, round({ALL3}, 9) AS all_three FROM c")
def a13f(t):
    return ev.confusion(t.l(), ["split"]).select("split", F.round(ev.macro_f1(True), 9).alias("active"), F.round(ev.macro_f1(False), 9).alias("all_three"))


SLICES = ["source", "source_language", "category", "split"]


def slices_sql(slices):
    part = lambda kind, value, group: f"SELECT '{kind}' AS slice, {value} AS value, count(*) AS n, {CELLS} FROM l {group}"
    return " UNION ALL ".join([part("overall", "''", "")] + [part(s, s, f"GROUP BY {s}") for s in slices])


@query("a14_slice_report", with_(MESSAGES, ledger(), f"c AS ({slices_sql(SLICES)})") + f"SELECT slice, value, n, round({ACC}, 9) AS accuracy, round({ACTIVE}, 9) AS macro_f1, round({ALL3}, 9) AS macro_f1_all FROM c")
def a14(t):
    return ev.slice_report(t.l(), SLICES)


@query("a15_metadata_slices", with_(MESSAGES, ledger(), f"c AS ({slices_sql(['source_language', 'split'])})") + "SELECT slice, value, n FROM c WHERE slice <> 'overall' AND slice IN (SELECT slice FROM c GROUP BY slice HAVING count(*) >= 2)")
def a15(t):
    c = ev.slice_report(t.l(), ["source_language", "split"]).where("slice <> 'overall'").select("slice", "value", "n")
    return c.join(c.groupBy("slice").count().where("count >= 2").select("slice"), "slice", "left_semi")


@query("a16_summaries", L + """, s AS (SELECT 'split' AS slice, split AS value, nll, argmax, truth FROM l UNION ALL SELECT 'category', category, nll, argmax, truth FROM l)
SELECT slice, value, count(*) AS n, round(avg(nll), 9) AS nll, count(*) FILTER (argmax <> truth) AS errors FROM s GROUP BY slice, value""".replace("WITH", "", 1))
def a16(t):
    rows = t.l().select(F.explode(F.create_map(F.lit("split"), "split", F.lit("category"), "category")).alias("slice", "value"), "nll", "argmax", "truth")
    return rows.groupBy("slice", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("nll"), 9).alias("nll"), F.count_if(F.col("argmax") != F.col("truth")).alias("errors"))


@query("t01_hardest_errors", L + "SELECT id, round(nll, 9) AS nll FROM l WHERE argmax <> truth ORDER BY nll DESC, id LIMIT 25")
def t01(t):
    return sampling.first_in_order(t.l().where("argmax <> truth").select("id", "nll"), 25, [F.col("nll").desc(), "id"]).select("id", F.round("nll", 9).alias("nll"))


@query("t02_error_buckets", L + """, a AS (SELECT split, id, 'fn' AS bucket FROM l WHERE truth = 'SCAM' AND verdict <> 'SCAM' QUALIFY row_number() OVER (PARTITION BY split ORDER BY p_scam, id) <= 5),
b AS (SELECT split, id, 'fp' AS bucket FROM l WHERE truth = 'SAFE' AND verdict = 'SCAM' QUALIFY row_number() OVER (PARTITION BY split ORDER BY p_scam DESC, id) <= 5),
c AS (SELECT split, id, 'nll' AS bucket FROM l WHERE id NOT IN (SELECT id FROM a UNION ALL SELECT id FROM b) QUALIFY row_number() OVER (PARTITION BY split ORDER BY nll DESC, id) <= 5)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""".replace("WITH", "", 1))
def t02(t):
    rows = t.l().select("split", "id", "truth", "verdict", "p_scam", "nll")
    pick = lambda r, order, name: sampling.top_per_group(r, ["split"], 5, [*order, F.col("id")]).select("split", "id", F.lit(name).alias("bucket"))
    a = pick(rows.where("truth = 'SCAM' AND verdict <> 'SCAM'"), [F.col("p_scam")], "fn")
    b = pick(rows.where("truth = 'SAFE' AND verdict = 'SCAM'"), [F.col("p_scam").desc()], "fp")
    first = a.unionByName(b)
    return first.unionByName(pick(rows.join(first.select("id"), "id", "left_anti"), [F.col("nll").desc()], "nll"))


@query("a20_pair_gaps", with_(MESSAGES, ledger(), f"x AS (SELECT {hex8('id')} % 60 AS pair_id, truth, avg(p_scam) AS p FROM l WHERE truth <> 'UNCERTAIN' GROUP BY ALL)", "g AS (SELECT pair_id, max(p) FILTER (truth = 'SCAM') - max(p) FILTER (truth = 'SAFE') AS gap FROM x GROUP BY pair_id HAVING count(*) = 2)") + "SELECT count(*) AS pairs, round(avg((gap > 0)::INT), 9) AS ordered, round(avg(gap), 9) AS mean_gap, round(quantile_cont(gap, 0.05), 9) AS p05, round(min(gap), 9) AS min_gap FROM g")
def a20(t):
    rows = t.l().where("truth <> 'UNCERTAIN'").withColumn("pair_id", tx.hash_number(F.col("id")) % 60)
    per = rows.groupBy("pair_id").pivot("truth", ["SAFE", "SCAM"]).agg(F.avg("p_scam")).where("SAFE IS NOT NULL AND SCAM IS NOT NULL")
    gap = F.col("SCAM") - F.col("SAFE")
    return per.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg((gap > 0).cast("int")), 9).alias("ordered"), F.round(F.avg(gap), 9).alias("mean_gap"),
        F.round(F.percentile(gap, F.lit(0.05)), 9).alias("p05"), F.round(F.min(gap), 9).alias("min_gap"),
    )


@query("a21_contrast_states", with_(MESSAGES, ledger(), f"x AS (SELECT {hex8('id')} % 40 AS c, {hex8(chr(39) + 's:' + chr(39) + ' || id')} % 4 AS state, avg(p_scam) AS p, count(*) FILTER (verdict = 'SCAM') AS alerts, count(*) AS n FROM l GROUP BY ALL)") + """
SELECT state, CAST(sum(n) AS BIGINT) AS n, round(sum(alerts) / sum(n), 9) AS alert_rate, (SELECT count(*) FROM (SELECT c FROM x GROUP BY c HAVING count(*) = 4 AND max(p) FILTER (state = 3) > max(p) FILTER (state = 0))) AS ordered FROM x GROUP BY state""")
def a21(t):
    rows = t.l().withColumn("c", tx.hash_number(F.col("id")) % 40).withColumn("state", tx.hash_bucket(F.col("id"), "s", 4))
    x = rows.groupBy("c", "state").agg(F.avg("p_scam").alias("p"), F.count_if(F.col("verdict") == "SCAM").alias("alerts"), F.count(F.lit(1)).alias("n"))
    wide = x.groupBy("c").pivot("state", [0, 1, 2, 3]).agg(F.max("p"))
    whole = wide.where(" AND ".join(f"`{k}` IS NOT NULL" for k in range(4))).agg(F.count_if(F.col("3") > F.col("0")).alias("ordered"))
    rates = x.groupBy("state").agg(F.sum("n").alias("n"), F.round(F.sum("alerts") / F.sum("n"), 9).alias("alert_rate"))
    return rates.join(F.broadcast(whole)).select("state", "n", "alert_rate", "ordered")


TARGETS = "t AS (SELECT id, k AS target, p_scam AS score, (" + hex8("id || CAST(k AS VARCHAR)") + " % 2) AS y FROM l, range(3) r(k))"


@query("a22_action_targets", with_(MESSAGES, ledger(), TARGETS, "s AS (SELECT target, score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM t GROUP BY ALL)", "u AS (SELECT target, p, q, p * (coalesce(sum(q) OVER (PARTITION BY target ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0) AS w FROM s)", "a AS (SELECT target, round(sum(w) / (sum(p) * sum(q)), 9) AS auc FROM u GROUP BY target)", "c AS (SELECT target, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn FROM t GROUP BY target)") + "SELECT target, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, auc FROM c JOIN a USING (target)")
def a22(t):
    rows = t.l().select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("target"), F.col("p_scam").alias("score"))
    rows = rows.withColumn("y", tx.hash_number(F.concat("id", F.col("target").cast("string"))) % 2)
    c = rows.groupBy("target").agg(*ev.binary_counts(F.col("score"), F.col("y"), 0.5)).drop("tn")
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.join(ev.auc(rows, "score", "y", ["target"]), "target").select("target", "tp", "fp", "fn", F.round(f1, 9).alias("f1"), F.round("auc", 9).alias("auc"))


@query("a23_latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events GROUP BY event_type")
def a23(t):
    return ev.latency_summary(t.events, "value", ["event_type"])


@query("a23_lineitem_percentiles", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 6) AS p50 FROM lineitem GROUP BY l_returnflag")
def a23b(t):
    return ev.latency_summary(t.lineitem, "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", "p50")


@query("g08_summary_check", "WITH s AS (SELECT avg(value) AS m FROM events) SELECT count(*) AS n, round(avg(value), 6) AS mean, abs(avg(value) - (SELECT m FROM s)) <= greatest(1e-9 * abs(avg(value)), 1e-6) AS agrees FROM events")
def g08(t):
    reported = t.events.agg(F.avg("value").alias("m"))
    found = t.events.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return found.join(F.broadcast(reported)).select("n", F.round("mean", 6).alias("mean"), lg.close(F.col("mean"), F.col("m"), 1e-9, 1e-6).alias("agrees"))


SWEEP = """per AS (SELECT p_scam AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM y GROUP BY 1),
k AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM per WINDOW w AS (ORDER BY threshold DESC)),
s AS (SELECT threshold, tp / ap AS recall, tp / (tp + fp) AS precision, fp / greatest(an, 1) AS fpr FROM k)"""


@query("w11_threshold_sweep", with_(MESSAGES, ledger(), LB, SWEEP) + "SELECT round(threshold, 12) AS threshold, round(recall, 9) AS recall, round(precision, 9) AS precision, round(fpr, 9) AS fpr FROM s")
def w11(t):
    return ev.sweep(ev.binary_subset(t.l())).select(F.round("threshold", 12).alias("threshold"), *[F.round(c, 9).alias(c) for c in ("recall", "precision", "fpr")])


@query("w11_choose_threshold", with_(MESSAGES, ledger(), LB, SWEEP) + "SELECT round(coalesce((SELECT threshold FROM s WHERE fpr <= 0.1 ORDER BY recall DESC, precision DESC, threshold DESC LIMIT 1), 1.0), 12) AS threshold, (SELECT count(*) FROM s WHERE fpr <= 0.1) AS feasible")
def w11c(t):
    return ev.choose_threshold(ev.binary_subset(t.l()), 0.1).select(F.round("threshold", 12).alias("threshold"), "feasible")


@query("w11_gate_threshold", with_(MESSAGES, ledger(), LB, SWEEP) + "SELECT round(max(threshold) FILTER (fpr <= 0.5 AND recall >= 0.3), 12) AS threshold FROM s")
def w11g(t):
    return ev.choose_gate_threshold(ev.binary_subset(t.l()), 0.5, 0.3).select(F.round("threshold", 12).alias("threshold"))


@query("m12_selection_metrics", with_(MESSAGES, ledger(), LB, SWEEP) + "SELECT round(threshold, 12) AS threshold, round(recall, 9) AS recall, round(precision, 9) AS precision FROM s WHERE fpr <= 0.1 ORDER BY s.recall DESC, s.precision DESC, s.threshold DESC LIMIT 1")
def m12(t):
    best = F.max(F.when(F.col("fpr") <= 0.1, F.struct("recall", "precision", "threshold"))).alias("b")
    return ev.sweep(ev.binary_subset(t.l())).agg(best).select(*[F.round(f"b.{c}", d).alias(c) for c, d in (("threshold", 12), ("recall", 9), ("precision", 9))])


ABSTAIN = """mv AS (SELECT p_safe AS s, truth, p_scam >= 0.5 AS fixed FROM l), th AS (SELECT DISTINCT s AS threshold FROM mv UNION SELECT 0.0 UNION SELECT 1.0),
pr AS (SELECT threshold, truth, CASE WHEN fixed THEN 'SCAM' WHEN s >= threshold THEN 'SAFE' ELSE 'UNCERTAIN' END AS verdict FROM th, mv),
c AS (SELECT threshold, """ + CELLS + " FROM pr GROUP BY threshold)"


@query("w12_abstention_threshold", with_(MESSAGES, ledger(), ABSTAIN) + f"SELECT threshold, round({ACTIVE}, 9) AS macro_f1, round({ACC}, 9) AS accuracy FROM c ORDER BY round({ACTIVE}, 12) DESC, round({ACC}, 12) DESC, threshold DESC LIMIT 1")
def w12(t):
    return ev.choose_abstention(t.l(), 0.5)


@query("w14_threshold_per_target", with_(MESSAGES, ledger(), TARGETS, "g AS (SELECT target, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM t GROUP BY ALL)", "k AS (SELECT target, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY target) AS ap FROM g WINDOW w AS (PARTITION BY target ORDER BY score DESC))", "f AS (SELECT target, score, round(2 * tp / (tp + fp + ap), 12) AS f1, round(tp / (tp + fp), 12) AS pr FROM k)") + "SELECT target, round(f1, 9) AS f1, round(score, 12) AS threshold FROM f QUALIFY row_number() OVER (PARTITION BY target ORDER BY f1 DESC, pr DESC, score DESC) = 1")
def w14(t):
    rows = t.l().select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("target"), "p_scam")
    rows = rows.withColumn("y", tx.hash_number(F.concat("id", F.col("target").cast("string"))) % 2)
    s = ev.sweep(rows, by=["target"]).withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 12)).withColumn("pr", F.round("precision", 12))
    return s.groupBy("target").agg(F.max(F.struct("f1", "pr", "threshold")).alias("b")).select("target", F.round("b.f1", 9).alias("f1"), F.round("b.threshold", 12).alias("threshold"))


@query("a26_oracle_ceiling", with_(MESSAGES, ledger(), f"c AS (SELECT {CELLS} FROM l)", "g AS (SELECT c.*, n_scam_safe + n_scam_uncertain AS missed, r.i AS given FROM c, range((SELECT n_scam_safe + n_scam_uncertain + 1 FROM c)) r(i))", "x AS (SELECT given, n_safe_safe + n_safe_uncertain AS n_safe_safe, 0 AS n_safe_uncertain, n_safe_scam, 0 AS n_uncertain_safe, n_uncertain_safe + n_uncertain_uncertain AS n_uncertain_uncertain, n_uncertain_scam, given AS n_scam_safe, missed - given AS n_scam_uncertain, n_scam_scam FROM g)", f"f AS (SELECT round({ACTIVE}, 12) AS f, given FROM x)") + "SELECT round(max(f), 9) AS macro_f1_upper_bound, arg_max(given, (f, given)) AS assigned_safe, count(*) AS allocations FROM f")
def a26(t):
    return ev.oracle_ceiling(ev.confusion(t.l()))


# ledgers


@query("s25_ledger_violations", L + ", x AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE id = '7') SELECT 'duplicate key' AS rule, split, id FROM x GROUP BY split, id HAVING count(*) > 1".replace("WITH", "", 1))
def s25(t):
    rows = t.l()
    return lg.violations(rows.unionByName(rows.where("id = '7'")))


@query("k07_ledger_records", L + "SELECT id, split, source, category, truth, argmax, verdict, p_scam >= 0.5 AS threshold_scam FROM l")
def k07(t):
    return t.l().select("id", "split", "source", "category", "truth", "argmax", "verdict", (F.col("p_scam") >= 0.5).alias("threshold_scam"))


@query("j01_strict_join", TWO + "SELECT id, split, va, vb FROM j")
def j01(t):
    return joined(t).select("id", "split", F.col("a.verdict").alias("va"), F.col("b.verdict").alias("vb"))


@query("j01_key_violations", L + "SELECT split, id, 'missing right' AS rule FROM l WHERE CAST(id AS BIGINT) >= 990")
def j01v(t):
    rows = t.l()
    return lg.strict_join(rows, rows.where("CAST(id AS BIGINT) < 990"), ["split", "id"], ["truth"])[1]


@query("j02_paired_binary", TWO + "SELECT count(*) AS n, count(*) FILTER ((va = 'SCAM') = (truth = 'SCAM') AND (vb = 'SCAM') <> (truth = 'SCAM')) AS first_only, count(*) FILTER ((va = 'SCAM') <> (truth = 'SCAM') AND (vb = 'SCAM') = (truth = 'SCAM')) AS second_only FROM j WHERE truth <> 'UNCERTAIN'")
def j02(t):
    rows = joined(t).select("a.truth", (F.col("a.verdict") == "SCAM").alias("x"), (F.col("b.verdict") == "SCAM").alias("y")).where("truth <> 'UNCERTAIN'")
    y = F.col("truth") == "SCAM"
    return rows.agg(
        F.count(F.lit(1)).alias("n"), vd.count_of((F.col("x") == y) & (F.col("y") != y)).alias("first_only"), vd.count_of((F.col("x") != y) & (F.col("y") == y)).alias("second_only")
    )


@query("a34_mcnemar")
def a34(t):
    r = j02(t).first()
    return t.spark.createDataFrame([(r.first_only, r.second_only, ev.exact_mcnemar(r.first_only, r.second_only))], "first_only long, second_only long, p_value double")


@query("a35_poisson_bootstrap")
def a35(t):
    rows = joined(t).select("id", F.col("a.truth").alias("truth"), F.col("a.verdict").alias("va"), F.col("b.verdict").alias("vb"))
    right = lambda c: F.sum(F.when(F.col(c) == F.col("truth"), F.col("weight")).otherwise(0)) / F.sum("weight")
    per = ev.poisson_bootstrap(rows, "id", ["truth", "va", "vb"], lambda r: r.groupBy("iteration").agg((right("vb") - right("va")).alias("d")), 200, 11)
    return per.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("iterations"))


@query("j03_parity", TWO + "SELECT count(*) AS n, round(max(greatest(abs(p_safe - q_safe), abs(p_uncertain - q_uncertain), abs(p_scam - q_scam))), 9) AS max_error, count(*) FILTER (va <> vb) AS mismatches, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM j WHERE va <> vb ORDER BY id LIMIT 20)) AS sample FROM j")
def j03(t):
    return lg.parity(t.l("a"), t.l("b"))


@query("j05_text_match", L + "SELECT count(*) AS n, count(*) FILTER (sha256(d.text) = sha256(l.text)) AS same_text FROM l JOIN documents d ON CAST(d.doc_id AS VARCHAR) = l.id")
def j05(t):
    a = t.l().select("id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    b = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("g"))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") == F.col("g")).alias("same_text"))


@query("j06_opaque_join", with_(MESSAGES, "x AS (SELECT 'sg-' || substr(sha256('review' || chr(1) || id), 1, 32) AS review_id, label FROM m)") + "SELECT m.id, x.label AS decision FROM m JOIN x ON x.review_id = 'sg-' || substr(sha256('review' || chr(1) || m.id), 1, 32)")
def j06(t):
    key = F.concat(F.lit("sg-"), tx.short_hash(F.concat(F.lit("review\x01"), F.col("id")), 32)).alias("review_id")
    return t.m.select("id", key).join(t.m.select(key, F.col("label").alias("decision")), "review_id").select("id", "decision")


@query("j20_flag_rates", L + f"SELECT category, count(*) FILTER ({hex8('id')} % 4 = 0) AS flagged, count(*) FILTER ({hex8('id')} % 4 = 0 AND verdict = 'SCAM') AS flagged_alerts, count(*) FILTER ({hex8('id')} % 4 <> 0 AND verdict = 'SCAM') AS other_alerts FROM l WHERE truth = 'SAFE' GROUP BY category")
def j20(t):
    flags = t.m.where(tx.hash_number(F.col("id")) % 4 == 0).select("id", F.lit(True).alias("flag"))
    rows = t.l().where("truth = 'SAFE'").join(flags, "id", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))
    alert = F.col("verdict") == "SCAM"
    return rows.groupBy("category").agg(F.count_if("flag").alias("flagged"), F.count_if(F.col("flag") & alert).alias("flagged_alerts"), F.count_if(~F.col("flag") & alert).alias("other_alerts"))


@query("a25_transitions", TWO + "SELECT va || '->' || vb AS change, CASE WHEN va = truth AND vb = truth THEN 'retained_correct' WHEN va = truth THEN 'regressed' WHEN vb = truth THEN 'improved' ELSE 'retained_wrong' END AS outcome, count(*) AS n FROM j GROUP BY 1, 2")
def a25(t):
    return lg.transitions(joined(t))


MARGIN = "list_sort([p_safe, p_uncertain, p_scam], 'DESC')[1] - list_sort([p_safe, p_uncertain, p_scam], 'DESC')[2]"


@query("m06_route", TWO + f"SELECT id, va = 'UNCERTAIN' OR {MARGIN} <= 0.1 AS escalated, CASE WHEN va = 'UNCERTAIN' OR {MARGIN} <= 0.1 THEN vb ELSE va END AS verdict FROM j")
def m06(t):
    return lg.routed(joined(t), 0.1).select("id", "escalated", "verdict")


RM = """SELECT {by} count(*) AS n, round(count(*) FILTER (escalated) / count(*)::DOUBLE, 9) AS escalation_rate, round(count(*) FILTER (truth = 'SAFE' AND verdict = 'SCAM') / greatest(count(*) FILTER (truth = 'SAFE'), 1)::DOUBLE, 9) AS fpr,
  round(CASE WHEN count(*) FILTER (truth = 'SCAM') = 0 THEN 0 ELSE count(*) FILTER (truth = 'SCAM' AND verdict = 'SCAM') / count(*) FILTER (truth = 'SCAM')::DOUBLE END, 9) AS recall, {cells} FROM x {group}"""


@query("a17_routed_metrics", TWO + f", x AS (SELECT truth, category, va = 'UNCERTAIN' OR {MARGIN} <= 0.1 AS escalated, CASE WHEN va = 'UNCERTAIN' OR {MARGIN} <= 0.1 THEN vb ELSE va END AS verdict FROM j), c AS ({RM.format(by='category,', cells=CELLS, group='GROUP BY category')}) SELECT category, n, escalation_rate, fpr, recall, round({ACTIVE}, 9) AS macro_f1 FROM c")
def a17(t):
    return lg.routed_metrics(lg.routed(joined(t), 0.1), ["category"])


MARGINS = [-1.0] + [i / 20 for i in range(21)]


@query("m07_fit_policy", TWO + f""", g AS (SELECT unnest([{', '.join(map(str, MARGINS))}]) AS margin_max), x AS (SELECT margin_max, truth, va = 'UNCERTAIN' OR {MARGIN} <= margin_max AS escalated, CASE WHEN va = 'UNCERTAIN' OR {MARGIN} <= margin_max THEN vb ELSE va END AS verdict FROM j, g WHERE split = 'dev'),
c AS ({RM.format(by='margin_max,', cells=CELLS, group='GROUP BY margin_max')}), z AS (SELECT *, round({ACTIVE}, 9) AS f FROM c WHERE escalation_rate <= 0.8 AND fpr <= 0.5) SELECT round(CAST(margin_max AS DOUBLE), 6) AS margin_max, true AS feasible FROM z ORDER BY recall DESC, f DESC, escalation_rate, z.margin_max LIMIT 1""")
def m07(t):
    found = lg.fit_policy(joined(t).where("split = 'dev'"), MARGINS, 0.8, 0.5)
    return found.select(F.round("margin_max", 6).alias("margin_max"), "feasible")


@query("m05_blend_grid", TWO + """, g AS (SELECT i / 10.0::DOUBLE AS w FROM range(11) r(i)), x AS (SELECT w, CAST(truth = 'SCAM' AS INT) AS y, (1 - w) * p_scam + w * q_scam AS p FROM j, g WHERE truth <> 'UNCERTAIN')
SELECT round(w, 6) AS weight, round(avg((p - y) * (p - y)), 9) AS brier FROM x GROUP BY w""")
def m05(t):
    rows = joined(t).where("a.truth <> 'UNCERTAIN'").withColumn("w", F.explode(F.array(*[F.lit(i / 10) for i in range(11)])))
    b = vd.blend(p("a."), p("b."), F.col("w"), "arithmetic")[2]
    y = (F.col("a.truth") == "SCAM").cast("int")
    return rows.select("w", (b - y).alias("d")).groupBy(F.round("w", 6).alias("weight")).agg(F.round(F.avg(F.col("d") * F.col("d")), 9).alias("brier"))


@query("m13_latency_report", "SELECT 'routed' AS path, round(CAST(8.6 + 0.25 * 177.92 AS DOUBLE), 6) AS expected_mean, CAST(NULL AS DOUBLE) AS p95 FROM range(1)")
def m13(t):
    # the p95 of a routed path does not follow from those of its parts, so it stays null
    return t.spark.range(1).select(F.lit("routed").alias("path"), F.round(F.lit(8.6) + F.lit(0.25) * F.lit(177.92), 6).alias("expected_mean"), F.lit(None).cast("double").alias("p95"))


@query("a18_gates", with_(MESSAGES, ledger(), "s AS (SELECT count(*) FILTER (truth = 'SCAM' AND verdict = 'SCAM') / count(*) FILTER (truth = 'SCAM')::DOUBLE AS recall, count(*) FILTER (truth = 'SAFE' AND verdict = 'SCAM') / count(*) FILTER (truth = 'SAFE')::DOUBLE AS fpr, count(*) AS n FROM l)") + """
SELECT 'recall' AS name, round(recall, 9) AS actual, '>=' AS op, CAST(0.3 AS DOUBLE) AS threshold, recall >= 0.3 AS passed FROM s UNION ALL SELECT 'fpr', round(fpr, 9), '<=', 0.02, fpr <= 0.02 FROM s UNION ALL SELECT 'rows', n, '>=', 100, n >= 100 FROM s""")
def a18(t):
    c = F.col
    m = {
        "recall": vd.count_of((c("truth") == "SCAM") & (c("verdict") == "SCAM")) / vd.count_of(c("truth") == "SCAM"),
        "fpr": vd.count_of((c("truth") == "SAFE") & (c("verdict") == "SCAM")) / vd.count_of(c("truth") == "SAFE"), "rows": F.count(F.lit(1)),
    }
    return lg.gates(m, [("recall", ">=", 0.3), ("fpr", "<=", 0.02), ("rows", ">=", 100)], t.l()).withColumn("actual", F.round("actual", 9))


AGREE = "x AS (SELECT l.category, l.verdict AS a, r.verdict AS b FROM l JOIN r USING (id))"


@query("a19_agreement", with_(MESSAGES, ledger(), ledger("r", "b"), AGREE, "n AS (SELECT category, count(*) AS n, count(*) FILTER (a = b) AS k FROM x GROUP BY category)") + f"SELECT category, n, k AS agreements, round(k / n::DOUBLE, 9) AS agreement, round((k / n::DOUBLE + {Z} * {Z} / (2.0 * n)) / (1 + {Z} * {Z} / n) - {Z} * sqrt((k / n::DOUBLE * (1 - k / n::DOUBLE) + {Z} * {Z} / (4.0 * n)) / n) / (1 + {Z} * {Z} / n), 9) AS lower FROM n")
def a19(t):
    rows = joined(t).select(F.col("a.category").alias("category"), F.col("a.verdict").alias("x"), F.col("b.verdict").alias("y"))
    return ev.agreement(rows, "x", "y", "category")


@query("a19_kappa", with_(MESSAGES, ledger(), ledger("r", "b"), AGREE, "o AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS k FROM x)", "e AS (SELECT sum(p * q) AS e FROM (SELECT a, count(*) AS p FROM x GROUP BY a) JOIN (SELECT b, count(*) AS q FROM x GROUP BY b) ON a = b)") + "SELECT CAST(n AS BIGINT) AS n, k AS agreements, round((k / n - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM o, e")
def a19k(t):
    rows = joined(t).select(F.col("a.verdict").alias("x"), F.col("b.verdict").alias("y"))
    return ev.agreement(rows, "x", "y").select("n", "agreements", "kappa")


@query("a36_paired_summary", TWO + "SELECT count(*) FILTER (va = 'SCAM') AS first_alerts, count(*) FILTER (vb = 'SCAM') AS second_alerts, count(*) FILTER (va = truth) AS first_right, count(*) FILTER (vb = truth) AS second_right FROM j")
def a36(t):
    r = joined(t)
    c = F.col
    return r.agg(
        F.count_if(c("a.verdict") == "SCAM").alias("first_alerts"), F.count_if(c("b.verdict") == "SCAM").alias("second_alerts"), F.count_if(c("a.verdict") == c("a.truth")).alias("first_right"),
        F.count_if(c("b.verdict") == c("b.truth")).alias("second_right"),
    )


@query("m11_plateau_rule", "WITH c(cap, score) AS (VALUES (10, 0.70), (20, 0.81), (40, 0.815), (80, 0.817)) SELECT CAST(min(cap) AS INT) AS cap FROM c WHERE score >= (SELECT max(score) FROM c) - 0.01")
def m11(t):
    rows = t.spark.createDataFrame([(10, 0.70), (20, 0.81), (40, 0.815), (80, 0.817)], "cap int, score double")
    return rows.join(F.broadcast(rows.agg(F.max("score").alias("best")))).where("score >= best - 0.01").agg(F.min("cap").alias("cap"))


@query("g05_incomplete_families", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) <> 4")
def g05(t):
    return t.nation.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).where("n <> 4")

