"""Queries on sources' label rules, contracts, sequential choices and the learnt baseline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import dialogue as dl
from ..functions import signals as sg
from ..functions import text as tx
from ..functions import verdicts as vd
from ..operators import evaluation as ev
from ..operators import linear, sampling
from ..operators import sequential as sq
from ..sources import readers, sinks
from .fixtures import MESSAGES, SAFE_AT, SCAM_AT, ledger, with_
from .more_queries import LINES, lines, scratch, signalled
from .registry import query
from .text_queries import FAM, family

M = with_(MESSAGES)
L = with_(MESSAGES, ledger())


@query("s04_label_map", M + "SELECT id, CASE label WHEN 'SAFE' THEN 'ham' ELSE 'scam' END AS mark, 'ood' AS split FROM m WHERE label <> 'UNCERTAIN'")
def s04(t):
    mark = F.create_map(F.lit("SAFE"), F.lit("ham"), F.lit("SCAM"), F.lit("scam"))
    return t.m.select("id", F.element_at(mark, F.col("label")).alias("mark"), F.lit("ood").alias("split")).where("mark IS NOT NULL")


@query("s07_evidence_gate", M + "SELECT id, CASE WHEN label = 'SCAM' AND regexp_matches(lower(text), 'password|refund|stupid') THEN 'SCAM' WHEN label = 'SCAM' THEN 'UNCERTAIN' ELSE label END AS label FROM m")
def s07(t):
    proof = F.lower("text").rlike("password|refund|stupid")
    return t.m.select("id", F.when((F.col("label") == "SCAM") & ~proof, "UNCERTAIN").otherwise(F.col("label")).alias("label"))


@query("s10_consistency", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE (l_linestatus = 'F') <> (l_returnflag IN ('A', 'R')) GROUP BY ALL")
def s10(t):
    wrong = (F.col("l_linestatus") == "F") != F.col("l_returnflag").isin("A", "R")
    return t.lineitem.where(wrong).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("s11_nested_dialogues", "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE text <> '' GROUP BY conv_id HAVING count(*) >= 4")
def s11(t):
    nested = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("u"))
    said = F.filter("u", lambda x: x["text"] != "")
    rows = nested.select("conv_id", said.alias("u")).where(F.size("u") >= 4)
    return rows.select("conv_id", F.size("u").cast("long").alias("turns"), F.aggregate("u", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"])).alias("chars"))


@query("s13_annotations", "SELECT conv_id, turn, CAST(turn AS INT) AS parsed, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS tokens FROM conversations")
def s13(t):
    index = F.concat(F.col("turn").cast("string"), F.lit(".0"))
    parsed = F.when(index.rlike(r"^\d+(?:\.0+)?$"), F.regexp_extract(index, r"^(\d+)", 1).cast("int"))
    return t.conversations.select("conv_id", "turn", parsed.alias("parsed"), F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long").alias("tokens"))


@query("s15_call_windows", with_(LINES) + "SELECT conv_id, kind, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT conv_id, 'early' AS kind, line FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 UNION ALL SELECT conv_id, 'recent', line FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY ALL")
def s15(t):
    calls = lines(t).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("s"))
    n = F.size("s")
    both = F.array(F.struct(F.lit("early").alias("kind"), F.slice("s", 1, 2).alias("w")), F.struct(F.lit("recent").alias("kind"), F.slice("s", F.greatest(n - 1, F.lit(1)), F.lit(2)).alias("w")))
    rows = calls.select("conv_id", F.explode(both).alias("x"))
    return rows.select("conv_id", "x.kind", F.aggregate("x.w", F.lit(0).cast("long"), lambda s, x: s + F.length(x["line"])).alias("chars"))


@query("s16_file_stems", "SELECT count(*) AS n FROM documents")
def s16(t):
    stems = t.documents.select(F.regexp_extract("_metadata.file_path", r"(documents)\.parquet", 1).alias("stem"))
    return stems.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("stem = 'documents'").select("n")


@query("s17_split_contract", "SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL) AS nulls FROM documents GROUP BY lang")
def s17(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("nulls"))


@query("s18_projected_scan", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, max(n_chars) AS longest FROM documents")
def s18(t):
    return t.documents.select("doc_id", "n_chars").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.max("n_chars").alias("longest"))


@query("s19_language_filter", M + "SELECT count(*) AS n, count(*) FILTER (source_language = 'en') AS kept FROM m")
def s19(t):
    return t.m.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_language") == "en").alias("kept"))


@query("s20_campaign_labels", L + "SELECT category, CASE WHEN category IN ('c0', 'c1') THEN 'SCAM' WHEN category = 'c2' THEN 'SAFE' ELSE 'UNCERTAIN' END AS mapped, count(*) AS n FROM l GROUP BY ALL")
def s20(t):
    mapped = F.when(F.col("category").isin("c0", "c1"), "SCAM").when(F.col("category") == "c2", "SAFE").otherwise("UNCERTAIN")
    return t.l().groupBy("category", mapped.alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query("s23_candidate_rows", M + "SELECT id FROM m WHERE trim(text) <> '' AND trim(label) <> ''")
def s23(t):
    return t.m.where("trim(text) <> '' AND trim(label) <> ''").select("id")


@query("p04_eligibility", M + "SELECT id, len(list_filter(['password', 'account', 'refund'], lambda w: contains(lower(text), w))) AS cues FROM m WHERE length(text) BETWEEN 200 AND 2000")
def p04(t):
    cues = F.filter(F.array(*map(F.lit, ("password", "account", "refund"))), lambda w: F.contains(F.lower("text"), w))
    return t.m.where(F.length("text").between(200, 2000)).select("id", F.size(cues).cast("long").alias("cues"))


@query("p07_evidence_predicate")
def p07(t):
    rows = signalled(t).withColumn("evidence", (F.size("signals") > 0) | F.col("source").isin("src0"))
    return rows.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"))


@query("p13_nested_strings", "SELECT event_id, props IS NOT NULL AND props <> '' AS has_text FROM events")
def p13(t):
    leaves = F.map_values(F.from_json("props", "map<string,string>"))
    return t.events.select("event_id", (F.size(F.coalesce(leaves, F.array().cast("array<string>"))) >= 0) & F.col("props").isNotNull() & (F.col("props") != "")).toDF("event_id", "has_text")


@query("j04_product_contract", L + "SELECT count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM l")
def j04(t):
    again = vd.verdict(F.col("p_safe"), F.col("p_scam"), SCAM_AT, SAFE_AT)
    rows = t.m.select("id", F.col("label").alias("own"), F.col("source").alias("from")).join(t.l(), "id")
    wrong = (F.col("own") != F.col("truth")) | (F.col("from") != F.col("source")) | (again != F.col("verdict"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong"))


@query("t05_errors_and_controls", L + ", e AS (SELECT split, id, truth, 'error' AS kind FROM l WHERE verdict <> truth AND split <> 'train'), k AS (SELECT split, truth, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT l.split, l.id, l.truth, row_number() OVER (PARTITION BY l.split, l.truth ORDER BY sha256('control:' || l.id)) AS rn FROM l WHERE verdict = l.truth AND split <> 'train') SELECT split, id, kind FROM e UNION ALL SELECT c.split, c.id, 'control' FROM c JOIN k USING (split, truth) WHERE rn <= k.n".replace("WITH", "", 1))
def t05(t):
    rows = t.l().where("split <> 'train'").select("split", "id", "truth", "verdict")
    errors = rows.where("verdict <> truth")
    wanted = errors.groupBy("split", "truth").agg(F.count(F.lit(1)).alias("n"))
    controls = sampling.ranked(rows.where("verdict = truth"), ["split", "truth"], [sampling.hash_rank("control")]).join(wanted, ["split", "truth"]).where("rn <= n")
    return errors.select("split", "id", F.lit("error").alias("kind")).unionByName(controls.select("split", "id", F.lit("control").alias("kind")))


@query("t06_component_subset")
def t06(t):
    sizes = {r.source: r["count"] for r in t.m.groupBy("source").count().collect()}
    return t.spark.createDataFrame([(s, sizes[s]) for s in sorted(sq.nearest_subset(sizes, 0.2, "partition"))], "source string, n long")


@query("w06_least_loaded")
def w06(t):
    return sq.least_loaded(family(t.m).select("family_id", "source", "id"), "family_id", "source", "balance")


@query("w13_stable_threshold")
def w13(t):
    rows = ev.binary_subset(t.l())
    at = ev.choose_threshold(rows, 0.1).first().threshold
    ends = t.l().agg(F.max(F.when(F.col("p_scam") < at, F.col("p_scam"))).alias("below"), F.min(F.when(F.col("p_scam") >= at, F.col("p_scam"))).alias("above")).first()
    return t.spark.createDataFrame([(at, sq.stable_threshold(at, ends.below, ends.above if ends.above is not None else at))], "observed double, stable double")


@query("u07_reference_union", "SELECT DISTINCT text FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM benchmark)")
def u07(t):
    return t.benchmark.select("text").unionByName(t.benchmark.select("text")).distinct()


@query("f14_materialized", "SELECT event_id, 'mail support@example.org or <OTHER> today' AS text, 'EMAIL,DATE' AS replaced FROM events")
def f14(t):
    text = F.lit("mail <EMAIL> or <OTHER> <DATE>")
    return t.events.select("event_id", sq.materialized(text).alias("text"), F.array_join(sq.placeholders(text), ",").alias("replaced"))


@query("r05_protective_labels")
def r05(t):
    rows = signalled(t)
    return rows.select("id", sg.protective_label(F.col("text"), F.col("signals")).alias("protective"), sg.strong_evidence(F.col("signals")).alias("strong"))


@query("r08_targets")
def r08(t):
    found = sg.signal_matches(F.col("text"))
    rows = t.m.select("id", "text", "label", found.alias("found"))
    safe = F.col("label") == "SAFE"
    quotes = F.transform("found", lambda x: x["text"])
    target = F.struct(F.col("label").alias("verdict"), F.when(safe, F.array().cast("array<string>")).otherwise(quotes).alias("evidence"))
    return rows.select("id", target.alias("target"), F.forall(quotes, lambda q: F.contains("text", q)).alias("valid"))


@query("d04_evidence_turns")
def d04(t):
    @F.pandas_udf("array<int>")
    def chosen(texts: pd.Series) -> pd.Series:
        return texts.map(lambda v: [x.at for x in dl.evidence([y.measured() for y in dl.turns(v)])])

    return t.dlg.select("conv_id", chosen("text").alias("turns"))


@query("d05_excerpts")
def d05(t):
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda v: [x.excerpt(x.measured().anchor, False) for x in dl.turns(v)])

    return t.dlg.select("conv_id", cut("text").alias("excerpts"))


@query("g06_visibility")
def g06(t):
    kept = dl.prepared(F.col("text"), "speaker-neutral-evidence-recent-v2")
    return t.dlg.select("conv_id", (F.length(kept) <= F.greatest(F.length("text"), F.lit(dl.MAX_CHARS))).alias("bounded"))


@query("m02_temperature")
def m02(t):
    rows = t.l().select("truth", *[F.log(c).alias(c) for c in ("p_safe", "p_uncertain", "p_scam")])
    best = sq.temperature(rows, "truth", {"SAFE": "p_safe", "UNCERTAIN": "p_uncertain", "SCAM": "p_scam"})
    return t.spark.createDataFrame([(best,)], "temperature double")


@query("m10_linear_baseline")
def m10(t):
    """TF-IDF of words and of characters within words, balanced logistic regression; the score of every row."""
    rows = t.m.where("label <> 'UNCERTAIN'").select("id", "text", (F.col("label") == "SCAM").cast("double").alias("y"))
    return linear.baseline(rows, ["id", "y"])


@query("x01_scorer_backend")
def x01(t):
    """Any scorer that takes a batch of texts and gives three probabilities, as an Arrow-batched map."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = f["text"].map(lambda v: len(sg.matches(v)))
            scam = (0.05 + 0.08 * found).clip(upper=0.98)
            yield pd.DataFrame({"id": f["id"], "p_safe": 1 - scam, "p_uncertain": 0.0, "p_scam": scam})

    return t.m.select("id", "text").mapInPandas(batches, "id string, p_safe double, p_uncertain double, p_scam double")


@query("x06_replayed_verdicts", L + "SELECT id, verdict FROM l")
def x06(t):
    return t.l().select("id", "verdict")


@query("x07_window_rows", with_(MESSAGES, FAM) + "SELECT id, unnest(['early', 'recent']) AS kind FROM f")
def x07(t):
    return t.m.select("id", F.explode(F.array(F.lit("early"), F.lit("recent"))).alias("kind"))


@query("k02_manifest", M + "SELECT source, count(*) AS n FROM m GROUP BY source")
def k02(t):
    path = scratch(t, "manifest")
    sinks.write_manifest(t.m.groupBy("source").agg(F.count(F.lit(1)).alias("n")), path)
    rows = t.spark.read.schema("counts array<struct<source:string,n:long>>, rows long").json(path)
    return rows.select(F.explode("counts").alias("c")).select("c.source", "c.n")



# files and registries


@query("s02_zip_csv", "SELECT r_name, CAST(r_regionkey AS VARCHAR) AS r_regionkey FROM region")
def s02(t):
    rows = t.region.select("r_regionkey", "r_name").collect()  # the five rows of a fixed dimension
    lines = "\ufeffr_regionkey,r_name\n" + "".join(f"{r.r_regionkey},{r.r_name}\n" for r in rows)
    path = scratch(t, "zip") + ".zip"
    sinks.write_bytes(t.spark, path, sinks.zipped({"rows.csv": lines.encode(), "notes.txt": b"no rows"}))
    return readers.read_zip_csv(t.spark, path, "r_regionkey string, r_name string").select("r_name", "r_regionkey")


@query("s26_text_and_audio", M + "SELECT id, CASE WHEN label = 'SAFE' THEN id ELSE source || chr(10) || id END AS text, CASE WHEN label = 'SAFE' THEN 0 ELSE 1 END AS audios FROM m")
def s26(t):
    part = lambda kind, text, audio: F.struct(F.lit(kind).alias("type"), text.alias("text"), audio.alias("audio"))
    none = F.lit(None).cast("string")
    parts = F.array(part("text", F.col("source"), none), part("audio", none, F.lit("a.wav")), part("text", F.col("id"), none))
    content = F.when(F.col("label") == "SAFE", F.concat(F.lit('"'), "id", F.lit('"'))).otherwise(F.to_json(parts))
    return t.m.select("id", content.alias("content")).select("id", readers.flatten_content("content").alias("x")).select("id", "x.text", "x.audios")


@query("s29_verified_inputs")
def s29(t):
    return readers.verified(t.spark, f"{t.sf_dir}/region.parquet", {"region.parquet": "0" * 64})


@query("k01_written_rows", M + "SELECT count(*) AS n FROM m")
def k01(t):
    return t.spark.createDataFrame([(sinks.write_jsonl(t.m, scratch(t, "jsonl")),)], "n long")


@query("k04_audit_csv", M + "SELECT id, label, '' AS auditor_label FROM m")
def k04(t):
    path = scratch(t, "audit")
    sinks.write_audit(t.m.select("id", "label"), path)
    rows = readers.read_csv(t.spark, path, "id string, label string, auditor_label string, notes string")
    return rows.select("id", "label", F.coalesce("auditor_label", F.lit("")).alias("auditor_label"))


@query("k06_deterministic_zip", "SELECT true AS same")
def k06(t):
    a, b = sinks.zipped({"x": b"1", "y": b"2"}), sinks.zipped({"y": b"2", "x": b"1"})
    return t.spark.createDataFrame([(a == b,)], "same boolean")


@query("k08_score_cache_miss", "SELECT true AS missed")
def k08(t):
    path = scratch(t, "scores")
    sinks.write_scores(t.l().select("id", "p_scam"), path, "run-a")
    return t.spark.createDataFrame([(readers.cached_scores(t.spark, path, "run-b") is None,)], "missed boolean")


@query("d08_x03_policies")
def d08(t):
    return t.dlg.select("conv_id", *[dl.prepared(F.col("text"), p).alias(p.replace("-", "_")) for p in dl.POLICIES])


@query("x02_transforms", M + "SELECT id, length(regexp_replace(text, '[ :—-]+', ' . ', 'g')) AS punctuation FROM m")
def x02(t):
    return t.m.select("id", F.length(tx.TRANSFORMS["punctuation"](F.col("text"), F.col("label"))).cast("long").alias("punctuation"))


@query("x04_blend_methods")
def x04(t):
    p = [F.col(c) for c in ("p_safe", "p_uncertain", "p_scam")]
    return t.l().select("id", *[vd.blend(p, p[::-1], F.lit(0.5), m)[0].alias(m) for m in ("arithmetic", "log_linear")])


@query("x05_metric_callback")
def x05(t):
    rows = t.l().select("id", "truth", "verdict", "argmax")
    right = lambda c: F.sum(F.when(F.col(c) == F.col("truth"), F.col("weight")).otherwise(0)) / F.sum("weight")
    return ev.poisson_bootstrap(rows, "id", ["truth", "verdict", "argmax"], lambda r: r.groupBy("iteration").agg((right("verdict") - right("argmax")).alias("d")), 50, 7)
