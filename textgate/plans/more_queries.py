"""Queries on neighbours, dialogues, rules, governance, files, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dialogue as dl
from ..functions import privacy, simhash
from ..functions import signals as sg
from ..functions import text as tx
from ..functions import verdicts as vd
from ..operators import dedup, dialogues, near, sampling, tiles
from ..sources import readers, sinks
from ..storage import shared_dir
from ..streaming import streams
from .fixtures import BENCHMARK, DIALOGUES, MESSAGES, hex8, ledger, normal, with_
from .registry import query
from .text_queries import FAM, NM, family, keyed

M = with_(MESSAGES)
#: Signatures with planted neighbours: groups of four differ in their lowest two bits.
SIGS = f"p AS (SELECT p_partkey AS k, {hex8('CAST(p_partkey // 4 AS VARCHAR)')} * 1048576 + p_partkey % 4 AS sig FROM part)"


def sigs(t):
    base = tx.hash_number(F.expr("CAST(p_partkey div 4 AS string)"))
    return t.part.select(F.col("p_partkey").alias("k"), (base * 1048576 + F.col("p_partkey") % 4).alias("sig"))


BANDS = ", ".join(f"({o}, {w})" for o, w in simhash._cuts(7))


@query("f08_simhash")
def f08(t):
    tagged, signed = near.signatures(t.texts.select("id", "text"), keep=["id"])
    return tagged.join(signed, "skeleton_hash").select("id", "sig")


@query("f09_bands", with_(SIGS, f"w AS (SELECT row_number() OVER () - 1 AS band, o, w FROM (VALUES {BANDS}) v(o, w))") + "SELECT k, CAST(band AS INT) AS band, (sig >> o) & ((1::BIGINT << w) - 1) AS value FROM p, w")
def f09(t):
    return sigs(t).select("k", F.explode(simhash.bands(F.col("sig"))).alias("b")).select("k", "b.band", "b.value")


@query("j10_hamming_pairs", with_(SIGS) + "SELECT x.k AS a, y.k AS b FROM p x JOIN p y ON x.k < y.k AND bit_count(xor(x.sig, y.sig)) <= 6")
def j10(t):
    return near.hamming_pairs(sigs(t), key="k")


@query("j10_near_overlap", with_(SIGS) + "SELECT DISTINCT x.k AS a FROM p x JOIN p y ON bit_count(xor(x.sig, y.sig)) <= 6 WHERE x.k % 2 = 0 AND y.k % 8 = 1")
def j10o(t):
    s = sigs(t)
    return near.near_any(s.where("k % 2 = 0"), s.where("k % 8 = 1"), "k").withColumnRenamed("k", "a")


@query("j11_clusters", with_(SIGS, "e AS (SELECT x.k AS a, y.k AS b FROM p x JOIN p y ON x.k <> y.k AND bit_count(xor(x.sig, y.sig)) <= 6)").replace("WITH", "WITH RECURSIVE", 1) + ", r AS (SELECT k AS node, k AS root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node")
def j11(t):
    s = sigs(t)
    return near.components(s, near.ties(s, "k"), "k")


@query("j11_near_clusters")
def j11n(t):
    return near.clusters(t.texts.select("id", "text"), keep=["id"]).select("id", "skeleton_hash", "root")


@query("a04_near_families")
def a04(t):
    # texts are signed before labels are joined to what is left of them
    found = near.clusters(t.texts.select("id", "text"), keep=["id"]).withColumn("split", tx.split_for_family(F.col("id")))
    return near.representatives(found.join(near.merged(t.m.select("id", "label")), "id"), "label", "split", "id", ["id", "split"]).select("id", "family_id", "split", "n")


@query("k03_near_quarantine")
def k03n(t):
    return near.near_families(t.m.select("id", "text", "label"))[1].select("root", "n", "lo", "hi")


@query("j10_remove_near")
def j10r(t):
    tagged, signed = near.signatures(t.texts.select("id", "text"), keep=["id"])
    return tagged.join(near.near_keys(signed, t.b), "skeleton_hash", "left_anti").select("id")


@query("j12_remove_families")
def j12(t):
    return near.remove_families(t.texts.select("id", "text", "source"), t.b, F.col("source")).select("id", "source")


@query("j13_privacy_overlaps")
def j13(t):
    """Pairs that are near only after masking."""
    before, after = (near.hamming_pairs(near.signatures(t.texts.select("id", x.alias("text")), keep=[])[1], near.signatures(t.b.select("id", x.alias("text")), keep=[])[1]) for x in (F.col("text"), tx.mask_contacts(F.col("text"))))
    return after.join(before, ["a", "b"], "left_anti")


@query("j14_split_leaks", with_(SIGS) + "SELECT x.k AS a, y.k AS b FROM p x JOIN p y ON x.k < y.k AND x.k % 3 <> y.k % 3 AND bit_count(xor(x.sig, y.sig)) <= 6")
def j14(t):
    return tiles.pairs(sigs(t), "k", near.RADIUS).where("a % 3 <> b % 3")


@query("j10_message_overlap")
def j10m(t):
    """Messages that are near a text of the benchmark; j10_near_overlap does so on some planted signatures."""
    tagged, signed = near.signatures(t.texts.select("id", "text"), keep=["id"])
    return tagged.join(near.near_keys(signed, t.b), "skeleton_hash", "left_semi").select("id")


@query("j14_message_leaks")
def j14m(t):
    """Near pairs of messages across splits; j14_split_leaks has them for planted signatures."""
    return near.split_leaks(t.texts.select("id", "text", tx.split_for_family(F.col("id")).alias("split")))


@query("a05_components", with_(MESSAGES, NM, "e AS (SELECT x.ordinal AS a, y.ordinal AS b FROM n x JOIN n y ON x.key = y.key AND x.ordinal <> y.ordinal)").replace("WITH", "WITH RECURSIVE", 1) + ", r AS (SELECT ordinal AS node, ordinal AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node")
def a05(t):
    rows = keyed(t.texts).select("ordinal", "key")
    first = rows.groupBy("key").agg(F.min("ordinal").alias("a"))
    return near.components(rows, rows.join(first, "key").select("a", F.col("ordinal").alias("b")), "ordinal")


# rules


@query("r01_signal_matches")
def r01(t):
    return t.texts.select("id", F.explode(sg.signal_matches(F.col("text"))).alias("s")).select("id", "s.*")


@query("r01_signal_flags")
def r01f(t):
    return t.texts.select("id", *[c.alias(n) for n, c in sg.signal_flags(F.col("text")).items()])


def signalled(t):
    return t.m.withColumn("signals", F.transform(sg.signal_matches(F.col("text")), lambda s: s["signal"]))


CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in sg.CATEGORY_WORDS) + " END"
DATASET_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in sg.DATASET_CATEGORY_WORDS) + " ELSE 'UNKNOWN' END"


@query("r02_infer_category", M + f"SELECT id, coalesce({CATEGORY}, 'UNKNOWN') AS category FROM m")
def r02(t):
    return t.texts.select("id", sg.infer_category(F.col("text"), F.array().cast("array<string>")).alias("category"))


@query("r03_dataset_category", M + f"SELECT id, {DATASET_CATEGORY} AS category FROM m")
def r03(t):
    return t.texts.select("id", sg.dataset_category(F.col("text")).alias("category"))


@query("r04_choose_action", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'DO_NOT_SHARE_CODE' WHEN event_id % 5 = 0 THEN 'DO_NOT_INSTALL_SOFTWARE' WHEN event_id % 7 = 0 THEN 'DO_NOT_PAY' ELSE 'NO_ACTION' END AS action FROM events")
def r04(t):
    given = [F.when(F.col("event_id") % n == 0, F.lit(s)) for n, s in ((3, "otp_request"), (5, "remote_access_request"), (7, "payment_request"))]
    return t.events.select("event_id", sg.choose_action(F.array_compact(F.array(*given))).alias("action"))


@query("r06_label_policies")
def r06(t):
    rows = signalled(t)
    mark = F.when(F.col("label") == "SAFE", "ham").when(F.col("label") == "SCAM", "smishing").otherwise("spam")
    return rows.select("id", sg.sms_label(F.col("text"), F.col("signals"), mark).alias("sms"), sg.forum_label(F.col("text"), F.col("signals"), mark).alias("forum"))


@query("r07_override")
def r07(t):
    return signalled(t).select("id", sg.override(F.col("text"), F.col("signals")).alias("override"))


@query("m08_heuristic_scores")
def m08(t):
    return signalled(t).select("id", sg.heuristic_scores(F.col("signals")).alias("s")).select("id", "s.*")


@query("m09_scan")
def m09(t):
    """Every message scored, judged and explained; texts of no or over 100,000 characters are errors."""
    text = F.trim("text")
    rows = t.texts.select("id", text.alias("text")).withColumn("bad", F.when(F.length("text") == 0, "empty").when(F.length("text") > 100_000, "too long"))
    rows = rows.withColumn("found", sg.signal_matches(F.col("text"))).withColumn("signals", F.transform("found", lambda s: s["signal"]))
    rows = rows.withColumn("s", sg.heuristic_scores(F.col("signals"))).withColumn("verdict", vd.verdict(F.col("s.p_safe"), F.col("s.p_scam"), 0.80, 0.80, 0.20))
    safe = F.col("verdict") == "SAFE"
    action = sg.choose_action(F.col("signals"))
    return rows.select(
        "id", F.col("bad").alias("error"), F.when(F.col("bad").isNull(), F.col("verdict")).alias("verdict"), F.col("s.p_scam").alias("risk"),
        F.when(safe, "NONE").otherwise(sg.infer_category(F.col("text"), F.col("signals"))).alias("category"),
        F.when(safe, F.array().cast("array<string>")).otherwise(F.col("signals")).alias("signals"),
        F.when(safe, "NO_ACTION").when(action == "NO_ACTION", "VERIFY_OFFICIAL_CHANNEL").otherwise(action).alias("action"),
    )


@query("a24_output_summary")
def a24(t):
    return m09(t).select(F.explode_outer("signals").alias("signal"), "verdict").groupBy("signal", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("a29_policy_coverage")
def a29(t):
    rows = signalled(t).select("label", sg.override(F.col("text"), F.col("signals"))["rule"].alias("rule"))
    return rows.groupBy("rule", "label").agg(F.count(F.lit(1)).alias("n"))


@query("j07_policy_join")
def j07(t):
    rule = signalled(t).select("id", sg.override(F.col("text"), F.col("signals"))["verdict"].alias("forced"))
    return t.l().join(rule, "id").select("id", F.coalesce("forced", "verdict").alias("verdict"), F.col("forced").isNotNull().alias("overridden"))


@query("f05_contextual_masks")
def f05(t):
    return t.texts.select("id", privacy.mask_contextual(F.col("text")).alias("p")).select("id", F.sha2(F.col("p.text").cast("binary"), 256).alias("masked"), F.map_entries("p.counts").alias("counts"))


# dialogues


TURN = "s AS (SELECT conv_id, turn, role, text FROM conversations)"


@query("d01_parse_turns")
def d01(t):
    return t.dlg.select("conv_id", F.posexplode(dl.parsed(F.col("text"))).alias("at", "t")).select("conv_id", F.col("at").cast("long").alias("at"), "t.*")


@query("d02_speaker_neutral")
def d02(t):
    return t.dlg.select("conv_id", dl.prepared(F.col("text"), "speaker-neutral-v1").alias("text"))


@query("d03_turn_scores")
def d03(t):
    return t.conversations.select("conv_id", "turn", *[c.cast("long").alias(n) for n, c in dl.turn_scores(F.col("text")).items()])


@query("d06_evidence_recent")
def d06(t):
    return t.dlg.select("conv_id", dl.prepared(F.col("text"), "speaker-neutral-evidence-recent-v2").alias("text"))


@query("d07_action_preserving")
def d07(t):
    return t.dlg.select("conv_id", dl.prepared(F.col("text"), "speaker-neutral-action-preserving-v3").alias("text"))


@query("d09_decisive_turn", "SELECT turn, count(DISTINCT text) AS texts FROM conversations GROUP BY turn")
def d09(t):
    return t.conversations.groupBy("turn").agg(F.count_distinct("text").alias("texts"))


@query("s12_dialogues", with_(DIALOGUES) + "SELECT conv_id, sha256(text) AS digest, turns FROM dlg")
def s12(t):
    return t.dlg.select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "turns")


@query("s14_conversation_ids", "SELECT DISTINCT conv_id FROM conversations")
def s14(t):
    return t.conversations.select("conv_id").distinct()


LINES = "c AS (SELECT conv_id, turn, upper(role) || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations)"


def lines(t):
    return t.conversations.select("conv_id", "turn", F.concat(F.upper("role"), F.lit(": "), tx.clean(F.col("text"))).alias("line"))


def context_sql(order):
    return with_(LINES, f"""r AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN length(line) > 600 THEN 600 ELSE length(line) END) OVER (PARTITION BY conv_id ORDER BY turn {order} ROWS UNBOUNDED PRECEDING) AS naive FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn {order})),
f AS (SELECT conv_id, max(CASE WHEN rn = 1 AND length(line) > 600 THEN 600 WHEN rn = 1 THEN length(line) END) AS first_len FROM r GROUP BY conv_id),
x AS (SELECT r.*, first_len + coalesce(sum(CASE WHEN rn > 1 THEN length(line) + 1 END) OVER (PARTITION BY r.conv_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS total FROM r JOIN f USING (conv_id))""") + """
SELECT conv_id, string_agg(CASE WHEN rn = 1 AND length(line) > 600 THEN rtrim(substr(line, 1, 599)) || '…' ELSE line END, chr(10) ORDER BY turn) AS context, count(*) AS lines FROM x WHERE rn = 1 OR total <= 600 GROUP BY conv_id"""


@query("w07_latest_context", context_sql("DESC"))
def w07(t):
    return sampling.context(lines(t), "conv_id", "turn", "line", 600, recent=True)


@query("w07_earliest_context", context_sql("ASC"))
def w07e(t):
    return sampling.context(lines(t), "conv_id", "turn", "line", 600, recent=False)


CHANGES = "c AS (SELECT *, (role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS changed FROM conversations)"


@query("w09_role_changes", with_(CHANGES) + "SELECT conv_id, count(*) AS turns, round(CASE WHEN count(*) > 1 THEN sum(changed) / (count(*) - 1)::DOUBLE END, 9) AS change_ratio FROM c GROUP BY conv_id")
def w09(t):
    return dialogues.role_changes(t.conversations, "conv_id", "turn", "role").withColumn("change_ratio", F.round("change_ratio", 9))


@query("w10_speaker_ordinals", "WITH f AS (SELECT conv_id, role, min(turn) AS seen FROM conversations GROUP BY ALL) SELECT conv_id, role, chr(64 + CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seen) AS INT)) AS speaker FROM f")
def w10(t):
    return dialogues.speaker_ordinals(t.conversations, "conv_id", "turn", "role")


@query("w08_turn_ends", with_(TURN, "p AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS ends FROM s)") + "SELECT conv_id, turn, CAST(ends AS BIGINT) AS ends, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM p")
def w08(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.conversations.select("conv_id", "turn", F.sum(F.length("text") + 1).over(upto).alias("ends"), F.lead("turn").over(w).alias("following"))


@query("w15_turn_max", "SELECT conv_id, turn, score FROM (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS score FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1")
def w15(t):
    return dialogues.strongest(t.conversations, "conv_id", "turn", F.length("text").cast("long"))


@query("r11_agent_turn", r"""WITH s AS (SELECT conv_id, turn, 5 * len(regexp_extract_all(lower(text), '\b(?:account|password|code|card)\b')) + 3 * len(regexp_extract_all(lower(text), '\b(?:please|send|share)\b')) AS score, length(text) AS size FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, size DESC, turn) = 1""")
def r11(t):
    hits = lambda p, w: F.regexp_count(F.lower("text"), F.lit(rf"\b(?:{p})\b")) * w
    rows = t.conversations.where("role = 'assistant'").withColumn("score", (hits("account|password|code|card", 5) + hits("please|send|share", 3)).cast("long"))
    best = rows.groupBy("conv_id").agg(F.max(F.struct("score", F.length("text").alias("size"), (-F.col("turn")).alias("at"))).alias("b"))
    return best.select("conv_id", (-F.col("b.at")).alias("turn"), "b.score")


@query("p03_quality_dialogue", with_(CHANGES, f"q AS (SELECT *, {normal('text')} AS norm FROM c)") + r"""SELECT conv_id, count(*) AS turns, (count(*) BETWEEN 6 AND 32 AND count(DISTINCT turn) = count(*) AND count(*) FILTER (role = 'user') >= 2 AND count(*) FILTER (role = 'assistant') >= 2
  AND count(*) FILTER (norm <> '') >= 6 AND count(DISTINCT norm) FILTER (norm <> '') >= 0.6 * count(*) FILTER (norm <> '') AND sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) >= 35 AND sum(changed) >= 0.65 * (count(*) - 1)) AS good FROM q GROUP BY conv_id""")
def p03(t):
    return dialogues.quality(t.conversations, "conv_id", "turn", "role", "text", ("user", "assistant")).select("conv_id", "turns", "good")


@query("p09_speaker_flags")
def p09(t):
    spoken = F.filter(dl.parsed(F.col("text")), lambda x: x["speaker"] == "user")
    own = F.array_join(F.transform(spoken, lambda x: x["content"]), "\n")
    return t.dlg.select("conv_id", *[own.rlike(p).alias(n) for n, p in (("asks_code", "(?i)code|password"), ("asks_payment", "(?i)pay|transfer"))])


@query("j16_granularity", """WITH u AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS whole, list(text) AS parts FROM conversations GROUP BY conv_id)
SELECT count(*) AS keys, count(*) FILTER (len(list_filter(parts, lambda p: NOT contains(whole, p))) = 0) AS contained FROM u""")
def j16(t):
    u = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s")).select("conv_id", F.array_join("s.text", " ").alias("whole"), F.col("s.text").alias("parts"))
    return u.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.forall("parts", lambda p: F.contains("whole", p))).alias("contained"))


@query("j17_seed_lookup", "WITH s AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id) SELECT conv_id, turn, c.role FROM s JOIN conversations c USING (conv_id, turn) WHERE length(c.text) > 20")
def j17(t):
    seeds = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return seeds.join(t.conversations, ["conv_id", "turn"]).where(F.length("text") > 20).select("conv_id", "turn", "role")


@query("a32_conversation_audit", "SELECT role, count(*) AS usable, count(DISTINCT conv_id) AS conversations, count(*) FILTER (text = '') AS empty FROM conversations GROUP BY role")
def a32(t):
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("usable"), F.count_distinct("conv_id").alias("conversations"), F.count_if(F.col("text") == "").alias("empty"))


@query("w16_unique_first", "WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY text ORDER BY sha256(CAST(conv_id AS VARCHAR)), turn) AS rn FROM conversations) SELECT conv_id, turn FROM r WHERE rn = 1")
def w16(t):
    rows = t.conversations.withColumn("h", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    return sampling.top_per_group(rows, ["text"], 1, [F.col("h"), F.col("turn")]).select("conv_id", "turn")


# governance


@query("g01_violations", with_(MESSAGES, FAM, f"s AS (SELECT *, {hex8('id')} % 3 AS split FROM f)") + r"""SELECT 'short text' AS rule, id FROM s WHERE length(trim(text)) < 4 UNION ALL SELECT 'long digits', id FROM s WHERE regexp_matches(text, '\d{10,}')
  UNION ALL SELECT 'family leak', min(id) FROM s GROUP BY family_id HAVING count(DISTINCT split) > 1""")
def g01(t):
    rows = family(t.texts).withColumn("split", tx.hash_number(F.col("id")) % 3)
    checks = F.array_compact(F.array(F.when(F.length(F.trim("text")) < 4, "short text"), F.when(F.col("text").rlike(r"\d{10,}"), "long digits")))
    leaks = rows.groupBy("family_id").agg(F.min("id").alias("id"), F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return rows.select(F.explode(checks).alias("rule"), "id").unionByName(leaks.select(F.lit("family leak").alias("rule"), "id"))


@query("g02_holdout", with_(MESSAGES, NM, BENCHMARK) + f"SELECT count(*) AS n, count(DISTINCT key) AS families, count(*) FILTER (key IN (SELECT {normal('text')} FROM b)) AS overlaps FROM n")
def g02(t):
    rows = keyed(t.texts).join(keyed(t.b).select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("families"), F.count("hit").alias("overlaps"))


@query("g03_blind_contract", M + "SELECT count(*) AS n, count(*) FILTER (id = '' OR text = '') AS incomplete, count(*) - count(DISTINCT id) AS repeated FROM m")
def g03(t):
    return t.texts.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("id") == "") | (F.col("text") == "")).alias("incomplete"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated"))


@query("g04_binding", M + "SELECT count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest, true AS bound FROM m")
def g04(t):
    a, b = dedup.set_digest(t.texts, "id"), dedup.set_digest(t.texts, "id").select(F.col("digest").alias("other"))
    return a.join(F.broadcast(b)).select("n", "digest", (F.col("digest") == F.col("other")).alias("bound"))


@query("g07_ancestry", with_(MESSAGES) + "SELECT id FROM m WHERE source NOT IN ('src0', 'src1') AND text NOT IN (SELECT text FROM m WHERE source IN ('src0', 'src1'))")
def g07(t):
    out = F.col("source").isin("src0", "src1")
    return t.texts.where(~out).join(t.texts.where(out).select("text").distinct(), "text", "left_anti").select("id")


@query("p05_source_filter", M + "SELECT source NOT IN ('src0', 'src1') AS retained, count(*) AS n FROM m GROUP BY 1")
def p05(t):
    return t.texts.groupBy((~F.col("source").isin("src0", "src1")).alias("retained")).agg(F.count(F.lit(1)).alias("n"))


@query("p06_partition_rows")
def p06(t):
    rows = signalled(t).withColumn("supported", (F.col("label") != "SCAM") | (F.size("signals") > 0))
    return rows.groupBy("supported", "label").agg(F.count(F.lit(1)).alias("n"))


@query("p10_token_filter", M + "SELECT id FROM m WHERE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) <= 200")
def p10(t):
    return t.texts.where(tx.word_count(F.col("text")) <= 200).select("id")


@query("p11_stamped_columns", "SELECT o_orderkey, o_orderstatus, 'v1' AS revision FROM orders")
def p11(t):
    rows = t.orders
    return rows.drop(*[c for c in rows.columns if c not in ("o_orderkey", "o_orderstatus")]).withColumns({"revision": F.lit("v1")})


@query("r09_output_contract")
def r09(t):
    """Error codes of JSON answers that must name a verdict."""
    answer = F.to_json(F.struct(F.col("label").alias("verdict"), F.lit(0.5).alias("risk")))
    got = F.from_json(answer, "verdict string, risk double")
    codes = F.array_compact(F.array(F.when(got["verdict"].isNull(), "missing verdict"), F.when(~got["verdict"].isin(*vd.LABELS), "unknown verdict"), F.when(~got["risk"].between(0, 1), "risk range")))
    return t.m.select("id", F.size(codes).cast("long").alias("errors"))


@query("r10_action_targets", with_(DIALOGUES) + "SELECT conv_id, contains(lower(text), 'password') AS asks_secret, contains(lower(text), 'pay') AS asks_payment FROM dlg")
def r10(t):
    return t.dlg.select("conv_id", F.contains(F.lower("text"), F.lit("password")).alias("asks_secret"), F.contains(F.lower("text"), F.lit("pay")).alias("asks_payment"))


# files


def scratch(t, name):
    return f"{shared_dir(t.spark).rstrip('/')}/textgate/{name}-{uuid.uuid4().hex}"


@query("s01_jsonl_round_trip", M + "SELECT id, label, sha256(text) AS digest FROM m")
def s01(t):
    path = scratch(t, "jsonl")
    sinks.write_jsonl(t.m.select("id", "label", "text"), path)
    rows = readers.read_jsonl(t.spark, path, "id string, label string, text string")
    return rows.select("id", "label", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("s01_missing_file", "SELECT CAST(0 AS BIGINT) AS n")
def s01m(t):
    return readers.read_jsonl(t.spark, scratch(t, "nothing"), "id string").agg(F.count(F.lit(1)).alias("n"))


@query("s27_csv_round_trip", M + "SELECT id, source, label FROM m")
def s27(t):
    path = scratch(t, "csv")
    sinks.write_audit(t.m.select("id", "source", "label"), path)
    return readers.read_csv(t.spark, path, "id string, source string, label string, auditor_label string, notes string").select("id", "source", "label")


@query("s24_reference_files", "SELECT 'file' || (item_id % 3) AS part, count(*) AS n FROM benchmark GROUP BY 1")
def s24(t):
    path = scratch(t, "refs")
    t.benchmark.select(F.concat(F.lit("file"), (F.col("item_id") % 3).cast("string")).alias("part"), "item_id", "text").write.json(path)
    rows = readers.read_references(t.spark, path, "part string, item_id long, text string")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("s28_score_cache", with_(MESSAGES, ledger()) + "SELECT id, round(p_scam, 12) AS p FROM l")
def s28(t):
    path = scratch(t, "scores")
    sinks.write_scores(t.l().select("id", "p_scam"), path, "run-a")
    return readers.cached_scores(t.spark, path, "run-a").select("id", F.round("p_scam", 12).alias("p"))


# streams


@query("z_tumbling_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def z1(t):
    rows = streams.tumbling_counts(streams.stream(t.spark, t.sf_dir, "events"), "event_type", late="0 seconds")
    return _complete(rows, "update").select("start", "event_type", "n")


@query("z_distinct_users", "SELECT DISTINCT user_id, event_type FROM events")
def z2(t):
    found = streams.finished(streams.distinct_within(streams.stream(t.spark, t.sf_dir, "events"), ["user_id", "event_type"], "3650 days"))
    return found.select("user_id", "event_type")


@query("z04_running_max", "SELECT user_id, round(max(value), 9) AS best FROM events GROUP BY user_id")
def z4(t):
    rows = streams.running_max(streams.stream(t.spark, t.sf_dir, "events").select("user_id", "value"), "user_id", "value")
    return streams.finished(rows, "update").groupBy("user_id").agg(F.round(F.max("best"), 9).alias("best"))


def _complete(rows, mode):
    """The last state of each window of a stream that sends updates."""
    found = streams.finished(rows, mode)
    return found.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max("n").alias("n"))
