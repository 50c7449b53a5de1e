"""Values of the queries that have no statement, against plain second implementations and by hand."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F
from textgate import plans
from textgate.functions import dialogue, nested, privacy, windows
from textgate.functions import signals as sg
from textgate.functions import text as tx
from textgate.functions import verdicts as vd
from textgate.operators import dedup, linear, near, sampling, validation
from textgate.operators import evaluation as ev
from textgate.operators import sequential as sq
from textgate.sources import contracts, readers, sinks

SMALL = "/root/testdata/sf0.001"
MESSAGES = [
    "Act now : click​ here or call this number", "URGENT  your otp  is needed", "Never share your verification code with anyone", "Your verification code is 123456", "hello there", "",
    "Use the official app instead", "Pay the fee of $5 with a gift card at www.foo.com today", "The bank: enter your password; do not call us to check", "discount offer today only",
    "free trial offer for homeowners", "our soulmate won the lottery, trust me", "call +12 345 678 90 now", "code de VÉRIFICATION sofort", "paſſword or Cıck or İRS", "move to whatsapp . ; | ok",
    "scam alert: click here https://x.y/z", "keep this secret and do not tell anyone about the processing fee", "জিতেছেন", "anydesk remote access within 24 hours", "parcel.com ist gesperrt",
]


def plainly(text):
    """Zero-width spaces and lone separators out, spaces collapsed, character by character."""
    skipped = set()
    for m in re.finditer("​|(?<=\\s)[.:;|](?=\\s)", text):
        skipped.update(range(m.start(), m.end()))
    out, places = "", []
    for i, c in enumerate(text):
        if i in skipped or (c.isspace() and out and out[-1] == " "):
            continue
        out += " " if c.isspace() else c
        places.append(i)
    return out, places


def slow_matches(text):
    plain, places = plainly(text or "")
    found = []
    for name, pattern in sg.RULES.items():
        if m := re.search(pattern, plain, re.I):
            a, b = places[m.start()], places[m.end() - 1] + 1
            found.append((name, text[a:b], a, b))
    return found


def python(pattern):
    return re.compile(pattern.replace("(?iU)", ""), re.I)


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.id, r.text, r.label) for r in plans.text_queries.keyed(fixture(spark).m).select("id", "text", "label").collect()]


def fixture(spark):
    from textgate.plans.fixtures import Tables

    return Tables(spark, SMALL)


@pytest.fixture(scope="module")
def given(spark):
    marks = ["ham", "spam", "smishing", "wrong number"]
    data = [(str(i), t, marks[i % 4]) for i, t in enumerate(MESSAGES)] + [(str(100 + i), t, "smishing") for i, t in enumerate(MESSAGES)]
    return data, spark.createDataFrame(data, "id string, text string, mark string").withColumn("found", sg.signal_matches(F.col("text"))).withColumn("signals", F.transform("found", lambda s: s["signal"]))


def test_signal_matches(spark, rows, given):
    data, df = given
    got = {r.id: [(s.signal, s.text, s.start, s.end) for s in r.found] for r in df.collect()}
    assert got == {i: slow_matches(t) for i, t, _ in data}
    assert {n for found in got.values() for n, *_ in found} >= {"otp_request", "contact_diversion", "payment_request", "suspicious_link", "trust_acceleration", "credential_request"}
    found = Counter((r.id, r.signal, r.start, r.end) for r in plans.QUERIES["r01_signal_matches"](spark, SMALL).collect())
    assert found == Counter((i, n, a, b) for i, t, _ in rows for n, _, a, b in slow_matches(t))


def test_signal_flags(spark, rows, given):
    data, df = given
    flags = df.select("id", *[c.alias(n) for n, c in sg.signal_flags(F.col("text")).items()]).collect()
    assert {r.id: {n for n in sg.RULES if r[n]} for r in flags} == {i: {n for n, *_ in slow_matches(t)} for i, t, _ in data}
    got = plans.QUERIES["r01_signal_flags"](spark, SMALL).collect()
    assert {r.id: {n for n in sg.RULES if r[n]} for r in got} == {i: {n for n, *_ in slow_matches(t)} for i, t, _ in rows}


def scores(signals):
    n, specific = len(signals), len(set(signals) & set(sg.SPECIFIC))
    scam = 0.05 + min(0.30, 0.08 * n) + min(0.54, 0.27 * specific) + 0.18 * ({"suspicious_link", "artificial_urgency"} <= set(signals))
    scam, uncertain = min(scam, 0.98), min(0.65, 0.08 * n + 0.08)
    safe = max(0.0, 1 - scam - uncertain)
    return tuple(x / (safe + scam + uncertain) for x in (safe, uncertain, scam))


def test_heuristic_scores(given):
    data, df = given
    for r in df.select("signals", sg.heuristic_scores(F.col("signals")).alias("s")).select("signals", "s.*").collect():
        assert (r.p_safe, r.p_uncertain, r.p_scam) == pytest.approx(scores(r.signals))
    assert scores([]) == pytest.approx((0.87, 0.08, 0.05))


def protective(text, signals):
    diverts = bool(python(sg.EXTERNAL_ACTION).search(text)) or "contact_diversion" in signals
    if python(sg.GUIDANCE).search(text):
        return ("UNCERTAIN", "defensive_guidance_with_external_action") if diverts else ("SAFE", "defensive_guidance")
    if python(sg.AUTH_CODE).search(text) and set(signals) <= {"authority_impersonation", "credential_request", "otp_request"}:
        return ("SAFE", "standalone_authentication_notification")
    return None


def sms(text, signals, mark):
    if mark in ("ham", "spam"):
        return ("SAFE", "source_ham") if mark == "ham" else ("UNCERTAIN", "source_generic_spam")
    if mark != "smishing":
        return None
    if own := protective(text, signals):
        return own
    if python(sg.LOW_RISK_OFFER).search(text) and set(signals) <= {"artificial_urgency", "contact_diversion", "payment_request", "suspicious_link"}:
        return ("UNCERTAIN", "commercial_offer_without_clear_fraud")
    return ("SCAM", "source_smishing_with_strong_text_evidence") if set(signals) & set(sg.STRONG) else ("UNCERTAIN", "source_smishing_without_strong_text_evidence")


def forum(text, signals, mark):
    if own := protective(text, signals):
        return own
    strong = bool(set(signals) & set(sg.STRONG))
    if mark == "spam":
        return ("UNCERTAIN", "source_generic_spam")
    if mark == "wrong number" and not strong:
        return ("UNCERTAIN", "wrong_number_without_message_evidence")
    return ("SCAM", "source_reported_smishing_with_strong_text_evidence") if strong else ("UNCERTAIN", "source_reported_without_strong_text_evidence")


def forced(text, signals):
    if "credential_request" in signals and python(sg.BLOCKED_CHECK).search(text):
        return ("SCAM", "blocked_verification_with_credential_request")
    allowed = {"authority_impersonation", "payment_request"}
    if python(sg.TRUSTED_CHANNEL).search(text) and set(signals) <= allowed and ("payment_request" not in signals or python(sg.EXPLICIT_SAFETY).search(text)):
        return ("SAFE", "explicit_trusted_channel_guidance")
    return None


def test_label_rules(spark, given, rows):
    data, df = given
    text, signals, mark = F.col("text"), F.col("signals"), F.col("mark")
    got = df.select("id", "text", "mark", "signals", sg.protective_label(text, signals).alias("p"), sg.strong_evidence(signals).alias("strong"), sg.sms_label(text, signals, mark).alias("sms"), sg.forum_label(text, signals, mark).alias("forum"), sg.override(text, signals).alias("o"))
    pair = lambda x: tuple(x) if x is not None else None
    seen = set()
    for r in got.collect():
        assert pair(r.p) == protective(r.text, r.signals) and r.strong == bool(set(r.signals) & set(sg.STRONG))
        assert pair(r.sms) == sms(r.text, r.signals, r.mark) and pair(r.forum) == forum(r.text, r.signals, r.mark) and pair(r.o) == forced(r.text, r.signals)
        seen |= {pair(r.p), pair(r.sms), pair(r.forum), pair(r.o)}
    assert len(seen) >= 12
    found = {i: [n for n, *_ in slow_matches(t)] for i, t, _ in rows}
    by = {i: (t, y) for i, t, y in rows}
    assert {r.id: (pair(r.protective), r.strong) for r in plans.QUERIES["r05_protective_labels"](spark, SMALL).collect()} == {i: (protective(by[i][0], s), bool(set(s) & set(sg.STRONG))) for i, s in found.items()}
    marks = {"SAFE": "ham", "SCAM": "smishing", "UNCERTAIN": "spam"}
    assert {r.id: (pair(r.sms), pair(r.forum)) for r in plans.QUERIES["r06_label_policies"](spark, SMALL).collect()} == {i: (sms(by[i][0], s, marks[by[i][1]]), forum(by[i][0], s, marks[by[i][1]])) for i, s in found.items()}
    rules = {i: forced(by[i][0], s) for i, s in found.items()}
    assert {r.id: pair(r.override) for r in plans.QUERIES["r07_override"](spark, SMALL).collect()} == rules
    assert {(r.rule, r.label): r.n for r in plans.QUERIES["a29_policy_coverage"](spark, SMALL).collect()} == Counter((rules[i][1] if rules[i] else None, by[i][1]) for i in by)
    ledger = {r.id: r.verdict for r in fixture(spark).l().select("id", "verdict").collect()}
    assert {r.id: (r.verdict, r.overridden) for r in plans.QUERIES["j07_policy_join"](spark, SMALL).collect()} == {i: (rules[i][0] if rules[i] else ledger[i], rules[i] is not None) for i in by}
    assert {(r.supported, r.label): r.n for r in plans.QUERIES["p06_partition_rows"](spark, SMALL).collect()} == Counter((y != "SCAM" or bool(found[i]), y) for i, (_, y) in by.items())


def test_scan(spark, rows):
    got = {r.id: r for r in plans.QUERIES["m09_scan"](spark, SMALL).collect()}
    summary = Counter()
    for i, text, _ in rows:
        text, r = text.strip(" "), got[i]
        found = [n for n, *_ in slow_matches(text)]
        p = scores(found)
        verdict = "SCAM" if p[2] >= 0.8 else "SAFE" if p[0] >= 0.8 and p[2] <= 0.2 else "UNCERTAIN"
        error = "empty" if not text else "too long" if len(text) > 100_000 else None
        assert r.error == error and r.verdict == (None if error else verdict) and r.risk == pytest.approx(p[2])
        assert r.signals == ([] if verdict == "SAFE" else found) and (verdict != "SAFE" or (r.category, r.action) == ("NONE", "NO_ACTION"))
        assert verdict == "SAFE" or r.action != "NO_ACTION"
        for n in r.signals or [None]:
            summary[n, r.verdict] += 1
    assert {(r.signal, r.verdict): r.n for r in plans.QUERIES["a24_output_summary"](spark, SMALL).collect()} == summary


def test_targets_and_contract(spark, rows):
    got = {r.id: r for r in plans.QUERIES["r08_targets"](spark, SMALL).collect()}
    for i, text, label in rows:
        quotes = [q for _, q, _, _ in slow_matches(text)]
        assert got[i].target.verdict == label and got[i].target.evidence == ([] if label == "SAFE" else quotes) and got[i].valid
    assert {r.errors for r in plans.QUERIES["r09_output_contract"](spark, SMALL).collect()} == {0}
    assert {r.id: r.p_scam for r in plans.QUERIES["x01_scorer_backend"](spark, SMALL).collect()} == pytest.approx({i: min(0.98, 0.05 + 0.08 * len(slow_matches(t))) for i, t, _ in rows})


def test_regional_rows(spark):
    data = [(t, ("Ham ", "spam", "smishing", "other", None)[i % 5]) for i, t in enumerate(MESSAGES)] + [(t, "SMISHING") for t in MESSAGES] + [(None, "ham")]
    got = contracts.regional_rows(spark.createDataFrame(data, "message string, label string")).collect()
    masked = {r.m: r.t for r in spark.createDataFrame([(t,) for t in MESSAGES], "m string").select("m", tx.mask_contacts(tx.clean(F.col("m"))).alias("t")).collect()}
    want = []
    for text, mark in data:
        mark, text = (mark or "").strip().lower(), masked.get(text, "")
        if mark not in ("ham", "spam", "smishing") or len(text) < 4:
            continue
        signals = [n for n, *_ in slow_matches(text)]
        by_text = protective(text, signals) or (("SCAM", "source_smishing_with_strong_text_evidence") if set(signals) & set(sg.STRONG) else ("UNCERTAIN", "source_smishing_without_strong_text_evidence"))
        own = {"ham": ("SAFE", "source_ham"), "spam": ("UNCERTAIN", "source_generic_spam")}.get(mark, by_text)
        want.append((text, *own, mark, "ood"))
    assert sorted(map(tuple, got)) == sorted(want) and len({w[2] for w in want}) >= 5


# texts


def test_text_forms(spark, rows):
    cleaned = {i: " ".join(unicodedata.normalize("NFKC", t).replace("\x00", " ").split()) for i, t, _ in rows}
    assert {r.id: r.cleaned for r in plans.QUERIES["f01_clean_text_nfkc"](spark, SMALL).collect()} == cleaned
    assert {r.id: r.key for r in plans.QUERIES["f02_normalized_exact"](spark, SMALL).collect()} == {i: re.sub("[^a-z0-9 ]+", "", c.casefold()) for i, c in cleaned.items()}


def test_contextual_masks(spark, rows):
    got = {r.id: (r.masked, {e.key: e.value for e in r.counts}) for r in plans.QUERIES["f05_contextual_masks"](spark, SMALL).collect()}
    want = {i: privacy.mask(t) for i, t, _ in rows}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), c) for i, (t, c) in want.items()}
    assert privacy.mask("Your OTP is 123456. zip code 90210; my password is hunter22, card ending in 4242") == (
        "Your OTP is <ACCESS_CODE>. zip code <POSTAL_CODE>; my password is <CREDENTIAL>, card ending in <ACCOUNT_NUMBER>",
        {"access_code": 1, "account_fragment": 1, "credential": 1, "postal_code": 1},
    )


def test_skeletons_do_not_depend_on_the_cheap_tests(spark):
    """Every pattern tried on every text gives the same skeleton."""
    texts = [*MESSAGES, "Pay 12,50 at https://x.test/a?b=1 or mail A.b@c.de code AB12CD ~~ref99", "WWW.Foo.com HTTPS://Bar", "foo[.]bar/x", "a1b2 ٣٤ 12", "end **ab-12  ", "x =~ abc", "one_two__three4", "1.5.2,3"]

    def slow(c):
        t = tx.fold_case(F.regexp_replace(tx.clean(c), tx.TRACKING_SUFFIX, ""))
        for pattern, mark in ((tx.URL, "<url>"), (tx.EMAIL, "<email>"), (tx.NUMBER, "<number>"), (tx.MIXED_TOKEN, "<token>")):
            t = F.regexp_replace(t, pattern, mark)
        return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z<> ]+", " "), tx.SPACES, " "))

    df = spark.createDataFrame([(t,) for t in texts], "t string").unionByName(fixture(spark).documents.select(F.col("text").alias("t")))
    assert df.where(tx.family_skeleton(F.col("t")) != slow(F.col("t"))).count() == 0


def test_hamming_pairs_by_brute_force(spark):
    """Signatures of which most bits never change, so that plain blocks would be one bucket."""
    sigs = [(i, ((i * 2654435761) % (1 << 20)) << 30 | i % 4) for i in range(700)] + [(700 + i, ((i * 2654435761) % (1 << 20)) << 30 | 1 << 5) for i in range(40)]
    df = spark.createDataFrame(sigs, "k long, sig long")
    want = {(a, b) for a, x in sigs for b, y in sigs if a < b and (x ^ y).bit_count() <= 6}
    for blocks in (None, 7, 9):
        assert {tuple(r) for r in near.hamming_pairs(df, key="k", blocks=blocks).collect()} == want
    tied = {r.node: r.root for r in near.components(df, near.ties(df, "k"), "k").collect()}
    every = {r.node: r.root for r in near.components(df, near.hamming_pairs(df, key="k"), "k").collect()}
    assert tied == every and len(set(tied.values())) < len(tied) and near.ties(df, "k").count() < len(want)
    left, right = df.where("k < 350"), df.where("k >= 350")
    assert {tuple(r) for r in near.hamming_pairs(left, right, key="k").collect()} == {(a, b) for a, b in want if a < 350 <= b}


# dialogues

TALK = "caller: hello customer: hi caller: please read me the verification code customer: no, never share the code caller: ok bye"


def test_dialogue_queries(spark):
    texts = {r.conv_id: r.text for r in fixture(spark).dlg.collect()}
    parsed = {}
    for r in plans.QUERIES["d01_parse_turns"](spark, SMALL).collect():
        parsed.setdefault(r.conv_id, []).append((r["at"], r.speaker, r.content))
    names = "caller|receiver|recipient|agent|customer|bank|courier|recruiter|applicant|sender|clerk|resident|participant|user|assistant"
    for conv, text in texts.items():
        marks = list(re.finditer(rf"(?<![A-Za-z0-9_])({names})\s*:", text, re.I))
        said = [(m[1].lower(), " ".join(text[m.end() : n.start() if n else len(text)].split())) for m, n in zip(marks, [*marks[1:], None], strict=True)]
        assert sorted(parsed.get(conv, [])) == [(i, s, c) for i, (s, c) in enumerate(x for x in said if x[1])]
    policies = {r.conv_id: r for r in plans.QUERIES["d08_x03_policies"](spark, SMALL).collect()}
    for name, query, f in (
        ("speaker_neutral_v1", "d02_speaker_neutral", dialogue.speaker_neutral), ("speaker_neutral_evidence_recent_v2", "d06_evidence_recent", dialogue.evidence_recent),
        ("speaker_neutral_action_preserving_v3", "d07_action_preserving", dialogue.action_preserving),
    ):
        own = {r.conv_id: r.text for r in plans.QUERIES[query](spark, SMALL).collect()}
        assert own == {c: f(t) for c, t in texts.items()} == {c: r[name] for c, r in policies.items()}
    flags = {r.conv_id: (r.asks_code, r.asks_payment) for r in plans.QUERIES["p09_speaker_flags"](spark, SMALL).collect()}
    said = {c: "\n".join(x for _, s, x in sorted(parsed.get(c, [])) if s == "user").lower() for c in texts}
    assert flags == {c: (bool(re.search("code|password", x)), bool(re.search("pay|transfer", x))) for c, x in said.items()}
    assert all(r.bounded for r in plans.QUERIES["g06_visibility"](spark, SMALL).collect())


def test_turn_scores(spark):
    data = fixture(spark).conversations.select("conv_id", "turn", "text").collect()
    extra = [(-1, 0, "please buy a gift card, pay and transfer money; your account password"), (-1, 1, "never share your code; hang up"), (-1, 2, "")]
    capped = lambda t: {k: min(3, len(re.findall(p, t, re.I))) for k, p in dialogue.PATTERNS.items()}

    def slow(text):
        n = capped(text)
        total = 12 * n["risk"] + 10 * n["boundary"] + 3 * n["request"] + 2 * n["service"] + 4 * n["irreversible"] + n["frame"]
        return total, 5 * n["service"] + 3 * n["request"] + 4 * n["irreversible"], 20 * n["boundary"] + 2 * n["risk"] + n["service"] if n["boundary"] else 0

    got = plans.QUERIES["d03_turn_scores"](spark, SMALL).collect()
    assert {(r.conv_id, r.turn): (r.score, r.service, r.safe) for r in got} == {(r.conv_id, r.turn): slow(r.text) for r in data}
    df = spark.createDataFrame(extra, "conv_id long, turn long, text string").select("turn", *[c.alias(n) for n, c in dialogue.turn_scores(F.col("text")).items()])
    assert {r.turn: (r.score, r.service, r.safe) for r in df.collect()} == {i: slow(t) for _, i, t in extra}
    assert slow(extra[0][2]) == (12 * 3 + 3 * 3 + 2 * 3 + 4 * 3, 5 * 3 + 3 * 3 + 4 * 3, 0)


def test_evidence_by_hand(spark):
    found = [t.measured() for t in dialogue.turns(TALK)]
    assert [t.score for t in found] == [0, 0, 12 + 2 * 3 + 2, 10 + 3 + 2, 0] and [t.at for t in dialogue.evidence(found)] == [2, 3, 4]
    assert dialogue.evidence_recent(TALK) == "EVIDENCE: A: please read me the verification code B: no, never share the code A: ok bye"
    chosen = {r.conv_id: r.turns for r in plans.QUERIES["d04_evidence_turns"](spark, SMALL).collect()}
    texts = {r.conv_id: r.text for r in fixture(spark).dlg.collect()}
    for conv, text in texts.items():
        own = [t.measured() for t in dialogue.turns(text)]
        assert len(chosen[conv]) == min(3, len(own)) and len(set(chosen[conv])) == len(chosen[conv])
        if len(own) > 3:
            score = {t.at: t.score for t in own}
            assert [score[i] for i in chosen[conv]] == sorted((score[i] for i in chosen[conv]), reverse=True)


@pytest.mark.parametrize("size", [0, 1, 519, 520, 521, 700, 1500])
def test_excerpts(size):
    text = "".join(f"{i:04d}|" for i in range(size))[:size]
    turn = dialogue.Turn(0, "a", text)
    for anchor in (None, 0, 200, 251, 400, size - 1 if size else 0):
        for recent in (False, True):
            got = turn.excerpt(anchor, recent)
            if size <= 520:
                assert got == text
                continue
            assert len(got) == 520 and got.strip("…") in text
            at = text.index(got.strip("…")) if got.startswith("…") else 0
            if anchor is None:
                assert got.endswith("…") != recent and got.startswith("…") == recent
            elif 250 < anchor < size - 270:
                assert at == anchor - 249 and got.startswith("…") and got.endswith("…")
    if size == 1500:
        assert turn.excerpt(600, False) == "…" + text[351:869] + "…"


def test_windows_by_hand(spark):
    def get(segments, limit=30, least=1):
        df = spark.createDataFrame([(segments,)], "s array<struct<role:string,text:string>>")
        return {w.kind: w.text for w in df.select(windows.call_windows(F.col("s"), limit, least).alias("w")).first().w}

    call = [("agent", "one two"), ("caller", " "), ("caller", "three  four"), ("agent", "five")]
    assert get(call) == {"early": "AGENT: one two", "recent": "CALLER: three four\nAGENT: five"}
    assert get([("a", "word " * 20)]) == {"early": "A: word word word word word", "recent": "A: word word word word word"}
    assert get([("a", "x" * 50)]) == {"early": "A: " + "x" * 27, "recent": "A: " + "x" * 27}
    assert get([]) == {} and get(call, least=20) == {"recent": "CALLER: three four\nAGENT: five"}


# samples and decisions


def test_least_loaded(spark):
    data = [(f"f{i % 60}", f"s{i * 7 % 5}", f"{i:04d}") for i in range(400)]
    got = sq.least_loaded(spark.createDataFrame(data, "family string, speaker string, id string").repartition(3), "family", "speaker", "seed").collect()
    h = lambda x: hashlib.sha256(f"seed:{x}".encode()).hexdigest()
    load, want = Counter(), []
    for f in sorted({d[0] for d in data}, key=lambda f: (h(f), f)):
        s, i = min(((s, i) for g, s, i in data if g == f), key=lambda x: (load[x[0]], h(x[1])))
        load[s] += 1
        want.append((f, s, i))
    assert sorted(map(tuple, got)) == sorted(want) and max(load.values()) - min(load.values()) < 20
    assert sq.least_loaded(spark.createDataFrame([], "family string, speaker string, id string"), "family", "speaker", "seed").collect() == []


def test_set_digest(spark):
    data = [("a" if i % 3 else "b", f"{i * 37 % 101:03d}") for i in range(101)] + [(None, "x"), ("a", None)]
    df = spark.createDataFrame(data, "g string, v string").repartition(4)
    digest = lambda values: hashlib.sha256("\n".join(sorted(values)).encode()).hexdigest()
    got = {r.g: (r.n, r.digest) for r in dedup.set_digest(df, "v", "g").collect()}
    assert got == {g: (sum(x == g for x, _ in data), digest([v for x, v in data if x == g and v is not None])) for g in ("a", "b", None)}
    assert tuple(dedup.set_digest(df, "v").first()) == (len(data), digest([v for _, v in data if v is not None]))
    assert dedup.set_digest(df.where("v = 'none'"), "v").collect() == []


def test_quota_sample_and_subset(spark, rows):
    got = plans.QUERIES["t04_quota_sample"](spark, SMALL).collect()
    counts, taken = Counter(y for _, _, y in rows), Counter()
    by = {i: y for i, _, y in rows}
    for r in got:
        taken[by[r.id]] += 1
    assert taken == sampling.largest_remainder({k: counts[k] for k in taken}, len(got))
    sizes = Counter(r.source for r in fixture(spark).m.select("source").collect())
    assert {r.source: r.n for r in plans.QUERIES["t06_component_subset"](spark, SMALL).collect()} == {s: sizes[s] for s in sq.nearest_subset(dict(sizes), 0.2, "partition")}


def test_models_and_metrics(spark):
    l = fixture(spark).l().collect()  # noqa: E741
    got = {r.id: (r.arithmetic, r.log_linear) for r in plans.QUERIES["x04_blend_methods"](spark, SMALL).collect()}
    for r in l:
        p = (r.p_safe, r.p_uncertain, r.p_scam)
        mean, root = [(a + b) / 2 for a, b in zip(p, p[::-1], strict=True)], [math.sqrt(a * b) for a, b in zip(p, p[::-1], strict=True)]
        assert got[r.id] == pytest.approx((mean[0], root[0] / sum(root)))
    m = plans.QUERIES["a34_mcnemar"](spark, SMALL).first()
    n, k = m.first_only + m.second_only, min(m.first_only, m.second_only)
    assert m.p_value == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0)
    per = [r.d for r in plans.QUERIES["x05_metric_callback"](spark, SMALL).collect()]
    true = sum((r.verdict == r.truth) - (r.argmax == r.truth) for r in l) / len(l)
    assert len(per) == 50 and abs(sum(per) / 50 - true) < 0.05
    assert plans.QUERIES["a35_poisson_bootstrap"](spark, SMALL).count() > 0
    t = plans.QUERIES["m02_temperature"](spark, SMALL).first().temperature
    loss = lambda x: -sum(math.log(p[k] ** (1 / x) / sum(v ** (1 / x) for v in p.values())) for r in l for k, p in [(r.truth, {"SAFE": r.p_safe, "UNCERTAIN": r.p_uncertain, "SCAM": r.p_scam})])
    assert loss(t) <= min(loss(t * 1.2) if t < 9 else 1e9, loss(t / 1.2)) + 1e-6 * abs(loss(t)) + 1e-6
    at = plans.QUERIES["w13_stable_threshold"](spark, SMALL).first()
    scam = sorted(r.p_scam for r in l)
    assert at.observed in scam or at.observed == 1.0
    assert max((p for p in scam if p < at.observed), default=0) <= at.stable <= at.observed


def test_linear_baseline(spark):
    data = [(str(i), ("pay the fee now to win a prize " if i % 2 else "see you at lunch tomorrow then ") + f"word{i % 7} é{i % 3}", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(data, "id string, text string, y double")
    for _ in range(2):  # twice in one session
        got = {r.id: (r.y, r.score) for r in linear.baseline(df, ["id", "y"]).collect()}
        assert len(got) == 60 and all((s > 0.5) == (y == 1.0) and 0 < s < 1 for y, s in got.values())
    assert len(linear.char_buckets("ab c")) == 2 + 1 + 1 and len(linear.char_buckets("")) == 0  # " ab", "ab ", " ab ", " c "
    assert len(linear.word_buckets("One twö a three")) == 3 + 2 and list(linear.word_buckets("two")) == list(linear.word_buckets("twö"[:2] + "o"))
    table = linear.counted(df, ["id", "y"])
    idf, n = linear._frequencies(table), Counter(int(i) for r in table.collect() for i in r["at"])
    for b, k in list(n.items())[:200]:
        assert idf[b] == pytest.approx(math.log(61 / (1 + k)) + 1 if k >= 2 else 0)
    one_class = linear.baseline(df.where("y = 1"), ["id", "y"]).collect()
    assert len(one_class) == 30 and all(r.score > 0.99 for r in one_class)


def test_repeated_linear_query(spark):
    assert sorted(map(tuple, plans.QUERIES["m10_linear_baseline"](spark, SMALL).collect())) == sorted(map(tuple, plans.QUERIES["m10_linear_baseline"](spark, SMALL).collect()))


# sources and validation


def test_verified_inputs(spark):
    got = plans.QUERIES["s29_verified_inputs"](spark, SMALL).first()
    assert (got.name, got.sha256, got.matches) == ("region.parquet", hashlib.sha256(open(f"{SMALL}/region.parquet", "rb").read()).hexdigest(), False)


def test_nested_values():
    assert nested.walked('{"a": ["x", {"Text": "y", "b": null}], "transcript": 3, "c": {"d": [["z"]]}}') == {"strings": ["x", "y", "z"], "keys": ["Text", "transcript"]}
    assert nested.walked('"x"') == {"strings": ["x"], "keys": []} and nested.walked("{") == {"strings": None, "keys": None} and nested.walked(None) == {"strings": [], "keys": []}
    assert nested.walked("[" * 900 + '"deep"' + "]" * 900)["strings"] == ["deep"]


def test_call_problems(spark):
    import json

    seg = {"role": "agent", "speaker_id": "1", "gender": "x", "text": "hi", "start": 0.0, "end": 1.0}
    call = {"accent": "us", "domain": "d", "file_name": "f", "duration": 2.0, "segments": [seg, seg | {"start": 1.0, "end": 2.0}]}
    cases = {
        "good": call, "late": call | {"segments": [seg | {"start": 5.0, "end": 6.0}, seg]}, "equal": call | {"segments": [seg, seg]}, "none": call | {"segments": []}, "extra": call | {"x": 1},
        "role": call | {"segments": [seg | {"role": "bot"}]}, "mute": call | {"segments": [seg | {"speaker_id": " "}]}, "keys": call | {"segments": [{k: v for k, v in seg.items() if k != "gender"}]},
        "time": call | {"segments": [seg | {"start": "x"}]}, "twice": call, "blank": call | {"domain": ""},
    }
    lines = [json.dumps(c | {"file_name": n}) for n, c in cases.items()] + [json.dumps(call | {"file_name": "twice"}), "{not json"]
    got = sorted(map(tuple, contracts.call_problems(spark.createDataFrame([(x,) for x in lines], "value string"), ("agent",)).collect()))
    assert got == sorted([
        ("late", "times out of order"), ("none", "no segments"), ("extra", "unexpected keys"), ("role", "unexpected role"), ("mute", "no speaker"), ("keys", "unexpected segment keys"), ("time", "times out of order"),
        ("twice", "repeated name"), ("blank", "no name"), ("", "unexpected keys"), ("", "no name"), ("", "no segments"),
    ])


def test_validation_by_hand(spark):
    good = ("1", "hello there", "SAFE", "NONE", "s", "x", "MIT", "train", "f1", False)
    data = [
        good, good[:0] + ("1", "other text", "SCAM", "FINANCIAL", "s", "x", "MIT", "dev", "f1", False), ("2", " Hello  THERE", "SCAM", "NONE", "s", " ", "GPL", "test", "f2", None),
        ("3", "mail me at a@b.org", "BAD", "ODD", "s", "x", "MIT", "train", "f3", False), ("4", "mail me at a@example.org", "SAFE", "FINANCIAL", "s", "x", "MIT", "train", "f4", False),
    ]
    df = spark.createDataFrame(data, "id string, text string, label string, category string, source string, source_label string, license string, split string, family_id string, is_synthetic boolean")
    manifest = spark.createDataFrame([("train", 3), ("dev", 2), ("gone", 1)], "split string, n long")
    got = Counter((r.rule, r.split, r.id, r.detail) for r in validation.violations(df, manifest).collect() if r.rule != "no scam of category")
    assert got == Counter([
        ("missing source_label", "test", "2", None), ("missing is_synthetic", "test", "2", None), ("unexpected license", "test", "2", None), ("scam without category", "test", "2", None),
        ("invalid label", "train", "3", None), ("invalid category", "train", "3", None), ("category without scam", "train", "3", None), ("personal value", "train", "3", None),
        ("category without scam", "train", "4", None), ("repeated id", "dev", "1", "2"), ("repeated text", "test", "1", "2"), ("family leak", "dev", "1", "f1"), ("no rows of label", "train", None, "SCAM"),
        ("no rows of label", "dev", None, "SAFE"), ("no rows of label", "test", None, "SAFE"), ("manifest count", "dev", None, "2 recorded, 1 found"), ("manifest count", "gone", None, "1 recorded, 0 found"),
        ("manifest count", "test", None, "0 recorded, 1 found"),
    ])
    near_pair = [("a", "please confirm your parcel delivery address today", "train"), ("b", "please confirm your parcel delivery address today!!", "test"), ("c", "something else entirely here", "dev")]
    rows = spark.createDataFrame([(i, t, "SAFE", "NONE", "s", "x", "MIT", s, f"f{i}", False) for i, t, s in near_pair], df.schema)
    leaks = validation.violations(rows, manifest, near=near.split_leaks).where("rule = 'near leak'").collect()
    assert [(r.split, r.id, r.detail) for r in leaks] == [("train", "a", "b")]


def test_workbook_round_trip(spark, tmp_path):
    data = sinks.workbook({"A": [("ID", "Text", "Label"), ("1", "a <b> & \"c\"  d", "x"), ("", "lost", "x")], "B": [("ID", "Text", "Label"), ("2", "é", "y")], "C": []})
    assert data == sinks.workbook({"A": [("ID", "Text", "Label"), ("1", "a <b> & \"c\"  d", "x"), ("", "lost", "x")], "B": [("ID", "Text", "Label"), ("2", "é", "y")], "C": []})
    sinks.write_bytes(spark, str(tmp_path / "b.xlsx"), data)
    rows = readers.read_xlsx(spark, str(tmp_path / "b.xlsx"), ("A", "B", "C"), ("ID", "Text", "Label")).collect()
    assert sorted(map(tuple, rows)) == [("1", 'a <b> & "c"  d', "x", "A"), ("2", "é", "y", "B")]


def test_features_and_poisson(spark, rows):
    text = F.col("text")
    got = spark.createDataFrame([("Hi, 123 aab!",)], "text string").select(*[c.alias(n) for n, c in tx.lexical_features(text).items()]).first().asDict()
    assert (got["longest_digit_run"], got["exclamations"], got["n_words"]) == (3, 1, 3)
    assert vd.LABELS == ("SAFE", "UNCERTAIN", "SCAM") and ev.exact_mcnemar(3, 3) == 1


def test_calls_are_files_that_tasks_write_and_read(spark, tmp_path, monkeypatch):
    """As many calls as files, a call without id among them, and texts of any kind; the driver sees folders only."""
    n = 4000
    rows = [(i, k, "user", f"é\u2028 {i}\n") for i in range(n) for k in range(1 + i % 3)] + [(None, 1, None, None), (None, None, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    kept = []
    monkeypatch.setattr(readers, "read_files", lambda s, path, f=readers.read_files: (kept.append(path), f(s, path))[1])
    found = plans.QUERIES["s16_calls_by_stem"](spark, str(tmp_path))
    got = {r.stem: (r.turns, r.task) for r in found.collect()}
    assert got == {str(i): (1 + i % 3, f"task{i % 3}" if i % 10 else None) for i in range(n)} | {None: (2, None)} and found.count() == n + 1
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    names = [(f.path.rsplit("/", 1)[1], f.content) for f in readers.read_files(spark, kept[0]).collect()]
    assert len(names) == n + 1 and (".json", '{"segments":[{"role":"user","text":"x"},{"turn":1}]}') in names
    assert readers.read_files(spark, f"{kept[0]}/none").count() == 0
