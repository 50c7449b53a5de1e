import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from textgate.functions import dialogue, privacy, signals, simhash
from textgate.functions import text as tx
from textgate.functions import verdicts as vd


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_text_keys(spark):
    assert one(spark, tx.clean, " a \tb\x00 c ") == "a b c"
    assert one(spark, lambda c: tx.clean(c, True), "ﬁn ① Å") == "fin 1 Å"
    assert one(spark, tx.normalized, "Straße, NOW! 42") == "strasse now 42"
    assert one(spark, lambda c: tx.normalized(c, True), "ΑΒΓ ok") == " ok"
    assert one(spark, tx.family_skeleton, "Pay 12,50 at https://x.test/a?b=1 or mail A.b@c.de code AB12CD ~~ref99") == "pay <number> at <url> or mail <email> code <token>"
    assert one(spark, tx.mask_contacts, "a@b.co or +44 20 7946 0958 or 12345678901234567890 x") == "<EMAIL> or <PHONE_NUMBER> or <PHONE_NUMBER> x"
    assert one(spark, tx.short_hash, "x") == hashlib.sha256(b"x").hexdigest()[:16]
    assert one(spark, tx.hash_number, "x") == int(hashlib.sha256(b"x").hexdigest()[:8], 16)
    assert one(spark, lambda c: tx.clip_early(c, 7), "one two three") == "one"
    assert one(spark, lambda c: tx.clip_recent(c, 9), "one two three") == "three"
    assert one(spark, tx.zero_width, "urgent x") == "u​r​g​e​n​t x"


def test_masks_need_context():
    assert privacy.mask("Your verification code is: 123456 today") == ("Your verification code is: <ACCESS_CODE> today", {"access_code": 1})
    assert privacy.mask("482913 is your Acme verification code") == ("<ACCESS_CODE> is your Acme verification code", {"access_code": 1})
    assert privacy.mask("The order of 123456 items") == ("The order of 123456 items", {})
    assert privacy.mask("my password is hunter22, ok") == ("my password is <CREDENTIAL>, ok", {"credential": 1})
    assert privacy.mask("my password is secret") == ("my password is secret", {})
    assert privacy.mask("card ending 4242 and zip code 90210") == ("card ending <ACCOUNT_NUMBER> and zip code <POSTAL_CODE>", {"account_fragment": 1, "postal_code": 1})


def test_signal_spans_point_into_the_original():
    text = "Act  now : click​ here or call this number"
    found = {m["signal"]: m for m in signals.matches(text)}
    assert {"artificial_urgency", "suspicious_link", "contact_diversion"} <= set(found)
    assert all(text[m["start"] : m["end"]] == m["text"] for m in found.values())
    assert signals.matches("") == [] and signals.matches(None) == []


def test_rules(spark):
    rows = [("otp and a gift card", "smishing"), ("scam alert: never share codes", "smishing"), ("discount offer today only", "smishing"), ("hello", "ham"), ("use the official app", "ham")]
    df = spark.createDataFrame(rows, "text string, mark string").withColumn("s", F.transform(signals.signal_matches(F.col("text")), lambda x: x["signal"]))
    got = df.select(signals.sms_label(F.col("text"), F.col("s"), F.col("mark"))["label"], signals.choose_action(F.col("s")), signals.override(F.col("text"), F.col("s"))["verdict"], signals.infer_category(F.col("text"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["SCAM", "SAFE", "UNCERTAIN", "SAFE", "SAFE"]
    assert got[0][1] == "DO_NOT_SHARE_CODE" and got[3][1] == "NO_ACTION" and got[4][2] == "SAFE"
    assert got[0][3] == "CREDENTIAL_MFA" and got[3][3] == "UNKNOWN"


TALK = "Transcript: caller: hello customer: hi there caller: please read me the verification code customer: no, hang up, I never share it caller: ok"


def test_dialogue_policies(spark):
    assert [(t.speaker, t.content) for t in dialogue.turns("x agent: a  b Customer: c agent:")] == [("agent", "a b"), ("customer", "c")]
    assert dialogue.speaker_neutral(TALK) == "A: hello B: hi there A: please read me the verification code B: no, hang up, I never share it A: ok"
    assert dialogue.speaker_neutral("caller: a customer: b") == "caller: a customer: b"
    assert dialogue.evidence_recent(TALK).startswith("EVIDENCE: ") and "RECENT: A: ok" in dialogue.evidence_recent(TALK)
    assert dialogue.action_preserving(TALK).startswith("EVIDENCE: A: please read me the verification code B: no, hang up")
    long = " ".join(f"{s}: {'word ' * 200}send the payment" for s in ("caller", "customer") * 4)
    assert len(dialogue.evidence_recent(long)) <= dialogue.MAX_CHARS
    with pytest.raises(ValueError):
        dialogue.prepared(F.lit("x"), "unknown")
    assert one(spark, lambda c: dialogue.prepared(c, "none"), TALK) == TALK


def by_definition(value):
    padded, weights = f"  {value}  ", [0] * 64
    for i in range(max(1, len(padded) - 3)):
        h = int.from_bytes(hashlib.blake2b(padded[i : i + 4].encode(), digest_size=8).digest(), "big")
        weights = [w + (1 if h >> b & 1 else -1) for b, w in enumerate(weights)]
    return sum(1 << b for b, w in enumerate(weights) if w >= 0)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab <>é", max_size=40))
def test_signature_by_definition(value):
    assert simhash.signature(value) == by_definition(value)


def test_block_keys_are_complete(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        a = int(rng.integers(-(1 << 62), 1 << 62))
        b = a
        for bit in rng.choice(63, 6, replace=False):
            b ^= 1 << int(bit)
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    share = lambda f: F.arrays_overlap(f(F.col("a")), f(F.col("b")))
    assert df.where(~share(simhash.bands)).count() == 0
    assert df.where(~share(simhash.block_keys)).count() == 0
    assert df.where(simhash.hamming(F.col("a"), F.col("b")) != 6).count() == 0


def test_wilson_and_verdict(spark):
    row = spark.range(1).select(*vd.wilson_interval(F.lit(0), F.lit(10)), *vd.wilson_interval(F.lit(10), F.lit(10)), *vd.wilson_interval(F.lit(0), F.lit(0)), vd.wilson_lower(F.lit(0), F.lit(0))).first()
    assert row[0] == 0 and row[3] == 1 and row[4:6] == (0, 1) and row[6] is None
    assert row[1] == pytest.approx(0.277533, abs=1e-6)
    with pytest.raises(ValueError):
        vd.verdict(F.lit(0.1), F.lit(0.2), 1.5, 0.5)
