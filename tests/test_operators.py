import math
import time
import zipfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from textgate.operators import evaluation as ev
from textgate.operators import ledgers as lg
from textgate.operators import near, sampling
from textgate.operators import sequential as sq
from textgate.sources import readers, sinks
from textgate.streaming import streams

SMALL = "/root/testdata/sf0.001"


def test_exact_mcnemar():
    assert ev.exact_mcnemar(0, 0) == 1 and ev.exact_mcnemar(0, 5) == ev.exact_mcnemar(5, 0) == 0.0625
    assert ev.exact_mcnemar(11, 2) == 0.0224609375


def test_entropy(spark):
    import math

    from textgate.functions.text import lexical_features

    text = "Hello, hello WORLD 12345 aa!!"
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in lexical_features(F.col("t")).items()]).first()
    low = text.lower()
    assert got.entropy == pytest.approx(-sum(low.count(c) / len(low) * math.log2(low.count(c) / len(low)) for c in set(low)))
    assert (got.longest_digit_run, got.n_words, got.exclamations) == (5, 5, 2)
    assert got.repeats == sum(a == b for a, b in zip(text, text[1:]))


def test_largest_remainder():
    assert sampling.largest_remainder({"SAFE": 1746, "UNCERTAIN": 41, "SCAM": 587}, 300) == {"SAFE": 210, "UNCERTAIN": 14, "SCAM": 76}
    with pytest.raises(ValueError):
        sampling.largest_remainder({"a": 5}, 9)


def binary(spark, n=120, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(float(round(p, 2)), int(y)) for p, y in zip(rng.random(n), rng.random(n) < 0.4, strict=True)]
    return rows, spark.createDataFrame(rows, "p_scam double, y int")


def test_threshold_against_brute_force(spark):
    rows, df = binary(spark)
    best = None
    for t in {p for p, _ in rows}:
        tp, fp = sum(p >= t and y for p, y in rows), sum(p >= t and not y for p, y in rows)
        if fp / sum(not y for _, y in rows) <= 0.2:
            best = max(best or (0, 0, 0), (tp / sum(y for _, y in rows), tp / (tp + fp), t))
    assert ev.choose_threshold(df, 0.2).first().threshold == best[2]
    assert ev.choose_threshold(df.where("y = 0"), -1.0).first().threshold == 1.0
    assert ev.choose_gate_threshold(df, 0.2, 1.1).first().threshold is None


def test_calibration_edges(spark):
    p = [i / 15 for i in range(16)] + [0.2, 0.999]
    df = spark.createDataFrame([(x,) for x in p], "p double").select("p", ev.edge_bin(F.col("p")).alias("b"))
    edges = np.linspace(0, 1, 16)
    assert all(r.b == min(14, int(np.searchsorted(edges, r.p, side="right")) - 1) for r in df.collect())


def test_stable_threshold():
    assert sq.stable_threshold(0.6, 0.4, 0.6) == 0.5 and sq.stable_threshold(0.6, None, 0.6) == 0.6
    assert sq.stable_threshold(0.6, 0.6 - 1e-9, 0.6) == 0.6


def test_nearest_subset():
    sizes = {f"c{i}": i + 1 for i in range(8)}
    picked = sq.nearest_subset(sizes, 0.25, "x")
    assert sum(sizes[c] for c in picked) == 9 and 3 <= len(picked) <= 6
    many = {f"c{i}": 10 for i in range(40)}
    assert abs(len(sq.nearest_subset(many, 0.2, "x")) - 8) <= 1


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    nodes = spark.range(400).withColumnRenamed("id", "node")
    for limit in (0, 10_000):
        got = near.components(nodes, spark.createDataFrame(edges, "a long, b long"), in_one_task=limit).collect()
        assert len(got) == 400 and all(r.root == top(r.node) for r in got)


def test_near_families_by_brute_force(spark):
    from textgate.functions.simhash import signature

    base = "dear customer your parcel is waiting please confirm the delivery address on our site today thank you very much indeed"
    texts = [base, base + " now", base.replace("parcel", "packet"), "an entirely different sentence about the weather in the hills", "", ""]
    rows = [(str(i), t, "SAFE" if i != 2 else "SCAM") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    found = {r.id: r.root for r in near.clusters(df).collect()}
    skeletons = {r.id: r.s for r in df.select("id", near.family_skeleton(F.col("text")).alias("s")).collect()}
    sig = {i: signature(s) for i, s in skeletons.items()}
    groups = {i: {i} for i in sig}
    for _ in sig:
        for i in sig:
            for j in sig:
                if (sig[i] ^ sig[j]).bit_count() <= 6:
                    groups[i] |= groups[j]
    for i in sig:
        assert {j for j in found if found[j] == found[i]} == groups[i]
    kept, out = near.near_families(df)
    bad = {r.root for r in out.collect()}
    assert {r.id for r in kept.collect()} == {i for i in found if found[i] not in bad}


def test_ledger_contract(spark):
    good = ("1", "dev", "s", "SAFE", "SAFE", "SAFE", 0.5, 0.25, 0.25)
    rows = [good, ("2", "dev", "s", "NO", "SAFE", "SAFE", 0.5, 0.25, 0.25), ("3", "dev", "s", "SAFE", "SAFE", "SAFE", 0.9, 0.9, 0.9), ("1", "dev", "s", "SAFE", "SAFE", "SAFE", 0.5, 0.25, 0.25)]
    df = spark.createDataFrame(rows, "id string, split string, source string, truth string, verdict string, argmax string, p_safe double, p_uncertain double, p_scam double")
    assert sorted((r.rule, r.id) for r in lg.violations(df).collect()) == [("duplicate key", "1"), ("label", "2"), ("sum", "3")]
    inner, bad = lg.strict_join(df.where("id = '2'"), df.where("id <> '1'"), ["split", "id"], ["truth"])
    assert inner.count() == 1 and [(r.id, r.rule) for r in bad.collect()] == [("3", "missing left")]


def test_round_robin_and_diverse(spark):
    rows = [(f"{i:03d}", f"g{min(i // 10, 3)}") for i in range(100)]
    df = spark.createDataFrame(rows, "id string, g string")
    taken = defaultdict(int)
    for r in sampling.round_robin(df, ["g"], 10, "s").collect():
        taken[r.g] += 1
    assert sorted(taken.values()) == [2, 2, 3, 3]
    assert sampling.diverse_sample(df, ["g"], 500, "s").count() == 100
    assert sampling.diverse_sample(df, ["g"], 40, "s").select("id").distinct().count() == 40


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "﻿id,text\n1,hello\n2,\"a,b\"\n")
        z.writestr("notes.txt", "no")
    rows = readers.read_zip_csv(spark, str(tmp_path / "a.zip"), "id string, text string").collect()
    assert sorted((r.id, r.text, r.member) for r in rows) == [("1", "hello", "one.csv"), ("2", "a,b", "one.csv")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.csv", "id,text\n")
    with pytest.raises(Exception, match="unsafe member"):
        readers.read_zip_csv(spark, str(tmp_path / "b.zip"), "id string, text string").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    df = spark.createDataFrame([("1", "é\tx"), ("2", "y")], "id string, text string")
    assert sinks.write_jsonl(df, str(tmp_path / "out")) == 2
    (tmp_path / "tabs.txt").write_text("ham\ta\tb\nnone\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_first_tab(spark, str(tmp_path / "tabs.txt")).collect()] == [("ham", "a\tb")]
    sinks.write_scores(df, str(tmp_path / "scores"), "run")
    assert readers.cached_scores(spark, str(tmp_path / "scores"), "run").count() == 2
    assert readers.cached_scores(spark, str(tmp_path / "scores"), "other") is None
    nested = spark.createDataFrame([('"plain"',), ('[{"type":"text","text":"a"},{"type":"audio","audio":"f.wav"}]',)], "c string").select(readers.flatten_content("c").alias("x")).select("x.*")
    assert sorted(tuple(r) for r in nested.collect()) == [("a", 1), ("plain", 0)]


def test_calls(spark, tmp_path):
    (tmp_path / "calls.json").write_text('{"accent":"x","domain":"d","file_name":"f","duration":1.0,"segments":[{"role":"agent","start":0.0},{"role":"caller","start":2.0}]}\n{"file_name":"g","segments":[{"start":3.0},{"start":2.0}]}\n')
    assert {r.file_name: r.monotone for r in readers.read_calls(spark, str(tmp_path / "calls.json")).collect()} == {"f": True, "g": False}


def test_streams_equal_batches(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    rows = streams.stream(spark, SMALL, "events")
    best = {r.user_id: r.b for r in events.groupBy("user_id").agg(F.max("value").alias("b")).collect()}
    got = streams.finished(streams.running_max(rows.select("user_id", "value"), "user_id", "value"), "update")
    assert {r.user_id: r.b for r in got.groupBy("user_id").agg(F.max("best").alias("b")).collect()} == best
    per = streams.finished(streams.session_counts(rows, "user_id"), "append")
    assert per.count() > 0
    slid = streams.finished(streams.tumbling_counts(rows, "event_type", "2 hours", "0 seconds", "1 hour"), "update")
    assert slid.count() > 0


def test_bootstraps(spark):
    truth = np.array([0, 1] * 50)
    first, second = truth.copy(), truth.copy()
    first[:20] = 1 - first[:20]
    low, high = ev.paired_bootstrap(first, second, truth, lambda t, p: float((t == p).mean()), 200, 3)
    assert 0.05 < low < 0.2 < high < 0.35
    df = spark.createDataFrame([(str(i), int(f), int(s), int(t)) for i, (f, s, t) in enumerate(zip(first, second, truth, strict=True))], "id string, f int, s int, t int")
    right = lambda c: F.sum(F.when(F.col(c) == F.col("t"), F.col("weight")).otherwise(0)) / F.sum("weight")
    per = ev.poisson_bootstrap(df, "id", ["f", "s", "t"], lambda r: r.groupBy("iteration").agg((right("s") - right("f")).alias("d")), 200, 3)
    d = [r.d for r in per.collect()]
    assert len(d) == 200 and abs(np.mean(d) - 0.2) < 0.02


def test_temperature(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(0, 3, (400, 3))
    p = np.exp(z / 2) / np.exp(z / 2).sum(axis=1, keepdims=True)
    y = [["SAFE", "UNCERTAIN", "SCAM"][rng.choice(3, p=q)] for q in p]
    df = spark.createDataFrame([(t, *map(float, r)) for t, r in zip(y, z, strict=True)], "truth string, a double, b double, c double")
    assert sq.temperature(df, "truth", {"SAFE": "a", "UNCERTAIN": "b", "SCAM": "c"}) == pytest.approx(2, rel=0.25)


def test_workbook_and_digests(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>hello</t></is></c><c r="B2"><v>7</v></c></row><row><c r="B3"><v>8</v></c></row></sheetData></worksheet>'
    data = sinks.zipped({
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'.encode(),
        "xl/_rels/workbook.xml.rels": b'<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>text</t></si><si><t>n</t></si></sst>".encode(), "xl/worksheets/s.xml": sheet.encode(),
    })
    sinks.write_bytes(spark, str(tmp_path / "b.xlsx"), data)
    rows = readers.read_xlsx(spark, str(tmp_path / "b.xlsx"), ("One",), ("text", "n")).collect()
    assert [tuple(r) for r in rows] == [("hello", "7", "One")]
    import hashlib

    found = readers.verified(spark, str(tmp_path / "b.xlsx"), {"b.xlsx": hashlib.sha256(data).hexdigest()}).first()
    assert found.matches and not readers.verified(spark, str(tmp_path / "b.xlsx"), {}).first().matches


def test_written_tables_can_be_removed(spark):
    import os

    from textgate.storage import discarded, written

    kept, gone = (written(spark.range(5).toDF("x"), n) for n in ("kept", "gone"))
    path = gone.written_to
    assert sorted(r.x for r in gone.collect()) == list(range(5)) and os.path.isdir(path.removeprefix("file:"))
    discarded(gone, None, spark.range(3), gone)
    assert not os.path.exists(path.removeprefix("file:")) and kept.count() == 5


def test_exact_mcnemar_of_many_rows():
    """The double next to the exact value where whole numbers end, and counts of which whole numbers never end."""
    began = time.process_time()
    for n in (1, 2, 9, 300, ev.WHOLE_NUMBERS - 1, ev.WHOLE_NUMBERS, ev.WHOLE_NUMBERS + 1, 30_000):
        total = term = 1
        ks = {0, 1, n // 3, max(0, n // 2 - 200), n // 2 - 40, (n - 1) // 2, n // 2} - {-1} if n > 99 else set(range(n // 2 + 1))
        for k in range(n // 2 + 1):
            if k in ks:
                want = min(1.0, 2 * total / 2**n)
                assert ev.exact_mcnemar(k, n - k) == ev.exact_mcnemar(n - k, k) == want, (n, k)
            term = term * (n - k) // (k + 1)
            total += term
    for n in (10**6, 10**9):  # next to the normal distribution, by half a row
        z = 1.5
        k = round(n / 2 - z * math.sqrt(n) / 2)
        assert ev.exact_mcnemar(k, n - k) == pytest.approx(math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 2)), rel=1e-5)
    assert ev.exact_mcnemar(0, 10**9) == 0.0 and ev.exact_mcnemar(0, 0) == ev.exact_mcnemar(10**9, 10**9) == 1.0
    assert (ev.exact_mcnemar(0, 5), ev.exact_mcnemar(11, 2)) == (0.0625, 0.0224609375)
    assert time.process_time() - began < 20
