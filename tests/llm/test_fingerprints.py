import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F
from textgate.llm import fingerprints
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_against_true_similarity(spark):
    texts = {i: prose(i, 40 + 12 * i) for i in range(40)}
    texts |= {100 + i: " ".join(texts[i].split()[: len(texts[i].split()) * 9 // 10]) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(df).collect()}
    order = sorted(texts)
    off = []
    for n, i in enumerate(order):
        following = texts[order[(n + 1) % len(order)]]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(texts[i])
        for value, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            a, b = shingles(texts[i]), shingles(other)
            off.append(value - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.2


def test_odd_rows(odd, odd_rows, none):
    got = fingerprints.compare_with_edits(odd).collect()
    assert len(got) == len(odd_rows) and all(len(r.fingerprint) == 512 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint != by[4].fingerprint
    assert by[6].fingerprint == by[7].fingerprint == by[8].fingerprint and by[6].near_next == 1.0
    order = sorted((r for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for n, r in enumerate(order):
        text, following = r[1] or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((r[0], hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert fingerprints.compare_with_edits(none).collect() == []


def plain_fingerprint(text):
    """Bins, densification and packing in plain Python."""
    words = " ".join((text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")).split()
    words = words or [""]
    bins = [None] * 256
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        at, rest = ((h >> 56) + 128) % 256, h & (1 << 56) - 1
        bins[at] = rest if bins[at] is None or rest < bins[at] else bins[at]
    filled = []
    for i, v in enumerate(bins):
        tries = (bins[fingerprints._probe(i, t)] for t in range(256))
        filled.append(v if v is not None else next(x for x in tries if x is not None))
    return "".join(bytes(x & 255 for x in reversed(filled[j : j + 8])).hex() for j in range(0, 256, 8))


def test_bins_and_densification_against_plain_python(spark):
    texts = {i: prose(i, 1 + 3 * i) for i in range(80)} | {100: "", 101: "one", 102: "a b c d", 103: prose(9, 4000), 104: "ñandú  中文\tx y\nz"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in texts.items()}


def test_many_ranges(spark, monkeypatch):
    df = spark.range(700).select((F.col("id") * 7 % 700 * 1_000_003 + (1 << 61)).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    want = sorted(map(tuple, fingerprints.compare_with_edits(df).collect()))
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    assert sorted(map(tuple, fingerprints.compare_with_edits(df).collect())) == want


def test_frequent_ids(spark, monkeypatch):
    """Ids that fill ranges by themselves, with copies, common starts and an id before and after them."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rows = [(None, f"{prose(i % 40, 12)} {i % 60}") for i in range(300)] + [(None, "same start " + "x" * i) for i in range(30)] + [(None, "copy")] * 90
    rows += [(7, prose(i, 9)) for i in range(120)] + [(7, None), (7, ""), (7, "é"), (7, "\U0001f600")] + [(i, prose(i, 9)) for i in (-5, 1, 8, 9, 10)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((doc, hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = fingerprints.compare_with_edits(df).collect()
        assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
        for r in got:
            if r.doc_id is None and r.n_chars == 4 and r.edited_sha256 == hashlib.sha256(b"coco").hexdigest():
                assert r.near_next == 1.0
