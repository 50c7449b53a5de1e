import re
import time

import duckdb
from textgate.llm import license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_index_words_come_from_key_phrases():
    for t in license_scan.index():
        assert t.words[t.key_at : t.key_at + t.key_len]
        assert all(t.words[i] == w and t.key_at <= i < t.key_at + t.key_len for w, i in t.rare)


def test_scan(spark):
    texts = {
        1: "Licensed under CC BY-NC 4.0.", 2: "GENERAL PUBLIC license, All-Rights reserved; general public license", 3: None, 4: "...",
        5: "the GNU General Public License version 3", 6: "permission is hereby granted", 7: "Kinsey all rights reserved",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels) == (7, 1, 2, "cc-by,cc-by-nc")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 6, "gpl,reserved")
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert got[4].n_words == 0
    assert got[5].labels == "gpl,gpl-3.0" and got[5].score == 1.0
    assert got[6].labels == "" and got[6].score == 0.0
    assert got[7].n_base == 1 and got[7].first_word == 1


def test_odd_rows_against_brute_force(odd, odd_rows, none):
    got = sorted((r.doc_id or 0, r.n_words, r.n_base) for r in license_scan.scan(odd).collect())
    want = []
    for r in odd_rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        places = sum(w[i : i + len(p.split())] == p.split() for _, p in license_scan.BASE for i in range(len(w)))
        want.append((r[0] or 0, len(w), places))
    assert got == sorted(want)
    assert license_scan.scan(none).collect() == []


def test_oracle(spark, odd):
    documents = odd.select("doc_id", "text").where("doc_id is not null").toArrow()  # noqa: F841
    want = duckdb.sql(license_scan.oracle()).fetchall()
    got = license_scan.scan(odd.where("doc_id is not null")).drop("spans").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_text_full_of_licence_words(spark):
    texts = {1: "cc by " * 20_000, 2: "general public license all rights reserved " * 8_000, 3: "by cc mit license " * 10_000}
    began = time.time()
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).drop("spans").collect()}
    assert time.time() - began < 60
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (20_000, 0, 39_998)
    assert (got[2].n_base, got[2].last_word, got[2].base_labels) == (16_000, 47_997, "gpl,reserved")
    assert (got[3].n_base, got[3].labels) == (0, "")
