"""Operator 1: licence scans with a positional rare-token index, in DataFrame functions only.

The index holds, for every template, its words of highest inverse document frequency (over the
templates) and where they stand. Of a file, only the words in that index are looked up; each
posting proposes (template, start = position in the file - position in the template). Starts that
all rare words of a template agree on are intersected out - they stand side by side among the
sorted proposals - then the template's mandatory key
phrase must stand there word for word, and the share of all template words in place is the score.
Base phrases are templates that are key phrase as a whole. Everything is one narrow map.

Defined cases: a null or empty text, or one without a word, has 0 words, no place, empty labels
and score 0; repeated rows give repeated results; an empty table gives no rows; further columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Labels, template words and key phrases.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
TEMPLATES = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("epl", "eclipse public license v 2 0", "eclipse public license"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KELVIN = "\u212a"  # the one other character that lower() turns into an ASCII letter by itself
RARE_WORDS = 2
START_BITS = 32
START = 1 << START_BITS
LEAST_SCORE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key_len: int
    base: bool
    rare: tuple[tuple[str, int], ...]


def index(base: tuple = BASE, templates: tuple = TEMPLATES, rare_words: int = RARE_WORDS) -> list[Template]:
    """The templates with their rarest words: the highest IDF over all templates, in the key phrase."""
    plain = [(a, tuple(p.split()), tuple(p.split()), True) for a, p in base]
    plain += [(a, tuple(p.split()), tuple(k.split()), False) for a, p, k in templates]
    idf = {}
    for _, words, _, _ in plain:
        for w in words:
            idf.setdefault(w, math.log(len(plain) / sum(w in other for _, other, _, _ in plain)))
    made = []
    for label, words, key, is_base in plain:
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        spots = sorted(((-idf[w], w, at + i) for i, w in enumerate(key)))
        rare = tuple((w, i) for _, w, i in spots[:rare_words])
        made.append(Template(label, words, at, len(key), is_base, rare))
    return made


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; its ends may be empty words."""
    lowered = F.when(F.instr(text, KELVIN) > 0, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.split(lowered, SEPARATORS, -1)


def _array(values: list[Column], kind: str) -> Column:
    return F.array(*values) if values else F.expr(f"cast(array() as array<{kind}>)")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``spans``.

    ``spans`` lists (label, start, words, score, base) of every verified place; starts count words
    from 0.
    """
    made = index(base, templates)
    vocabulary = sorted({w for t in made for w, _ in t.rare})
    postings = _array(
        [F.struct(F.lit(w).alias("w"), F.lit(n).alias("t"), F.lit(i).alias("p")) for n, t in enumerate(made) for w, i in t.rare],
        "struct<w string, t int, p int>",
    )
    table = _array(
        [
            F.struct(
                F.lit(t.label).alias("label"), F.array(*map(F.lit, t.words)).alias("words"), F.lit(t.key_at).alias("key_at"),
                F.lit(t.key_len).alias("key_len"), F.lit(t.base).alias("base"),
            )
            for t in made
        ],
        "struct<label string, words array<string>, key_at int, key_len int, base boolean>",
    )
    needs = _array([F.lit(len(t.rare)) for t in made], "int")
    w = F.col("w")
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(text_or_empty(text_col)).alias("w"))
    rows = rows.select(
        "doc_id", "w", F.when(F.get(w, F.lit(0)) == "", 1).otherwise(0).alias("lead"),
        F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0).alias("trail"),
        F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(vocabulary)).alias("hits"),
    )
    # a proposal is one number: the template, and the start from -START on
    code = lambda t, at: t.cast("long") * F.lit(2 * START) + at.cast("long") + F.lit(START)
    proposals = F.flatten(
        F.transform(
            F.col("hits"),
            lambda i: F.transform(F.filter(postings, lambda p: p["w"] == F.get(w, i)), lambda p: code(p["t"], i - p["p"])),
        )
    )
    rows = rows.select("*", F.sort_array(proposals).alias("proposals"))
    of = lambda x: F.shiftright(x, START_BITS + 1).cast("int")
    # each rare word proposes a start once, so a start that all agree on stands as often in a row
    agreed = F.filter(
        F.col("proposals"),
        lambda x, i: ((i == 0) | (F.get("proposals", i - 1) != x)) & (F.get("proposals", i + F.get(needs, of(x)) - 1) == x),
    )
    placed = F.transform(
        agreed,
        lambda x: F.struct((F.pmod(x, F.lit(2 * START)) - F.lit(START)).cast("int").alias("at"), F.get(table, of(x)).alias("of")),
    )
    rows = rows.select("*", placed.alias("placed"))

    def in_place(c: Column, k: Column) -> Column:
        at = c["at"] + k
        return F.coalesce((at >= 0) & (F.get(w, at) == F.get(c["of"]["words"], k)), F.lit(False))

    keyed = F.filter(
        F.col("placed"),
        lambda c: F.forall(
            F.sequence(c["of"]["key_at"], c["of"]["key_at"] + c["of"]["key_len"] - 1), lambda k: in_place(c, k)
        ),
    )
    spans = F.transform(
        keyed,
        lambda c: F.struct(
            c["of"]["label"].alias("label"), (c["at"] - F.col("lead")).cast("long").alias("start"),
            F.size(c["of"]["words"]).alias("words"),
            (
                F.size(F.filter(F.sequence(F.lit(0), F.size(c["of"]["words"]) - 1), lambda k: in_place(c, k)))
                / F.size(c["of"]["words"])
            ).alias("score"),
            c["of"]["base"].alias("base"),
        ),
    )
    rows = rows.select("doc_id", "w", "lead", "trail", spans.alias("keyed"))
    rows = rows.select(
        "doc_id", (F.size(w) - F.col("lead") - F.col("trail")).cast("long").alias("n_words"),
        F.filter(F.col("keyed"), lambda s: s["score"] >= LEAST_SCORE).alias("spans"),
    )
    rows = rows.select("*", F.filter(F.col("spans"), lambda s: s["base"]).alias("base_spans"))

    def labels(spans: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(F.col(spans), lambda s: s["label"]))), ",")

    starts = F.transform(F.col("base_spans"), lambda s: s["start"])
    return rows.select(
        "doc_id", "n_words", F.size("base_spans").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels("base_spans").alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col("spans"), lambda s: s["score"])), F.lit(0.0)).alias("score"), "spans",
    )


def oracle() -> str:
    """The digest columns by brute force in DuckDB: every start of every template is tried."""
    one = []
    for t in index():
        n = len(t.words)
        hit = lambda k: f"(i + {k} >= 1 AND coalesce(ws[i + {k}] = '{t.words[k]}', false))"  # noqa: B023, E731
        key = " AND ".join(hit(k) for k in range(t.key_at, t.key_at + t.key_len))
        score = " + ".join(f"{hit(k)}::INT" for k in range(n))
        one.append(
            f"list_transform(list_filter(range(1 - {t.key_at}, len(ws) + 1), lambda i: {key}), "
            f"lambda i: {{'label': '{t.label}', 'at': i - 1, 'score': ({score})::DOUBLE / {n}, 'base': {str(t.base).lower()}}})"
        )
    spans = "flatten([" + ", ".join(one) + "])"
    return f"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
        s AS (SELECT doc_id, len(ws) AS n_words, list_filter({spans}, lambda x: x.score >= {LEAST_SCORE}) AS spans FROM w),
        b AS (SELECT *, list_filter(spans, lambda x: x.base) AS bs FROM s)
        SELECT doc_id, n_words, len(bs) AS n_base,
          list_min(list_transform(bs, lambda x: x.at)) AS first_word, list_max(list_transform(bs, lambda x: x.at)) AS last_word,
          array_to_string(list_sort(list_distinct(list_transform(bs, lambda x: x.label))), ',') AS base_labels,
          array_to_string(list_sort(list_distinct(list_transform(spans, lambda x: x.label))), ',') AS labels,
          coalesce(list_max(list_transform(spans, lambda x: x.score)), 0.0) AS score
        FROM b"""
