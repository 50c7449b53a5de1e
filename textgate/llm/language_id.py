"""Operator 8: language identification by averaged hashed subword embeddings.

A text is lower-cased, runs of other characters than letters become one boundary mark, and its
letter 2-, 3- and 4-grams inside word boundaries are hashed to buckets. The text's vector is the
mean of its buckets' embeddings; a linear softmax follows. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of rows. A temperature is fitted on rows
left out of the descent, and the rejection threshold is the least score from which on the accepted
rows left out reach a target precision. Scoring multiplies embeddings and softmax out into one
small table, which is all that executors get.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected;
without any row to learn from every text is; repeated rows give repeated results; an empty table
gives no rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 14
DIMENSIONS = 16
#: At most about this many rows are sampled to learn from, by a hash of their id.
SAMPLE_ROWS = 4000
EPOCHS = 12
RATE = 0.5
ACCEPTED_PRECISION = 0.99
PIECE_CHARS = 1 << 20
MARK = 32
#: n-grams without evidence that are added to each text, so that very short texts score lower.
PRIOR_GRAMS = 20

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def _hashed(codes: np.ndarray, known: int = 0) -> np.ndarray:
    """Buckets of the n-grams of a marked run of letters, but those that lie within its first ``known`` codes."""
    c = codes.astype(np.uint32)
    inner = c != MARK
    found = []
    h = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    found.append((h ^ np.uint32(0x2545F491))[max(0, known - 1) :])
    if len(c) > 2:
        h = h[:-1] + c[2:] * np.uint32(0xC2B2AE35)
        found.append((h ^ np.uint32(0x1B873593))[max(0, known - 2) :][inner[1:-1][max(0, known - 2) :]])
    if len(c) > 3:
        h = h[:-1] + c[3:] * np.uint32(0x27D4EB2F)
        found.append((h ^ np.uint32(0xCC9E2D51))[max(0, known - 3) :][(inner[1:-2] & inner[2:-1])[max(0, known - 3) :]])
    all_ = np.concatenate(found)
    all_ ^= all_ >> np.uint32(15)
    all_ *= np.uint32(0x2C1B3C6D)
    return all_ >> np.uint32(32 - BUCKET_BITS)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """The whole text's buckets, in pieces of bounded size; nothing for a text without a letter.

    The last three codes of a piece precede the next one, so that the pieces' n-grams are those of
    the uncut text, each once.
    """
    letters, whole = _letters(), (text or "").lower()
    before, told = np.array([MARK], np.uint32), False
    for at in range(0, len(whole), PIECE_CHARS):
        codes = np.frombuffer(whole[at : at + PIECE_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate((before, np.where(letters[codes], codes, np.uint32(MARK)), [MARK] if at + PIECE_CHARS >= len(whole) else [])).astype(np.uint32)
        codes = codes[np.concatenate(([True], (codes[1:] != MARK) | (codes[:-1] != MARK)))]
        told |= bool((codes != MARK).any())
        if told and len(codes) > len(before):
            yield _hashed(codes, len(before))
        before = codes[-3:]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x lang: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.langs)), 0
        for h in buckets(text):
            total += self.table[h].sum(axis=0, dtype=np.float64) if len(self.langs) else 0
            n += len(h)
        if not n or not self.langs:
            return "und", 0.0
        p = _softmax((total / (n + PRIOR_GRAMS) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """rows: (lang, buckets, their shares of the text), in a fixed order."""
    langs = sorted({r[0] for r in rows})
    size = 1 << BUCKET_BITS
    if not langs:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (size, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, len(langs))), np.zeros(len(langs))
    at = {x: i for i, x in enumerate(langs)}
    order = rng.permutation(len(rows))
    left_out, kept = order[: len(rows) // 5], order[len(rows) // 5 :]
    kept = kept if len(kept) else order
    steps, step = EPOCHS * len(kept), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(kept):
            lang, idx, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            rowsof = emb[idx]
            x = share @ rowsof
            g = -_softmax(x @ weights + bias)
            g[at[lang]] += 1
            back = weights @ g
            weights += rate * np.outer(x, g)
            bias += 0.02 * rate * g
            # a bucket's step is scaled by its share relative to the largest one, not by its share
            emb[idx] = rowsof + 0.2 * rate * np.outer(share / share.max(), back)
    table = (emb @ weights).astype(np.float32)
    held = [rows[i] for i in (left_out if len(left_out) else kept)]
    z = np.array([s @ table[i] + bias for _, i, s in held])
    y = np.array([at[r[0]] for r in held])
    grid = np.geomspace(0.02, 20, 121)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    best = np.sort(p.max(axis=1))
    right = (p.argmax(axis=1) == y)[np.argsort(p.max(axis=1), kind="stable")]
    precision = np.cumsum(right[::-1])[::-1] / np.arange(len(y), 0, -1)
    good = np.flatnonzero(precision >= ACCEPTED_PRECISION)
    reject = 0.0 if not len(good) or good[0] == 0 else float(best[good[0]])
    return Model(langs, table, bias, temperature, reject)


def fit(learn: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most about ``sample_rows`` rows of ``learn``, drawn by a hash of the id.

    Executors turn the drawn texts into bucket shares; the driver collects those alone, at most
    2 ** BUCKET_BITS numbers a row.
    """
    known = learn.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    if not n:
        return train([])
    share = min(1.0, sample_rows / n)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)
    drawn = known.where(draw).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    )

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, idx, share_ = [], [], [], []
            for i, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total = np.zeros(1 << BUCKET_BITS)
                for h in buckets(text):
                    total += np.bincount(h, minlength=1 << BUCKET_BITS)
                if total.any():
                    at = np.flatnonzero(total)
                    ids.append(i)
                    langs.append(lang)
                    idx.append(at.astype(np.int32))
                    share_.append((total[at] / total.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(idx, pa.list_(pa.int32())), pa.array(share_, pa.list_(pa.float32()))],
                names=["id", "lang", "idx", "share"],
            )

    got = drawn.mapInArrow(shares, "id string, lang string, idx array<int>, share array<float>").toArrow().combine_chunks()
    got = got.sort_by([("id", "ascending"), ("lang", "ascending")])
    langs = got.column("lang").to_pylist()
    idx, parts = got.column("idx"), got.column("share")
    return train([(lang, idx[i].values.to_numpy(), parts[i].values.to_numpy().astype(np.float64)) for i, lang in enumerate(langs)])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of ``docs``; a narrow map."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS numbers a language
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            found = [m.scores(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[0] == "und" or x[1] < m.reject_below for x in found], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(per_batch, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
