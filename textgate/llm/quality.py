"""Operator 6: quality classification by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled text train a linear scorer on statistics of the whole
text by minimising the non-negative unbiased risk

    prior * E_P[l(+f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),   l(z) = log(1 + exp(-z)).

The class prior is estimated from positives and unlabelled text alone: five models tell positives
from unlabelled text, each learnt on four fifths of the positives; the share of unlabelled rows above
a threshold, divided by the share of positives above it (each scored by the model that has not seen
it), is least where the top is pure, and that least ratio, with two standard errors, is the prior. Labels 0 are not used, unless
``calibrate`` is set, which fits the output to both labels.

All unlabelled rows count: each Newton step sums loss, gradient and curvature over the table of
their statistics, and the driver gets the sums. Only the positives are sampled (``sample_rows``).

Defined cases: a null text is an empty text and gets the score of its (zero) statistics; without
any label 1 to learn from every score is 0 (1 where no label is known at all); a document with
several labels has the more frequent one (1 where they tie); an id on several rows gives its least
statistics to learning once; null labels and ids are left out of learning; repeated rows give
repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discarded, fold, written

#: At most about this many labelled rows are sampled, by a hash of the id.
SAMPLE_ROWS = 15_000
STEPS = 25
HALVINGS = 3
THRESHOLDS = 200
FOLDS = 5
#: Weight decay: a floor, and a part that fades as trusted positives grow in number.
DECAY, DECAY_OF_ONE = 1e-3, 2.0
#: Statistics that hardly vary among learning rows must not decide by a phone number's few digits.
LEAST_SCALE = 0.05

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all "
    "de la le et les des en un une du que est pour qui dans par sur au plus ne se pas avec son ce il "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "el los del y las por con para al lo como su no si más o pero sus le ya".split()
)
_SYMBOLS = "*$%&#|!<>{}[]\\^~=+_@/"
NAMES = (
    "log_chars", "log_words", "upper", "lower", "digit", "space", "newline", "stops_commas", "other_punctuation", "high_bytes",
    *(f"symbol_{c}" for c in _SYMBOLS), "word_length", "distinct_words", "top_word", "same_as_before", "stop_words", "distinct_lines",
    "symbol_words", "upper_words",
)


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; zeros for an empty one."""
    out = np.zeros(len(NAMES))
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    seen = np.zeros(256)
    for at in range(0, len(raw), 1 << 22):
        seen += np.bincount(np.frombuffer(raw[at : at + (1 << 22)], np.uint8), minlength=256)
    seen /= len(raw)
    words = text.split()
    n = max(1, len(words))
    out[0], out[1] = np.log1p(len(text)), np.log1p(len(words))
    out[2], out[3], out[4], out[5], out[6] = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum(), seen[32], seen[10]
    out[7], out[9] = seen[44] + seen[46], seen[128:].sum()
    symbols = [float(seen[ord(c)]) for c in _SYMBOLS]
    out[8] = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum() - out[7] - sum(symbols)
    at = 10 + len(symbols)
    out[10:at] = np.sqrt(symbols)
    counts = Counter(words)
    lines = text.split("\n")
    out[at] = min(40.0, len(text) / n)
    out[at + 1] = len(counts) / n ** 0.8
    out[at + 2] = np.sqrt(max(counts.values(), default=0) / n)
    out[at + 3] = np.sqrt(sum(map(operator.eq, words, words[1:])) / n)
    out[at + 4] = sum(c for w, c in counts.items() if w in STOP_WORDS) / n
    out[at + 5] = len(set(lines)) / len(lines)
    out[at + 6] = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?") / n
    out[at + 7] = sum(c for w, c in counts.items() if w.isupper()) / n
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return _sigmoid(self.slope * z + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


#: Sums a function of statistics (rows by columns) over all unlabelled rows.
Totals = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]


class Scaled:
    """Statistics made comparable, with a last column of ones."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def _loss_sums(heads: list[np.ndarray], scaled: Scaled) -> Callable[[np.ndarray], np.ndarray]:
    """Of each head, the summed loss of calling a row positive, its gradient and its curvature."""

    def sums(x: np.ndarray) -> np.ndarray:
        x, found = scaled(x), []
        for w in heads:
            f = x @ w
            p = _sigmoid(f)
            found += [[np.logaddexp(0, f).sum()], x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
        return np.concatenate(found)

    return sums


def _minimised(positives: list[np.ndarray], prior: float | None, slack: float, scaled: Scaled, totals: Totals, n: float) -> list[np.ndarray]:
    """Of each set of positives, the weights of least risk; all heads share each pass over the unlabelled rows.

    With a prior it is the non-negative risk: a step after which its second part is more negative than
    chance explains (the prior's ``slack``, and a standard error over the positives) is halved back.
    Without one, positives are told from unlabelled rows: E_P[l(+f)] + E_U[l(-f)].
    """
    width = len(scaled.mean) + 1
    xs = [scaled(x) for x in positives]
    decays = [np.append(np.full(width - 1, DECAY + DECAY_OF_ONE / len(x)), 1e-9) for x in xs]

    def risk(x: np.ndarray, w: np.ndarray, decay: np.ndarray, u: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        f, loss, g, h = x @ w, u[0] / n, u[1 : 1 + width] / n, u[1 + width :].reshape(width, width) / n
        p = _sigmoid(f)
        if prior is None:
            value = np.logaddexp(0, -f).mean() + loss
            g, h = g - x.T @ (1 - p) / len(x), h + (x * (p * (1 - p))[:, None]).T @ x / len(x)
        else:
            called = np.logaddexp(0, f)
            rest, error = loss - prior * called.mean(), slack * called.mean() + prior * called.std() / np.sqrt(len(x))
            value = np.inf if rest < -error else prior * np.logaddexp(0, -f).mean() + rest
            g = g - prior * x.mean(axis=0)
        return value + 0.5 * (decay * w * w).sum(), g + decay * w, h + np.diag(decay) + 1e-9 * np.eye(width)

    best = [np.zeros(width) for _ in xs]
    values: list[float] = [np.inf] * len(xs)
    steps: list[np.ndarray | None] = [None] * len(xs)
    halved, done = [0] * len(xs), [False] * len(xs)
    for _ in range(STEPS):
        tried = [w if s is None else w - s for w, s in zip(best, steps, strict=True)]
        sums = np.split(totals(_loss_sums(tried, scaled)), len(xs))
        for i, (x, w, u) in enumerate(zip(xs, tried, sums, strict=True)):
            if done[i]:
                continue
            value, g, h = risk(x, w, decays[i], u)
            if steps[i] is None or value < values[i]:
                gain = values[i] - value
                best[i], values[i], steps[i], halved[i] = w, value, np.linalg.solve(h, g), 0
                done[i] = gain < 1e-6
            else:
                steps[i], halved[i] = steps[i] / 2, halved[i] + 1
                done[i] = halved[i] > HALVINGS
            if done[i]:
                steps[i] = None
        if all(done):
            break
    return best


def _prior(folds: list[np.ndarray], heads: list[np.ndarray], scaled: Scaled, totals: Totals, n: float) -> tuple[float, float]:
    """The share of positives among unlabelled rows, and what of it is allowed for chance. Each head scores
    the fold that it has not seen."""
    scores = [scaled(x) @ w for x, w in zip(folds, heads, strict=True)]
    cuts = [np.unique(np.quantile(s, np.linspace(0, 1, THRESHOLDS + 1), method="lower")) for s in scores]

    def above(x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        return np.concatenate([len(x) - np.searchsorted(np.sort(x @ w), c) for w, c in zip(heads, cuts, strict=True)])

    counts = np.split(totals(above), np.cumsum([len(c) for c in cuts])[:-1])
    # of each positive, the share of unlabelled rows that score as high
    ranks = np.sort(np.concatenate([k[np.searchsorted(c, s, "right") - 1] / n for s, c, k in zip(scores, cuts, counts, strict=True)]))
    of_p = np.arange(1, len(ranks) + 1) / (len(ranks) + 1)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(len(ranks)))
    at = int(np.argmin((ranks + 1.01 * margin) / of_p))
    # the least of many ratios is too low by chance: two standard errors keep clean documents on few labels
    u, p = ranks[at], of_p[at]
    off = (np.sqrt(u * (1 - u) / n) + u * np.sqrt((1 - p) / p / len(ranks))) / p
    prior = float(np.clip(u / p + 2 * off, 0.01, 0.99))
    return prior, max(0.0, prior - u / p)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * z + b)
        g = np.array([(z * (p - target)).sum(), (p - target).sum()])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(labelled: np.ndarray, y: np.ndarray, unlabelled: np.ndarray | Totals, calibrate: bool = False) -> Model:
    """A model from statistics of labelled rows, and of unlabelled rows or sums over them."""
    width = len(NAMES)
    positives = labelled[y == 1]
    totals = unlabelled if callable(unlabelled) else (lambda f: f(unlabelled))
    n, *sums = totals(_moments) if len(positives) else (0,)
    if not len(positives) or not n:
        known = 0.0 if len(y) and not len(positives) else 1.0
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0, 60.0 * known - 30.0, known)
    sums = np.array(sums)
    mean = sums[:width] / n
    scaled = Scaled(mean, np.maximum(np.sqrt(np.maximum(sums[width:] / n - mean * mean, 0)), LEAST_SCALE))
    folds = [positives[k::FOLDS] for k in range(FOLDS)] if len(positives) >= 2 * FOLDS else [positives]
    seen = [np.vstack([x for x in folds if x is not fold]) for fold in folds] if len(folds) > 1 else folds
    prior, slack = _prior(folds, _minimised(seen, None, 0.0, scaled, totals, n), scaled, totals, n)
    (w,) = _minimised([positives], prior, slack, scaled, totals, n)
    slope, shift = _calibrated(scaled(labelled) @ w, y) if calibrate and (y == 0).any() else (1.0, 0.0)
    return Model(mean, scaled.scale, w[:-1], float(w[-1]), slope, shift, prior)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, calibrate: bool = False,
) -> Model:
    """A model from ``labels``, sampled to about ``sample_rows`` by a hash of the id, and from all of ``docs``.

    Statistics of all rows are made once and written. The driver gets those of the sampled ids, one
    row an id, and of all rows sums alone.
    """
    key, text = F.col(id_col).cast("string"), F.col(text_col).cast("string")
    marks = labels.select(F.col(id_col).cast("string").alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y is not null")
    marks = marks.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    marks = written(marks if calibrate else marks.where("y = 1"), "marks")
    share = min(1.0, sample_rows / max(1, marks.count()))
    some = marks.where(F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    known = written(_statistics(docs.select(key.alias("k"), text.alias("text")).where("k is not null")), "statistics")
    # about sample_rows ids: small enough to send to all
    got = known.join(F.broadcast(some), "k").groupBy("k", "y").agg(F.min("x").alias("x")).toArrow().to_pandas().sort_values("k", kind="stable")
    x = np.stack(got["x"].to_numpy()).astype(np.float64) if len(got) else np.zeros((0, len(NAMES)))
    anything = len(got) or labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).limit(1).count()
    y = got["y"].to_numpy() if len(got) else np.zeros(1 if anything else 0, int)
    model = train(x if len(got) else np.zeros((len(y), len(NAMES))), y, _totals(known), calibrate)
    discarded(marks, known)
    return model


def _totals(known: DataFrame) -> Totals:
    """Sums over the rows of a table of statistics: one row of sums a task, which are summed place by place."""

    def totals(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        size = len(f(np.zeros((0, len(NAMES)))))

        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    out += f(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["s"])

        rows = known.select("x").mapInArrow(per_task, "s array<double>").select(F.posexplode("s").alias("i", "v"))
        got = rows.groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # one row a place
        out = np.zeros(size)
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
        return out

    return totals


def _statistics(rows: DataFrame) -> DataFrame:
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t).astype(np.float32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], names=["k", "x"])

    return rows.mapInArrow(per_batch, "k string, x array<float>")


def scored(text: Column, model: Model) -> Column:
    """The score of a text column: an Arrow-batched function that gets the model's few numbers."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])))

    return score(text.cast("string"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``; a narrow map."""
    rows = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col), model).alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def learnable(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return df.where(fold(id_col, 3) != 1)
