"""Text quality by positive-unlabelled learning.

A linear model over measures of a whole text minimises the non-negative
unbiased risk: trusted positives weighed by the class prior, plus what the
unlabelled texts' risk leaves after the positives' share is taken off, never
under zero. The prior is estimated from positives and unlabelled texts alone.
Labels of both kinds only calibrate the finished score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import NOT_SPACE
from .text_arrays import LOWER, chunks, let_go, prefix_sums, span_hash, text_bytes, words

#: Rows that the model is fitted on at most, about: labelled and unlabelled ones.
LABELLED, UNLABELLED = 20_000, 20_000

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
N_MEASURES = 12 + len(_PUNCTUATION)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of measures for each text, each roughly between 0 and 5."""
    n = len(offsets) - 1
    out = np.zeros((n, N_MEASURES))
    low = LOWER[data]
    starts, ends, doc = words(low, offsets, NOT_SPACE)
    h = span_hash(prefix_sums(low), starts, ends)
    n_words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    adjacent = np.bincount(doc[again], minlength=n) if len(h) else np.zeros(n)
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = letters[128:] = True
    ends_other = np.bincount(doc[~letters[data[ends - 1]]], minlength=n) if len(h) else np.zeros(n)
    for i in range(n):
        size = offsets[i + 1] - offsets[i]
        if not size:
            continue
        count = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        w = max(int(n_words[i]), 1)
        own = h[first[i] : first[i + 1]]
        distinct, times = np.unique(own, return_counts=True)
        upper, lower = count[65:91].sum(), count[97:123].sum()
        out[i, :12] = (
            np.log1p(size) / 4, upper / max(upper + lower, 1), count[48:58].sum() / size, count[128:].sum() / size, count[10] / w, count[32] / size,
            size / w / 8, adjacent[i] / w, len(distinct) / w, (times.max() if len(times) else 0) / w, ends_other[i] / w, np.log1p(w) / 4,
        )
        out[i, 12:] = np.log1p(200 * count[_PUNCTUATION] / size)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Standardised linear score with calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.mean, self.scale, self.weights, self.bias, self.slope, self.shift = mean, scale, weights, bias, slope, shift

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift)


def nnpu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the non-negative unbiased risk under the logistic loss, and their slopes.

    Of positives called negative (times the prior), and of negatives called
    positive: what the unlabelled rows' loss leaves without the positives'
    share. Rows end with a 1 for the bias. The risk is the first part plus the
    second where that is not under zero.
    """
    gp, gu = p @ w, u @ w
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    slope_positive = prior * p.T @ (_sigmoid(gp) - 1) / len(p)
    slope_negative = u.T @ _sigmoid(gu) / len(u) - prior * p.T @ _sigmoid(gp) / len(p)
    return positive, negative, slope_positive, slope_negative


def _adam(slope, n: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        grad = slope(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of all rows, and both kinds standardised with a 1 at their end."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))] for x in (positive, unlabelled))
    return mean, scale, p, u


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05, confidence: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from those two alone.

    A logistic model learns on every second row to tell positives from
    unlabelled ones. Above any score, the unlabelled share over the positives'
    share bounds the prior from above, for the positives' own scores are a
    part of the unlabelled ones'; on the other rows the least of these bounds,
    each with its sampling error, is looked up and given without the error.
    """
    _, _, p, u = _scaled(positive, unlabelled)
    if len(p) < 4 or len(u) < 4:
        return 0.5
    fit_p, fit_u = p[::2], u[::2]
    w = _adam(lambda w: (fit_p.T @ (_sigmoid(fit_p @ w) - 1) / len(fit_p) + fit_u.T @ _sigmoid(fit_u @ w) / len(fit_u)) / 2 + 1e-3 * w, p.shape[1], steps, rate)
    sp, su = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    cut = np.unique(sp)
    above_p = 1 - np.searchsorted(sp, cut, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, cut, "left") / len(su)
    error = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Adam on the non-negative unbiased risk."""
    mean, scale, p, u = _scaled(positive, unlabelled)

    def slope(w: np.ndarray) -> np.ndarray:
        _, negative, slope_positive, slope_negative = nnpu_risk(w, p, u, prior)
        # Where the negatives' risk falls under zero the model has overfitted; the step undoes that.
        return (slope_positive + slope_negative if negative >= 0 else -slope_negative) + decay * w

    w = _adam(slope, p.shape[1], steps, rate)
    return Model(mean, scale, w[:-1], w[-1])


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 60) -> None:
    """Slope and shift by Newton steps on the logistic loss, a little ridge for separable labels."""
    a = np.c_[model.raw(x), np.ones(len(x))]
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(a @ w)
        grad = a.T @ (p - y) + 0.01 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
        if np.abs(grad).max() < 1e-8 or not np.isfinite(w).all():
            break
    if np.isfinite(w).all() and w[0] > 0:
        model.slope, model.shift = float(w[0]), float(w[1])


_MEASURED = "doc_id long, quality int, sampled boolean, measures binary"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        for i, j in chunks(offsets):
            x = measures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "sampled", "measures"])


def _fold(of: str = "doc_id", parts: int = 4):
    return F.pmod(F.crc32(F.col(of).cast("string").cast("binary")), F.lit(parts))


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """A model from the rows whose crc32(doc_id) mod ``folds`` is not ``held_out``.

    Ids are sampled by their hash to about ``labelled`` and ``unlabelled`` at
    most, which bounds what the driver and each broadcast hold; scores are for
    every row all the same. Texts are measured where they lie: the sampled ids
    go to them. Labels other than 0 and 1 are none; of several for one id the
    least counts. Without positives or texts every score is 0.5.
    """
    def share(df: DataFrame, most: int) -> int:
        return min(1 << 30, int(most / max(df.count(), 1) * (1 << 30)))

    def drawn(salt: int, part: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < part

    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold(parts=folds) != held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.where(drawn(3, share(known, labelled))).select(F.col("doc_id").alias("__id"), "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (_fold(parts=folds) != held_out))
    texts = texts.select("doc_id", drawn(4, share(texts, unlabelled)).alias("sampled"), "text")
    met = texts.join(F.broadcast(known), F.col("doc_id") == F.col("__id"), "left").where("sampled or quality is not null")
    rows = met.select("doc_id", "quality", "sampled", "text").mapInArrow(_measure, _MEASURED).collect()
    rows.sort(key=lambda r: (r[0], bytes(r[3])))  # the same model from any order of the rows
    x = np.stack([np.frombuffer(r[3]) for r in rows]) if rows else np.zeros((0, N_MEASURES))
    y = np.array([-1 if r[1] is None else r[1] for r in rows], np.int64)
    u = x[np.array([r[2] for r in rows], bool)]
    if not (y == 1).any() or not len(u):
        return Model(np.zeros(N_MEASURES), np.ones(N_MEASURES), np.zeros(N_MEASURES), 0.0)
    model = fit_nnpu(x[y == 1], u, class_prior(x[y == 1], u))
    if (y == 0).any():
        calibrate(model, x[y >= 0], y[y >= 0].astype(float))
    return model


def _score(model: Model, keep: float | None, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for i, j in chunks(offsets):
                s = model.score(measures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(s >= keep)) if keep is not None else pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, from the whole text alone.

    Null is scored as the empty text. Rows come out as they come in, repeated
    ones too (null ids with held_out null); an empty table gives no rows. A
    text of any length is measured whole; it must fit in a task. Other columns,
    whatever their names, are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(model, None, 1), "doc_id long, score double")
    return scored.select("doc_id", (_fold(parts=folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that the model scores ``threshold`` or more.

    Each row is judged by its own text alone, so repeated rows stay or go
    together and ids, null ones too, don't matter. Null and empty texts are
    scored as the empty text. A text of any length is measured whole. An empty
    table stays empty; columns of any other name pass through.
    """
    return docs.mapInArrow(_score(model, threshold, docs.columns.index("text")), docs.schema)
