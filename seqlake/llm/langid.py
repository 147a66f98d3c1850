"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed subwords (byte n-grams of
words, word edges included). Embeddings and softmax are trained together by
stochastic gradient descent in numpy. A slice of the training rows sets the
temperature of the probabilities and the score under which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import _fold
from .text_arrays import BYTE_CODE, LOWER, U64, chunks, text_bytes

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIMENSIONS = 16
#: Rows that the model is trained on at most, about.
TRAINED_ON = 4_000
NONE = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every subword. All but letters and bytes beyond ASCII count as word edges."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    # A word edge before each text and after the last.
    text = np.full(len(data) + n + 1, 32, np.uint8)
    doc = np.repeat(np.arange(n), size)
    at = np.arange(len(data)) + doc + 1
    low = LOWER[data]
    text[at] = np.where(_LETTER[low], low, 32)
    owner = np.append(np.repeat(np.arange(n), size + 1), n)
    letter = text != 32
    h = BYTE_CODE[text]
    buckets, owners = [], []
    roll = h
    inner = None
    for k in range(2, max(GRAMS) + 1):
        roll = roll[:-1] * U64(0x9E3779B97F4A7C15) + h[k - 1 :]
        if k == 2:
            ok = letter[:-1] | letter[1:]
        else:
            inner = letter[1 : len(letter) - k + 2] if inner is None else inner[: len(letter) - k + 1] & letter[k - 2 : len(letter) - 1]
            ok = inner[: len(roll)]
        if k in GRAMS:
            use = np.nonzero(ok)[0]
            # A gram that begins with an edge belongs to the text of its second byte.
            own = owner[use + 1] if k > 2 else np.where(letter[use], owner[use], owner[use + 1])
            buckets.append(((roll[use] ^ (roll[use] >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(64 - 15)).astype(np.int64))
            owners.append(own)
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    def __init__(self, languages: list[str], embedding: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.embedding, self.weights, self.bias = languages, embedding, weights, bias
        self.temperature, self.reject_below = 1.0, 0.0

    def tables(self) -> np.ndarray:
        """What each bucket adds to the mean's logits: the embedding and the softmax in one."""
        return self.embedding @ self.weights

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.5, held: float = 0.15) -> Model:
    """rows: language, distinct buckets, counts. The last ``held`` of a shuffled order calibrates."""
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(11)
    model = Model(languages, rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, max(len(languages), 1))), np.zeros(max(len(languages), 1)))
    rows = [r for r in rows if len(r[1])]
    if len(languages) < 2 or not rows:
        return model
    order = rng.permutation(len(rows))
    cut = len(rows) - int(held * len(rows)) if len(rows) >= 20 else len(rows)
    fit, check = order[:cut], order[cut:] if cut < len(rows) else order
    y = np.array([languages.index(r[0]) for r in rows])
    total = epochs * len(fit)
    step = 0
    e, w, b = model.embedding, model.weights, model.bias
    for _ in range(epochs):
        for i in rng.permutation(fit):
            now = rate * (1 - step / total)
            step += 1
            _, bucket, count = rows[i]
            share = count / count.sum()
            x = share @ e[bucket]
            z = x @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= now * np.outer(x, p)
            b -= now * p
            # Subwords share the step by their part of the text, scaled up as there are many of them.
            e[bucket] -= (now * 20 * np.minimum(share, 0.05))[:, None] * back
    table = model.tables()
    logits = np.stack([(rows[i][2] / rows[i][2].sum()) @ table[rows[i][1]] + b for i in check])
    best, grid = np.inf, np.geomspace(0.05, 5, 40)
    for t in grid:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[check]]).mean()
        if loss < best - 1e-6:
            best, model.temperature = loss, float(t)
    p = model.probabilities(logits)
    right = p.argmax(axis=1) == y[check]
    # The least score over which nearly all calibration rows are right.
    top = p.max(axis=1)
    for t in np.sort(top):
        if right[top >= t].mean() >= 0.99:
            model.reject_below = float(t)
            break
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in chunks(offsets):
            bucket, owner = subwords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
            edge = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
            key = (key % BUCKETS).astype(np.uint16)
            count = count.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([key[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()), pa.array([count[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())],
                names=["lang", "buckets", "counts"],
            )


def fit(docs: DataFrame, held_out: int = 1, folds: int = 3, most: int = TRAINED_ON) -> Model:
    """A model from text and lang of rows whose crc32(doc_id) mod ``folds`` is not ``held_out``.

    They are sampled by their id's hash to about ``most``; each row brings at
    most BUCKETS counts, so what the driver holds is bounded.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (_fold(parts=folds) != held_out))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    got = rows.select("lang", "text").mapInArrow(_features, "lang string, buckets binary, counts binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    return train([(r[0], np.frombuffer(r[1], np.uint16).astype(np.int64), np.frombuffer(r[2], np.float32)) for r in got])


def _predict(model: Model, reject: bool):
    table = model.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets):
                base = offsets[i]
                own, at = data[base : offsets[j]], offsets[i : j + 1] - base
                bucket, owner = subwords(own, at)
                n = j - i
                count = np.maximum(np.bincount(owner, minlength=n), 1)
                logits = np.stack([np.bincount(owner, table[bucket, c], n) for c in range(table.shape[1])], axis=1) / count[:, None] + model.bias
                p = model.probabilities(logits)
                best, score = p.argmax(axis=1), p.max(axis=1)
                sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[LOWER[own]])])
                lettered = sums[at[1:]] > sums[at[:-1]]
                wide = np.concatenate([[0], np.cumsum(own >= 128)])
                for k in np.nonzero(~lettered & (wide[at[1:]] > wide[at[:-1]]))[0]:
                    lettered[k] = any(c.isalpha() for c in own[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
                if not model.languages:
                    lettered[:] = False
                none = ~lettered | (reject & (score < model.reject_below))
                out = [NONE if x else model.languages[b] for x, b in zip(none, best)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(out, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, held_out: int = 1, folds: int = 3, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, from the whole text alone.

    ``und`` with score 0 for null texts and texts without a letter; with
    ``reject`` also where the score is under the model's calibrated bound.
    Languages of equal score go to the first in code-point order. Rows come out
    as they come in, repeated ones too (null ids with held_out null); an empty
    table gives no rows. A text of any length is read whole; it must fit in a
    task. Other columns, whatever their names, are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_predict(model, reject), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (_fold(parts=folds) == held_out).alias("held_out"), "lang_pred", "score")
