"""A residual vector quantiser with codebooks fitted by distributed k-means, as an encoder and decoder pair.

It takes the place of a neural codec: frames of ``hop`` samples are vectors,
each codebook codes what the ones before have left, and any number of leading
codebooks decodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def frames_of(x, hop: int) -> np.ndarray:
    """The signal as rows of ``hop`` samples, the last padded with zeros."""
    x = np.asarray([] if x is None else x, np.float64)
    return np.pad(x, (0, -len(x) % hop)).reshape(-1, hop)


def nearest(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each vector, ties to the first; by blocks, so a long signal needs no large matrix."""
    out = np.empty(len(vectors), np.int64)
    square = (book * book).sum(axis=1)
    for i in range(0, len(vectors), 4096):
        out[i : i + 4096] = np.argmin(square - 2 * vectors[i : i + 4096] @ book.T, axis=1)
    return out


@dataclass
class Codec:
    """Codebooks (books, levels, hop)."""

    books: np.ndarray

    @property
    def hop(self) -> int:
        return self.books.shape[2]

    def encode(self, x) -> np.ndarray:
        """Codes 1..levels as (books, steps)."""
        rest, out = frames_of(x, self.hop), []
        for book in self.books:
            code = nearest(rest, book)
            out.append(code + 1)
            rest = rest - book[code]
        return np.array(out).reshape(len(self.books), -1)

    def decode(self, codes, n: int | None = None) -> np.ndarray:
        """The signal of codes (1..levels) of the first books; 0 adds nothing. ``n``: its length."""
        codes = [np.asarray(c, np.int64) for c in codes]
        y = np.zeros((len(codes[0]) if codes else 0, self.hop))
        for book, code in zip(self.books, codes):
            y += np.where(code[:, None] > 0, book[np.clip(code - 1, 0, len(book) - 1)], 0.0)
        return y.reshape(-1)[:n]

    def encoder(self):
        """A UDF samples -> codes; null and empty signals have none."""

        @pandas_udf(ArrayType(ArrayType(IntegerType())))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for samples in batches:
                yield pd.Series([None if x is None or not len(x) else [list(map(int, c)) for c in self.encode(x)] for x in samples])

        return run

    def decoder(self, books: int | None = None):
        """A UDF (codes, n samples) -> samples by the first ``books`` codebooks."""

        @pandas_udf(ArrayType(DoubleType()))
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for codes, n in batches:
                yield pd.Series([None if c is None else self.decode(list(c)[:books], int(k)) for c, k in zip(codes, n)])

        return run


def _frames(clips: pd.Series, hop: int) -> Iterator[np.ndarray]:
    """The frames of 512 clips at a time."""
    for i in range(0, len(clips), 512):
        yield np.concatenate([frames_of(x, hop) for x in clips.iloc[i : i + 512]])


def _gathered(books: list[np.ndarray], hop: int, centres: np.ndarray):
    """Sums and numbers of what the books so far leave, by nearest of the centres, once for each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for rest in _frames(batch["samples"], hop):
                for book in books:
                    rest = rest - book[nearest(rest, book)]
                code = nearest(rest, centres)
                np.add.at(sums, code, rest)
                n += np.bincount(code, minlength=len(centres))
            some = np.nonzero(n)[0]
            yield pd.DataFrame({"centre": some, "n": n[some], "total": list(sums[some])})

    return run


def _sampled(books: list[np.ndarray], hop: int):
    """Each frame and what the books leave of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame in _frames(batch["samples"], hop):
                rest = frame
                for book in books:
                    rest = rest - book[nearest(rest, book)]
                if len(rest):
                    yield pd.DataFrame({"frame": list(frame), "rest": list(rest)})

    return run


def fit(clips: DataFrame, hop: int, books: int = 4, levels: int = 64, rounds: int = 6) -> Codec:
    """Codebooks fitted to the frames of all ``clips`` (samples), one after the other, each by ``rounds`` of k-means.

    A round is one pass: every batch sums the residuals of its frames by
    nearest centre, the sums meet by centre, and the driver takes levels * hop
    numbers, whatever the clips' size. The first centres are the residuals of the
    frames that come first by hash, so the same clips give the same codebooks wherever they
    lie, up to the rounding of sums in another order. A centre that loses all
    frames stays as it is; with fewer distinct frames than levels some centres
    are equal. Null and empty clips have no frames; without any, all centres
    are zeros.
    """
    x = clips.select("samples").where(F.size("samples") > 0)
    done: list[np.ndarray] = []
    for k in range(books):
        frames = x.mapInPandas(_sampled(done, hop), "frame array<double>, rest array<double>").dropDuplicates(["frame"])
        first = frames.select("rest", F.xxhash64("frame", F.lit(k)).alias("h")).orderBy("h").limit(levels).collect()
        centres = np.zeros((levels, hop))
        for i, r in enumerate(first):
            centres[i] = r["rest"]
        for _ in range(rounds):
            parts = x.mapInPandas(_gathered(done, hop, centres), "centre int, n long, total array<double>")
            sums = parts.select("centre", "n", F.posexplode("total").alias("d", "v")).groupBy("centre", "d").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
            for r in sums:
                centres[r["centre"], r["d"]] = r["v"] / r["n"]
        done.append(centres.copy())
    return Codec(np.array(done))


def round_trips(clips: DataFrame, codec: Codec, counts: list[int]) -> DataFrame:
    """``clips`` (samples, other columns) with books and copy: each clip decoded from its first 1, 2, ... codebooks.

    A grid of ``counts``; counts beyond the codec's books are left out, so
    codecs with different numbers of books make a ragged grid. Encoded once.
    """
    keep = [c for c in clips.columns if c != "samples"]
    coded = clips.where(F.size("samples") > 0).select(*keep, "samples", F.explode(F.array(codec.encoder()("samples"))).alias("codes"))
    out: DataFrame | None = None
    for n in [c for c in counts if c <= len(codec.books)]:
        one = coded.select(*keep, "samples", F.lit(n).alias("books"), codec.decoder(n)("codes", F.size("samples")).alias("copy"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the codec has fewer codebooks than any of the counts")
    return out


def batched_codes(clips: DataFrame, codec: Codec, samples: str = "samples") -> DataFrame:
    """``clips`` with codes of their real samples: n // hop steps, null for two or fewer, as of a padded batch."""
    from .signal import trimmed

    n: Column = F.coalesce(F.size(samples), F.lit(0))
    return clips.withColumn("codes", trimmed(codec.encoder()(samples), n, codec.hop))
