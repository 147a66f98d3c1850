"""Long recordings cut into chunks, block-wise resampling, detector scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import scores as Q
from ..functions.binding import let
from . import signal as G


def quartile(values: Column) -> Column:
    """The interpolated lower quartile of an array."""

    def at(v: Column) -> Column:
        place = (F.size(v) - 1) * 0.25
        low = F.floor(place).cast("int")
        a, b = F.element_at(v, low + 1), F.element_at(v, F.least(low + 2, F.size(v)))
        return a + (b - a) * (place - low)

    return let(F.array_sort(values), at)


def quiet_stretches(energies: Column, threshold: Column, hop: int, close_trailing: bool = True) -> Column:
    """(start, stop) in samples of maximal stretches of frames strictly under ``threshold``.

    One that reaches the last frame ends there; without ``close_trailing`` it
    is left out.
    """

    def of(e: Column) -> Column:
        n = F.size(e)

        def quiet(i: Column) -> Column:
            return F.element_at(e, i + 1) < threshold

        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: quiet(i) & F.when(i == 0, F.lit(True)).otherwise(~quiet(F.greatest(i - 1, F.lit(0)))))
        stops = F.filter(F.sequence(F.lit(1), n), lambda j: quiet(j - 1) & F.when(j == n, F.lit(True)).otherwise(~quiet(F.least(j, n - 1))))
        both = F.zip_with(starts, stops, lambda a, b: F.struct((a.cast("long") * hop).alias("start"), (b.cast("long") * hop).alias("stop")))
        return both if close_trailing else F.filter(both, lambda r: r["stop"] < n * hop)

    return let(energies, of)


def segment_long(
    recordings: DataFrame, sr: int, longest: float = 30.0, shortest: float = 2.0, max_silence: float = 4.0, fill: float = 0.5,
    threshold: float | None = None, shorten_short: bool = False, close_trailing: bool = False,
) -> DataFrame:
    """``recordings`` with ``samples``, exploded to chunk (int), start, stop (long) and the chunk's samples; other columns stay.

    Silences longer than ``max_silence`` seconds become ``fill`` seconds of
    zeros, then the rest is cut at the latest middle of a silence of a tenth of
    a second or more within [``shortest``, ``longest``] of the last cut, else at
    ``longest``; start and stop count in the shortened signal.

    Without ``threshold`` a frame is quiet under the lower quartile of the
    recording's energies (1e-6 at least), taken before silences are shortened.
    Recordings within ``longest`` stay as they are unless ``shorten_short``. In
    the second search for silences one that is open at the end counts only with
    ``close_trailing``. Null and empty recordings, and those under ``shortest``,
    give no rows. Everything happens within a row: nothing is shuffled.
    """
    frame, hop = int(0.025 * sr), int(0.010 * sr)
    most, least = int(longest * sr), int(shortest * sr)
    if frame < 1 or hop < 1:
        raise ValueError("the rate is too low for frames of 25 ms every 10 ms")
    keep = [c for c in recordings.columns if c != "samples"]
    s = F.col("samples")

    def level(e: Column) -> Column:
        return F.lit(float(threshold)) if threshold is not None else F.greatest(quartile(e), F.lit(1e-6))

    def shortened(x: Column) -> Column:
        """(samples, threshold, total) after long silences are shortened."""

        def with_level(e: Column) -> Column:
            def rebuilt(t: Column) -> Column:
                long = F.filter(quiet_stretches(e, t, hop), lambda r: (r["stop"] - r["start"]) / sr > max_silence)
                return let(G.without_long_silence(x, long, int(fill * sr)), lambda y: F.struct(y.alias("samples"), t.alias("level"), F.size(y).cast("long").alias("n")))

            return let(level(e), rebuilt)

        return let(Q.frame_energies(x, frame, hop), with_level)

    def cuts(x: Column, t: Column, total: Column) -> Column:
        silences = quiet_stretches(Q.frame_energies(x, frame, hop), t, hop, close_trailing)
        middles = F.transform(F.filter(silences, lambda r: (r["stop"] - r["start"]) / sr >= 0.1), lambda r: F.floor((r["start"] + r["stop"]) / 2))
        return let(middles, lambda m: let(G.split_starts(total, m, max(least, 1), most), lambda a: G.chunks(a, total, least, most)))

    n = F.size(s)
    as_is = F.struct(s.alias("samples"), F.lit(0.0).alias("level"), n.cast("long").alias("n"))
    first = shortened(s) if shorten_short else F.when(n > most, shortened(s)).otherwise(as_is)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("__r.n").alias("stop")))
    ready = recordings.where(F.coalesce(n, F.lit(0)) >= max(least, 1)).select(*keep, first.alias("__r")).where(F.col("__r.n") >= max(least, 1))
    parts = F.when(F.col("__r.n") <= most, whole).otherwise(cuts(F.col("__r.samples"), F.col("__r.level"), F.col("__r.n")))
    cut = F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.slice(F.col("__r.samples"), (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")).alias("samples")))
    return ready.select(*keep, F.posexplode(cut).alias("chunk", "__p")).select(*keep, "chunk", "__p.start", "__p.stop", "__p.samples")


def resampled_in_blocks(recordings: DataFrame, key: str, target: int, seconds: float = 60.0) -> DataFrame:
    """``recordings`` (key, samples, sr) at the ``target`` rate, in blocks of ``seconds`` dealt out as rows.

    Each block is resampled by itself, so there are edge effects where blocks
    meet; a recording at the target rate already stays as it is. Rows that
    share a key are recordings of their own; a row with a null rate stays, with
    null samples; other columns stay. A recording comes out as one row, as it
    went in; block rows (``blocks.resampled_blocks``) never are.
    """
    size = F.greatest((F.col("sr") * seconds).cast("int"), F.lit(1))
    rest = [c for c in recordings.columns if c != "samples"]
    numbered = recordings.where(F.col("sr") != target).withColumn("__row", F.monotonically_increasing_id())
    blocks = numbered.select("__row", *rest, F.posexplode_outer(F.when(F.size("samples") > 0, F.transform(F.sequence(F.lit(1), F.size("samples"), size), lambda a: F.slice("samples", a, size)))).alias("__b", "__x"))
    done = blocks.repartition("__row", "__b").select("__row", *rest, "__b", G.resampled(target)(F.coalesce("__x", F.array().cast("array<double>")), "sr").alias("__y"))
    whole = done.groupBy("__row").agg(F.first(F.struct(*rest)).alias("__o"), F.array_sort(F.collect_list(F.struct("__b", "__y"))).alias("__p"))
    rate = F.lit(target).cast(recordings.schema["sr"].dataType)
    back = whole.select(F.flatten(F.transform("__p", lambda r: r["__y"])).alias("samples"), *[(rate if c == "sr" else F.col("__o")[c]).alias(c) for c in rest])
    unknown = recordings.where(F.col("sr").isNull()).withColumn("samples", F.lit(None).cast(recordings.schema["samples"].dataType))
    return recordings.where(F.col("sr") == target).unionByName(back).unionByName(unknown)


def detector(score: Callable[[np.ndarray], np.ndarray], rate: int = 10000, window: int = 39124, failures=None):
    """A UDF (samples, sr) -> mean of ``score`` over whole windows at ``rate``.

    ``score`` takes windows as rows of an array and gives a number each. Null
    where there is no whole window, or where ``score`` raises an error; an
    accumulator given as ``failures`` counts the latter, so that a scorer which
    always fails doesn't go unseen.
    """

    @pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for samples, sr in batches:
            out = []
            for x, r in zip(samples, sr):
                x = G.resample(np.asarray([] if x is None else x, np.float64), int(r), rate)
                n = len(x) // window
                try:
                    out.append(float(np.mean(score(x[: n * window].reshape(n, window)))) if n else None)
                except Exception:  # noqa: BLE001 - a recording the model fails on has no score
                    out.append(None)
                    if failures is not None:
                        failures.add(1)
            yield pd.Series(out, dtype="float64")

    return run


def window_level(windows: np.ndarray) -> np.ndarray:
    """A stand-in for a trained detector: the RMS of each window."""
    return np.sqrt((windows**2).mean(axis=1))


def band_variation(band: Column, sr: Column, seconds: float = 0.5) -> Column:
    """Deviation over mean of the levels of whole, not overlapping frames; 0 for fewer than three."""
    size = (sr * seconds).cast("int")
    n = F.floor(F.size(band) / size).cast("int")

    def ratio(e: Column) -> Column:
        return let(Q.mean_of(e), lambda m: F.sqrt(Q.mean_of(F.transform(e, lambda v: (v - m) * (v - m)))) / F.greatest(m, F.lit(1e-10)))

    levels = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: Q.rms(F.slice(band, i * size + 1, size)))
    return F.when(n < 3, F.lit(0.0)).otherwise(let(levels, ratio))
