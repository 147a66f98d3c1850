"""Tables behind plots: spectra, mel spectrograms in decibels, two signals side by side, bars of call types."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from . import signal as G


def _power(n_fft: int, hop: int):
    @pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([[list(f) for f in (G.stft_magnitude(np.asarray(x), n_fft, hop) ** 2).T] for x in samples])

    return run


def spectrum_rows(clips: DataFrame, key: str, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """key, frame, bin, power of clips (``key``, samples); null and empty clips give no rows."""
    frames = clips.where(F.size("samples") > 0).select(key, F.posexplode(_power(n_fft, hop)("samples")).alias("frame", "p"))
    return frames.select(key, "frame", F.posexplode("p").alias("bin", "power"))


def mel_table(spark: SparkSession, sr: int, n_fft: int, n_mels: int) -> DataFrame:
    """bin, mel, weight: the filter bank without its zeros, but for one entry of a filter that has no bin. At most 2 * bins + n_mels rows."""
    bank = G.mel_filters(sr, n_fft, n_mels)
    mel, bin_ = np.nonzero(bank)
    rows = [(int(b), int(m), float(bank[m, b])) for m, b in zip(mel, bin_)] + [(0, int(m), 0.0) for m in np.nonzero(~bank.any(axis=1))[0]]
    return spark.createDataFrame(rows, "bin int, mel int, weight double")


def mel_rows(clips: DataFrame, key: str, sr: int, n_mels: int = 128, n_fft: int = 2048, hop: int = 512, floor_db: float = 80.0) -> DataFrame:
    """key, frame, mel, db: power through a mel filter bank, in dB against the clip's greatest, ``floor_db`` under it at least.

    The bank is a sparse table that meets the spectrum by bin, a broadcast side
    of bounded size; sums per frame and mel are pre-aggregated. A clip's peak
    is one number a clip.
    """
    bank = mel_table(clips.sparkSession, sr, n_fft, n_mels)
    mel = spectrum_rows(clips, key, n_fft, hop).join(F.broadcast(bank), "bin").groupBy(key, "frame", "mel").agg(F.sum(F.col("power") * F.col("weight")).alias("p"))
    peak = mel.groupBy(key).agg(F.max("p").alias("peak"))
    db = lambda p: F.log10(F.greatest(p, F.lit(1e-10))) * 10
    return mel.join(peak, key).select(key, "frame", "mel", F.greatest(db(F.col("p")) - db(F.col("peak")), F.lit(-floor_db)).alias("db"))


def comparison_rows(pairs: DataFrame, key: str, sr: float) -> DataFrame:
    """key, i, t, original, copy of two signals (``key``, original, copy) side by side; the shorter ends with nulls."""
    n = F.greatest(F.coalesce(F.size("original"), F.lit(0)), F.coalesce(F.size("copy"), F.lit(0)))
    points = pairs.where(n > 0).select(key, "original", "copy", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return points.select(key, "i", (F.col("i") / sr).alias("t"), F.get("original", F.col("i")).alias("original"), F.get("copy", F.col("i")).alias("copy"))


def distribution_bars(real: DataFrame, made: DataFrame | None = None, label: str = "coda", n: str = "n") -> DataFrame:
    """place, label, real, made: shares of the types of ``real`` in the order of their names, and of the same types in ``made``, 0 where it has none.

    The counts (label, n) are few, a row for each type.
    """
    from pyspark.sql import Window

    def shares(counts: DataFrame, name: str) -> DataFrame:
        return counts.join(F.broadcast(counts.agg(F.sum(n).alias("__all")))).select(F.col(label), (F.col(n) / F.col("__all")).alias(name))

    out = shares(real, "real").withColumn("place", F.row_number().over(Window.orderBy(label)))
    out = out.join(shares(made, "made"), label, "left") if made is not None else out.withColumn("made", F.lit(None).cast("double"))
    return out.select("place", label, "real", F.coalesce("made", F.lit(0.0)).alias("made") if made is not None else "made")
