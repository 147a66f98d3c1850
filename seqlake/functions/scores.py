"""Scores, grades and schedules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Weights, scales and cut-offs of the published quality score.
GRADES = ((0.8, "A"), (0.6, "B"), (0.4, "C"), (0.2, "D"))
GRADE_RANK = {"A": 5, "B": 4, "C": 3, "D": 2, "F": 1}


def quality_score(flatness: Column, variance: Column, crest: Column, rms: Column) -> Column:
    """0 to 1 from tonality, dynamics, crest factor and loudness."""
    one, zero = F.lit(1.0), F.lit(0.0)
    tonal = one - F.least(flatness, one)
    dynamic = F.least(variance / 0.005, one)
    peaked = F.greatest(F.least((crest - 1) / 10, one), zero)
    loud = F.least(rms / 0.01, one)
    return F.greatest(zero, F.least(one, 0.35 * tonal + 0.25 * dynamic + 0.20 * peaked + 0.20 * loud))


def grade(score: Column) -> Column:
    out = None
    for cut, letter in GRADES:
        out = F.when(score >= cut, letter) if out is None else out.when(score >= cut, letter)
    return out.otherwise("F")


def grade_rank(letter: Column) -> Column:
    """5 for A to 1 for F, 0 for anything else."""
    names = F.create_map(*[F.lit(x) for kv in GRADE_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(names, letter), F.lit(0))


def learning_rate(step: Column, base: float, warmup: int, total: int, least_ratio: float) -> Column:
    """Linear warm-up, then a cosine down to ``least_ratio`` of ``base``."""
    done = F.least((step - warmup) / max(total - warmup, 1), F.lit(1.0))
    cosine = 0.5 * (1 + F.cos(F.pi() * done))
    return F.when(step < warmup, base * step / max(warmup, 1)).otherwise(base * (least_ratio + (1 - least_ratio) * cosine))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def rms(samples: Column) -> Column:
    return F.sqrt(mean_of(F.transform(samples, lambda x: x * x)))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x)))


def frame_energies(samples: Column, frame: int, hop: int) -> Column:
    """RMS of each frame; max(1, (n - frame) // hop) frames."""
    n = F.greatest(F.lit(1), F.floor((F.size(samples) - frame) / hop).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: rms(F.slice(samples, i * hop + 1, frame)))


def variance(values: Column) -> Column:
    """Population variance of an array."""
    return F.aggregate(
        values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["n"] + 1).alias("n")),
        lambda a: F.greatest(a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]), F.lit(0.0)),
    )


def peak_normalised(samples: Column, to: float = 0.9) -> Column:
    """Scaled so that the peak is ``to``, clipped to -1..1; silence stays."""
    def scaled(p: Column) -> Column:
        return F.when(p > 0, F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * to / p)))).otherwise(samples)

    return let(peak(samples), scaled)


def snr_db(original: Column, copy: Column) -> Column:
    """Signal to noise in dB over the common length, 100 where the noise is nothing."""
    noise = mean_of(F.zip_with(*_common(original, copy), lambda a, b: (a - b) * (a - b)))
    signal = mean_of(F.transform(_common(original, copy)[0], lambda a: a * a))
    return F.when(noise < 1e-10, 100.0).otherwise(10 * F.log10(signal / noise))


def mse(original: Column, copy: Column) -> Column:
    return mean_of(F.zip_with(*_common(original, copy), lambda a, b: (a - b) * (a - b)))


def correlation(original: Column, copy: Column) -> Column:
    """Zero-lag correlation of the centred signals, 0 where either is flat."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def centred(values: Column, use) -> Column:
        return let(values, lambda v: let(mean_of(v), lambda m: let(F.transform(v, lambda x: x - m), use)))

    def ratio(a: Column, b: Column) -> Column:
        return let(F.sqrt(dot(a, a) * dot(b, b)), lambda scale: F.when(scale < 1e-10, 0.0).otherwise(dot(a, b) / scale))

    a, b = _common(original, copy)
    return centred(a, lambda x: centred(b, lambda y: ratio(x, y)))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def band_cutoffs(sr: Column, low: float, high: float, limit: float = 0.95) -> tuple[Column, Column]:
    """Cut-offs as shares of the Nyquist rate, kept under ``limit``."""
    nyquist = sr / 2
    return F.least(F.lit(low) / nyquist, F.lit(limit)), F.least(F.lit(high) / nyquist, F.lit(limit))
