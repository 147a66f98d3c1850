"""Signal operators: segmentation on frames, and Arrow UDFs for filters and spectra.

Filters and spectra run per clip inside tasks (numpy only); clips are rows, so
Spark deals out the work. Long recordings are cut in ``segments``.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.binding import let

# Types as objects: no session is needed to import this module.
SAMPLES = ArrayType(DoubleType())


def _struct(**fields) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])

# ------------------------------------------------------------ frames, native


def frames(clips: DataFrame, frame: int, hop: int, key: str = "id", samples: str = "samples", inclusive: bool = False) -> DataFrame:
    """key, frame_no, energy (RMS). max(1, (n - frame) // hop) frames, or with ``inclusive`` as many as start before n - frame."""
    n = F.size(samples) - frame
    count = F.ceil(n / hop) if inclusive else F.greatest(F.lit(1), F.floor(n / hop))
    part = lambda i: F.slice(samples, i * hop + 1, F.lit(frame))
    energy = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: let(part(i), lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))))
    return clips.where(n > 0 if inclusive else F.size(samples) > 0).select(key, F.posexplode(energy).alias("frame_no", "energy"))


def runs(energy: DataFrame, active: Column, key: str = "id") -> DataFrame:
    """key, first, end (exclusive), open of maximal runs of frames for which ``active`` holds; open: reaches the last frame."""
    w = Window.partitionBy(key).orderBy("frame_no")
    flagged = energy.withColumn("__a", active).withColumn("__n", F.max("frame_no").over(Window.partitionBy(key)))
    marked = flagged.withColumn("__i", F.col("frame_no") - F.sum(F.col("__a").cast("int")).over(w))
    return marked.where("__a").groupBy(key, "__i").agg(F.min("frame_no").alias("first"), (F.max("frame_no") + 1).alias("end"), F.max("__n").alias("__n")).select(key, "first", "end", (F.col("end") > F.col("__n")).alias("open"))


def active_segments(clips: DataFrame, sr: int, longest: float = 5.0, shortest: float = 0.3, threshold: float = 0.005, key: str = "id") -> DataFrame:
    """key, start, stop in samples of loud stretches.

    Clips up to ``longest`` seconds come whole if they reach ``shortest``. In
    longer ones runs of frames over the threshold are kept, cut into pieces of
    ``longest``; a run open at the end counts only if it is within both limits.
    """
    frame, hop = int(0.025 * sr), int(0.010 * sr)
    sized = clips.withColumn("__n", F.size("samples"))
    short = sized.where((F.col("__n") <= longest * sr) & (F.col("__n") >= shortest * sr)).select(key, F.lit(0).cast("long").alias("start"), F.col("__n").cast("long").alias("stop"))
    long = sized.where(F.col("__n") > longest * sr)
    energy = frames(long, frame, hop, key, inclusive=True)
    r = runs(energy, F.col("energy") > threshold, key).join(long.select(key, "__n"), key)
    r = r.select(key, (F.col("first") * hop).alias("start"), F.when(F.col("open"), F.col("__n")).otherwise(F.col("end") * hop).alias("stop"), "open")
    length = F.col("stop") - F.col("start")
    most = int(longest * sr)
    fit = r.where((length >= shortest * sr) & (length <= longest * sr)).select(key, "start", "stop")
    cut = r.where((length > longest * sr) & ~F.col("open")).select(key, F.explode(F.sequence("start", F.col("stop") - 1, F.lit(most))).alias("start"), "stop")
    cut = cut.select(key, "start", F.least(F.col("start") + most, F.col("stop")).alias("stop")).where(F.col("stop") - F.col("start") >= shortest * sr)
    whole = short
    for part in (fit, cut):
        whole = whole.unionAll(part.select(key, F.col("start").cast("long"), F.col("stop").cast("long")))
    return whole


def silence_threshold(energy: DataFrame, key: str = "id") -> DataFrame:
    """key, threshold: the exact lower quartile of its energies, at least 1e-6."""
    return energy.groupBy(key).agg(F.greatest(F.percentile("energy", F.lit(0.25)), F.lit(1e-6)).alias("threshold"))


def silences(energy: DataFrame, thresholds: DataFrame, key: str = "id", close_trailing: bool = True) -> DataFrame:
    """Runs of frames strictly under their clip's threshold; an open last one only with ``close_trailing``."""
    r = runs(energy.join(thresholds, key), F.col("energy") < F.col("threshold"), key)
    return r if close_trailing else r.where(~F.col("open"))


def without_long_silence(samples: Column, regions: Column, fill: int) -> Column:
    """Samples with each region (start, stop), in order, replaced by ``fill`` zeros."""
    zeros = F.array_repeat(F.lit(0.0), fill)
    done = F.aggregate(
        regions, F.struct(F.array().cast("array<double>").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, r: F.struct(F.concat(a["out"], F.slice(samples, (a["at"] + 1).cast("int"), (r["start"] - a["at"]).cast("int")), zeros).alias("out"), r["stop"].cast("long").alias("at")),
    )
    return let(done, lambda d: F.concat(d["out"], F.slice(samples, (d["at"] + 1).cast("int"), F.greatest(F.size(samples) - d["at"], F.lit(0)).cast("int"))))


def split_starts(total: Column, candidates: Column, least: int, most: int) -> Column:
    """Starts of chunks: each next one at the latest candidate within [least, most] of the last, else at most.

    A recording of n chunks takes n steps; the fold runs over the possible
    steps, total // least + 1 of them.
    """
    steps = F.sequence(F.lit(1), F.floor(total / least).cast("int") + 1)

    def go(a: Column, _: Column) -> Column:
        at = F.element_at(a, -1)
        last = let(at, lambda s: F.coalesce(F.array_max(F.filter(candidates, lambda c: (c >= s + least) & (c <= s + most))), s + most))
        return F.when(total - at <= most, a).otherwise(F.concat(a, F.array(last)))

    return F.aggregate(steps, F.array(F.lit(0).cast("long")), go)


def chunks(starts: Column, total: Column, least: int, most: int) -> Column:
    """(start, stop) of chunks of at least ``least``."""
    pairs = F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.coalesce(F.try_element_at(starts, i + 2), total).alias("stop")))
    return F.filter(pairs, lambda p: p["stop"] - p["start"] >= least)


# ------------------------------------------------------------------- filters


def _poles(order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    return np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))


def butterworth_band(order: int, low: float, high: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a Butterworth band-pass; limits as shares of the Nyquist rate.

    The analog prototype's poles are shifted to the band and mapped by the
    bilinear transform; each conjugate pair makes a section with a zero at
    either end of the spectrum.
    """
    w1, w2 = 4 * np.tan(np.pi * low / 2), 4 * np.tan(np.pi * high / 2)
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    p = _poles(order) * width / 2
    root = np.sqrt(p * p - centre * centre)
    analog = np.concatenate([p + root, p - root])
    z = (4 + analog) / (4 - analog)
    upper = z[z.imag > 1e-12]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(c, np.conj(c)) for c in sorted(upper, key=lambda c: -abs(c))] + list(zip(real[::2], real[1::2]))
    sos = np.array([[1, 0, -1, 1, -(a + b).real, (a * b).real] for a, b in pairs])
    # Unit gain at the centre of the band.
    mid = 2 * np.arctan(centre / 4)
    e = np.exp(-1j * mid * np.arange(3))
    gain = np.prod([abs((s[:3] @ e) / (s[3:] @ e)) for s in sos])
    sos[0, :3] /= gain
    return sos


def sos_filter(sos: np.ndarray, x: np.ndarray, block: int = 256) -> np.ndarray:
    """Cascaded sections over one signal, from rest."""
    return sos_states(sos, x, None, block)[0]


def sos_states(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The filtered signal entered in ``state`` (two values a section, at rest if None), and the state it is left in.

    A block's output is its response from rest, a product with the section's
    impulse response, plus the response to the two state values it starts
    with; only the states are carried from block to block.
    """
    y = np.asarray(x, np.float64)
    many = y[None], None if state is None else np.asarray(state, np.float64).reshape(1, -1)
    out, leaves = sos_states_of(sos, *many, block)
    return out[0], leaves[0]


def sos_states_of(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``sos_states`` of signals of one length, the rows of ``x``, at once; ``state`` has a row for each."""
    y = np.asarray(x, np.float64)
    signals, n = y.shape
    enters = np.zeros((signals, len(sos), 2)) if state is None else np.asarray(state, np.float64).reshape(signals, len(sos), 2)
    if not n:
        return y.copy(), enters.copy()
    block = min(block, n)
    leaves = np.empty((signals, len(sos), 2))
    rows = -(-n // block)
    over = n - (rows - 1) * block  # samples in the last block
    y = np.pad(y, ((0, 0), (0, rows * block - n))).reshape(signals, rows, block)
    for k, section in enumerate(np.asarray(sos, np.float64)):
        powers, tail, rest = _responses(section.tobytes(), block)
        ends = y @ tail[-block:]
        now, states = enters[:, k].copy(), np.empty((signals, rows, 2))
        for i in range(rows):
            states[:, i] = now
            now = now @ powers[block].T + ends[:, i]
        leaves[:, k] = states[:, -1] @ powers[over].T + y[:, -1, :over] @ tail[-over:]
        y = y @ rest.T + states @ powers[:block, 0, :].T
        y[:, -1, over:] = 0.0
    return y.reshape(signals, -1)[:, :n], leaves


@lru_cache(maxsize=64)
def _responses(section: bytes, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one section over ``block`` samples: powers of the state's step, what each sample adds to the leaving state, the response from rest."""
    b0, b1, b2, _, a1, a2 = np.frombuffer(section)
    step = np.array([[-a1, 1.0], [-a2, 0.0]])
    enter = np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    powers = np.array(powers)
    impulse = np.concatenate([[b0], (powers[: block - 1] @ enter)[:, 0]])
    lag = np.arange(block)[:, None] - np.arange(block)
    rest = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    return powers, powers[block - 1 :: -1] @ enter, rest


def sos_step(sos: np.ndarray) -> np.ndarray:
    """The matrix that one sample of silence applies to the cascade's state."""
    units = np.eye(2 * len(sos))
    return np.stack([sos_states(sos, np.zeros(1), u, 1)[1].ravel() for u in units], axis=1)


def bandpass(low_hz: float = 80, high_hz: float = 20000, order: int = 5, limit: float = 0.95):
    """A UDF (samples, sr) -> samples; as it is where the limits leave no band."""

    @pandas_udf(SAMPLES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for samples, sr in batches:
            out = []
            for x, rate in zip(samples, sr):
                low, high = min(low_hz / (rate / 2), limit), min(high_hz / (rate / 2), limit)
                out.append(sos_filter(butterworth_band(order, low, high), x) if low < high else np.asarray(x, np.float64))
            yield pd.Series(out)

    return run


# ------------------------------------------------------------------- spectra


def stft_magnitude(x: np.ndarray, n_fft: int = 2048, hop: int | None = None) -> np.ndarray:
    """Magnitudes (bins, frames): Hann window, centred frames, zero padding."""
    hop = hop or n_fft // 4
    x = np.pad(np.asarray(x, np.float64), n_fft // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    view = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    return np.abs(np.fft.rfft(view * window, axis=1)).T


def spectral_measures(x: np.ndarray, sr: int) -> tuple[float, float, float]:
    """Mean flatness, centroid and bandwidth; 1, 0, 0 for clips under 64 samples."""
    n_fft = min(2048, len(x))
    if n_fft < 64:
        return 1.0, 0.0, 0.0
    power = stft_magnitude(x, n_fft) ** 2
    freq = np.fft.rfftfreq(n_fft, 1 / sr)
    floored = np.maximum(power**2, 1e-10)
    flat = np.exp(np.log(floored).mean(axis=0)) / floored.mean(axis=0)
    share = power / np.maximum(power.sum(axis=0), 1e-300)
    centre = freq @ share
    width = np.sqrt(((freq[:, None] - centre) ** 2 * share).sum(axis=0))
    return float(flat.mean()), float(centre.mean()), float(width.mean())


@pandas_udf(_struct(flatness=DoubleType(), centroid=DoubleType(), bandwidth=DoubleType()))
def spectral(samples: pd.Series, sr: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([spectral_measures(np.asarray(x), int(r)) for x, r in zip(samples, sr)], columns=["flatness", "centroid", "bandwidth"])


def band_ratio(low: float = 200, high: float = 4000, n_fft: int = 2048, hop: int = 512):
    """A UDF (samples, sr) -> share of spectral energy within the band."""

    @pandas_udf(DoubleType())
    def run(samples: pd.Series, sr: pd.Series) -> pd.Series:
        out = []
        for x, rate in zip(samples, sr):
            e = stft_magnitude(x, n_fft, hop) ** 2
            f = np.fft.rfftfreq(n_fft, 1 / rate)
            out.append(e[(f >= low) & (f <= high)].sum() / (e.sum() + 1e-10))
        return pd.Series(out)

    return run


@pandas_udf(DoubleType())
def spectral_convergence(original: pd.Series, copy: pd.Series) -> pd.Series:
    """Norm of the difference of magnitudes over the norm of the original's."""
    out = []
    for a, b in zip(original, copy):
        s, t = stft_magnitude(a), stft_magnitude(b)
        n = min(s.shape[1], t.shape[1])
        out.append(np.linalg.norm(s[:, :n] - t[:, :n]) / (np.linalg.norm(s[:, :n]) + 1e-10))
    return pd.Series(out)


@pandas_udf(DoubleType())
def log_spectral_distance(original: pd.Series, copy: pd.Series) -> pd.Series:
    """Root mean square difference of magnitudes in dB, 80 dB under the peak at least."""
    def db(s: np.ndarray) -> np.ndarray:
        d = 20 * np.log10(np.maximum(s + 1e-8, 1e-5))
        return np.maximum(d, d.max() - 80)

    out = []
    for a, b in zip(original, copy):
        s, t = stft_magnitude(a), stft_magnitude(b)
        n = min(s.shape[1], t.shape[1])
        out.append(float(np.sqrt(np.mean((db(s[:, :n]) - db(t[:, :n])) ** 2))))
    return pd.Series(out)


@lru_cache(maxsize=16)
def mel_filters(sr: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters on the mel scale (linear to 1 kHz, then logarithmic), each of unit area."""
    def to_mel(f):
        f = np.asarray(f, float)
        return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / (np.log(6.4) / 27))

    def to_hz(m):
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))

    edge = to_hz(np.linspace(0, to_mel(sr / 2), n_mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / sr)
    up = (f - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - f) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mfcc(x: np.ndarray, sr: int, n_mfcc: int = 13, n_mels: int = 80, n_fft: int = 2048) -> np.ndarray:
    """Cepstral coefficients (n_mfcc, frames): log mel power, orthonormal cosine transform."""
    mel = mel_filters(sr, n_fft, n_mels) @ stft_magnitude(x, n_fft) ** 2  # the filters are made once a worker
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    db = np.maximum(db, db.max() - 80)
    k, n = np.arange(n_mfcc)[:, None], np.arange(n_mels)
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * n_mels)) * np.sqrt(np.where(k == 0, 1, 2) / n_mels)
    return basis @ db


def mel_cepstral_distortion(sr: int, mean_of_norms: bool = True, n_mels: int = 80):
    """A UDF (original, copy): mean norm of the frames' differences, or the root of twice their mean square."""

    @pandas_udf(DoubleType())
    def run(original: pd.Series, copy: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(original, copy):
            s, t = mfcc(a, sr, n_mels=n_mels), mfcc(b, sr, n_mels=n_mels)
            n = min(s.shape[1], t.shape[1])
            d = (s[:, :n] - t[:, :n]) ** 2
            out.append(float(np.sqrt(d.sum(axis=0)).mean() if mean_of_norms else np.sqrt(2 * d.mean())))
        return pd.Series(out)

    return run


# ------------------------------------------------------- loudness and denoise


def _biquad_shelf(sr: float) -> np.ndarray:
    """The two sections of the K weighting (ITU-R BS.1770) at any rate."""
    f0, g, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k = np.tan(np.pi * f0 / sr)
    vh, vb = 10 ** (g / 20), (10 ** (g / 20)) ** 0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = [(vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0, 1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]
    f0, q = 38.13547087602444, 0.5003270373238773
    k = np.tan(np.pi * f0 / sr)
    a0 = 1 + k / q + k * k
    return np.array([shelf, [1, -2, 1, 1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]])


def loudness_sections(sr: float) -> np.ndarray:
    """The weighting that loudness is measured behind."""
    return _biquad_shelf(sr)


def integrated_loudness(x: np.ndarray, sr: int) -> float:
    """LUFS of a mono signal: 400 ms blocks, three quarters overlapping, gated at -70 and 10 below the mean."""
    y = sos_filter(_biquad_shelf(sr), x)
    size, step = int(0.4 * sr), int(0.1 * sr)
    if len(y) < size or step < 1:
        return -np.inf
    power = np.array([np.mean(y[i : i + size] ** 2) for i in range(0, len(y) - size + 1, step)])
    with np.errstate(divide="ignore"):
        level = -0.691 + 10 * np.log10(power)
    loud = level > -70
    if not loud.any():
        return -np.inf
    gate = -0.691 + 10 * np.log10(power[loud].mean()) - 10
    loud &= level > gate
    return float(-0.691 + 10 * np.log10(power[loud].mean())) if loud.any() else -np.inf


def loudness_normalized(target: float = -20.0):
    """A UDF (samples, sr) -> samples at the target loudness, half scale where there is none to measure, clipped."""

    @pandas_udf(SAMPLES)
    def run(samples: pd.Series, sr: pd.Series) -> pd.Series:
        out = []
        for x, rate in zip(samples, sr):
            x = np.asarray(x, np.float64)
            level = integrated_loudness(x, int(rate))
            if np.isfinite(level):
                x = x * 10 ** ((target - level) / 20)
            elif len(x) and np.abs(x).max() > 0:
                x = x * (0.5 / np.abs(x).max())
            out.append(np.clip(x, -1, 1))
        return pd.Series(out)

    return run


def spectral_gate(x: np.ndarray, strength: float, stationary: bool, n_fft: int = 1024, hop: int = 256) -> np.ndarray:
    """Bins near their noise level are turned down by ``strength``.

    Stationary: the level is a bin's mean plus 1.5 deviations over the clip;
    else twice a running mean over frames.
    """
    x = np.asarray(x, np.float64)
    if len(x) < n_fft:
        return x
    window = np.sqrt(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft))
    padded = np.pad(x, (n_fft, n_fft + (-len(x)) % hop))
    spec = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop] * window, axis=1)
    db = 20 * np.log10(np.abs(spec) + 1e-10)
    if stationary:
        level = db.mean(axis=0) + 1.5 * db.std(axis=0)
    else:
        span = min(len(db), 64)
        sums = np.cumsum(np.pad(np.abs(spec), ((span // 2 + 1, span - span // 2 - 1), (0, 0)), mode="edge"), axis=0)
        level = 20 * np.log10(2 * (sums[span:] - sums[:-span])[: len(db)] / span + 1e-10)[: len(db)]
        level = np.pad(level, ((0, len(db) - len(level)), (0, 0)), mode="edge")
    mask = (db > level).astype(float)
    kernel = np.outer([0.25, 0.5, 0.25], [0.25, 0.5, 0.25])
    wide = np.pad(mask, 1, mode="edge")
    smooth = sum(kernel[i, j] * wide[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3))
    frames_ = np.fft.irfft(spec * (1 - strength * (1 - smooth)), n_fft, axis=1) * window
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for i, f in enumerate(frames_):
        out[i * hop : i * hop + n_fft] += f
        weight[i * hop : i * hop + n_fft] += window**2
    return (out / np.maximum(weight, 1e-8))[n_fft : n_fft + len(x)]


def spectral_subtraction(x: np.ndarray, factor: float = 1.5, floor: float = 0.02, n_fft: int = 1024, hop: int = 256) -> np.ndarray:
    """``factor`` times the mean of the tenth quietest frames is taken off each magnitude, down to ``floor`` of it."""
    x = np.asarray(x, np.float64)
    if len(x) < n_fft:
        return x
    window = np.sqrt(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft))
    padded = np.pad(x, (n_fft, n_fft + (-len(x)) % hop))
    spec = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop] * window, axis=1)
    mag = np.abs(spec)
    quiet = np.argsort((mag**2).sum(axis=1), kind="stable")[: max(1, int(0.1 * len(mag)))]
    clean = np.maximum(mag - factor * mag[quiet].mean(axis=0), floor * mag)
    frames_ = np.fft.irfft(spec * (clean / np.maximum(mag, 1e-12)), n_fft, axis=1) * window
    out, weight = np.zeros(len(padded)), np.zeros(len(padded))
    for i, f in enumerate(frames_):
        out[i * hop : i * hop + n_fft] += f
        weight[i * hop : i * hop + n_fft] += window**2
    return (out / np.maximum(weight, 1e-8))[n_fft : n_fft + len(x)]


#: level -> (order, low, high, limit, gates (strength, stationary), subtraction)
DENOISE = {
    "demo": (4, 200, 22000, 0.99, ((0.85, True),), False),
    "medium": (5, 400, 20000, 0.99, ((0.90, True), (0.75, False)), False),
    "aggressive": (5, 400, 20000, 0.99, ((0.95, True), (0.85, False)), True),
}


def wiener(x: np.ndarray, size: int = 7) -> np.ndarray:
    """Local mean and variance filter; the noise power is the mean local variance."""
    if len(x) < size:
        return x
    k = np.ones(size) / size
    mean = np.convolve(x, k, "same")
    var = np.maximum(np.convolve(x * x, k, "same") - mean**2, 0)
    noise = var.mean()
    gain = np.maximum(var - noise, 0) / np.maximum(var, max(noise, 1e-12))
    return mean + gain * (x - mean)


def denoised(level: str = "medium"):
    """A UDF (samples, sr) -> samples: band-pass, gates, and for 'aggressive' Wiener filter and subtraction, then loudness."""
    order, low, high, limit, gates, subtract = DENOISE[level]

    @pandas_udf(SAMPLES)
    def run(samples: pd.Series, sr: pd.Series) -> pd.Series:
        out = []
        for x, rate in zip(samples, sr):
            y = np.asarray(x, np.float64)
            a, b = min(low / (rate / 2), limit), min(high / (rate / 2), limit)
            if a < b:
                y = sos_filter(butterworth_band(order, a, b), y)
            for strength, stationary in gates:
                y = spectral_gate(y, strength, stationary)
            if subtract:
                y = spectral_subtraction(wiener(y))
            loud = integrated_loudness(y, int(rate))
            if np.isfinite(loud):
                y = y * 10 ** ((-20.0 - loud) / 20)
            elif len(y) and np.abs(y).max() > 0:
                y = y * (0.5 / np.abs(y).max())
            out.append(np.clip(y, -1, 1))
        return pd.Series(out)

    return run


def gated(level: str = "medium"):
    """A UDF samples -> samples after the gates of a denoise level alone."""

    @pandas_udf(SAMPLES)
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for x in samples:
            y = np.asarray(x, np.float64)
            for strength, stationary in DENOISE[level][4]:
                y = spectral_gate(y, strength, stationary)
            out.append(y)
        return pd.Series(out)

    return run


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """One signal at another rate: windowed sinc, 32 zero crossings to a side."""
    x = np.asarray(x, np.float64)
    if rate == target or not len(x):
        return x
    n = int(np.ceil(len(x) * target / rate))
    cut = min(1.0, target / rate)
    half = int(np.ceil(32 / cut))
    at = np.arange(n) * (rate / target)
    base = np.floor(at).astype(int)
    y = np.zeros(n)
    for k in range(-half, half + 1):
        j = base + k
        d = at - j
        ok = (j >= 0) & (j < len(x)) & (np.abs(d) <= half)
        y[ok] += x[j[ok]] * cut * np.sinc(cut * d[ok]) * (0.5 + 0.5 * np.cos(np.pi * d[ok] / half))
    return y


def resampled(target: int):
    """A UDF (samples, sr) -> samples at the target rate."""

    @pandas_udf(SAMPLES)
    def run(samples: pd.Series, sr: pd.Series) -> pd.Series:
        return pd.Series([resample(x, int(rate), target) for x, rate in zip(samples, sr)])

    return run


# ----------------------------------------------------------- codec, detector


def encoder(encode, codebooks: int):
    """An iterator UDF samples -> codes for any callable ``encode(samples) -> (codebooks, steps)``, loaded once per worker."""

    @pandas_udf(ArrayType(ArrayType(IntegerType())))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for samples in batches:
            yield pd.Series([[list(map(int, row)) for row in encode(np.asarray(x))[:codebooks]] for x in samples])

    return run


def trimmed(codes: Column, n_samples: Column, hop: int) -> Column:
    """Codes of the real samples of a padded batch: n // hop steps, null for two or fewer."""
    steps = F.floor(n_samples / hop).cast("int")
    return F.when(steps > 2, F.transform(codes, lambda book: F.slice(book, F.lit(1), steps)))


def residual_quantiser(codebooks: int = 4, levels: int = 1024):
    """A stand-in for a neural codec: each codebook quantises what the ones before left, codes 1..levels."""

    def encode(x: np.ndarray) -> np.ndarray:
        rest, scale, out = np.clip(x, -1, 1).astype(np.float64), 1.0, []
        for _ in range(codebooks):
            q = np.clip(np.floor((rest / scale + 1) / 2 * levels), 0, levels - 1)
            out.append(q + 1)
            rest = rest - ((q + 0.5) / levels * 2 - 1) * scale
            scale /= levels
        return np.array(out, np.int64)

    return encode


@udtf(returnType=_struct(chunk=IntegerType(), start=IntegerType(), stop=IntegerType()))
class SegmentAtSilence:
    """Table function (samples, sr, least_s, most_s): chunks cut at the latest silence within limits."""

    def eval(self, samples, sr: int, least_s: float, most_s: float):
        x = np.asarray(samples, np.float64)
        n, least, most = len(x), int(least_s * sr), int(most_s * sr)
        hop = max(1, int(0.01 * sr))
        frame = max(1, int(0.025 * sr))
        count = max(1, (n - frame) // hop)
        e = np.array([np.sqrt(np.mean(x[i * hop : i * hop + frame] ** 2)) if len(x[i * hop : i * hop + frame]) else 0.0 for i in range(count)])
        quiet = e < max(np.percentile(e, 25), 1e-6)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], quiet.astype(int), [0]])))
        middle = [(a + b) * hop // 2 for a, b in zip(edge[::2], edge[1::2]) if (b - a) * hop >= 0.1 * sr]
        at = k = 0
        while at < n:
            if n - at <= most:
                stop = n
            else:
                fit = [c for c in middle if at + least <= c <= at + most]
                stop = max(fit) if fit else at + most
            if stop - at >= least:
                yield int(k), int(at), int(stop)
                k += 1
            at = stop


@pandas_udf(_struct(sr=IntegerType(), samples=SAMPLES))
def decode_wav(content: pd.Series) -> pd.DataFrame:
    """PCM WAV bytes to mono samples in -1..1; what is no WAV gives null samples."""
    out = []
    for raw in content:
        try:
            with wave.open(io.BytesIO(bytes(raw))) as w:
                width, channels, sr = w.getsampwidth(), w.getnchannels(), w.getframerate()
                data = w.readframes(w.getnframes())
            if width == 3:
                b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
            else:
                x = np.frombuffer(data, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]) / {1: 128.0, 2: 2.0**15, 4: 2.0**31}[width] - (1.0 if width == 1 else 0.0)
            out.append((sr, x.reshape(-1, channels).mean(axis=1)))
        except (wave.Error, EOFError, KeyError, TypeError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["sr", "samples"])


@pandas_udf(BinaryType())
def encode_wav(samples: pd.Series, sr: pd.Series) -> pd.Series:
    """16-bit mono WAV bytes."""
    out = []
    for x, rate in zip(samples, sr):
        buf = io.BytesIO()
        with wave.open(buf, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(int(rate))
            w.writeframes((np.clip(np.asarray(x), -1, 1) * 32767).astype("<i2").tobytes())
        out.append(buf.getvalue())
    return pd.Series(out)
