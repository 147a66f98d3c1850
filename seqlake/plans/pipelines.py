"""Whole jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scores as Q
from ..functions.binding import settled
from ..operators import catalog, grading, segments, signal
from ..sources import sinks


def graded(clips: DataFrame, sr: int = 8000) -> DataFrame:
    """Metrics, score and grade of each clip (source, file, segment_idx, samples)."""
    s = F.col("samples")
    m = clips.select("source", "file", "segment_idx", (F.size(s) / sr).alias("duration_s"), signal.spectral(s, F.lit(sr)).alias("m"), Q.rms(s).alias("rms_energy"), (Q.peak(s) / (Q.rms(s) + 1e-10)).alias("peak_to_rms"), Q.variance(Q.frame_energies(s, max(2, int(0.025 * sr)), max(1, int(0.010 * sr)))).alias("energy_variance"))
    score = Q.quality_score(F.col("m.flatness"), F.col("energy_variance"), F.col("peak_to_rms"), F.col("rms_energy"))
    return m.select("source", "file", "segment_idx", "duration_s", F.col("m.flatness").alias("spectral_flatness"), F.col("m.centroid").alias("spectral_centroid"), F.col("m.bandwidth").alias("spectral_bandwidth"), "rms_energy", "peak_to_rms", "energy_variance", score.alias("quality_score"), Q.grade(score).alias("grade"))


def prepared(clips: DataFrame, seconds: float, low: float = 80, high: float = 20000) -> DataFrame:
    """``clips`` (samples, sr) cut to ``seconds``, band-passed, with the peak at 0.9."""
    cut = clips.withColumn("samples", F.slice("samples", F.lit(1), F.greatest((F.col("sr") * seconds).cast("int"), F.lit(1))))
    return cut.withColumn("samples", signal.bandpass(low, high)("samples", "sr")).withColumn("samples", Q.peak_normalised(F.col("samples")))


def tokenised(clips: DataFrame, encode, codebooks: int, allowed: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """source, name, tokens: clips that ``allowed`` names, encoded and interleaved.

    The semi join comes first, so what is filtered out is never encoded.
    """
    kept = clips.join(allowed, keys, "left_semi") if allowed is not None else clips
    coded = settled(kept, "codes", signal.encoder(encode, codebooks)("samples"))
    tokens = coded.select("*", A.to_sequence(F.col("codes")).alias("tokens")).where(F.size("tokens") > 2)
    return sinks.with_running_names(tokens, "source", ["file", "segment_idx"]).select("source", "name", "tokens")


def hydrophone(files: DataFrame, hours: DataFrame, done: DataFrame, most: int | None = None) -> DataFrame:
    """Files left to process: of detection hours, not in the ledger, sorted, limited."""
    left = catalog.remaining(catalog.in_hours(files, hours), done).orderBy("name")
    return left if most is None else left.limit(most)


def gated(chunks: DataFrame, encode, codebooks: int, least_cv: float = 0.8, least_ratio: float = 0.0) -> DataFrame:
    """Chunks by cheap measures first, then by detector score; only what passes is encoded."""
    ok = chunks.where(grading.heuristic_pass(F.col("whale_cv"), F.col("energy_ratio"), least_cv=least_cv, least_ratio=least_ratio)).where(grading.detector_pass(F.col("detector_score")))
    return ok.withColumn("codes", signal.encoder(encode, codebooks)("samples"))


def source_grades(recordings: DataFrame, key: str, sr: int, **limits) -> DataFrame:
    """Loud stretches of whole recordings (source, ``key``, samples), measured, scored and graded."""
    found = signal.active_segments(recordings, sr, key=key, **limits)
    idx = F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1
    cut = recordings.join(found.withColumn("segment_idx", idx), key)
    part = F.slice("samples", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return graded(cut.select("source", F.col(key).alias("file"), "segment_idx", part.alias("samples")), sr)


def heard(recordings: DataFrame, key: str, target: int, skip_seconds: float = 0.0, band: tuple[float, float] = (80, 20000), **limits) -> DataFrame:
    """Chunks of recordings (``key``, samples, sr) with their peaks at 0.9.

    In this order: a test tone off the front of what is longer, the target
    rate, block by block, the band, the cut at silences.
    """
    s, skip = F.col("samples"), (F.col("sr") * skip_seconds).cast("int")
    lead = recordings.withColumn("samples", F.when(F.size(s) > skip, F.slice(s, skip + 1, F.size(s))).otherwise(s)) if skip_seconds else recordings
    level = segments.resampled_in_blocks(lead, key, target)
    chunks = segments.segment_long(level.withColumn("samples", signal.bandpass(*band)("samples", "sr")), target, **limits)
    return settled(chunks, "samples", Q.peak_normalised(s))


def hydrophone_chunks(chunks: DataFrame, key: str, band: tuple[float, float] = (200, 4000), n_fft: int = 2048, hop: int = 512, least_cv: float = 0.8, least_ratio: float = 0.0, least_rms: float = 0.0, frame_seconds: float = 0.5) -> DataFrame:
    """``key``, chunk, start, stop, whale_cv, energy_ratio, whale_rms, sr, samples of chunks that vary enough, at -20 LUFS.

    The variation is judged first; spectra and loudness are computed for what
    is left. A limit of 0 for ratio and level is no limit.
    """
    heard_band = settled(chunks, "__band", signal.bandpass(*band, limit=1.0)("samples", "sr"))
    varied = heard_band.select(key, "chunk", "start", "stop", "sr", "samples", segments.band_variation(F.col("__band"), F.col("sr"), frame_seconds).alias("whale_cv"), Q.rms(F.col("__band")).alias("whale_rms")).where(F.col("whale_cv") >= least_cv)
    rated = settled(varied, "energy_ratio", signal.band_ratio(*band, n_fft, hop)("samples", "sr"))
    ok = rated.where(grading.heuristic_pass(F.col("whale_cv"), F.col("energy_ratio"), F.col("whale_rms"), least_cv, least_ratio, least_rms))
    return ok.withColumn("samples", signal.loudness_normalized()("samples", "sr"))


def gated_chunks(chunks: DataFrame, least: float = 0.2) -> DataFrame:
    """Chunks after two gates with ``retention``; those that keep under ``least`` of their level go, the rest come to -20 LUFS."""
    after = settled(chunks, "__y", signal.gated("medium")("samples"))
    share = grading.retention(F.greatest(Q.rms(F.col("samples")), F.lit(1e-10)), Q.rms(F.col("__y")))
    left = after.withColumn("retention", share).where(F.col("retention") >= least)
    return left.withColumn("samples", signal.loudness_normalized()("__y", "sr")).drop("__y")


def chunk_tokens(chunks: DataFrame, encode, codebooks: int) -> DataFrame:
    """``chunks`` with codes and interleaved tokens in place of samples; sequences of two tokens or fewer go."""
    coded = settled(chunks, "codes", signal.encoder(encode, codebooks)("samples"))
    return coded.withColumn("tokens", A.to_sequence(F.col("codes"))).where(F.size("tokens") > 2).drop("samples")


def denoised_tree(files: DataFrame, source_root: str, target_root: str, target: int, least_sr: int = 0, level: str = "medium") -> DataFrame:
    """target path, sr, samples of recordings (path, sr, samples) at a sufficient rate: resampled in blocks, denoised, sub-paths kept."""
    level_rate = segments.resampled_in_blocks(files.where(F.col("sr") >= least_sr), "path", target)
    to = F.concat(F.lit(target_root), F.substring("path", len(source_root) + 1, 4096))
    return level_rate.select(to.alias("path"), "sr", signal.denoised(level)("samples", "sr").alias("samples"))
