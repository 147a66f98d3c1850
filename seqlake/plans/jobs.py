"""Jobs that begin with a folder of audio files and end with files, restart-safe and bounded per run.

A run fixes the names that it works on in a plan, writes each output under the
run's name in that output's ledger, and the names into the done ledger last.
A run that broke off is finished by the next call with the same names; outputs
that it had written whole are not written again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.binding import settled
from ..operators import grading, segments, signal
from ..sources import readers, sinks
from ..sources.once import ledger, read_once, write_once
from . import pipelines as P

#: (recordings of the run, its name) -> None: writes one output.
Output = Callable[[DataFrame, str], None]


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """path, source (the folder right below ``folder``, else the empty string), stem, sr, samples of the WAV files below it; unreadable ones have null samples."""
    a = readers.wav_clips(spark, folder)
    root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", folder.rstrip("/")) + "/"
    inner = F.substr(F.col("path"), F.locate(root, "path") + len(root))
    source = F.when(F.contains(inner, F.lit("/")), F.substring_index(inner, "/", 1)).otherwise("")
    return a.select("path", source.alias("source"), F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "sr", "samples")


def run_folder(spark: SparkSession, folder: str, out: str, outputs: dict[str, Output], most: int | None = None) -> int:
    """One run over the next ``most`` files below ``folder`` that no run has done, in the order of their paths; the number of files.

    Only names are listed for the plan; contents are read by the outputs.
    """
    done = ledger(spark, f"{out}/done").count()
    run = f"run-{done:06d}"
    if ledger(spark, f"{out}/plan").where(F.col("batch") == run).isEmpty():
        names = readers.audio_files(spark, folder, "*.wav").select("path").join(read_once(spark, f"{out}/done", "path string"), "path", "left_anti").orderBy("path")
        names = names if most is None else names.limit(most)
        if names.isEmpty():
            return 0
        write_once(names, f"{out}/plan", run)
    planned = ledger(spark, f"{out}/plan").where(F.col("batch") == run).first()["files"]
    names = spark.read.schema("path string").json([f"{out}/plan/{f}" for f in planned])
    todo = recordings(spark, folder).join(F.broadcast(names) if most is not None and most <= 10_000 else names, "path", "left_semi")
    for write in outputs.values():
        write(todo, run)
    write_once(names, f"{out}/done", run)
    return names.count()


def grades_output(out: str, sr: int, **limits) -> Output:
    """Graded segments of each recording, brought to ``sr``, as CSV."""

    def write(todo: DataFrame, run: str) -> None:
        level = segments.resampled_in_blocks(todo.where("samples is not null"), "path", sr)
        write_once(P.source_grades(level, "path", sr, **limits), f"{out}/grades", run, "csv")

    return write


def tokens_output(out: str, encode, codebooks: int, seconds: float, band: tuple[float, float] = (80, 20000)) -> Output:
    """One token array a recording, ``tokens/<source>/<stem>.npy``: cut, band-passed, peak at 0.9, encoded, interleaved."""

    def write(todo: DataFrame, run: str) -> None:
        clips = P.prepared(todo.where("samples is not null"), seconds, *band)
        coded = settled(clips, "codes", signal.encoder(encode, codebooks)("samples")).withColumn("tokens", A.to_sequence(F.col("codes"))).where(F.size("tokens") > 2)
        sinks.write_tokens(coded.withColumn("name", F.concat_ws("/", F.when(F.col("source") != "", F.col("source")), "stem")), f"{out}/tokens", run)

    return write


def denoised_output(out: str, folder: str, target: int, least_sr: int = 0, level: str = "medium") -> Output:
    """Every recording at a sufficient rate, resampled and denoised, as WAV under the path it had below ``folder``."""

    def write(todo: DataFrame, run: str) -> None:
        inner = todo.where("samples is not null").withColumn("path", F.concat(F.lit("/in/"), F.concat_ws("/", F.when(F.col("source") != "", F.col("source")), F.concat("stem", F.lit(".wav")))))
        sinks.write_audio(P.denoised_tree(inner.select("path", "sr", "samples"), "/in/", "", target, least_sr, level), f"{out}/denoised", run)

    return write


def hydrophone_output(out: str, encode, codebooks: int, target: int, score=segments.window_level, score_rate: int = 10000, score_window: int = 39124, least_score: float = 0.1, heard: dict | None = None, chosen: dict | None = None) -> Output:
    """Chunks that vary enough and that the detector lets pass, as codes by chunk, with a CSV row of scores each.

    The detector sees only chunks that passed the cheap measures; a chunk too
    short for a whole window has no score and passes.
    """

    def write(todo: DataFrame, run: str) -> None:
        whole = todo.where("samples is not null").select("path", "stem", "sr", "samples")
        found = P.hydrophone_chunks(P.heard(whole.drop("stem"), "path", target, **(heard or {})), "path", **(chosen or {}))
        stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
        rated = settled(found, "detector_score", segments.detector(score, score_rate, score_window)("samples", "sr")).where(grading.detector_pass(F.col("detector_score"), least_score))
        rated = rated.withColumn("name", F.format_string("%s_%05d", stem, "chunk"))
        coded = settled(rated, "codes", signal.encoder(encode, codebooks)("samples"))
        sinks.write_tokens(coded, f"{out}/chunks", run, tokens="codes")
        write_once(rated.select(F.concat("name", F.lit(".npy")).alias("npy_file"), "path", "chunk", "whale_cv", "energy_ratio", "whale_rms", "detector_score"), f"{out}/scores", run, "csv")

    return write
