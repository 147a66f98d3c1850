"""Scans: annotation and detection CSVs, logs, token arrays, audio files, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CODAS = "Date string, Unit string, UnitNum int, codaNUM2018 int, CodaType string, Duration double, TsTo double"
DIALOGUE = "REC string, TsTo string, Whale int, nClicks int, Duration double, CodaType string"
GRADES = "source string, species string, file string, segment_idx int, duration_s double, spectral_flatness double, spectral_centroid double, spectral_bandwidth double, rms_energy double, peak_to_rms double, energy_variance double, quality_score double, grade string"
CHUNKS = "npy_file string, flac_name string, chunk_idx_in_flac int, whale_cv double, energy_ratio double, whale_rms double, detector_score double, tokenized string"
LOG = "step long, epoch int, train_loss double, lr double, elapsed_s double, val_loss double, aux_loss double"


def csv(spark: SparkSession, path, columns: str) -> DataFrame:
    """Columns by their header's names (a byte order mark is no part of one); missing ones are null, bad cells too."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    want = StructType.fromDDL(columns)
    return raw.select(*[(F.expr(f"try_cast(`{names[f.name]}` as {f.dataType.simpleString()})") if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])


def codas(spark: SparkSession, path) -> DataFrame:
    return csv(spark, path, CODAS)


def dialogues(spark: SparkSession, path) -> DataFrame:
    """A null Whale fails the query, a time that is no number is null."""
    from ..operators.sequences import require_whales

    return require_whales(csv(spark, path, DIALOGUE))


def detections(spark: SparkSession, path) -> DataFrame:
    """The first two cells of each row, whatever they are called; shorter rows are left out."""
    raw = spark.read.option("header", True).csv(path)
    if len(raw.columns) < 2:
        return spark.createDataFrame([], "timestamp string, proportion string")
    return raw.toDF(*[f"c{i}" for i in range(len(raw.columns))]).select(F.col("c0").alias("timestamp"), F.col("c1").alias("proportion")).where("proportion is not null")


def grades(spark: SparkSession, path) -> DataFrame:
    return csv(spark, path, GRADES)


def chunk_scores(spark: SparkSession, path) -> DataFrame:
    return csv(spark, path, CHUNKS)


def training_log(spark: SparkSession, path) -> DataFrame:
    """JSON lines; losses that a line lacks are null."""
    return spark.read.schema(LOG).json(path)


def audio_files(spark: SparkSession, path, pattern: str = "*.{wav,flac}") -> DataFrame:
    """path, name, length, content of non-empty files in all folders below; ``content`` is read only where it is used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return f.where("length > 0").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def wav_clips(spark: SparkSession, path) -> DataFrame:
    """path, name, sr, samples of WAV files."""
    from ..operators.signal import decode_wav

    a = audio_files(spark, path, "*.wav").select("path", "name", decode_wav("content").alias("a"))
    return a.select("path", "name", "a.sr", "a.samples")


def token_arrays(spark: SparkSession, paths) -> DataFrame:
    """dir_ordinal, path, stem, shape, tokens (row by row) of NumPy array files, those of two steps or fewer left out."""
    from .npy import decode

    out = None
    for i, p in enumerate([paths] if isinstance(paths, str) else paths):
        f = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(p).select(F.lit(i).alias("dir_ordinal"), "path", "content")
        out = f if out is None else out.unionAll(f)
    stem = F.regexp_extract("path", r"([^/]+)\.npy$", 1)
    d = out.select("dir_ordinal", "path", stem.alias("stem"), decode("content").alias("a")).select("dir_ordinal", "path", "stem", "a.shape", "a.tokens")
    return d.where(F.element_at("shape", -1) > 2)


def token_headers(spark: SparkSession, paths) -> DataFrame:
    """dir_ordinal, path, stem, steps of array files from their headers alone; those of two steps or fewer are left out.

    ``steps`` is the time dimension, the second of two. Any item type, order
    and header length is right, as the header says them; no content is read.
    """
    from .npy import NpySource

    spark.dataSource.register(NpySource)
    out = None
    for i, p in enumerate([paths] if isinstance(paths, str) else paths):
        f = spark.read.format("npy").schema("path string, stem string, steps long").option("path", p).load().select(F.lit(i).alias("dir_ordinal"), "path", "stem", "steps")
        out = f if out is None else out.unionAll(f)
    return out.where("steps > 2")


def token_lengths(spark: SparkSession, paths, item_bytes: int = 4, codebooks: int = 1) -> DataFrame:
    """dir_ordinal, path, stem, steps of array files from their sizes alone; no content is read.

    Holds for arrays of ``item_bytes`` wide items in files written by
    ``numpy.save``, whose header takes 128 bytes; those of two steps or fewer
    are left out.
    """
    out = None
    for i, p in enumerate([paths] if isinstance(paths, str) else paths):
        f = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(p).select(F.lit(i).alias("dir_ordinal"), "path", "length")
        out = f if out is None else out.unionAll(f)
    steps = F.floor((F.col("length") - 128) / (item_bytes * codebooks))
    return out.select("dir_ordinal", "path", F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("stem"), steps.alias("steps")).where("steps > 2")


def config(path: str) -> dict:
    """A run's settings: JSON, or YAML where a YAML library is installed."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the yaml package; JSON needs none") from e
    return yaml.safe_load(text)
