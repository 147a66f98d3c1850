"""Outputs: named token files, append-only score tables, ledgers, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import settled
from ..operators.windows import running_sum


def with_running_names(df: DataFrame, source: str, order: list[str], first: Column | int = 0, bucket: Column | None = None) -> DataFrame:
    """``name``: source and a six-digit running number per source, from ``first`` on.

    Rows are numbered within buckets that rise with the order: values of
    ``bucket``, or of the first column of the order.
    """
    numbered = running_sum(df, source, order, F.lit(1).cast("long"), "__n", [F.col(order[0]) if bucket is None else bucket])
    return numbered.withColumn("name", F.format_string("%s_%06d", F.col(source), F.col("__n") + first)).drop("__n")


def write_tokens(df: DataFrame, path: str, batch: str, name: str = "name", tokens: str = "tokens") -> None:
    """Each row's tokens, or codes as a two-dimensional array, as the array file ``<name>.npy`` below ``path``; a batch is written once.

    ``name`` may hold sub-folders, as a source's or a file's stem.
    """
    from .npy import encode
    from .once import write_once

    rows = settled(df.where(F.col(name).isNotNull() & F.col(tokens).isNotNull()).select(name, tokens), tokens, F.col(tokens))
    write_once(rows.select(F.concat(F.col(name), F.lit(".npy")).alias("name"), encode(tokens).alias("content")), path, batch, "files")


def write_audio(df: DataFrame, path: str, batch: str, name: str = "path") -> None:
    """Each row's samples at its sr as the WAV file of that name below ``path``; a batch is written once."""
    from ..operators.signal import encode_wav
    from .once import write_once

    rows = settled(df.where(F.col(name).isNotNull() & F.col("samples").isNotNull()).select(name, "sr", "samples"), "samples", F.col("samples"))
    write_once(rows.select(F.col(name).alias("name"), encode_wav("samples", "sr").alias("content")), path, batch, "files")


def append_scores(df: DataFrame, path: str, key: list[str]) -> None:
    """Append only rows whose key is not there yet, so a repeated run changes nothing."""
    from .files import exists

    if exists(df.sparkSession, path):
        df = df.join(df.sparkSession.read.parquet(path).select(*key).distinct(), key, "left_anti")
    df.dropDuplicates(key).write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table in place of what is there, a header in each file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in place of what is there."""
    df.write.mode("overwrite").json(path)


def retained(checkpoints: DataFrame, k: int = 3, run: tuple[str, ...] = ()) -> DataFrame:
    """The manifest (step, val_loss, columns of ``run``) with keep and on_disk.

    keep: the k least losses of a run, ties to the earlier step. A checkpoint
    that is worse than k others the moment it is written is forgotten but never
    unlinked, so on_disk holds for those as well. Displaced losses are handed
    on from place to place by running minima: k windows over one sort.
    """
    before = Window.partitionBy(*run).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    out, loss = checkpoints.withColumn("__x", F.col("val_loss").cast("double")), F.col("val_loss").cast("double")
    for place in range(k):
        out = out.withColumn(f"__m{place}", F.coalesce(F.min("__x").over(before), F.lit(float("inf"))))
        out = out.withColumn("__x", F.greatest("__x", f"__m{place}"))
    best = F.row_number().over(Window.partitionBy(*run).orderBy("val_loss", "step")) <= k
    out = out.withColumn("keep", best).withColumn("on_disk", F.col("keep") | (F.col(f"__m{k - 1}") <= loss))
    return out.drop("__x", *[f"__m{i}" for i in range(k)])


def run_metadata(df: DataFrame, **settings) -> DataFrame:
    """One JSON object of a run: its settings and totals."""
    totals = df.agg(F.count("*").alias("n_files"), F.sum("n_tokens").alias("n_tokens"))
    return totals.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(settings.items())], "n_files", "n_tokens")).alias("metadata"))
