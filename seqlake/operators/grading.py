"""Quality tables: filters, summaries, chunk gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as Q
from .selection import quantiles


def at_least(grades: DataFrame, least: str) -> DataFrame:
    """Distinct (source, file, segment_idx) graded ``least`` or better; an unknown grade lets all pass."""
    return grades.where(Q.grade_rank(F.col("grade")) >= Q.GRADE_RANK.get(least, 0)).select("source", "file", "segment_idx").distinct()


def good_files(grades: DataFrame, least: float = 0.6) -> DataFrame:
    """(source, file) whose segments' mean score is ``least`` or more."""
    return grades.groupBy("source", "file").agg(F.avg("quality_score").alias("mean_score")).where(F.col("mean_score") >= least)


def grade_counts(grades: DataFrame, key: str) -> DataFrame:
    """Segments per grade and key, zeros included."""
    return grades.groupBy(key).agg(*[F.count_if(F.col("grade") == g).alias(g) for g in Q.GRADE_RANK])


def grade_summary(grades: DataFrame, key: str = "source") -> DataFrame:
    """The same with n and mean score, and a TOTAL row."""
    out = grades.rollup(key).agg(F.grouping(key).alias("__total"), *[F.count_if(F.col("grade") == g).alias(g) for g in Q.GRADE_RANK], F.count("*").alias("n"), F.avg("quality_score").alias("mean_score"))
    return out.withColumn(key, F.when(F.col("__total") == 1, "TOTAL").otherwise(F.col(key))).drop("__total")


def quartiles(grades: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, metric, q25, q50, q75 (exact, linear interpolation), by radix selection: no task holds a group's values."""
    long = grades.select(key, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    q = quantiles(long, [key, "metric"], "value", [0.25, 0.5, 0.75])
    return q.groupBy(key, "metric").agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for s, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])


def heuristic_pass(cv: Column, ratio: Column, rms: Column | None = None, least_cv: float = 0.8, least_ratio: float = 0.0, least_rms: float = 0.0) -> Column:
    """Variable enough, then rich enough in the band, then loud enough; a limit of 0 is no limit."""
    ok = cv >= least_cv
    if least_ratio > 0:
        ok = ok & (ratio >= least_ratio)
    if least_rms > 0 and rms is not None:
        ok = ok & (rms >= least_rms)
    return ok


def detector_pass(score: Column, least: float = 0.1) -> Column:
    """A missing score passes."""
    return score.isNull() | (score >= least)


def accepted_names(scores: DataFrame, least: float) -> DataFrame:
    """Distinct npy_file with any blank or sufficient score; blank names are none."""
    return scores.where((F.col("npy_file") != "") & detector_pass(F.col("detector_score"), least)).select("npy_file").distinct()


def retention(before: Column, after: Column) -> Column:
    """Share of the energy that gating left."""
    return after / before


def adjacent_runs(chunks: DataFrame, file: str = "flac", idx: str = "idx") -> DataFrame:
    """Runs of consecutive chunk numbers: file, first, last, n.

    The row number within a file is what consecutive numbers have in common
    when taken off them.
    """
    from pyspark.sql import Window

    island = F.col(idx) - F.row_number().over(Window.partitionBy(file).orderBy(idx))
    return chunks.select(file, idx, island.alias("__i")).groupBy(file, "__i").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n")).drop("__i")


def chain_candidates(runs: DataFrame, sizes: list[int]) -> DataFrame:
    """k, n: windows of k adjacent chunks over all runs."""
    return runs.select(F.explode(F.array(*map(F.lit, sizes))).alias("k"), F.col("n").alias("m")).groupBy("k").agg(F.sum(F.greatest(F.col("m") - F.col("k") + 1, F.lit(0))).alias("n"))
