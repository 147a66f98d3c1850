"""Queries over quality grades and chunk scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as Q
from ..operators import grading as G
from . import fixtures as X
from .registry import query

_AUDIO = X.AUDIO_SQL
#: Frames of 16 samples every 8; flatness is stood in for by a share of small samples.
_METRICS = f"""{_AUDIO}, m AS (SELECT vec_id, label, sqrt(list_avg(list_transform(samples, lambda x: x * x))) AS rms, list_max(list_transform(samples, lambda x: abs(x))) AS peak,
  list_transform(range(0, 6), lambda i: sqrt(list_avg(list_transform(samples[i * 8 + 1:i * 8 + 16], lambda x: x * x)))) AS e, len(list_filter(samples, lambda x: abs(x) < 0.05)) / 64.0 AS flat FROM audio),
metrics AS (SELECT vec_id, label, rms, peak / (rms + 1e-10) AS crest, list_var_pop(e) AS variance, flat FROM m),
scored AS (SELECT *, round(greatest(0, least(1, 0.35 * (1 - least(flat, 1)) + 0.25 * least(variance / 0.005, 1) + 0.2 * greatest(least((crest - 1) / 10, 1), 0) + 0.2 * least(rms / 0.01, 1))), 6) AS quality_score FROM metrics),
grades AS (SELECT 's' || label AS source, 'f' || (vec_id % 40) AS file, vec_id AS segment_idx, quality_score, rms, crest, variance,
  CASE WHEN quality_score >= 0.8 THEN 'A' WHEN quality_score >= 0.6 THEN 'B' WHEN quality_score >= 0.4 THEN 'C' WHEN quality_score >= 0.2 THEN 'D' ELSE 'F' END AS grade FROM scored)"""


def grades(spark, sf_dir):
    a = X.audio(spark, sf_dir)
    s = F.col("samples")
    rms = Q.rms(s)
    m = a.select("vec_id", "label", rms.alias("rms"), (Q.peak(s) / (rms + 1e-10)).alias("crest"), Q.variance(Q.frame_energies(s, 16, 8)).alias("variance"), (F.size(F.filter(s, lambda x: F.abs(x) < 0.05)) / 64.0).alias("flat"))
    scored = m.withColumn("quality_score", F.round(Q.quality_score(F.col("flat"), F.col("variance"), F.col("crest"), F.col("rms")), 6))
    return scored.select(F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), F.concat(F.lit("f"), (F.col("vec_id") % 40).cast("string")).alias("file"), F.col("vec_id").alias("segment_idx"), "quality_score", "rms", "crest", "variance", Q.grade(F.col("quality_score")).alias("grade"))


_VAR = "list_var_pop(e)"
_METRICS = _METRICS.replace(_VAR, "list_aggregate(e, 'var_pop')")


@query("segment_grades", f"WITH {_METRICS} SELECT source, file, segment_idx, quality_score, grade, round(rms, 6) AS rms, round(crest, 5) AS crest FROM grades")
def segment_grades(spark, sf_dir):
    """Metrics, score and grade of each segment."""
    return grades(spark, sf_dir).select("source", "file", "segment_idx", "quality_score", "grade", F.round("rms", 6).alias("rms"), F.round("crest", 5).alias("crest"))


@query("grade_summary", f"WITH {_METRICS} SELECT coalesce(source, 'TOTAL') AS source, count(*) FILTER (grade = 'A') AS A, count(*) FILTER (grade = 'B') AS B, count(*) FILTER (grade = 'C') AS C, count(*) FILTER (grade = 'D') AS D, count(*) FILTER (grade = 'F') AS F, count(*) AS n, round(avg(quality_score), 5) AS mean_score FROM grades GROUP BY ROLLUP (source)")
def grade_summary(spark, sf_dir):
    """Grades per source and in total."""
    return G.grade_summary(grades(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 5))


@query("grade_counts", f"WITH {_METRICS} SELECT source, count(*) FILTER (grade = 'A') AS A, count(*) FILTER (grade = 'B') AS B, count(*) FILTER (grade = 'C') AS C, count(*) FILTER (grade = 'D') AS D, count(*) FILTER (grade = 'F') AS F FROM grades GROUP BY 1")
def grade_counts(spark, sf_dir):
    """G4."""
    return G.grade_counts(grades(spark, sf_dir), "source")


@query("top_species_grades", f"WITH {_METRICS}, t AS (SELECT file FROM grades GROUP BY 1 ORDER BY count(*) DESC, file LIMIT 15) SELECT file, count(*) FILTER (grade = 'A') AS A, count(*) FILTER (grade = 'B') AS B, count(*) FILTER (grade = 'C') AS C, count(*) FILTER (grade = 'D') AS D, count(*) FILTER (grade = 'F') AS F FROM grades SEMI JOIN t USING (file) GROUP BY 1")
def top_species_grades(spark, sf_dir):
    """Grades of the fifteen largest groups."""
    g = grades(spark, sf_dir)
    top = g.groupBy("file").count().orderBy(F.desc("count"), "file").limit(15).select("file")
    return G.grade_counts(g.join(F.broadcast(top), "file", "left_semi"), "file")


@query("metric_quartiles", f"WITH {_METRICS}, l AS (SELECT source, 'rms' AS metric, rms AS v FROM grades UNION ALL SELECT source, 'crest', crest FROM grades UNION ALL SELECT source, 'variance', variance FROM grades UNION ALL SELECT source, 'quality_score', quality_score FROM grades) SELECT source, metric, round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.5), 5) AS q50, round(quantile_cont(v, 0.75), 5) AS q75 FROM l GROUP BY 1, 2")
def metric_quartiles(spark, sf_dir):
    """Exact quartiles of four metrics."""
    q = G.quartiles(grades(spark, sf_dir), "source", ["rms", "crest", "variance", "quality_score"])
    return q.select("source", "metric", *[F.round(c, 5).alias(c) for c in ("q25", "q50", "q75")])


@query("graded_segments", f"WITH {_METRICS}, a AS (SELECT DISTINCT source, file, segment_idx FROM grades WHERE grade IN ('A', 'B', 'C')) SELECT g.source, count(*) AS n FROM grades g SEMI JOIN a ON g.source = a.source AND g.file = a.file AND g.segment_idx = a.segment_idx GROUP BY 1")
def graded_segments(spark, sf_dir):
    """Segments graded C or better."""
    g = grades(spark, sf_dir)
    return g.join(G.at_least(g, "C"), ["source", "file", "segment_idx"], "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("good_files", f"WITH {_METRICS}, f AS (SELECT source, file FROM grades GROUP BY 1, 2 HAVING avg(quality_score) >= 0.55) SELECT g.source, g.file, count(*) AS n FROM grades g SEMI JOIN f ON g.source = f.source AND g.file = f.file GROUP BY 1, 2")
def good_files(spark, sf_dir):
    """Files by mean score."""
    g = grades(spark, sf_dir)
    return g.join(G.good_files(g, 0.55), ["source", "file"], "left_semi").groupBy("source", "file").agg(F.count("*").alias("n"))


_CH = X.CHUNK_SQL


@query("chunk_filter", f"WITH {_CH} SELECT flac % 10 AS bucket, count(*) AS total, count(*) FILTER (whale_cv >= 0.8 AND energy_ratio >= 0.3) AS passed, count(*) FILTER (NOT (whale_cv >= 0.8 AND energy_ratio >= 0.3)) AS filtered, round(100.0 * count(*) FILTER (whale_cv >= 0.8 AND energy_ratio >= 0.3) / greatest(count(*), 1), 4) AS percent FROM chunk_scores GROUP BY 1")
def chunk_filter(spark, sf_dir):
    """The heuristic gate with counts and shares."""
    ok = G.heuristic_pass(F.col("whale_cv"), F.col("energy_ratio"), least_ratio=0.3)
    c = X.chunk_scores(spark, sf_dir).groupBy((F.col("flac") % 10).alias("bucket")).agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("filtered"))
    return c.withColumn("percent", F.round(100.0 * F.col("passed") / F.greatest(F.col("total"), F.lit(1)), 4))


@query("detector_gate", f"WITH {_CH} SELECT flac, idx, detector_score, detector_score IS NULL OR detector_score >= 0.1 AS tokenized, coalesce(detector_score >= 0.5, false) AS strong FROM chunk_scores WHERE whale_cv >= 0.8")
def detector_gate(spark, sf_dir):
    """Missing scores pass; 0.1 to tokenise, 0.5 to count as strong."""
    s = F.col("detector_score")
    return X.chunk_scores(spark, sf_dir).where("whale_cv >= 0.8").select("flac", "idx", "detector_score", G.detector_pass(s).alias("tokenized"), F.coalesce(s >= 0.5, F.lit(False)).alias("strong"))


@query("accepted_files", f"WITH {_CH} SELECT DISTINCT npy_file FROM chunk_scores WHERE npy_file <> '' AND (detector_score IS NULL OR detector_score >= 0.6)")
def accepted_files(spark, sf_dir):
    """Names with a blank or sufficient score."""
    return G.accepted_names(X.chunk_scores(spark, sf_dir), 0.6)


@query("retained_chunks", f"WITH {_CH} SELECT flac, idx FROM chunk_scores WHERE energy_ratio > 0 AND round(whale_cv / (energy_ratio * 10), 6) >= 0.2")
def retained_chunks(spark, sf_dir):
    """energy left after gating."""
    return X.chunk_scores(spark, sf_dir).where((F.col("energy_ratio") > 0) & (F.round(G.retention(F.col("energy_ratio") * 10, F.col("whale_cv")), 6) >= 0.2)).select("flac", "idx")


@query("adjacent_runs", f"WITH {_CH}, k AS (SELECT flac, idx, idx - row_number() OVER (PARTITION BY flac ORDER BY idx) AS i FROM chunk_scores WHERE detector_score >= 0.3) SELECT flac, min(idx) AS first, max(idx) AS last, count(*) AS n FROM k GROUP BY flac, i")
def adjacent_runs(spark, sf_dir):
    """Runs of consecutive chunks."""
    return G.adjacent_runs(X.chunk_scores(spark, sf_dir).where("detector_score >= 0.3"))


@query("chain_candidates", f"WITH {_CH}, k AS (SELECT flac, idx, idx - row_number() OVER (PARTITION BY flac ORDER BY idx) AS i FROM chunk_scores WHERE detector_score >= 0.3), r AS (SELECT count(*) AS m FROM k GROUP BY flac, i) SELECT k::INTEGER AS k, sum(greatest(m - k + 1, 0))::BIGINT AS n FROM r, (SELECT unnest([2, 3, 4, 5, 6]) AS k) GROUP BY 1")
def chain_candidates(spark, sf_dir):
    """How many chains of two to six chunks."""
    return G.chain_candidates(G.adjacent_runs(X.chunk_scores(spark, sf_dir).where("detector_score >= 0.3")), [2, 3, 4, 5, 6])


@query("positional_zip", f"WITH {_CH}, a AS (SELECT flac, idx, whale_cv, detector_score, npy_file, row_number() OVER (PARTITION BY flac ORDER BY idx) AS p FROM chunk_scores) SELECT flac, p AS position, whale_cv, detector_score, npy_file FROM a")
def positional_zip(spark, sf_dir):
    """Scores, detector scores and names joined by position."""
    c = X.chunk_scores(spark, sf_dir).groupBy("flac").agg(F.array_sort(F.collect_list(F.struct("idx", "whale_cv", "detector_score", "npy_file"))).alias("r"))
    z = F.arrays_zip(F.col("r.whale_cv").alias("whale_cv"), F.col("r.detector_score").alias("detector_score"), F.col("r.npy_file").alias("npy_file"))
    return c.select("flac", F.posexplode(z).alias("p", "z")).select("flac", (F.col("p") + 1).alias("position"), "z.whale_cv", "z.detector_score", "z.npy_file")


@query("chunk_durations", f"WITH {_CH} SELECT round(avg(whale_cv), 5) AS mean, min(whale_cv) AS least, max(whale_cv) AS most FROM chunk_scores")
def chunk_durations(spark, sf_dir):
    """Mean and range."""
    return X.chunk_scores(spark, sf_dir).agg(F.round(F.avg("whale_cv"), 5).alias("mean"), F.min("whale_cv").alias("least"), F.max("whale_cv").alias("most"))


@query("best_chunk_per_file", f"WITH {_CH}, r AS (SELECT *, row_number() OVER (PARTITION BY flac ORDER BY detector_score DESC NULLS LAST, idx) AS rn FROM chunk_scores) SELECT flac, idx, detector_score FROM r WHERE rn <= 2")
def best_chunk_per_file(spark, sf_dir):
    """L4: top two per file."""
    rn = F.row_number().over(Window.partitionBy("flac").orderBy(F.col("detector_score").desc_nulls_last(), "idx"))
    return X.chunk_scores(spark, sf_dir).withColumn("rn", rn).where("rn <= 2").select("flac", "idx", "detector_score")
