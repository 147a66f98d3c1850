"""Queries over whole recordings: long segmentation, detector, per-file jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as Q
from ..operators import blocks as B
from ..operators import segments as S
from ..operators import signal as G
from . import fixtures as X
from . import pipelines as P
from .registry import query
from .signal import long_signals

#: Some clips of a recording are nearly silent: short pauses, and longer ones.
_PAUSES = f"""{X.AUDIO_SQL}, rec AS (SELECT label::BIGINT * 1000000 + vec_id // 512 AS id, flatten(list(list_transform(samples, lambda v: v * f) ORDER BY vec_id)) AS x
  FROM (SELECT *, CASE WHEN (vec_id // 20) % 10 = 0 OR vec_id % 250 BETWEEN 100 AND 139 THEN 0.05::DOUBLE ELSE 1::DOUBLE END AS f FROM audio) GROUP BY 1)"""


def paused(spark, sf_dir, sr=1000):
    """id, samples, sr of recordings with pauses."""
    quiet = (F.expr("(vec_id div 20) % 10") == 0) | (F.col("vec_id") % 250).between(100, 139)
    a = X.audio(spark, sf_dir).withColumn("f", F.when(quiet, F.lit(0.05)).otherwise(F.lit(1.0)))
    a = a.withColumn("samples", F.transform("samples", lambda x: x * F.col("f")))
    key = F.col("label").cast("long") * 1000000 + F.expr("vec_id div 512")
    return a.groupBy(key.alias("id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "samples"))).alias("p")).select("id", F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"), F.lit(sr).alias("sr"))


def _levels(x: str) -> str:
    return f"list_transform(range(0, greatest(1, (len({x}) - 25) // 10)), lambda i: sqrt(list_avg(list_transform({x}[i * 10 + 1:i * 10 + 25], lambda v: v * v))))"


def _quiet(name: str, source: str) -> str:
    """Stretches of frames under the threshold of each recording in ``source`` (id, e, t)."""
    return f"""{name} AS (SELECT id, min(i) * 10 AS a, (max(i) + 1) * 10 AS b, (max(i) + 1 = any_value(n)) AS open FROM (SELECT id, i, n, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g
    FROM (SELECT id, t, e[i + 1] AS e, i, n FROM (SELECT id, e, t, len(e) AS n, unnest(range(0, len(e))) AS i FROM {source})) WHERE e < t) GROUP BY id, g)"""


def _long_sql(threshold: str, at_least: int, trailing: str) -> str:
    """Chunks of 50 to 500 samples; silences over 200 samples become 50 zeros in recordings longer than ``at_least``."""
    return f"""WITH RECURSIVE {_PAUSES}, e1 AS (SELECT id, x, {_levels('x')} AS e FROM rec WHERE len(x) >= 50), t1 AS (SELECT id, x, e, {threshold} AS t FROM e1),
  {_quiet('q1', 't1')}, far AS (SELECT id, a, b, lag(b, 1, 0) OVER (PARTITION BY id ORDER BY a) AS p FROM q1 WHERE (b - a) / 1000.0 > 0.2),
  kept AS (SELECT far.id, flatten(list(list_concat(x[p + 1:a], list_transform(range(0, 50), lambda i: 0::DOUBLE)) ORDER BY a)) AS ps, max(b) AS last FROM far JOIN t1 USING (id) GROUP BY far.id),
  y1 AS (SELECT t1.id, t, CASE WHEN kept.id IS NULL OR len(x) <= {at_least} THEN x ELSE list_concat(ps, x[last + 1:]) END AS y FROM t1 LEFT JOIN kept USING (id)),
  t2 AS (SELECT id, t, y, {_levels('y')} AS e FROM y1), {_quiet('q2', 't2')},
  mid AS (SELECT id, list((a + b) // 2) AS c FROM q2 WHERE (b - a) / 1000.0 >= 0.1 AND ({trailing} OR NOT open) GROUP BY id),
  y2 AS (SELECT y1.id, len(y)::BIGINT AS total, coalesce(c, []) AS c FROM y1 LEFT JOIN mid USING (id)),
  r AS (SELECT id, total, c, 0::BIGINT AS s FROM y2 UNION ALL SELECT id, total, c, coalesce(list_max(list_filter(c, lambda m: m >= s + 50 AND m <= s + 500)), s + 500) FROM r WHERE total - s > 500),
  k AS (SELECT id, s AS start, lead(s, 1, total) OVER (PARTITION BY id ORDER BY s) AS stop FROM r)
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INTEGER AS chunk, start, stop, round(coalesce(list_sum(y[start + 1:stop]), 0), 6) AS total FROM k JOIN y1 USING (id) WHERE stop - start >= 50"""


_SHORT = dict(longest=0.5, shortest=0.05, max_silence=0.2, fill=0.05)


def _summed(chunks):
    return chunks.select("id", "chunk", "start", "stop", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("long_chunks", _long_sql("greatest(list_aggregate(e, 'quantile_cont', 0.25), 1e-6)", 500, "false"))
def long_chunks(spark, sf_dir):
    """Quiet under the lower quartile, an open last silence left out."""
    return _summed(S.segment_long(paused(spark, sf_dir), 1000, **_SHORT))


@query("long_chunks_fixed", _long_sql("0.02::DOUBLE", 0, "true"))
def long_chunks_fixed(spark, sf_dir):
    """A fixed threshold, short recordings shortened too, an open last silence closed."""
    return _summed(S.segment_long(paused(spark, sf_dir), 1000, threshold=0.02, shorten_short=True, close_trailing=True, **_SHORT))


def clip_blocks(spark, sf_dir):
    """id, block, samples: the same recordings, a block for each clip; no recording is ever one row."""
    quiet = (F.expr("(vec_id div 20) % 10") == 0) | (F.col("vec_id") % 250).between(100, 139)
    a = X.audio(spark, sf_dir).select((F.col("label").cast("long") * 1000000 + F.expr("vec_id div 512")).alias("id"), "vec_id", F.transform("samples", lambda x: x * F.when(quiet, F.lit(0.05)).otherwise(F.lit(1.0))).alias("samples"))
    return a.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("vec_id")) - 1).alias("block"), "samples")


@query("long_chunks_of_blocks", _long_sql("greatest(list_aggregate(e, 'quantile_cont', 0.25), 1e-6)", 500, "false"))
def long_chunks_of_blocks(spark, sf_dir):
    """The cut at silences from block rows: frames summed over blocks, radix quartiles, pointer doubling."""
    return _summed(B.segment_blocks(clip_blocks(spark, sf_dir), "id", 64, 1000, **_SHORT)).withColumn("chunk", F.col("chunk").cast("int"))


@query("long_chunks_of_blocks_fixed", _long_sql("0.02::DOUBLE", 0, "true"))
def long_chunks_of_blocks_fixed(spark, sf_dir):
    """The same with a fixed threshold, short recordings shortened too, an open last silence closed."""
    return _summed(B.segment_blocks(clip_blocks(spark, sf_dir), "id", 64, 1000, threshold=0.02, shorten_short=True, close_trailing=True, **_SHORT)).withColumn("chunk", F.col("chunk").cast("int"))


def _weighted_sql(sr: int) -> str:
    """y (id, i, y): recordings after the two sections that loudness is measured behind, sample by sample."""
    (a0, a1, a2, _, c1, c2), (b0, b1, b2, _, d1, d2) = (tuple(f"({float(v)!r})::DOUBLE" for v in row) for row in G.loudness_sections(sr))
    return f"""{_PAUSES}, y0 AS (SELECT id, x, 0::BIGINT AS i, 0::DOUBLE AS p, 0::DOUBLE AS s1, 0::DOUBLE AS s2, 0::DOUBLE AS y, 0::DOUBLE AS t1, 0::DOUBLE AS t2 FROM rec
  UNION ALL SELECT id, x, i + 1, p1, {a1} * v - {c1} * p1 + s2, {a2} * v - {c2} * p1, q1, {b1} * p1 - {d1} * q1 + t2, {b2} * p1 - {d2} * q1
  FROM (SELECT *, {b0} * p1 + t1 AS q1 FROM (SELECT *, {a0} * v + s1 AS p1 FROM (SELECT *, x[i + 1] AS v FROM y0 WHERE i < len(x))))),
  y AS (SELECT id, i - 1 AS i, y FROM y0 WHERE i > 0)"""


@query("block_filter", f"WITH RECURSIVE {_weighted_sql(8000)} SELECT id, (i // 64)::INTEGER AS block, round(sum(y), 6) AS total, round(sqrt(avg(y * y)), 6) AS level FROM y GROUP BY 1, 2")
def block_filter(spark, sf_dir):
    """A cascade over block rows, each block from its exact state by a prefix scan of filter states."""
    y = B.filtered(clip_blocks(spark, sf_dir), "id", 64, G.loudness_sections(8000))
    return y.select("id", "block", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(Q.rms(F.col("samples")), 6).alias("level"))


@query("block_loudness", f"""WITH RECURSIVE {_weighted_sql(4000)}, n AS (SELECT id, len(x) AS n FROM rec), w AS (SELECT id, n, unnest(range(0, (n - 1600) // 400 + 1)) AS k FROM n WHERE n >= 1600),
  p AS (SELECT w.id, k, avg(y * y) AS p FROM w JOIN y ON y.id = w.id AND y.i >= k * 400 AND y.i < k * 400 + 1600 GROUP BY 1, 2), l AS (SELECT id, p, 10 * log10(p) - 0.691 AS level FROM p WHERE 10 * log10(p) - 0.691 > -70),
  g AS (SELECT id, 10 * log10(avg(p)) - 0.691 - 10 AS gate FROM l GROUP BY 1), o AS (SELECT id, round(10 * log10(avg(p)) - 0.691, 6) AS loudness FROM l JOIN g USING (id) WHERE level > gate GROUP BY 1)
  SELECT n.id, loudness FROM n LEFT JOIN o USING (id)""")
def block_loudness(spark, sf_dir):
    """Gated loudness of recordings as block rows."""
    return B.loudness(clip_blocks(spark, sf_dir), "id", 64, 4000).withColumn("loudness", F.round("loudness", 6))


@query("detector_scores", f"""WITH {_PAUSES} SELECT id, CASE WHEN len(x) >= 512 THEN round(list_avg(list_transform(range(0, len(x) // 512), lambda k: sqrt(list_avg(list_transform(x[k * 512 + 1:k * 512 + 512], lambda v: v * v))))), 8) END AS score FROM rec""")
def detector_scores(spark, sf_dir):
    """Mean score over whole windows by a pluggable scorer, null without one."""
    return paused(spark, sf_dir, 10000).select("id", F.round(S.detector(S.window_level, 10000, 512)("samples", "sr"), 8).alias("score"))


@query("resampled_in_blocks")
def resampled_in_blocks(spark, sf_dir):
    """From 8 to 5 kHz in blocks of a tenth of a second."""
    y = S.resampled_in_blocks(long_signals(spark, sf_dir).withColumn("sr", F.lit(8000)), "id", 5000, 0.1)
    return y.select("id", F.size("samples").alias("n"), F.round(Q.rms(F.col("samples")), 6).alias("rms"))


def _chunks(spark, sf_dir):
    return P.heard(paused(spark, sf_dir, 9600), "id", 8000, 0.01, (80, 3800), longest=0.2, shortest=0.02, max_silence=0.025, fill=0.01)


@query("hydrophone_chunks")
def hydrophone_chunks(spark, sf_dir):
    """Tone, rate, band, cut, peak, variation, ratio, level, loudness of each recording."""
    c = P.hydrophone_chunks(_chunks(spark, sf_dir), "id", (200, 3500), 256, 64, least_cv=0.2, frame_seconds=0.01)
    return c.select("id", "chunk", "start", "stop", F.round("whale_cv", 4).alias("whale_cv"), F.round("energy_ratio", 4).alias("energy_ratio"), F.round("whale_rms", 6).alias("whale_rms"), F.round(Q.rms(F.col("samples")), 6).alias("rms"))


@query("hydrophone_tokens")
def hydrophone_tokens(spark, sf_dir):
    """Each recording's chunks as token sequences."""
    return P.chunk_tokens(_chunks(spark, sf_dir), G.residual_quantiser(2), 2).select("id", "chunk", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("digest"))


@query("gated_chunks")
def gated_chunks(spark, sf_dir):
    """Chunks that keep a fifth of their level through two gates."""
    c = P.gated_chunks(_chunks(spark, sf_dir))
    return c.select("id", "chunk", F.round("retention", 5).alias("retention"), F.round(Q.rms(F.col("samples")), 6).alias("rms"))


@query("source_grades")
def source_grades(spark, sf_dir):
    """Loud stretches of each recording, measured and graded."""
    r = long_signals(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), F.expr("id div 1000000")))
    g = P.source_grades(r, "id", 1000, longest=1.0, shortest=0.1, threshold=0.11)
    return g.select("source", F.col("file").alias("id"), "segment_idx", F.round("duration_s", 4).alias("duration_s"), F.round("spectral_flatness", 6).alias("flatness"), F.round("quality_score", 6).alias("quality_score"), "grade")


@query("denoised_tree")
def denoised_tree(spark, sf_dir):
    """Every recording at a sufficient rate, denoised, with its new path."""
    r = long_signals(spark, sf_dir).select(F.format_string("/in/%d/%d.wav", F.expr("id div 1000000"), F.col("id")).alias("path"), F.when(F.col("id") % 2 == 0, 8000).otherwise(6000).alias("sr"), "samples")
    d = P.denoised_tree(r, "/in", "/out", 8000, 5000)
    return d.select("path", "sr", F.size("samples").alias("n"), F.round(Q.rms(F.col("samples")), 6).alias("rms"))
