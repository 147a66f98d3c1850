"""Queries over clips: frames, segments, metrics, filters, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as Q
from ..operators import codec as C
from ..operators import signal as G
from ..operators import spectra as D
from . import fixtures as X
from .registry import query

A = X.AUDIO_SQL
#: A recording: the clips of one label among 512 ids, in the order of their ids. Its length is bounded at any size of the table.
_LONG = f"{A}, long AS (SELECT label::BIGINT * 1000000 + vec_id // 512 AS id, flatten(list(samples ORDER BY vec_id)) AS samples FROM audio GROUP BY 1)"
_FRAMES = f"{_LONG}, fr AS (SELECT id, samples, unnest(range(0, greatest(1, (len(samples) - 16) // 8))) AS frame_no FROM long), energy AS (SELECT id, frame_no, sqrt(list_avg(list_transform(samples[frame_no * 8 + 1:frame_no * 8 + 16], lambda x: x * x))) AS energy FROM fr)"


def long_signals(spark, sf_dir):
    a = X.audio(spark, sf_dir)
    key = F.col("label").cast("long") * 1000000 + F.expr("vec_id div 512")
    return a.groupBy(key.alias("id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "samples"))).alias("p")).select("id", F.flatten(F.transform("p", lambda x: x["samples"])).alias("samples"))


@query("frame_energies", f"WITH {_FRAMES} SELECT id, frame_no, round(energy, 8) AS energy FROM energy")
def frame_energies(spark, sf_dir):
    """RMS of frames."""
    return G.frames(long_signals(spark, sf_dir), 16, 8).select("id", F.col("frame_no").cast("long").alias("frame_no"), F.round("energy", 8).alias("energy"))


_ISLANDS = """fl AS (SELECT id, frame_no, a, max(frame_no) OVER (PARTITION BY id) AS n, frame_no - sum(a::INT) OVER (PARTITION BY id ORDER BY frame_no) AS i FROM marked), runs AS (SELECT id, min(frame_no) AS first, max(frame_no) + 1 AS stop, max(frame_no) = max(n) AS open FROM fl WHERE a GROUP BY id, i)"""


@query("active_runs", f"WITH {_FRAMES}, marked AS (SELECT id, frame_no, round(energy, 9) > 0.12 AS a FROM energy), {_ISLANDS} SELECT id, first, stop, open FROM runs")
def active_runs(spark, sf_dir):
    """Loud stretches as islands of frames."""
    r = G.runs(G.frames(long_signals(spark, sf_dir), 16, 8), F.round("energy", 9) > 0.12)
    return r.select("id", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("stop"), "open")


@query("silence_runs", f"WITH {_FRAMES}, t AS (SELECT id, greatest(quantile_cont(energy, 0.25), 1e-6) AS t FROM energy GROUP BY 1), marked AS (SELECT id, frame_no, round(energy - t, 12) < 0 AS a FROM energy JOIN t USING (id)), {_ISLANDS} SELECT id, first, stop FROM runs WHERE NOT open")
def silence_runs(spark, sf_dir):
    """Stretches under the lower quartile, the open last one left out."""
    e = G.frames(long_signals(spark, sf_dir), 16, 8)
    t = G.silence_threshold(e)
    r = G.runs(e.join(t, "id"), F.round(F.col("energy") - F.col("threshold"), 12) < 0)
    return r.where("not open").select("id", F.col("first").cast("long").alias("first"), F.col("end").cast("long").alias("stop"))


@query("active_segments", f"""WITH {_LONG}, fr AS (SELECT id, samples, unnest(range(0, (len(samples) - 16 + 9) // 10)) AS frame_no FROM long), energy AS (SELECT id, frame_no, sqrt(list_avg(list_transform(samples[frame_no * 10 + 1:frame_no * 10 + 25], lambda x: x * x))) AS energy FROM fr WHERE frame_no * 10 < len(samples) - 25),
  marked AS (SELECT id, frame_no, energy > 0.11 AS a FROM energy), {_ISLANDS}, p AS (SELECT r.id, first * 10 AS a, CASE WHEN open THEN len(l.samples) ELSE stop * 10 END AS b, open FROM runs r JOIN long l USING (id)),
  c AS (SELECT id, a, b FROM p WHERE b - a BETWEEN 20 AND 100 UNION ALL SELECT id, s, least(s + 100, b) FROM (SELECT id, b, unnest(range(a, b, 100)) AS s FROM p WHERE b - a > 100 AND NOT open) WHERE least(s + 100, b) - s >= 20) SELECT id, a AS start, b AS stop FROM c""")
def active_segments(spark, sf_dir):
    """Segments within limits, longer ones cut."""
    return G.active_segments(long_signals(spark, sf_dir), 1000, 0.1, 0.02, 0.11)


@query("long_silence_removed", f"""WITH {_LONG}, c AS (SELECT id, samples, list_transform(range(0, len(samples) // 700), lambda i: i * 700 + 100) AS starts FROM long)
  SELECT id, (len(samples) - len(starts) * 150 + len(starts) * 20)::BIGINT AS n, round(list_sum(samples) - coalesce(list_sum(list_transform(starts, lambda s: list_sum(samples[s + 1:s + 150]))), 0), 7) AS total FROM c""")
def long_silence_removed(spark, sf_dir):
    """Stretches replaced by a short silence."""
    s = long_signals(spark, sf_dir)
    n = F.floor(F.size("samples") / 700).cast("int")
    regions = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i * 700 + 100).alias("start"), (i * 700 + 250).alias("stop"))))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    out = s.select("id", G.without_long_silence(F.col("samples"), F.coalesce(regions, empty), 20).alias("x"))
    return out.select("id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 7).alias("total"))


@query("silence_splits", """WITH RECURSIVE d AS (SELECT doc_id, n_chars AS total, list_transform(range(1, (n_chars // 37 + 1)::BIGINT), lambda i: i * 37 - (i * 11) % 17) AS c FROM documents),
  r AS (SELECT doc_id, total, c, 0::BIGINT AS s FROM d UNION ALL SELECT doc_id, total, c, coalesce(list_max(list_filter(c, lambda x: x >= s + 100 AND x <= s + 400)), s + 400) FROM r WHERE total - s > 400)
  SELECT doc_id, count(*) AS n_starts, sum(s)::BIGINT AS starts FROM r GROUP BY 1""")
def silence_splits(spark, sf_dir):
    """Greedy split at the latest candidate within limits."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("total"))
    n = F.floor(F.col("total") / 37)
    c = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda i: i * 37 - (i * 11) % 17)).otherwise(F.array().cast("array<bigint>"))
    s = d.withColumn("c", c).select("doc_id", G.split_starts(F.col("total"), F.col("c"), 100, 400).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_starts"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("starts"))


@query("peak_normalised", f"WITH {A}, p AS (SELECT vec_id, samples, list_max(list_transform(samples, lambda x: abs(x))) AS p FROM audio) SELECT vec_id, round(list_sum(list_transform(samples, lambda x: greatest(-1.0, least(1.0, x * 0.9 / p)))), 6) AS total, round(p, 8) AS peak FROM p WHERE p > 0")
def peak_normalised(spark, sf_dir):
    """Peak to 0.9."""
    s = F.col("samples")
    out = X.audio(spark, sf_dir).where(Q.peak(s) > 0).select("vec_id", Q.peak_normalised(s).alias("y"), F.round(Q.peak(s), 8).alias("peak"))
    return out.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "peak")


_PAIR = f"{A}, pair AS (SELECT vec_id, samples[1:63] AS o, list_transform(samples[2:64], lambda x: x / 2) AS c FROM audio)"


def pairs(spark, sf_dir):
    a = X.audio(spark, sf_dir)
    return a.select("vec_id", F.slice("samples", 1, 63).alias("o"), F.transform(F.slice("samples", 2, 63), lambda x: x / 2).alias("c"))


@query("reconstruction_metrics", f"""WITH {_PAIR}, m AS (SELECT vec_id, list_avg(list_transform(range(1, 64), lambda i: (o[i] - c[i]) * (o[i] - c[i]))) AS mse, list_avg(list_transform(o, lambda x: x * x)) AS power, list_avg(o) AS mo, list_avg(c) AS mc, o, c FROM pair)
  SELECT vec_id, round(mse, 9) AS mse, round(CASE WHEN mse < 1e-10 THEN 100 ELSE 10 * log10(power / mse) END, 6) AS snr,
  round(list_sum(list_transform(range(1, 64), lambda i: (o[i] - mo) * (c[i] - mc))) / sqrt(list_sum(list_transform(o, lambda x: (x - mo) * (x - mo))) * list_sum(list_transform(c, lambda x: (x - mc) * (x - mc)))), 6) AS correlation FROM m""")
def reconstruction_metrics(spark, sf_dir):
    """Noise, correlation, error."""
    o, c = F.col("o"), F.col("c")
    return pairs(spark, sf_dir).select("vec_id", F.round(Q.mse(o, c), 9).alias("mse"), F.round(Q.snr_db(o, c), 6).alias("snr"), F.round(Q.correlation(o, c), 6).alias("correlation"))


@query("codec_means", f"""WITH {_PAIR}, m AS (SELECT vec_id, list_avg(list_transform(range(1, 64), lambda i: (o[i] - c[i]) * (o[i] - c[i]))) AS mse FROM pair), g AS (SELECT *, unnest(CASE WHEN vec_id % 2 = 0 THEN [1, 4] ELSE [1, 4, 9] END) AS n_cb FROM m)
  SELECT CASE WHEN vec_id % 2 = 0 THEN 'lac' ELSE 'dac' END AS codec, n_cb::INTEGER AS n_cb, round(avg(mse), 8) AS mse, count(*) AS n FROM g GROUP BY 1, 2""")
def codec_means(spark, sf_dir):
    """Means over a ragged grid of codecs and codebooks."""
    m = pairs(spark, sf_dir).select("vec_id", Q.mse(F.col("o"), F.col("c")).alias("mse"))
    even = F.col("vec_id") % 2 == 0
    g = m.select(F.when(even, "lac").otherwise("dac").alias("codec"), "mse", F.explode(F.when(even, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(4), F.lit(9)))).alias("n_cb"))
    return g.groupBy("codec", "n_cb").agg(F.round(F.avg("mse"), 8).alias("mse"), F.count("*").alias("n"))


@query("quiet_frames", f"WITH {_FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY energy, frame_no) AS rn, count(*) OVER (PARTITION BY id) AS n FROM energy) SELECT id, frame_no FROM r WHERE rn <= greatest(1, floor(0.1 * n))")
def quiet_frames(spark, sf_dir):
    """The tenth quietest frames."""
    from pyspark.sql import Window

    e = G.frames(long_signals(spark, sf_dir), 16, 8)
    r = e.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("energy", "frame_no"))).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    return r.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.lit(0.1) * F.col("n")))).select("id", F.col("frame_no").cast("long").alias("frame_no"))


@query("band_cutoffs", "SELECT vec_id, sr, round(least(80 / (sr / 2.0), 0.95), 8) AS low, round(least(20000 / (sr / 2.0), 0.95), 8) AS high FROM (SELECT vec_id, [8000, 16000, 44100, 96000][vec_id % 4 + 1] AS sr FROM embeddings)")
def band_cutoffs(spark, sf_dir):
    """Limits under the Nyquist rate."""
    sr = F.element_at(F.array(*map(F.lit, (8000, 16000, 44100, 96000))), (F.col("vec_id") % 4 + 1).cast("int"))
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", sr.alias("sr"))
    low, high = Q.band_cutoffs(F.col("sr"), 80, 20000)
    return e.select("vec_id", "sr", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("test_tone_skipped", f"WITH {_LONG} SELECT id, len(CASE WHEN len(samples) > 320 THEN samples[321:] ELSE samples END)::BIGINT AS n FROM long")
def test_tone_skipped(spark, sf_dir):
    """P10: five seconds off the front of what is longer."""
    s = F.col("samples")
    return long_signals(spark, sf_dir).select("id", F.size(F.when(F.size(s) > 320, F.slice(s, F.lit(321), F.greatest(F.size(s) - 320, F.lit(0)))).otherwise(s)).cast("long").alias("n"))


@query("waveform_points", f"WITH {A} SELECT vec_id, unnest(range(0, 64)) / 64.0::DOUBLE AS t, round(unnest(samples), 8) AS amplitude FROM audio")
def waveform_points(spark, sf_dir):
    """P25: what a waveform plot shows, of every clip."""
    a = X.audio(spark, sf_dir).select("vec_id", F.posexplode("samples").alias("i", "x"))
    return a.select("vec_id", (F.col("i") / 64).alias("t"), F.round("x", 8).alias("amplitude"))


_BANK = G.mel_filters(8000, 64, 16)
_MEL = ", ".join(f"({b}, {m}, {float(_BANK[m, b])!r})" for m in range(16) for b in range(33) if _BANK[m, b] or not b and not _BANK[m].any())
_TURN = lambda of: f"list_sum(list_transform(range(0, 64), lambda n: CASE WHEN frame * 16 + n BETWEEN 32 AND 95 THEN samples[frame * 16 + n - 31] * (0.5 - 0.5 * cos(2 * pi() * n / 64)) * {of}(2 * pi() * bin * n / 64) ELSE 0 END))"


@query("mel_rows", f"""WITH {A}, f AS (SELECT vec_id, samples, unnest(range(0, 5)) AS frame FROM audio), b AS (SELECT *, unnest(range(0, 33)) AS bin FROM f), p AS (SELECT vec_id, frame, bin, pow({_TURN('cos')}, 2) + pow({_TURN('sin')}, 2) AS power FROM b),
  m AS (SELECT vec_id, frame, mel, sum(power * weight::DOUBLE) AS p FROM p JOIN (VALUES {_MEL}) t(bin, mel, weight) USING (bin) GROUP BY ALL), k AS (SELECT vec_id, max(p) AS peak FROM m GROUP BY 1)
  SELECT vec_id, frame::INTEGER AS frame, mel, round(greatest(10 * log10(greatest(p, 1e-10)) - 10 * log10(greatest(peak, 1e-10)), -80), 4) AS db FROM m JOIN k USING (vec_id)""")
def mel_rows(spark, sf_dir):
    """P25: mel spectrogram of every clip through a sparse filter table, in dB against its peak."""
    return D.mel_rows(X.audio(spark, sf_dir), "vec_id", 8000, 16, 64, 16).withColumn("db", F.round("db", 4))


@query("comparison_rows", f"WITH {A} SELECT vec_id, i::INTEGER AS i, (i / 8000.0)::DOUBLE AS t, round(samples[i + 1], 8) AS original, CASE WHEN i < 64 - vec_id % 3 THEN round((floor(samples[i + 1] * 8) + 0.5) / 8, 8) END AS copy FROM (SELECT *, unnest(range(0, 64)) AS i FROM audio)")
def comparison_rows(spark, sf_dir):
    """P25: every clip beside a coarse, sometimes shorter copy."""
    copy = F.transform(F.slice("samples", F.lit(1), (64 - F.col("vec_id") % 3).cast("int")), lambda x: (F.floor(x * 8) + 0.5) / 8)
    c = D.comparison_rows(X.audio(spark, sf_dir).select("vec_id", F.col("samples").alias("original"), copy.alias("copy")), "vec_id", 8000.0)
    return c.select("vec_id", "i", "t", F.round("original", 8).alias("original"), F.round("copy", 8).alias("copy"))


def _rated(spark, sf_dir, sr=8000):
    return long_signals(spark, sf_dir).withColumn("sr", F.lit(sr))


@query("spectral_metrics")
def spectral_metrics(spark, sf_dir):
    """Flatness, centroid, bandwidth by an Arrow UDF."""
    s = _rated(spark, sf_dir).select("id", G.spectral("samples", "sr").alias("m"))
    return s.select("id", *[F.round(f"m.{c}", 6).alias(c) for c in ("flatness", "centroid", "bandwidth")])


@query("band_metrics")
def band_metrics(spark, sf_dir):
    """Band signal, its variation, level and share."""
    b = _rated(spark, sf_dir).select("id", "samples", "sr", G.bandpass(200, 3500)("samples", "sr").alias("band"))
    e = Q.frame_energies(F.col("band"), 80, 80)
    cv = F.sqrt(Q.variance(e)) / F.greatest(Q.mean_of(e), F.lit(1e-10))
    return b.select("id", F.round(cv, 6).alias("whale_cv"), F.round(Q.rms(F.col("band")), 8).alias("whale_rms"), F.round(G.band_ratio(200, 3500, 256, 64)("samples", "sr"), 6).alias("energy_ratio"))


@query("loudness")
def loudness(spark, sf_dir):
    """To -20 LUFS."""
    s = _rated(spark, sf_dir).select("id", G.loudness_normalized()("samples", "sr").alias("y"))
    return s.select("id", F.round(Q.rms(F.col("y")), 8).alias("rms"), F.round(Q.peak(F.col("y")), 8).alias("peak"))


@query("denoised_levels")
def denoised_levels(spark, sf_dir):
    """Three denoise levels."""
    out = None
    for level in ("demo", "medium", "aggressive"):
        s = _rated(spark, sf_dir).select(F.lit(level).alias("level"), "id", F.size("samples").alias("n"), G.denoised(level)("samples", "sr").alias("y"))
        s = s.select("level", "id", (F.size("y") == F.col("n")).alias("same_length"), F.round(Q.rms(F.col("y")), 6).alias("rms"))
        out = s if out is None else out.unionAll(s)
    return out


@query("resampled_clips")
def resampled_clips(spark, sf_dir):
    """From 8 to 5 kHz."""
    s = _rated(spark, sf_dir).select("id", G.resampled(5000)("samples", "sr").alias("y"))
    return s.select("id", F.size("y").alias("n"), F.round(Q.rms(F.col("y")), 6).alias("rms"))


@query("codec_round_trip")
def codec_round_trip(spark, sf_dir):
    """Codes by a pluggable encoder, spectral distances of a coarse copy."""
    e = G.encoder(G.residual_quantiser(2), 2)
    c = _rated(spark, sf_dir).select("id", "samples", e("samples").alias("codes"))
    back = F.transform(F.col("codes")[0], lambda v: (v - 0.5) / 1024 * 2 - 1)
    r = c.select("id", "samples", back.alias("copy"))
    return r.select("id", F.round(Q.snr_db(F.col("samples"), F.col("copy")), 4).alias("snr"), F.round(G.spectral_convergence("samples", "copy"), 6).alias("spectral_convergence"), F.round(G.log_spectral_distance("samples", "copy"), 5).alias("log_spectral_distance"), F.round(G.mel_cepstral_distortion(8000)("samples", "copy"), 4).alias("mcd"))


@query("codec_grid")
def codec_grid(spark, sf_dir):
    """Codebooks fitted by k-means, every clip decoded from one, two and three of them; means by number of codebooks."""
    clips = X.audio(spark, sf_dir).select("vec_id", "samples")
    g = C.round_trips(clips, C.fit(clips, 8, books=3, levels=16, rounds=3), [1, 2, 3])
    m = g.select("books", Q.snr_db(F.col("samples"), F.col("copy")).alias("snr"), G.spectral_convergence("samples", "copy").alias("sc"), G.log_spectral_distance("samples", "copy").alias("lsd"), G.mel_cepstral_distortion(8000)("samples", "copy").alias("mcd"), G.mel_cepstral_distortion(8000, False)("samples", "copy").alias("mcd_rms"))
    return m.groupBy("books").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("snr", "sc", "lsd", "mcd", "mcd_rms")])


@query("silence_chunks")
def silence_chunks(spark, sf_dir):
    """Chunks by a table function over raw samples."""
    s = _rated(spark, sf_dir, 64)
    return s.lateralJoin(G.SegmentAtSilence(F.col("samples").outer(), F.col("sr").outer(), F.lit(2.0), F.lit(8.0))).select("id", "chunk", "start", "stop")
