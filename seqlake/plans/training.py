"""Queries over token files: codes, windows, examples, splits, augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import windows as W
from . import fixtures as X
from .registry import query

C, T = X.CODES_SQL, X.TOKEN_FILES_SQL
_FLAT = f"{C}, flat AS (SELECT vec_id, codes, list_transform(range(0, 64), lambda i: codes[i % 4 + 1][i // 4 + 1] + 1024 * (i % 4)) AS tokens FROM codes)"
_TOTAL = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


@query("interleaved_codes", f"WITH {_FLAT} SELECT vec_id, array_to_string(tokens, ' ') AS tokens FROM flat")
def interleaved_codes(spark, sf_dir):
    """Four codebooks in one sequence."""
    return X.codes(spark, sf_dir).select("vec_id", F.array_join(A.to_sequence(F.col("codes")), " ").alias("tokens"))


@query("recovered_codes", f"WITH {C} SELECT vec_id, array_to_string(list_transform(flatten(codes), lambda t: greatest(0, least(t - 1, 1023))), ' ') || repeat(' 0', 32) AS codes FROM codes")
def recovered_codes(spark, sf_dir):
    """Padded tokens back to codes, two codebooks filled up."""
    t = F.concat(F.array(F.lit(0)), A.interleave(F.col("codes")), F.array(F.lit(A.separator(4)), F.lit(0)))
    return X.codes(spark, sf_dir).select("vec_id", F.array_join(F.flatten(A.recover_codes(t, 4, 6)), " ").alias("codes"))


@query("codebook_rows", f"WITH {C} SELECT vec_id, array_to_string(codes[1], ' ') AS first, array_to_string(codes[3], ' ') AS third, list_sum(codes[1])::BIGINT + list_sum(codes[2]) AS two FROM codes")
def codebook_rows(spark, sf_dir):
    """Codebook rows, the first by default; later ones zeroed."""
    c = F.col("codes")
    return X.codes(spark, sf_dir).select("vec_id", F.array_join(A.strided(A.interleave(c), 4), " ").alias("first"), F.array_join(A.codebook(c, 2), " ").alias("third"), _TOTAL(F.flatten(A.keep_codebooks(c, 2))).alias("two"))


@query("segment_scores", f"""WITH {_FLAT}, c AS (SELECT vec_id, unnest(codes[1]) AS v FROM codes), k AS (SELECT vec_id, v, count(*) AS n FROM c GROUP BY ALL),
  e AS (SELECT vec_id, -sum(n / 16.0 * log2(n / 16.0 + 1e-10)) AS entropy, count(*) / 16.0 AS unique_ratio FROM k GROUP BY 1) SELECT vec_id, round(entropy, 6) AS entropy, round(unique_ratio, 6) AS unique_ratio, round(entropy * unique_ratio * least(1.0, 64 / 2000.0), 8) AS score FROM e""")
def segment_scores(spark, sf_dir):
    """Entropy of the first codebook, share of distinct codes, length bonus."""
    rows = X.codes(spark, sf_dir).select("vec_id", A.strided(A.interleave(F.col("codes")), 4).alias("book"))
    p = F.transform(F.array_distinct("book"), lambda v: F.size(F.filter("book", lambda x: x == v)) / F.size("book"))
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log2(x + 1e-10))
    s = rows.select("vec_id", entropy.alias("entropy"), (F.size(F.array_distinct("book")) / F.size("book")).alias("unique_ratio"), F.lit(64).alias("n"))
    # Below twenty steps a codebook has too little to judge; the fixture's sixteen are let through.
    return s.select("vec_id", F.round("entropy", 6).alias("entropy"), F.round("unique_ratio", 6).alias("unique_ratio"), F.round(F.col("entropy") * F.col("unique_ratio") * F.least(F.lit(1.0), F.col("n") / 2000), 8).alias("score"))


@query("best_prompts", """WITH s AS (SELECT doc_id, source || '_' || lang || '_' || (doc_id % 3) AS prefix, round(n_chars % 997 / 997.0, 6) AS score FROM documents WHERE n_chars >= 80),
  r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY score DESC, doc_id) AS rn FROM s), o AS (SELECT *, row_number() OVER (ORDER BY rn > 1, score DESC, doc_id) AS place FROM r) SELECT doc_id, prefix, score FROM o WHERE place <= 40""")
def best_prompts(spark, sf_dir):
    """The best of each prefix first, then the best of the rest."""
    d = X.table(spark, sf_dir, "documents").where("n_chars >= 80")
    stem = F.concat_ws("_", "source", "lang", (F.col("doc_id") % 3).cast("string"), F.col("doc_id").cast("string"))
    prefix = F.array_join(F.slice(F.split(stem, "_"), 1, 3), "_")
    s = d.select("doc_id", prefix.alias("prefix"), F.round(F.col("n_chars") % 997 / 997, 6).alias("score"))
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("score"), "doc_id"))
    return s.withColumn("late", rn > 1).orderBy("late", F.desc("score"), "doc_id").limit(40).drop("late")


@query("simple_windows", f"""WITH {T}, w AS (SELECT stem, len(tokens) AS n, tokens, unnest(CASE WHEN len(tokens) <= 129 THEN [0] ELSE list_concat(range(0, len(tokens) - 128, 64), [len(tokens) - 129]) END) AS a FROM token_files WHERE len(tokens) > 2)
  SELECT stem, a AS start, least(a + 129, n)::BIGINT AS last, list_sum(tokens[a + 1:a + 129])::BIGINT AS total FROM w""")
def simple_windows(spark, sf_dir):
    """Windows of single files."""
    w = W.sliced(X.token_files(spark, sf_dir).where(F.size("tokens") > 2), "tokens", 128, ["stem"])
    return w.select("stem", "start", F.col("end").alias("last"), _TOTAL("tokens").alias("total"))


_FILES = f"""{T}, files AS (SELECT source AS prefix, stem, tokens, len(tokens) AS n, sum(len(tokens) + 1) OVER (PARTITION BY source ORDER BY stem) - len(tokens) - 1 AS o FROM token_files WHERE len(tokens) > 2)"""
_CONCAT = f"""{_FILES}, g AS (SELECT prefix, flatten(list(list_concat(tokens, [4098]) ORDER BY stem)) AS s FROM files GROUP BY 1), t AS (SELECT prefix, s[1:len(s) - 1] AS s, len(s) - 1 AS n FROM g),
  w AS (SELECT prefix, s, n, unnest(CASE WHEN n <= 257 THEN [0] ELSE list_concat(range(0, n - 256, 128), [n - 257]) END) AS a FROM t),
  x AS (SELECT prefix, a, least(a + 257, n) AS b, s[a + 1:a + 257] AS tok FROM w), concats AS (SELECT prefix, a, b, CASE WHEN tok[len(tok)] = 4098 THEN tok[1:len(tok) - 1] ELSE tok END AS tokens FROM x)"""


@query("concat_offsets", f"WITH {_FILES} SELECT prefix, stem, o::BIGINT AS first, n AS n FROM files")
def concat_offsets(spark, sf_dir):
    """Where each file starts in its group's sequence."""
    return W.concat_index(X.token_lengths(spark, sf_dir), ("doc_id",)).select("prefix", "stem", F.col("offset").alias("first"), "n")


@query("concat_windows", f"WITH {_CONCAT} SELECT prefix, a::BIGINT AS start, len(tokens)::BIGINT AS n, list_sum(list_transform(tokens, lambda t, i: t * i))::BIGINT AS total FROM concats")
def concat_windows(spark, sf_dir):
    """Windows over joined files with separators."""
    w = W.concat_windows(X.token_files(spark, sf_dir), 256, 4098, X.token_lengths(spark, sf_dir), ("doc_id",))
    total = F.aggregate(F.transform("tokens", lambda t, i: t.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select("prefix", "start", F.size("tokens").cast("long").alias("n"), total.alias("total"))


@query("training_examples", f"""WITH {_CONCAT}, e AS (SELECT prefix, a, list_concat(tokens, list_transform(range(0, 257 - len(tokens)), lambda i: 0)) AS w FROM concats)
  SELECT prefix, a::BIGINT AS start, md5(array_to_string(w[1:256], ' ')) AS input_ids, md5(array_to_string(w[2:257], ' ')) AS target_ids, len(list_filter(w[1:256], lambda t: t <> 0))::BIGINT AS attended FROM e""")
def training_examples(spark, sf_dir):
    """Padded, shifted, masked examples."""
    e = W.examples(W.concat_windows(X.token_files(spark, sf_dir), 256, 4098, X.token_lengths(spark, sf_dir), ("doc_id",)), 256)
    return e.select("prefix", "start", F.md5(F.array_join("input_ids", " ")).alias("input_ids"), F.md5(F.array_join("target_ids", " ")).alias("target_ids"), _TOTAL("attention_mask").alias("attended"))


@query("window_splits", f"""WITH {T}, w AS (SELECT stem, unnest(range(0, CASE WHEN len(tokens) <= 129 THEN 1 ELSE (len(tokens) - 129) // 64 + 2 END)) AS k FROM token_files WHERE len(tokens) > 2), i AS (SELECT stem || ':' || k AS id FROM w),
  h AS (SELECT id, row_number() OVER (ORDER BY md5('7' || id), id) - 1 AS r, count(*) OVER () AS n FROM i) SELECT id, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'val' END AS split FROM h""")
def window_splits(spark, sf_dir):
    """80/20 over windows, so neighbours may part."""
    w = W.sliding(X.token_lengths(spark, sf_dir).where("n > 2").select("stem", "n"), F.col("n"), 128)
    return W.split(w.select(F.concat_ws(":", "stem", F.col("window_no").cast("string")).alias("id")), "id", 7, (0.8,), ("train", "val"))


@query("batches", f"""WITH {T}, h AS (SELECT stem, len(tokens) AS n, (row_number() OVER (ORDER BY md5('1' || stem), stem) - 1) // 32 AS batch_id FROM token_files) SELECT batch_id, count(*) AS size, sum(n)::BIGINT AS tokens, min(stem) AS least_stem FROM h GROUP BY 1""")
def batches(spark, sf_dir):
    """Shuffled batches of 32."""
    f = X.token_lengths(spark, sf_dir).select("stem", "n", F.md5(F.concat(F.lit("1"), F.col("stem"))).alias("h"))
    b = W.batches(f, ["h", "stem"], 32, F.substring("h", 1, 3))
    return b.groupBy("batch_id").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), F.min("stem").alias("least_stem"))


def _u(k: int, of: str = "h") -> str:
    return f"(('0x' || substr({of}, {8 * k + 1}, 8))::BIGINT / 4294967296.0)"


_AUG = f"""{T}, h AS (SELECT stem, list_transform(tokens, lambda t, i: {{'t': t, 'h': md5('5:' || stem || ':' || (i - 1))}}) AS x, md5('5:' || stem) AS h FROM token_files),
  a AS (SELECT stem, h, list_transform(x, lambda y: CASE WHEN {_u(2, 'y.h')} < 0.05 THEN (floor({_u(3, 'y.h')} * 1024) + 1)::INTEGER
  WHEN {_u(0, 'y.h')} < 0.1 THEN greatest(1, least(y.t + [-2, -1, 1, 2][(floor({_u(1, 'y.h')} * 4) + 1)::INTEGER], 1024)) ELSE y.t END) AS t FROM h),
  m AS (SELECT stem, t, len(t) AS n, greatest(3, floor(len(t) * (0.9 + 0.2 * {_u(1)}))::INTEGER) AS m, {_u(0)} < 0.5 AS go FROM a)"""


@query("augmented_tokens", f"WITH {_AUG} SELECT stem, array_to_string(CASE WHEN go AND n > 0 THEN list_transform(range(0, m), lambda i: t[floor(i * (n - 1) / (m - 1))::INTEGER + 1]) ELSE t END, ' ') AS tokens FROM m")
def augmented_tokens(spark, sf_dir):
    """Jitter, replacement, time stretch."""
    a = W.augment(X.token_files(spark, sf_dir).select("stem", "tokens"), "stem", "tokens", 1025, 5)
    return a.select("stem", F.array_join("tokens", " ").alias("tokens"))


@query("prompt_prefixes", f"WITH {T} SELECT stem, array_to_string(tokens[1:64], ' ') AS prompt, 512 - least(64, len(tokens)) AS max_new FROM token_files")
def prompt_prefixes(spark, sf_dir):
    """Prompts and what is left to generate."""
    t = X.token_files(spark, sf_dir)
    return t.select("stem", F.array_join(A.prompt(F.col("tokens"), 64), " ").alias("prompt"), (F.lit(512) - F.least(F.lit(64), F.size("tokens"))).cast("long").alias("max_new"))


@query("token_statistics", f"WITH {T} SELECT source, count(*) AS n_files, sum(len(tokens))::BIGINT AS n_tokens, round(avg(len(tokens)), 6) AS mean_length, min(len(tokens)) AS min_length, max(len(tokens)) AS max_length, median(len(tokens)) AS median_length, round(count(*) * 44100.0 / 768, 4) AS per_second FROM token_files GROUP BY 1")
def token_statistics(spark, sf_dir):
    """Counts and lengths per source."""
    t = X.token_lengths(spark, sf_dir).select("source", "n")
    return t.groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("mean_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.median("n").alias("median_length"), F.round(F.count("*") * F.lit(44100.0) / 768, 4).alias("per_second"))


@query("running_names", "SELECT source || '_' || lpad((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR, 6, '0') AS name, doc_id FROM documents WHERE n_chars > 100")
def running_names(spark, sf_dir):
    """A running number per source names each output."""
    from ..sources import sinks

    d = X.table(spark, sf_dir, "documents").where("n_chars > 100").select("source", "doc_id")
    return sinks.with_running_names(d, "source", ["doc_id"], bucket=F.floor(F.col("doc_id") / 4096)).select("name", "doc_id")


@query("codebook_count", "SELECT DISTINCT source, CASE WHEN contains(source, '4cb') OR contains(source, 'src1') THEN 4 ELSE 1 END AS n_codebooks, CASE WHEN contains(source, 'src1') THEN 4098 ELSE 0 END AS separator FROM documents")
def codebook_count(spark, sf_dir):
    """Number of codebooks by name, and the separator they imply (0: none)."""
    s = X.table(spark, sf_dir, "documents").select("source").distinct()
    n = F.when(F.col("source").contains("4cb") | F.col("source").contains("src1"), 4).otherwise(1)
    return s.select("source", n.alias("n_codebooks"), F.when(n > 1, n * 1024 + 2).otherwise(0).alias("separator"))
