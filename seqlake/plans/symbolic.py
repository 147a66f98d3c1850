"""Queries over annotated calls: vocabulary, gaps, dialogues, tokens, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import datasets as DS
from ..operators import sequences as S
from ..operators import spectra as Y
from ..operators import windows as W
from . import fixtures as X
from .registry import query

D = X.DIALOGUE_SQL
_KEPT = "kept AS (SELECT * FROM dialogue WHERE CodaType IS NULL OR NOT contains(CodaType, 'NOISE'))"
_GAP = "gaps AS (SELECT *, TsTo - lag(TsTo) OVER (PARTITION BY REC ORDER BY TsTo, event_id) - Duration AS gap FROM kept)"
_PAUSE = "CASE WHEN gap > 0 THEN CASE WHEN gap < 0.5 THEN 3 WHEN gap < 2 THEN 4 WHEN gap < 5 THEN 5 WHEN gap < 15 THEN 6 ELSE 7 END END"
_PIECES = f"""pieces AS (SELECT REC, TsTo, event_id, list_filter([{_PAUSE}, CASE WHEN Whale BETWEEN 1 AND 20 THEN 7 + Whale END, {X.TYPE_SQL}], lambda t: t IS NOT NULL) AS p FROM gaps)"""
_SIZES = "sizes AS (SELECT REC, count(*) AS n_codas FROM dialogue WHERE REC IS NOT NULL GROUP BY REC HAVING count(*) >= 3)"
_TOKENS = f"""{D}, {_KEPT}, {_GAP}, {_PIECES}, {_SIZES},
tokens AS (SELECT s.REC, s.n_codas, list_concat([1], coalesce(flatten(list(p.p ORDER BY p.TsTo, p.event_id) FILTER (p.p IS NOT NULL)), []), [2])::INTEGER[] AS tokens
  FROM sizes s LEFT JOIN pieces p USING (REC) GROUP BY s.REC, s.n_codas)"""


def _tokens(spark, sf_dir):
    return S.tokenize(X.dialogue(spark, sf_dir), ["REC"], ["TsTo", "event_id"])


@query("dialogue_tokens", f"WITH {_TOKENS} SELECT REC, n_codas, array_to_string(tokens, ' ') AS tokens FROM tokens")
def dialogue_tokens(spark, sf_dir):
    """A recording's calls as tokens."""
    return _tokens(spark, sf_dir).withColumn("tokens", F.array_join("tokens", " "))


_CODA = f"""{D}, sizes AS (SELECT REC, Unit, UnitNum, count(*) AS n_codas FROM dialogue GROUP BY ALL HAVING count(*) >= 3),
typed AS (SELECT REC, Unit, UnitNum, event_id, {X.TYPE_SQL} AS t FROM dialogue WHERE CodaType IS NULL OR NOT contains(CodaType, 'NOISE')),
tokens AS (SELECT s.*, list_concat([1], coalesce(list(t.t ORDER BY t.event_id) FILTER (t.t IS NOT NULL), []), [2])::INTEGER[] AS tokens
  FROM sizes s LEFT JOIN typed t USING (REC, Unit, UnitNum) GROUP BY ALL)"""


@query("coda_sequences", f"WITH {_CODA} SELECT REC, Unit, UnitNum, n_codas, array_to_string(tokens, ' ') AS tokens FROM tokens WHERE len(tokens) > 3")
def coda_sequences(spark, sf_dir):
    """Per individual and day, types only; sequences with fewer than two inner tokens go."""
    d = X.dialogue(spark, sf_dir).withColumnRenamed("event_id", "codaNUM2018")
    t = S.tokenize(d, ["REC", "Unit", "UnitNum"], ["codaNUM2018"], pauses=False, whales=False).where(F.size("tokens") > 3)
    return t.withColumn("tokens", F.array_join("tokens", " "))


@query("dialogue_summary", f"""WITH {D} SELECT REC AS recording, count(*) AS n_codas, count(DISTINCT Whale) AS n_whales, round(max(TsTo) - min(TsTo), 4) AS duration_s,
  array_to_string(list_sort(list(DISTINCT Whale)), ',') AS whale_ids FROM dialogue WHERE REC IS NOT NULL GROUP BY REC HAVING count(*) >= 3""")
def dialogue_summary(spark, sf_dir):
    """Noise rows and individuals out of range count."""
    d = S.dialogues(X.dialogue(spark, sf_dir))
    return d.withColumn("duration_s", F.round("duration_s", 4)).withColumn("whale_ids", F.array_join("whale_ids", ","))


@query("sequence_order", f"WITH {D}, s AS (SELECT REC AS recording, count(*) AS n_codas FROM dialogue GROUP BY REC HAVING count(*) >= 3) SELECT recording, n_codas, row_number() OVER (ORDER BY n_codas DESC, recording) AS place FROM s")
def sequence_order(spark, sf_dir):
    """L1: largest first, ties by key. Places come from counts per size, so no task sees all groups."""
    d = S.dialogues(X.dialogue(spark, sf_dir)).select("recording", "n_codas")
    return W.global_rank(d, ["-n_codas", "recording"], "place")


@query("pause_buckets", f"WITH {D}, {_KEPT}, {_GAP} SELECT coalesce({_PAUSE}, 0)::INTEGER AS pause, count(*) AS n, round(avg(gap), 6) AS mean_gap FROM gaps GROUP BY 1")
def pause_buckets(spark, sf_dir):
    """Gaps between surviving rows by bucket (0: none)."""
    d = X.dialogue(spark, sf_dir).where(~S.is_noise(F.col("CodaType")))
    g = S.gaps(d, ["REC"], ["TsTo", "event_id"])
    return g.groupBy(F.coalesce(V.pause_token(F.col("gap")), F.lit(0)).alias("pause")).agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("mean_gap"))


_NAMES = ", ".join(f"'{t}'" for t in V.CODA_TYPES)
_PAUSES = ", ".join(f"'{t}'" for t in V._PAUSE_TEXT)
_TEXT = f"""CASE WHEN t = 0 THEN '<pad>' WHEN t = 1 THEN '<bos>' WHEN t = 2 THEN '<eos>' WHEN t BETWEEN 3 AND 7 THEN [{_PAUSES}][t - 2]
  WHEN t BETWEEN 8 AND 27 THEN '<whale:' || (t - 7) || '>' WHEN t BETWEEN 28 AND 73 THEN [{_NAMES}][t - 27] ELSE '<unk:' || t || '>' END"""


@query("decoded_tokens", f"WITH {_TOKENS}, u AS (SELECT REC, unnest(tokens) AS t FROM tokens) SELECT {_TEXT} AS text, count(*) AS n FROM u GROUP BY 1")
def decoded_tokens(spark, sf_dir):
    """Token texts and how often they occur."""
    t = _tokens(spark, sf_dir).select(F.explode("tokens").alias("t"))
    return t.groupBy(V.decode_token(F.col("t")).alias("text")).agg(F.count("*").alias("n"))


@query("vocabulary_join", f"WITH {_TOKENS}, u AS (SELECT unnest(tokens) AS t FROM tokens) SELECT t AS token_id, CASE WHEN t < 3 THEN 'special' WHEN t < 8 THEN 'pause' WHEN t < 28 THEN 'whale' ELSE 'coda' END AS kind, count(*) AS n FROM u GROUP BY 1, 2")
def vocabulary_join(spark, sf_dir):
    """Counts joined to the 74-row vocabulary."""
    t = _tokens(spark, sf_dir).select(F.explode("tokens").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
    return t.join(F.broadcast(V.vocabulary(spark).select("token_id", "kind")), "token_id", "left").select("token_id", "kind", "n")


@query("token_kinds", f"WITH {_TOKENS}, u AS (SELECT unnest(tokens) AS t FROM tokens) SELECT count(*) FILTER (t >= 28) AS codas, count(*) FILTER (t BETWEEN 3 AND 7) AS pauses, count(*) FILTER (t BETWEEN 8 AND 27) AS whales FROM u")
def token_kinds(spark, sf_dir):
    """F16: the three predicates."""
    t = _tokens(spark, sf_dir).select(F.explode("tokens").alias("t"))
    return t.agg(F.count_if(V.is_coda(F.col("t"))).alias("codas"), F.count_if(V.is_pause(F.col("t"))).alias("pauses"), F.count_if(V.is_whale(F.col("t"))).alias("whales"))


@query("coda_distribution", f"WITH {_TOKENS}, u AS (SELECT unnest(tokens) AS t FROM tokens) SELECT {_TEXT} AS coda, count(*) AS n FROM u WHERE t >= 28 GROUP BY 1")
def coda_distribution(spark, sf_dir):
    """Type tokens."""
    return S.coda_distribution(_tokens(spark, sf_dir))


@query("coda_share", f"WITH {_TOKENS}, u AS (SELECT unnest(tokens) AS t FROM tokens), c AS (SELECT {_TEXT} AS coda, count(*) AS n FROM u WHERE t >= 28 GROUP BY 1) SELECT coda, round(n / sum(n) OVER (), 8) AS share FROM c")
def coda_share(spark, sf_dir):
    """Normalised; the total joins as one row."""
    c = S.coda_distribution(_tokens(spark, sf_dir))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("total")))).select("coda", F.round(F.col("n") / F.col("total"), 8).alias("share"))


@query("whale_transitions", f"""WITH {_TOKENS}, w AS (SELECT REC, list_filter(tokens, lambda t: t BETWEEN 8 AND 27) AS w FROM tokens),
  u AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM w) SELECT '<whale:' || (p[1] - 7) || '>' AS prev, '<whale:' || (p[2] - 7) || '>' AS cur, count(*) AS n FROM u GROUP BY 1, 2""")
def whale_transitions(spark, sf_dir):
    """Who follows whom."""
    return S.transitions(_tokens(spark, sf_dir))


@query("sequence_analysis", f"WITH {_TOKENS} SELECT count(*) AS n_sequences, round(avg(len(list_filter(tokens, lambda t: t >= 28))), 8) AS avg_codas_per_seq FROM tokens")
def sequence_analysis(spark, sf_dir):
    """Sequences and mean number of calls."""
    return S.sequence_summary(_tokens(spark, sf_dir)).withColumn("avg_codas_per_seq", F.round("avg_codas_per_seq", 8))


@query("real_vs_generated", f"""WITH {_TOKENS}, u AS (SELECT REC, unnest(tokens) AS t FROM tokens), r AS (SELECT {_TEXT} AS coda, count(*) AS n FROM u WHERE t >= 28 AND REC <= '2024-01-15' GROUP BY 1),
  g AS (SELECT {_TEXT} AS coda, count(*) AS n FROM u WHERE t >= 28 AND t % 3 <> 0 AND REC > '2024-01-15' GROUP BY 1) SELECT r.coda, r.n AS real_n, coalesce(g.n, 0) AS generated_n FROM r LEFT JOIN g USING (coda)""")
def real_vs_generated(spark, sf_dir):
    """Types of the real side only, missing ones 0."""
    t = _tokens(spark, sf_dir)
    real = S.coda_distribution(t.where("REC <= '2024-01-15'")).withColumnRenamed("n", "real_n")
    made = S.coda_distribution(t.where("REC > '2024-01-15'").withColumn("tokens", F.filter("tokens", lambda x: x % 3 != 0))).withColumnRenamed("n", "generated_n")
    return real.join(made, "coda", "left").select("coda", "real_n", F.coalesce("generated_n", F.lit(0)).alias("generated_n"))


@query("coda_bars", f"""WITH {_TOKENS}, u AS (SELECT REC, unnest(tokens) AS t FROM tokens), r AS (SELECT {_TEXT} AS coda, count(*) AS n FROM u WHERE t >= 28 AND REC <= '2024-01-15' GROUP BY 1),
  g AS (SELECT {_TEXT} AS coda, count(*) AS n FROM u WHERE t >= 28 AND t % 3 <> 0 AND REC > '2024-01-15' GROUP BY 1)
  SELECT (row_number() OVER (ORDER BY r.coda))::INTEGER AS place, r.coda, round(r.n / (SELECT sum(n) FROM r), 8) AS real, round(coalesce(g.n / (SELECT sum(n) FROM g), 0), 8) AS made FROM r LEFT JOIN g USING (coda)""")
def coda_bars(spark, sf_dir):
    """Bars of real and generated types, in the order of the real ones' names."""
    t = _tokens(spark, sf_dir)
    made = t.where("REC > '2024-01-15'").withColumn("tokens", F.filter("tokens", lambda x: x % 3 != 0))
    b = Y.distribution_bars(S.coda_distribution(t.where("REC <= '2024-01-15'")), S.coda_distribution(made))
    return b.select("place", "coda", F.round("real", 8).alias("real"), F.round("made", 8).alias("made"))


@query("chat_tokens", """WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 21 END AS w, turn * 3 AS ts FROM conversations),
  s AS (SELECT conv_id FROM c GROUP BY 1 HAVING count(*) >= 3), g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM c SEMI JOIN s USING (conv_id)),
  p AS (SELECT conv_id, turn, list_filter([CASE WHEN gap > 0 THEN CASE WHEN gap < 5 THEN 5 WHEN gap < 15 THEN 6 ELSE 7 END END, CASE WHEN w <= 20 THEN 7 + w END], lambda t: t IS NOT NULL) AS p FROM g)
  SELECT conv_id, array_to_string(list_concat([1], flatten(list(p ORDER BY turn)), [2]), ' ') AS tokens FROM p GROUP BY 1""")
def chat_tokens(spark, sf_dir):
    """A2 on conversations: speakers and pauses without types."""
    c = X.table(spark, sf_dir, "conversations")
    d = c.select("conv_id", "turn", F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(21).alias("Whale"), (F.col("turn") * 3).cast("double").alias("TsTo"))
    return S.tokenize(d, ["conv_id"], ["turn"]).select("conv_id", F.array_join("tokens", " ").alias("tokens"))


@query("dialogue_windows", f"""WITH {_TOKENS}, s AS (SELECT REC, tokens, len(tokens) AS n FROM tokens WHERE len(tokens) > 3),
  w AS (SELECT REC, n, tokens, unnest(CASE WHEN n <= 65 THEN [0] ELSE list_concat(range(0, n - 64, 32), [n - 65]) END) AS a FROM s)
  SELECT REC, a AS first, least(a + 65, n)::BIGINT AS last, list_sum(tokens[a + 1:a + 65])::BIGINT AS total FROM w""")
def dialogue_windows(spark, sf_dir):
    """Windows of 65 tokens, half overlapping, the tail always once more."""
    t = _tokens(spark, sf_dir).where(F.size("tokens") > 3)
    w = W.sliced(t, "tokens", 64, ["REC"])
    return w.select("REC", F.col("start").alias("first"), F.col("end").alias("last"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("cut_at_eos", f"""WITH {_TOKENS} SELECT REC, array_to_string(CASE WHEN list_position(tokens, 37) > 0 THEN tokens[1:list_position(tokens, 37)] ELSE tokens END, ' ') AS tokens FROM tokens""")
def cut_at_eos(spark, sf_dir):
    """Up to and with the first stop token (here 37)."""
    at = F.array_position("tokens", 37)
    return _tokens(spark, sf_dir).select("REC", F.array_join(F.when(at > 0, F.slice("tokens", F.lit(1), F.greatest(at, F.lit(1)).cast("int"))).otherwise(F.col("tokens")), " ").alias("tokens"))


@query("recording_splits", f"""WITH {D}, r AS (SELECT REC AS recording FROM dialogue GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT recording, row_number() OVER (ORDER BY md5('42' || recording), recording) - 1 AS i, count(*) OVER () AS n FROM r)
  SELECT recording, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM k""")
def recording_splits(spark, sf_dir):
    """80/10/10 by recording in the order of a seeded hash."""
    return W.split(S.dialogues(X.dialogue(spark, sf_dir)).select("recording"), "recording", 42, (0.8, 0.1))


@query("symbolic_datasets", f"""WITH a AS (SELECT 'coda' AS dataset, REC || ':' || Unit || ':' || UnitNum AS id, tokens, 16 AS l FROM (WITH {_CODA} SELECT * FROM tokens)
  UNION ALL SELECT 'dialogue', REC, tokens, 64 FROM (WITH {_TOKENS} SELECT * FROM tokens)),
  r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42' || id), id) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM a),
  s AS (SELECT dataset, id, tokens, l, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r WHERE len(tokens) > 3),
  w AS (SELECT *, unnest(CASE WHEN dataset = 'coda' OR len(tokens) <= l + 1 THEN [0] ELSE list_concat(range(0, len(tokens) - l, l // 2), [len(tokens) - l - 1]) END) AS start FROM s),
  p AS (SELECT dataset, split, id, start, l, list_concat(tokens[start + 1:start + l + 1], list_transform(range(0, greatest(0, l + 1 - len(tokens[start + 1:start + l + 1]))), lambda i: 0)) AS t FROM w)
  SELECT dataset, split, id, start::BIGINT AS start, md5(array_to_string(t[1:l], ' ')) AS input_ids, md5(array_to_string(t[2:l + 1], ' ')) AS target_ids, len(list_filter(t[1:l], lambda x: x <> 0))::BIGINT AS attended FROM p""")
def symbolic_datasets(spark, sf_dir):
    """Split by group, then sequences of types and windows of dialogues as padded examples."""
    d = X.dialogue(spark, sf_dir)
    e = DS.symbolic_datasets(d, d, ["REC", "Unit", "UnitNum"], ["event_id"], ["REC"], ["TsTo", "event_id"], 16, 64)
    return e.select("dataset", "split", "id", "start", F.md5(F.array_join("input_ids", " ")).alias("input_ids"), F.md5(F.array_join("target_ids", " ")).alias("target_ids"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))
