"""Queries over model arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.staging import staged
from ..operators import attention as T
from ..operators import generation as N
from ..operators import kernels as K
from ..operators import sequences as S
from ..operators import windows as W
from . import fixtures as X
from .registry import query
from .symbolic import _TOKENS, _tokens

L = X.LOGITS_SQL
_NLL = f"{L}, losses AS (SELECT vec_id, target, vec_id // 16 AS batch_id, CASE WHEN target <> 0 THEN ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - (logits[target + 1] - list_max(logits)) END AS nll FROM logits)"


def losses(spark, sf_dir):
    return X.logits(spark, sf_dir).select("vec_id", "target", F.floor(F.col("vec_id") / 16).alias("batch_id"), K.nll(F.col("logits"), F.col("target")).alias("nll"))


@query("cross_entropy", f"WITH {_NLL} SELECT vec_id, round(nll, 6) AS nll FROM losses WHERE target <> 0")
def cross_entropy(spark, sf_dir):
    """M1: padding targets take no part."""
    return losses(spark, sf_dir).where("target <> 0").select("vec_id", F.round("nll", 6).alias("nll"))


@query("perplexity", f"WITH {_NLL} SELECT round(exp(sum(nll) / greatest(count(nll), 1)), 5) AS perplexity, count(nll) AS total_tokens FROM losses")
def perplexity(spark, sf_dir):
    """Weighed by token."""
    return K.perplexity(losses(spark, sf_dir)).withColumn("perplexity", F.round("perplexity", 5))


@query("macro_loss", f"WITH {_NLL}, b AS (SELECT batch_id, avg(nll) AS m FROM losses WHERE batch_id < 20 GROUP BY 1) SELECT round(avg(m), 6) AS val_loss, count(*) AS n_batches, round(exp(avg(m)), 4) AS perplexity FROM b")
def macro_loss(spark, sf_dir):
    """Mean of batch means with a cap on batches."""
    m = K.macro_loss(losses(spark, sf_dir), "batch_id", 20)
    return m.select(F.round("val_loss", 6).alias("val_loss"), "n_batches", F.round(F.exp("val_loss"), 4).alias("perplexity"))


_TOP = f"{L}, o AS (SELECT vec_id, target, list_sort(list_transform(logits, lambda x, i: {{'x': -x, 'i': i - 1}})) AS s FROM logits), tops AS (SELECT vec_id, target, list_transform(s[1:5], lambda p: p.i) AS top FROM o)"


@query("accuracy", f"WITH {_TOP} SELECT round(count(*) FILTER (top[1] = target) / greatest(count(*), 1), 8) AS top1_accuracy, round(count(*) FILTER (list_contains(top, target)) / greatest(count(*), 1), 8) AS topk_accuracy, count(*) AS total_tokens FROM tops WHERE target <> 0")
def accuracy(spark, sf_dir):
    """Top-1 and top-5 over all targets but padding."""
    a = K.accuracy(X.logits(spark, sf_dir))
    return a.select(F.round("top1_accuracy", 8).alias("top1_accuracy"), F.round("topk_accuracy", 8).alias("topk_accuracy"), "total_tokens")


_TYPES = ", ".join(f"'{t}'" for t in V.CODA_TYPES)


@query("accuracy_by_type", f"WITH {_TOP}, t AS (SELECT target, avg((top[1] = target)::INT) AS a, count(*) AS n FROM tops WHERE target >= 28 GROUP BY 1) SELECT [{_TYPES}][target - 27] AS type, round(a, 8) AS accuracy, n FROM t ORDER BY a DESC, 1 LIMIT 10")
def accuracy_by_type(spark, sf_dir):
    """By call type, the ten best."""
    a = K.accuracy_by_target(X.logits(spark, sf_dir), V.decode_token)
    return a.select("type", F.round("accuracy", 8).alias("accuracy"), "n").orderBy(F.desc("accuracy"), "type").limit(10)


@query("top5_predictions", f"WITH {_TOP} SELECT vec_id, array_to_string(top, ' ') AS top FROM tops")
def top5_predictions(spark, sf_dir):
    """L4: the five likeliest tokens."""
    return X.logits(spark, sf_dir).select("vec_id", F.array_join(K.top_tokens(F.col("logits"), 5), " ").alias("top"))


_R = f"{L}, r AS (SELECT vec_id, target, list_transform(logits, lambda x: round(x)) AS logits FROM logits)"


@query("top_k_mask", f"WITH {_R} SELECT vec_id, len(list_filter(logits, lambda x: x >= list_sort(logits, 'DESC')[5]))::BIGINT AS kept FROM r")
def top_k_mask(spark, sf_dir):
    """Ties with the k-th stay."""
    r = X.logits(spark, sf_dir).select("vec_id", F.transform("logits", lambda x: F.round(x)).alias("logits"))
    return r.select("vec_id", F.size(F.filter(K.top_k_mask(F.col("logits"), 5), lambda x: x.isNotNull())).cast("long").alias("kept"))


@query("nucleus", f"""WITH {L}, e AS (SELECT vec_id, unnest(list_transform(logits, lambda x, i: {{'i': i - 1, 'e': exp(x - list_max(logits))}})) AS s FROM logits), p AS (SELECT vec_id, s.i AS i, s.e / sum(s.e) OVER (PARTITION BY vec_id) AS p FROM e),
  c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT vec_id, count(*) AS kept, sum(i)::BIGINT AS ids FROM c WHERE before <= 0.9 GROUP BY 1""")
def nucleus(spark, sf_dir):
    """Cumulative probability, shifted by one."""
    kept = F.filter(F.transform(K.nucleus(F.col("logits"), 0.9), lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    n = X.logits(spark, sf_dir).select("vec_id", kept.alias("k"))
    return n.select("vec_id", F.size("k").cast("long").alias("kept"), F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query("sampled_tokens", f"""WITH {L}, z AS (SELECT vec_id, list_transform(logits, lambda x: x / 0.8) AS z FROM logits), k AS (SELECT vec_id, z, list_sort(z, 'DESC')[10] AS kth FROM z),
  e AS (SELECT vec_id, unnest(list_transform(z, lambda x, i: {{'i': i - 1, 'e': CASE WHEN x >= kth THEN exp(x - list_max(z)) ELSE 0 END}})) AS s FROM k), p AS (SELECT vec_id, s.i AS i, s.e / sum(s.e) OVER (PARTITION BY vec_id) AS p FROM e),
  c AS (SELECT vec_id, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM p) SELECT vec_id, min(i) AS token FROM c WHERE ('0x' || substr(md5('9:' || vec_id), 1, 8))::BIGINT / 4294967296.0 < c GROUP BY 1""")
def sampled_tokens(spark, sf_dir):
    """M2: temperature, top-k, inverse distribution of a seeded uniform."""
    u = W.uniform(F.lit("9"), F.col("vec_id").cast("string"))
    return X.logits(spark, sf_dir).select("vec_id", K.sample(F.col("logits"), u, 0.8, 10).cast("long").alias("token"))


@query("greedy_tokens", f"WITH {_TOP} SELECT vec_id, top[1] AS token FROM tops")
def greedy_tokens(spark, sf_dir):
    """M2 at temperature 0."""
    return X.logits(spark, sf_dir).select("vec_id", K.sample(F.col("logits"), F.lit(0.0), 0).cast("long").alias("token"))


@query("context_crop", f"WITH {_TOKENS} SELECT REC, array_to_string(tokens[greatest(len(tokens) - 31, 1):], ' ') AS context, list_contains(tokens[greatest(len(tokens) - 31, 1):], 2) AS ended FROM tokens")
def context_crop(spark, sf_dir):
    """M3: the last tokens, and whether the sequence has ended."""
    c = K.cropped(F.col("tokens"), 32)
    return _tokens(spark, sf_dir).select("REC", F.array_join(c, " ").alias("context"), F.array_contains(c, 2).alias("ended"))


_E = X.AUDIO_SQL + ", experts AS (SELECT vec_id, list_transform(samples, lambda x: x * 10) AS logits FROM audio)"


def experts(spark, sf_dir):
    return X.audio(spark, sf_dir).select("vec_id", F.transform("samples", lambda x: x * 10).alias("logits"))


@query("expert_routing", f"""WITH {_E}, o AS (SELECT vec_id, list_sort(list_transform(logits, lambda x, i: {{'x': -x, 'i': i - 1}}))[1:2] AS s FROM experts),
  u AS (SELECT vec_id, unnest([0, 1]) AS slot, unnest(s) AS p, list_sum(list_transform(s, lambda q: exp(-q.x))) AS total FROM o) SELECT vec_id, slot, p.i AS expert, round(exp(-p.x) / total, 8) AS weight FROM u""")
def expert_routing(spark, sf_dir):
    """M7: two experts, softmax over the two."""
    return K.route(experts(spark, sf_dir), "vec_id", "logits", 2).withColumn("weight", F.round("weight", 8))


@query("load_balance", f"""WITH {_E}, o AS (SELECT vec_id, logits, list_transform(list_sort(list_transform(logits, lambda x, i: {{'x': -x, 'i': i - 1}}))[1:2], lambda p: p.i) AS b FROM experts),
  u AS (SELECT unnest(range(0, 64)) AS expert, unnest(list_transform(logits, lambda x: exp(x) / list_sum(list_transform(logits, lambda y: exp(y))))) AS p, b FROM o), g AS (SELECT expert, count(*) FILTER (list_contains(b, expert)) AS a, avg(p) AS p FROM u GROUP BY 1)
  SELECT round(count(*) * sum(a * p) / sum(a), 8) AS aux_loss FROM g""")
def load_balance(spark, sf_dir):
    """Share of assignments times mean probability."""
    return K.load_balance(experts(spark, sf_dir), "logits", 2).withColumn("aux_loss", F.round("aux_loss", 8))


@query("attention_band", "WITH s AS (SELECT conv_id AS seq, count(*) * 4 AS n FROM conversations GROUP BY 1), q AS (SELECT seq, unnest(range(0, n)) AS q FROM s) SELECT seq, q, sum(least(q + 1, 6))::BIGINT AS keys, sum(greatest(0, q - 5))::BIGINT AS first_key FROM q GROUP BY 1, 2")
def attention_band(spark, sf_dir):
    """Keys within a sliding window."""
    p = X.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("seq")).agg((F.count("*") * 4).cast("int").alias("n"))
    return K.attention_span(p, 6).groupBy("seq", "q").agg(F.count("*").alias("keys"), F.min("k").cast("long").alias("first_key"))


@query("attention_output", """WITH a AS (SELECT vec_id // 8 AS seq, vec_id % 8 AS pos, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS qk, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE * x::DOUBLE)) AS v FROM embeddings),
  s AS (SELECT q.seq, q.pos, exp(q.qk * k.qk) AS e, k.v FROM a q JOIN a k ON q.seq = k.seq AND k.pos BETWEEN q.pos - 3 AND q.pos) SELECT seq, pos, round(sum(e * v) / sum(e), 8) AS output FROM s GROUP BY 1, 2""")
def attention_output(spark, sf_dir):
    """M5: softmax-weighed values over the band, on arrays of a sequence."""
    total = lambda f: F.aggregate("embedding", F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    e = X.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("seq"), (F.col("vec_id") % 8).alias("pos"), total(lambda x: x).alias("qk"), total(lambda x: x * x * x).alias("v"))
    keys = e.select("seq", F.explode(F.array(*[F.col("pos") + d for d in range(4)])).alias("pos"), F.col("qk").alias("kk"), "v")
    j = e.select("seq", "pos", "qk").join(keys, ["seq", "pos"]).withColumn("e", F.exp(F.col("qk") * F.col("kk")))
    return j.groupBy("seq", "pos").agg(F.round(F.sum(F.col("e") * F.col("v")) / F.sum("e"), 8).alias("output"))


@query("rotary_table", "WITH g AS (SELECT conv_id, turn::BIGINT * 8 AS pos, unnest(range(0, 16)) AS i FROM conversations) SELECT conv_id, pos, i, round(cos(pos / pow(10000, 2.0 * i / 32)), 8) AS cos, round(sin(pos / pow(10000, 2.0 * i / 32)), 8) AS sin FROM g")
def rotary_table(spark, sf_dir):
    """M4: angles of the place where each turn of each conversation starts."""
    p = X.table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn").cast("long") * 8).alias("pos"))
    return K.rotary_angles(p, 32).select("conv_id", "pos", "i", F.round("cos", 8).alias("cos"), F.round("sin", 8).alias("sin"))


@query("rotated_vectors", """WITH a AS (SELECT vec_id, (vec_id % 100)::DOUBLE AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
  r AS (SELECT vec_id, list_transform(range(0, 64), lambda i: x[i + 1] * cos(pos / pow(10000, 2.0 * (i % 32) / 64)) + CASE WHEN i < 32 THEN -x[i + 33] ELSE x[i - 31] END * sin(pos / pow(10000, 2.0 * (i % 32) / 64))) AS y FROM a)
  SELECT vec_id, round(y[1], 7) AS first, round(y[33], 7) AS middle, round(list_sum(y), 6) AS total FROM r""")
def rotated_vectors(spark, sf_dir):
    """M4: rotate-half."""
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 100).cast("double").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    y = e.select("vec_id", K.rotated(F.col("x"), F.col("pos"), 64).alias("y"))
    return y.select("vec_id", F.round(F.col("y")[0], 7).alias("first"), F.round(F.col("y")[32], 7).alias("middle"), F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("swiglu", "SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE / (1 + exp(-embedding[i]::DOUBLE)) * embedding[i + 32]::DOUBLE)), 8) AS total FROM embeddings")
def swiglu(spark, sf_dir):
    """M6: gated halves."""
    d = lambda a: F.transform(a, lambda x: x.cast("double"))
    e = X.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.aggregate(K.swiglu(d(F.slice("embedding", 1, 32)), d(F.slice("embedding", 33, 32))), F.lit(0.0), lambda a, x: a + x), 8).alias("total"))


_P = "presets(preset, n_layers, n_heads, d_model, d_ff, swa_window_size, full_attention_every_n, n_experts, moe_top_k, expert_d_ff) AS (VALUES " + ", ".join(str(p) for p in K.PRESETS) + ")"


_NAMES = [p[0] for p in K.PRESETS]


@query("layer_kinds", f"""WITH {_P}, v AS (SELECT {_NAMES}[(doc_id % {len(_NAMES)} + 1)::INTEGER] AS preset, 1 + n_chars % 5 AS w, count(*) AS runs FROM documents GROUP BY 1, 2),
  l AS (SELECT preset, w, runs, swa_window_size * w AS swa, full_attention_every_n AS n, unnest(range(0, n_layers)) AS layer FROM presets JOIN v USING (preset))
  SELECT w::BIGINT AS w, preset, max(runs) AS runs, count(*) FILTER (swa > 0 AND n > 0 AND (layer + 1) % CASE WHEN n > 0 THEN n ELSE 1 END <> 0) AS sliding, count(*) AS layers FROM l GROUP BY 1, 2""")
def layer_kinds(spark, sf_dir):
    """Which layers slide, for the preset and window factor of each document."""
    d = X.table(spark, sf_dir, "documents")
    preset = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    runs = d.groupBy(preset.alias("preset"), (1 + F.col("n_chars") % 5).cast("long").alias("w")).agg(F.count("*").alias("runs"))
    p = runs.join(F.broadcast(K.presets(spark)), "preset").withColumn("swa_window_size", F.col("swa_window_size") * F.col("w"))
    kinds = K.layer_kinds(p.withColumn("preset", F.concat_ws("|", "preset", F.col("w").cast("string"), F.col("runs").cast("string"))))
    g = kinds.groupBy("preset").agg(F.count_if("sliding").alias("sliding"), F.count("*").alias("layers"))
    parts = F.split("preset", r"\|")
    return g.select(parts[1].cast("long").alias("w"), parts[0].alias("preset"), parts[2].cast("long").alias("runs"), "sliding", "layers")


@query("parameter_counts", f"WITH {_P}, v AS (SELECT DISTINCT source, 1024 * (1 + doc_id % 4) + 3 AS vocab FROM documents) SELECT preset, vocab, count(*) AS runs, max(vocab * d_model + n_layers * (4 * d_model * d_model + CASE WHEN n_experts > 0 THEN n_experts * 3 * d_model * expert_d_ff ELSE 3 * d_model * d_ff END))::BIGINT AS parameters FROM presets, v GROUP BY 1, 2")
def parameter_counts(spark, sf_dir):
    """Weights per preset and vocabulary, embeddings tied."""
    v = X.table(spark, sf_dir, "documents").select("source", (1024 * (1 + F.col("doc_id") % 4) + 3).alias("vocab")).distinct()
    p = v.join(F.broadcast(K.presets(spark)))
    block = 4 * F.col("d_model") * F.col("d_model") + F.when(F.col("n_experts") > 0, F.col("n_experts") * 3 * F.col("d_model") * F.col("expert_d_ff")).otherwise(3 * F.col("d_model") * F.col("d_ff"))
    return p.groupBy("preset", "vocab").agg(F.count("*").alias("runs"), F.max(F.col("vocab") * F.col("d_model") + F.col("n_layers") * block).alias("parameters"))


_BI = f"{_TOKENS}, pairs AS (SELECT REC, unnest(list_transform(range(1, len(tokens)), lambda i: [tokens[i], tokens[i + 1]])) AS p FROM tokens)"


@query("bigram_counts", f"WITH {_BI} SELECT p[1] AS prev, p[2] AS cur, count(*) AS n FROM pairs GROUP BY 1, 2")
def bigram_counts(spark, sf_dir):
    """Counts in place of a trained network."""
    return K.ngram_counts(_tokens(spark, sf_dir))


@query("bigram_perplexity", f"""WITH {_BI}, c AS (SELECT p[1] AS prev, p[2] AS cur, count(*) AS n FROM pairs WHERE REC <= '2024-01-24' GROUP BY 1, 2), t AS (SELECT prev, sum(n) AS total FROM c GROUP BY 1),
  s AS (SELECT p[1] AS prev, p[2] AS cur FROM pairs WHERE REC > '2024-01-24') SELECT round(exp(-avg(ln((coalesce(c.n, 0) + 1) / (coalesce(t.total, 0) + 74)))), 6) AS perplexity, count(*) AS total_tokens FROM s LEFT JOIN c USING (prev, cur) LEFT JOIN t ON t.prev = s.prev""")
def bigram_perplexity(spark, sf_dir):
    """Held-out sequences under the counts of the others."""
    t = _tokens(spark, sf_dir)
    out = K.ngram_perplexity(t.where("REC > '2024-01-24'"), K.ngram_counts(t.where("REC <= '2024-01-24'")), V.VOCAB_SIZE)
    return out.withColumn("perplexity", F.round("perplexity", 6))


def _grown_sql(prompt: str, steps: int, seed: int) -> str:
    """Back-off n-grams of orders 1 to 4 and a walk by the same md5 uniforms."""
    return f"""WITH RECURSIVE {_TOKENS}, i AS (SELECT tokens, unnest(range(1, len(tokens) + 1)) AS i FROM tokens), k AS (SELECT tokens, i, unnest(range(0, least(i, 4))) AS k FROM i),
  g AS (SELECT array_to_string(tokens[i - k:i - 1], ' ') AS context, tokens[i] AS token, count(*) AS n FROM k GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, token) AS r FROM g), c AS (SELECT context, list(token ORDER BY r) AS token, list(n ORDER BY r) AS n FROM b WHERE r <= 8 GROUP BY context),
  w AS (SELECT REC AS id, 0 AS step, {prompt} AS tokens, false AS done FROM tokens
  UNION ALL SELECT id, step + 1, list_append(tokens, token), token = 2 FROM (
    SELECT id, step, tokens, token[len(list_filter(list_transform(range(1, len(n) + 1), lambda j: list_sum(n[1:j])), lambda x: x <= u * list_sum(n))) + 1] AS token FROM (
      SELECT w.id, w.step, w.tokens, coalesce(c3.token, c2.token, c1.token, c0.token) AS token, coalesce(c3.n, c2.n, c1.n, c0.n) AS n,
        ('0x' || substr(md5('{seed}:' || w.step || ':' || w.id), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM w LEFT JOIN c c3 ON len(w.tokens) >= 3 AND c3.context = array_to_string(w.tokens[-3:], ' ') LEFT JOIN c c2 ON len(w.tokens) >= 2 AND c2.context = array_to_string(w.tokens[-2:], ' ')
        LEFT JOIN c c1 ON len(w.tokens) >= 1 AND c1.context = array_to_string(w.tokens[-1:], ' ') LEFT JOIN c c0 ON c0.context = '' WHERE NOT w.done AND w.step < {steps})))
  SELECT id, array_to_string(arg_max(tokens, step), ' ') AS tokens, bool_or(done) AS done FROM w GROUP BY id"""


def _grown(spark, sf_dir, prompt, steps, seed):
    t = _tokens(spark, sf_dir).select(F.col("REC").alias("id"), "tokens")
    return N.continued(t.select("id", prompt.alias("tokens")), staged(N.backoff_table(t)), steps, seed, V.EOS).withColumn("tokens", F.array_join("tokens", " "))


@query("generated_sequences", _grown_sql("tokens[1:1]", 24, 3))
def generated_sequences(spark, sf_dir):
    """Sequences from their first token alone, by back-off n-grams and recursive SQL."""
    return _grown(spark, sf_dir, F.slice("tokens", 1, 1), 24, 3)


@query("prompted_sequences", _grown_sql("tokens[1:16]", 12, 5))
def prompted_sequences(spark, sf_dir):
    """Prompts of sixteen tokens continued."""
    return _grown(spark, sf_dir, F.slice("tokens", 1, 16), 12, 5)


@query("blocked_attention", """WITH a AS (SELECT vec_id // 100 AS seq, vec_id % 100 AS pos, list_transform(embedding, lambda x: x::DOUBLE * 8) AS q, list_reverse(list_transform(embedding, lambda x: x::DOUBLE * 8)) AS k, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  p AS (SELECT a.seq, a.pos, h, exp(list_dot_product(a.q[h * 16 + 1:h * 16 + 16], b.k[h * 16 + 1:h * 16 + 16]) / 4) AS e, b.v[h * 16 + 1:h * 16 + 16] AS v FROM a JOIN a b ON a.seq = b.seq AND b.pos > a.pos - 24 AND b.pos <= a.pos, range(0, 4) t(h)),
  s AS (SELECT seq, pos, h, sum(e) AS total FROM p GROUP BY ALL), u AS (SELECT seq, pos, h, unnest(range(0, 16)) AS i, e, unnest(v) AS v FROM p)
  SELECT seq, pos, h::INTEGER AS head, i::INTEGER AS i, round(sum(e * v) / any_value(total), 7) AS output FROM u JOIN s USING (seq, pos, h) GROUP BY seq, pos, h, i""")
def blocked_attention(spark, sf_dir):
    """Four heads of sixteen over all components, blocks of sixteen positions merged by an online softmax."""
    x = lambda by: F.transform("embedding", lambda v: v.cast("double") * by)
    e = X.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 100").alias("seq"), (F.col("vec_id") % 100).alias("pos"), x(8).alias("q"), F.reverse(x(8)).alias("k"), x(1).alias("v"))
    o = T.banded_attention(e, 24, heads=4, block=16)
    return o.select("seq", "pos", "head", F.posexplode("output").alias("i", "o")).select("seq", "pos", "head", "i", F.round("o", 7).alias("output"))
