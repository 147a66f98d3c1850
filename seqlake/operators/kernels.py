"""Model arithmetic as relational operators: losses, sampling, routing, attention tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.vocabulary import is_coda

# The published model sizes.
PRESETS = (
    ("tiny", 6, 4, 256, 1024, 0, 0, 0, 0, 0), ("small", 8, 8, 512, 2048, 0, 0, 0, 0, 0), ("medium", 12, 12, 768, 3072, 0, 0, 0, 0, 0),
    ("large", 16, 16, 1024, 4096, 0, 0, 0, 0, 0), ("xlarge", 24, 16, 1280, 5120, 0, 0, 0, 0, 0),
    ("small_swa_moe", 8, 8, 512, 2048, 512, 5, 8, 2, 512), ("medium_swa_moe", 12, 12, 768, 3072, 1024, 5, 8, 2, 768), ("large_swa_moe", 16, 16, 1024, 4096, 1024, 5, 8, 2, 1024),
)
PRESET_COLUMNS = "preset string, n_layers int, n_heads int, d_model int, d_ff int, swa_window_size int, full_attention_every_n int, n_experts int, moe_top_k int, expert_d_ff int"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), PRESET_COLUMNS)


def with_overrides(configs: DataFrame, **values) -> DataFrame:
    """Preset columns replaced by what is given (None keeps the preset's)."""
    return configs.withColumns({k: F.coalesce(F.lit(v), F.col(k)) for k, v in values.items() if v is not None})


def layer_kinds(configs: DataFrame) -> DataFrame:
    """preset, layer, sliding: every n-th layer attends to all."""
    n = F.col("full_attention_every_n")
    rows = configs.select("preset", "swa_window_size", "full_attention_every_n", F.explode(F.sequence(F.lit(0), F.col("n_layers") - 1)).alias("layer"))
    return rows.select("preset", "layer", ((F.col("swa_window_size") > 0) & (n > 0) & ((F.col("layer") + 1) % F.when(n > 0, n) != 0)).alias("sliding")).fillna(False, ["sliding"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """Null logits are masked: probability 0."""
    def shares(z: Column) -> Column:
        return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.coalesce(F.exp(x - top), F.lit(0.0))), lambda e: let(_sum(e), lambda s: F.transform(e, lambda x: x / s))))

    return let(logits, shares)


def nll(logits: Column, target: Column) -> Column:
    """Cross-entropy of the target's logit; null for padding (0), which takes no part."""
    def loss(z: Column, top: Column) -> Column:
        return F.log(_sum(F.transform(z, lambda x: F.exp(x - top)))) - (F.element_at(z, target + 1) - top)

    return F.when(target != 0, let(logits, lambda z: let(F.array_max(z), lambda top: loss(z, top))))


def perplexity(losses: DataFrame, column: str = "nll") -> DataFrame:
    """Weighed by token: exp of all losses' sum over their number."""
    return losses.agg(F.exp(F.coalesce(F.sum(column), F.lit(0.0)) / F.greatest(F.count(column), F.lit(1))).alias("perplexity"), F.count(column).alias("total_tokens"))


def macro_loss(losses: DataFrame, batch: str, most: int | None = None, column: str = "nll") -> DataFrame:
    """Mean of batch means, of the first ``most`` batches."""
    part = losses if most is None else losses.where(F.col(batch) < most)
    return part.groupBy(batch).agg(F.avg(column).alias("m")).agg(F.avg("m").alias("val_loss"), F.count("*").alias("n_batches"))


def argmax(logits: Column) -> Column:
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def top_tokens(logits: Column, k: int) -> Column:
    """The k best token ids, ties to the smaller id."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def accuracy(predictions: DataFrame, k: int = 5) -> DataFrame:
    """top1_accuracy, topk_accuracy, total_tokens over rows whose target is no padding."""
    t = predictions.where("target <> 0").select(F.col("target"), argmax(F.col("logits")).alias("p"), top_tokens(F.col("logits"), k).alias("top"))
    n = F.greatest(F.count("*"), F.lit(1))
    return t.agg((F.count_if(F.col("p") == F.col("target")) / n).alias("top1_accuracy"), (F.count_if(F.array_contains("top", F.col("target"))) / n).alias("topk_accuracy"), F.count("*").alias("total_tokens"))


def accuracy_by_target(predictions: DataFrame, name) -> DataFrame:
    """type, accuracy, n for each call type that is a target; other kinds of tokens have no row."""
    t = predictions.where(is_coda(F.col("target"))).select(F.col("target"), (argmax(F.col("logits")) == F.col("target")).cast("int").alias("ok"))
    return t.groupBy(name(F.col("target")).alias("type")).agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n"))


def top_k_mask(logits: Column, k: int) -> Column:
    """Logits under the k-th largest become null; all that tie with it stay."""
    def masked(z: Column) -> Column:
        return F.when(F.size(z) <= k, z).otherwise(let(F.element_at(F.sort_array(z, asc=False), k), lambda kth: F.transform(z, lambda x: F.when(x >= kth, x))))

    return let(logits, masked)


def nucleus(logits: Column, top_p: float) -> Column:
    """Logits outside the nucleus become null: a token stays if the probability before it is at most ``top_p``.

    The most likely token always stays. Ties are ordered by id.
    """
    def kept(z: Column) -> Column:
        order = F.array_sort(F.transform(softmax(z), lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
        return F.aggregate(
            order, F.struct(F.lit(0.0).alias("c"), F.array().cast("array<int>").alias("kept")),
            lambda a, t: F.struct((a["c"] - t["x"]).alias("c"), F.when((a["c"] <= top_p) & (t["x"] < 0), F.concat(a["kept"], F.array(t["i"]))).otherwise(a["kept"]).alias("kept")),
            lambda a: a["kept"],
        )

    return let(logits, lambda z: let(kept(z), lambda ids: F.transform(z, lambda x, i: F.when(F.array_contains(ids, i), x))))


def sample(logits: Column, uniform: Column, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None) -> Column:
    """A token by inverse distribution of a uniform number; the likeliest at temperature 0."""
    if temperature == 0:
        return argmax(logits)
    z = F.transform(logits, lambda x: x / temperature)
    z = top_k_mask(z, top_k) if top_k else z
    z = nucleus(z, top_p) if top_p else z

    def walk(z: Column, u: Column) -> Column:
        return F.aggregate(
            softmax(z), F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i"), F.lit(-1).alias("hit")),
            lambda a, p: F.struct((a["c"] + p).alias("c"), (a["i"] + 1).alias("i"), F.when((a["hit"] < 0) & (u < a["c"] + p), a["i"]).otherwise(a["hit"]).alias("hit")),
            lambda a: F.when(a["hit"] < 0, F.array_position(z, F.array_max(z)).cast("int") - 1).otherwise(a["hit"]),
        ).cast("int")

    return let(z, lambda v: let(uniform, lambda u: walk(v, u)))


def cropped(tokens: Column, most: int) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - most + 1, F.lit(1)), F.lit(most))


def route(tokens: DataFrame, key: str, logits: str, k: int) -> DataFrame:
    """key, slot, expert, weight: the k best experts, softmax over them alone."""
    best = top_tokens(F.col(logits), k)
    chosen = tokens.select(key, F.col(logits).alias("__l"), best.alias("__b"))
    w = softmax(F.transform("__b", lambda i: F.element_at(F.col("__l"), i + 1)))
    return chosen.select(key, F.posexplode(F.arrays_zip(F.col("__b").alias("expert"), w.alias("weight"))).alias("slot", "z")).select(key, "slot", "z.expert", "z.weight")


def load_balance(tokens: DataFrame, logits: str, k: int) -> DataFrame:
    """aux_loss: experts times the sum of assigned share times mean probability."""
    rows = tokens.select(top_tokens(F.col(logits), k).alias("b"), softmax(F.col(logits)).alias("p"))
    long = rows.select(F.posexplode("p").alias("expert", "p"), "b").select("expert", "p", F.array_contains("b", F.col("expert")).cast("int").alias("a"))
    per = long.groupBy("expert").agg(F.sum("a").alias("a"), F.avg("p").alias("p"))
    return per.agg((F.count("*") * F.sum(F.col("a") * F.col("p")) / F.sum("a")).alias("aux_loss"))


def attention_span(positions: DataFrame, window: int | None) -> DataFrame:
    """seq, q, k: keys a query may see; the band is generated, not joined."""
    low = F.lit(0) if window is None else F.greatest(F.lit(0), F.col("q") - window + 1)
    rows = positions.select("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"))
    return rows.select("seq", "q", F.explode(F.sequence(low, F.col("q"))).alias("k"))


def rotary_angles(positions: DataFrame, dim: int, base: float = 10000.0) -> DataFrame:
    """``positions`` (pos and any columns) with i, cos, sin: a row for each of dim // 2 angles."""
    angle = F.col("pos") / F.pow(F.lit(base), 2.0 * F.col("i") / dim)
    grid = positions.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dim // 2 - 1).cast("long"))).alias("i"))
    return grid.select("*", F.cos(angle).alias("cos"), F.sin(angle).alias("sin"))


def rotary_table(spark: SparkSession, positions: int, dim: int, base: float = 10000.0) -> DataFrame:
    """pos, i, cos, sin of the first ``positions``."""
    return rotary_angles(spark.range(positions).withColumnRenamed("id", "pos"), dim, base)


def rotated(x: Column, pos: Column, dim: int, base: float = 10000.0) -> Column:
    """Halves rotated against each other by the position's angles."""
    half = dim // 2

    def one(i: Column) -> Column:
        angle = pos / F.pow(F.lit(base), 2.0 * (i % half) / dim)
        other = F.when(i < half, -F.try_element_at(x, i + half + 1)).otherwise(F.try_element_at(x, F.greatest(i - half, F.lit(0)) + 1))
        return F.element_at(x, i + 1) * F.cos(angle) + other * F.sin(angle)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one)


def swiglu(gate: Column, up: Column) -> Column:
    """silu(gate) * up, element by element."""
    return F.zip_with(gate, up, lambda g, u: g / (1 + F.exp(-g)) * u)


def ngram_counts(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """prev, cur, n: a bigram model in place of a trained network."""
    a = F.col(column)
    pairs = F.arrays_zip(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))).alias("prev"), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))).alias("cur"))
    return sequences.select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.cur").agg(F.count("*").alias("n"))


def ngram_perplexity(sequences: DataFrame, counts: DataFrame, vocab_size: int, column: str = "tokens") -> DataFrame:
    """Perplexity of sequences under add-one smoothed bigrams."""
    seen = ngram_counts(sequences, column).withColumnRenamed("n", "m")
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    joined = seen.join(counts, ["prev", "cur"], "left").join(totals, "prev", "left")
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + vocab_size)
    return joined.agg(F.exp(-F.sum(F.col("m") * F.log(p)) / F.sum("m")).alias("perplexity"), F.sum("m").alias("total_tokens"))


def generate(prompts: DataFrame, counts: DataFrame, steps: int, seed: int, end: int, top_k: int = 8) -> DataFrame:
    """Prompts continued by the bigram model's top-k choices, stopping at ``end``.

    The model becomes one row per token: its likeliest followers. Each step is
    a broadcast-size-checked join on the last token; Spark decides by the
    table's size.
    """
    from .windows import uniform

    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("n"), "cur"))).where(F.col("r") <= top_k)
    table = ranked.groupBy("prev").agg(F.array_sort(F.collect_list(F.struct("r", "cur", "n"))).alias("next"))
    out = prompts.select("id", "tokens", F.lit(False).alias("done"))
    for step in range(steps):
        u = uniform(F.lit(str(seed)), F.lit(str(step)), F.col("id").cast("string"))
        joined = out.withColumn("prev", F.element_at("tokens", -1)).join(table, "prev", "left")
        total = F.aggregate("next", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        pick = F.aggregate("next", F.struct(F.lit(0).cast("long").alias("c"), F.lit(-1).alias("hit")), lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when((a["hit"] < 0) & (u * total < a["c"] + x["n"]), x["cur"]).otherwise(a["hit"]).alias("hit")), lambda a: a["hit"])
        chosen = F.coalesce(pick, F.lit(end))
        out = joined.select("id", F.when(F.col("done"), F.col("tokens")).otherwise(F.concat("tokens", F.array(chosen))).alias("tokens"), (F.col("done") | (chosen == end)).alias("done"))
    return out.select("id", "tokens", "done")
