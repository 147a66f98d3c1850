"""Call annotations to token sequences: grouping, gaps, tokenising, analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def is_noise(coda_type: Column) -> Column:
    """Null types are no noise."""
    return F.coalesce(coda_type.contains("NOISE"), F.lit(False))


def _order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    out = []
    for c in order:
        x = F.nanvl(F.col(c), F.lit(None)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c)
        out.append(x.asc_nulls_last())
    return out


def large_enough(df: DataFrame, keys: Sequence[str], least: int = 3) -> DataFrame:
    """Rows of groups with at least ``least`` rows; rows with a null key belong to no group."""
    whole = df.where(F.expr(" and ".join(f"{k} is not null" for k in keys)))
    return whole.withColumn("n_codas", F.count("*").over(Window.partitionBy(*keys))).where(F.col("n_codas") >= least)


def gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``gap``: time since the row before it in its group, less the row's own duration.

    A null time before gives a null gap; rows are not skipped over.
    """
    w = Window.partitionBy(*keys).orderBy(*_order(df, order))
    own = F.nanvl(F.col("Duration"), F.lit(None)) if "Duration" in df.columns else F.lit(0.0)
    before = F.lag(F.nanvl(F.col("TsTo"), F.lit(None))).over(w)
    return df.withColumn("gap", F.nanvl(F.col("TsTo"), F.lit(None)) - before - own)


def tokenize(df: DataFrame, keys: Sequence[str], order: Sequence[str], pauses: bool = True, whales: bool = True, drop_noise: bool = True, least: int = 3) -> DataFrame:
    """One row per group of at least ``least`` rows: keys, n_codas, tokens.

    A row gives its pause, individual and type tokens, as far as it has them;
    noise rows are left out before gaps are measured. One shuffle by the keys:
    the group count, the gaps and the list share it.
    """
    rows = large_enough(df, keys, least)
    kept = rows.withColumn("__noise", is_noise(F.col("CodaType")) & F.lit(drop_noise)) if "CodaType" in df.columns else rows.withColumn("__noise", F.lit(False))
    missing = F.lit(None).cast("int")
    if pauses and "TsTo" in df.columns:
        w = Window.partitionBy(*keys, "__noise").orderBy(*_order(df, order))
        own = F.nanvl(F.col("Duration"), F.lit(None)) if "Duration" in df.columns else F.lit(0.0)
        ts = F.nanvl(F.col("TsTo"), F.lit(None))
        kept = kept.withColumn("__pause", V.pause_token(ts - F.lag(ts).over(w) - own))
    else:
        kept = kept.withColumn("__pause", missing)
    whale = V.whale_token(F.col("Whale")) if whales and "Whale" in df.columns else missing
    typed = V.type_token(F.col("CodaType") if "CodaType" in df.columns else F.lit(None).cast("string"), F.col("nClicks") if "nClicks" in df.columns else None)
    piece = F.filter(F.array("__pause", whale, typed), lambda t: t.isNotNull())
    place = [F.struct(x.isNull().alias("last"), x.alias("at")) for x in (F.nanvl(F.col(c), F.lit(None)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in order)]
    item = F.struct(*[p.alias(f"o{i}") for i, p in enumerate(place)], piece.alias("piece"))
    grouped = kept.groupBy(*keys).agg(F.first("n_codas").alias("n_codas"), F.array_sort(F.collect_list(F.when(~F.col("__noise"), item))).alias("items"))
    inner = F.flatten(F.transform("items", lambda x: x["piece"]))
    return grouped.select(*keys, F.col("n_codas").cast("long").alias("n_codas"), F.concat(F.array(F.lit(V.BOS)), inner, F.array(F.lit(V.EOS))).alias("tokens"))


def dialogues(df: DataFrame, key: str = "REC", least: int = 3) -> DataFrame:
    """Per recording: recording, n_codas, n_whales, duration_s, whale_ids; noise rows count too."""
    ts = F.nanvl(F.col("TsTo"), F.lit(None))
    grouped = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("recording")).agg(F.count("*").alias("n_codas"), F.array_sort(F.collect_set("Whale")).alias("whale_ids"), (F.max(ts) - F.min(ts)).alias("duration_s"))
    return grouped.where(F.col("n_codas") >= least).select("recording", "n_codas", F.size("whale_ids").cast("long").alias("n_whales"), "duration_s", "whale_ids")


def require_whales(df: DataFrame) -> DataFrame:
    """TsTo as a number (null where it is none) and Whale as int; a null Whale fails the query."""
    return df.withColumn("TsTo", F.expr("try_cast(TsTo as double)")).withColumn("Whale", F.when(F.col("Whale").isNull(), F.raise_error(F.lit("Whale is null")).cast("int")).otherwise(F.col("Whale").cast("int")))


def decode(df: DataFrame, column: str = "tokens") -> DataFrame:
    return df.withColumn("texts", F.transform(column, lambda t: V.decode_token(t)))


def coda_distribution(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """coda, n: type tokens over all sequences."""
    t = sequences.select(F.explode(column).alias("t")).where(V.is_coda(F.col("t")))
    return t.groupBy(V.decode_token(F.col("t")).alias("coda")).agg(F.count("*").alias("n"))


def transitions(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """prev, cur, n: individual tokens that follow each other within a sequence, self-transitions too.

    Pairs are made inside each array, so nothing is shuffled but the counts.
    """
    whales = F.filter(column, lambda t: V.is_whale(t))
    pairs = F.arrays_zip(F.slice(whales, F.lit(1), F.greatest(F.size(whales) - 1, F.lit(0))).alias("prev"), F.slice(whales, 2, F.greatest(F.size(whales), F.lit(0))).alias("cur"))
    return sequences.select(F.explode(pairs).alias("p")).groupBy(V.decode_token(F.col("p.prev")).alias("prev"), V.decode_token(F.col("p.cur")).alias("cur")).agg(F.count("*").alias("n"))


def sequence_summary(sequences: DataFrame, column: str = "tokens") -> DataFrame:
    """One row: n_sequences, avg_codas_per_seq (sequences without any count as 0)."""
    n = F.size(F.filter(column, lambda t: V.is_coda(t)))
    return sequences.agg(F.count("*").alias("n_sequences"), F.avg(n).alias("avg_codas_per_seq"))
