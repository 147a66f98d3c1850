"""Sliding-window attention over sequences of any length, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let


def _partial(heads: int, window: int):
    """For one block of queries and one of keys: each query's and head's greatest score, sum of weights below it, and weighed values."""

    def run(queries: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"seq": pd.Series([], dtype=queries["seq"].dtype), "pos": np.zeros(0, np.int64), "head": np.zeros(0, np.int32), "kb": np.zeros(0, np.int64), "m": np.zeros(0), "l": np.zeros(0), "o": pd.Series([], dtype=object)})
        if not len(queries) or not len(keys):
            return none
        at, of = queries["pos"].to_numpy(), keys["pos"].to_numpy()
        seen = (of[None, :] <= at[:, None]) & (of[None, :] > at[:, None] - window)
        if not seen.any():
            return none
        cut = lambda x: np.stack(x.to_numpy()).astype(np.float64).reshape(len(x), heads, -1).transpose(1, 0, 2)
        q, k, v = cut(queries["q"]), cut(keys["k"]), cut(keys["v"])
        score = np.where(seen, q @ k.transpose(0, 2, 1) / np.sqrt(q.shape[-1]), -np.inf)
        m = score.max(axis=2)
        some = np.isfinite(m)
        w = np.exp(score - np.where(some, m, 0.0)[..., None])
        o = w @ v
        h, i = np.nonzero(some)
        return pd.DataFrame({"seq": queries["seq"].to_numpy()[i], "pos": at[i], "head": h.astype(np.int32), "kb": keys["kb"].iloc[0], "m": m[h, i], "l": w.sum(axis=2)[h, i], "o": list(o[h, i])})

    return run


def banded_attention(rows: DataFrame, window: int, heads: int = 1, block: int = 128) -> DataFrame:
    """seq, pos, head, output (array) of ``rows(seq, pos, q, k, v)``: softmax(q k / sqrt(d)) v over the last ``window`` positions.

    A vector of heads * d numbers is cut into its heads. A query sees keys of
    its own sequence with pos - window < position <= pos. Positions are dealt
    to blocks; a block of queries meets each block of keys in its band in a
    task of its own and hands on, per query and head, the greatest score, the
    sum of weights relative to it and the weighed values. These are merged in
    the order of key blocks by the running maximum and sum, which rescales what
    came before (online softmax). So a task holds two blocks, whatever a
    sequence's length, and a query meets window / block + 2 parts at most.

    Rows with a null seq, pos or vector take no part; positions may have gaps.
    Rows that repeat seq and pos are keys each, and queries whose parts merge,
    so they must not differ. An empty table gives no rows.
    """
    sound = rows.where(F.col("seq").isNotNull() & F.col("pos").isNotNull() & F.col("q").isNotNull() & F.col("k").isNotNull() & F.col("v").isNotNull())
    kind = rows.schema["seq"].dataType.simpleString()
    b = sound.withColumn("pos", F.col("pos").cast("long")).withColumn("own", F.floor(F.col("pos") / block))
    # Queries go once to each key block of their band, keys once to each query block that may see them.
    low = F.floor((F.floor(F.col("pos") / block) * block - window + 1) / block)
    queries = b.select(F.col("seq").alias("seq"), F.col("pos").alias("pos"), "q", F.col("own").alias("qb"), F.explode(F.sequence(low, F.col("own"))).alias("kb"))
    keys = b.select(F.col("seq").alias("seq"), F.col("pos").alias("pos"), "k", "v", F.col("own").alias("kb"), F.explode(F.sequence(F.col("own"), F.floor((F.col("pos") + window - 1) / block))).alias("qb"))
    parts = queries.groupBy("seq", "qb", "kb").cogroup(keys.groupBy("seq", "qb", "kb")).applyInPandas(_partial(heads, window), f"seq {kind}, pos long, head int, kb long, m double, l double, o array<double>")
    listed = parts.groupBy("seq", "pos", "head").agg(F.array_sort(F.collect_list(F.struct("kb", "m", "l", "o"))).alias("parts"))

    def merged(a, p):
        top = F.greatest(a["m"], p["m"])
        x, y = F.exp(a["m"] - top), F.exp(p["m"] - top)
        return F.struct(top.alias("m"), (a["l"] * x + p["l"] * y).alias("l"), F.zip_with(a["o"], p["o"], lambda u, w: u * x + w * y).alias("o"))

    first = lambda p: F.struct(p["m"].alias("m"), p["l"].alias("l"), p["o"].alias("o"))
    total = F.aggregate(F.slice("parts", 2, F.size("parts")), first(F.element_at("parts", 1)), merged)
    return listed.select("seq", "pos", "head", let(total, lambda t: F.transform(t["o"], lambda x: x / t["l"])).alias("output"))
