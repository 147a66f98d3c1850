"""Exact quantiles of groups of any size by radix selection.

A histogram of value prefixes, with each bucket's count, least and greatest
value, tells in which bucket a rank lies; only that bucket's rows go on to the
next, finer histogram. What is left after the last is counted by value. Counts
are summed on the map side, so no task ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _magnitude(v: Column) -> Column:
    """Whole numbers that rise with ``v``: sign and binary exponent."""
    e = F.floor(F.log2(F.greatest(F.abs(v), F.lit(5e-324)))).cast("int") + 1100
    return F.when(v > 0, e).when(v < 0, -e).otherwise(F.lit(0))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], steps: int = 2, width: int = 4096) -> DataFrame:
    """``keys``, share, quantile: the exact, linearly interpolated quantiles of each group's values.

    Null values and NaN take no part; groups without others give no rows; a
    null key is a key of its own. ``df`` is read ``steps`` + 2 times, and what
    each pass hands on is a histogram of at most 4,400 or ``width`` buckets for
    a group and rank; so write out first what is dear to compute. Two ranks
    around a quantile mostly share their bucket and then are looked up together.
    Equal values are one entry of the last count, however often they occur.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or [F.lit(True)]

    def found(buckets: DataFrame, targets: DataFrame, within: list[str], by: str) -> DataFrame:
        """The bucket of each target: (keys, within, by, n, lo, hi) met by (keys, within, share, high, rank), whose rank counts from the bucket on."""
        along = Window.partitionBy(*keys, *within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        placed = buckets.withColumn("__before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        on = [*same("b", "t"), *[F.col(f"b.{c}") == F.col(f"t.{c}") for c in within]]
        hit = placed.alias("b").join(targets.alias("t"), on).where("t.rank >= b.__before and t.rank < b.__before + b.n")
        return hit.select(*[F.col(f"b.{k}").alias(k) for k in keys], "t.share", "t.high", "t.place", (F.col("t.rank") - F.col("b.__before")).alias("rank"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))

    def of(targets: DataFrame) -> DataFrame:
        """The rows of the buckets that hold a target."""
        spans = targets.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("__spans"))
        met = rows.alias("r").join(spans.alias("s"), same("r", "s")).select(*[F.col(f"r.{k}").alias(k) for k in keys], "__v", "__spans")
        inside = F.filter("__spans", lambda s: (s["lo"] <= F.col("__v")) & (s["hi"] >= F.col("__v")))
        return met.select(*keys, "__v", F.inline(inside))

    counted = [F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most")]
    first = rows.groupBy(*keys, _magnitude(F.col("__v")).alias("b")).agg(*counted).select(*keys, "b", "n", F.col("least").alias("lo"), F.col("most").alias("hi"))
    total = first.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = total.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")).withColumn("place", (F.col("total") - 1) * F.col("share"))
    low = F.floor("place")
    ranks = F.inline(F.array(F.struct(F.lit(0).alias("high"), low.alias("rank")), F.struct(F.lit(1).alias("high"), F.least(low + 1, F.col("total") - 1).alias("rank"))))
    targets = found(first, wanted.select(*keys, "share", "place", ranks), [], "b")
    for _ in range(steps):
        across = F.col("hi") - F.col("lo")
        bucket = F.when(across > 0, F.least(F.lit(width - 1), F.floor((F.col("__v") - F.col("lo")) / across * width).cast("int"))).otherwise(F.lit(0))
        finer = of(targets).groupBy(*keys, "lo", "hi", bucket.alias("b")).agg(*counted)
        finer = finer.select(*keys, F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"), "b", "n", F.col("least").alias("lo"), F.col("most").alias("hi"))
        targets = found(finer, targets.select(*keys, F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"), "share", "high", "place", "rank"), ["in_lo", "in_hi"], "b")
    last = of(targets).groupBy(*keys, "lo", "hi", "__v").agg(F.count("*").alias("n"))
    last = last.select(*keys, F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"), F.col("__v").alias("b"), "n", F.col("__v").alias("lo"), F.col("__v").alias("hi"))
    values = found(last, targets.select(*keys, F.col("lo").alias("in_lo"), F.col("hi").alias("in_hi"), "share", "high", "place", "rank"), ["in_lo", "in_hi"], "b")
    pair = values.groupBy(*keys, "share").agg(F.max("place").alias("place"), F.max(F.when(F.col("high") == 0, F.col("lo"))).alias("a"), F.max(F.when(F.col("high") == 1, F.col("lo"))).alias("b"))
    return pair.select(*keys, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("quantile"))
