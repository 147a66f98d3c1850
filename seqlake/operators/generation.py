"""A back-off n-gram model in one table, and sequences continued by recursive SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def backoff_table(sequences: DataFrame, column: str = "tokens", orders: int = 4, top_k: int = 8) -> DataFrame:
    """context, next: for each run of 0 to ``orders`` - 1 tokens its ``top_k`` most frequent followers (token, n), ties to the smaller.

    A context is its tokens joined by spaces, so the contexts of all orders are
    one table with one key, and the empty one has the single tokens. Counts are
    summed on the map side; followers of a context are ranked after that, a
    row for each distinct n-gram. Null sequences and tokens are left out.
    """
    clean = sequences.select(F.filter(column, lambda t: t.isNotNull()).alias("t")).where(F.size("t") > 0)
    at = clean.select("t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("i")).select("t", "i", F.explode(F.sequence(F.lit(0), F.least(F.col("i") - 1, F.lit(orders - 1)))).alias("k"))
    grams = at.select(F.array_join(F.slice("t", F.col("i") - F.col("k"), F.col("k")), " ").alias("context"), F.element_at("t", F.col("i")).alias("token"))
    counts = grams.groupBy("context", "token").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("n"), "token"))).where(F.col("r") <= top_k)
    listed = best.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("r", "token", "n"))).alias("next"))
    return listed.select("context", F.transform("next", lambda x: F.struct(x["token"].alias("token"), x["n"].alias("n"))).alias("next"))


def continued(prompts: DataFrame, table: DataFrame, steps: int, seed: int, end: int, orders: int = 4) -> DataFrame:
    """id, tokens, done: ``prompts(id, tokens)`` continued by up to ``steps`` tokens, stopping at ``end``.

    Each step takes the longest context that the table has (back-off) and draws
    one of its followers by the md5 of seed, step and id. The steps are one
    recursive query: its plan doesn't grow with their number, and sequences
    that have ended take no part in later ones. Every step joins the open
    sequences with the table once an order, so ``table`` should be written or
    checkpointed first. A recursion may yield as many rows
    as ``spark.sql.cteRecursionRowLimit`` says; prompts times steps must not
    exceed it, and ``steps`` not ``spark.sql.cteRecursionLevelLimit``.
    """
    spark, tag = prompts.sparkSession, uuid.uuid4().hex[:12]
    p, m = f"prompts_{tag}", f"contexts_{tag}"
    prompts.select("id", F.col("tokens").cast("array<int>").alias("tokens")).createOrReplaceTempView(p)
    table.select("context", F.col("next").cast("array<struct<token:int,n:bigint>>").alias("next")).createOrReplaceTempView(m)
    suffix = lambda k: f"array_join(slice(r.tokens, greatest(size(r.tokens) - {k} + 1, 1), {k}), ' ')" if k else "''"
    joins = "\n".join(f"LEFT JOIN {m} m{k} ON m{k}.context = {suffix(k)}" + (f" AND size(r.tokens) >= {k}" if k else "") for k in range(orders))
    found = ", ".join(f"m{k}.next" for k in reversed(range(orders)))
    u = f"conv(substring(md5(concat_ws(':', '{seed}', cast(step AS string), cast(id AS string))), 1, 8), 16, 10) / 4294967296D"
    pick = "aggregate(next, named_struct('c', 0L, 'hit', cast(NULL AS int)), (a, x) -> named_struct('c', a.c + x.n, 'hit', coalesce(a.hit, IF(u * total < a.c + x.n, x.token, NULL))), a -> a.hit)"
    rows = spark.sql(f"""
WITH RECURSIVE r (id, step, tokens, done) AS (
  SELECT id, 0, tokens, false FROM {p}
  UNION ALL
  SELECT id, step + 1, concat(tokens, array(token)), token = {end} FROM (
    SELECT id, step, tokens, coalesce({pick}, {end}) AS token FROM (
      SELECT id, step, tokens, next, aggregate(next, 0L, (a, x) -> a + x.n) AS total, {u} AS u FROM (
        SELECT r.id, r.step, r.tokens, coalesce({found}) AS next FROM r
        {joins}
        WHERE NOT r.done AND r.step < {steps})))
)
SELECT id, step, tokens, done FROM r""")
    last = F.max(F.struct("step", "tokens", "done"))
    return rows.groupBy("id").agg(last.alias("x")).select("id", "x.tokens", "x.done")
