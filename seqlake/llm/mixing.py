"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts.

Every row gets a hash-random key. Within its source the rows stand in the order
of their keys, dealt to buckets by ranges of the key; the buckets' sums in order
and the sums within each bucket make a row's prefix sum. A source's budget is so
many whole passes over it and a rest, and the rest is cut exactly where the
prefix sum reaches it, within a document if need be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source in one range of keys, about.
BUCKET_ROWS = 4_000


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(row_id: Column, text: Column, seed: str = "") -> Column:
    """Thirty-two hexadecimal digits, the same at each run, from seed, id and text."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))))


def _placed(names: DataFrame) -> DataFrame:
    """``names`` with ``place``, the number (from 0) of each source in code-point order, null last.

    Sources are range-sorted; only the counts of the ranges are summed in one task.
    """
    ranged = names.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "sources")
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.count("*").alias("many")).select("part", F.coalesce(F.sum("many").over(along), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return ranged.withColumn("in_part", F.row_number().over(within) - 1).join(before, "part").withColumn("place", F.col("in_part") + F.col("before")).drop("part", "in_part", "before")


def targets(sources: DataFrame, epochs: int) -> DataFrame:
    """``sources(source, weight, source_size)`` with ``target``: shares of the sum of all sizes by weight, at most ``epochs`` times a source's size.

    What is over a source's limit is shared among the others by weight, until
    none is above. All targets are then one level times the weight, or the
    limit; the level rises from aggregate to aggregate, of which the driver
    sees three numbers. There are as many as the level passes limits in turn,
    in practice a few.
    """
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, capped, limit = float(total) / float(weights) if weights else 0.0, 0, F.col("source_size").cast("double") * epochs
    while total:
        above = limit < F.lit(level) * F.col("weight")
        n, full, left = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size") * epochs)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == capped:
            break
        capped, level = n, float(total - full) / float(left)
    return sources.withColumn("target", F.when(limit < F.lit(level) * F.col("weight"), limit).otherwise(F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: str = "", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """What the mix takes of each row: doc_id, text_key, source, size, source_size, weight, target, passes, last, taken.

    Sizes are words. Sources in code-point order, null last, take ``weights`` in
    turn and share the sum of all sizes by them; no target exceeds ``epochs``
    times its source's size (``targets``). A row is taken ``passes`` times
    whole and once its first ``last`` words: a source's takings add up to its
    target, rounded, exactly. ``text_key`` is a hash of the text.

    Null and empty texts have size 0 and nothing is taken of them; a null source
    is a source, the last. Rows that repeat id and text stand side by side in
    the order and are taken on their own; a null id counts as an empty one.
    Ties of keys are ordered by size; rows equal in both are alike in what
    comes out. A text of any length counts whole. An empty table gives no rows.
    Other columns of ``docs``, whatever their names, are ignored. The result is
    the same at each run and doesn't depend on the partitions. A source of any
    size is dealt to ranges of about BUCKET_ROWS rows; only their sums are
    sorted in one task. A text's words are not shuffled.
    """
    text = F.col(text_column).cast("string")
    rows = cut(docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(source_column).alias("source"), word_count(text).alias("size"), random_key(F.col(id_column), text, seed).alias("key")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(_placed(sources).select("source", "source_size", "rows", weight.alias("weight")), "weights")
    wanted = targets(sources, epochs).withColumn("budget", F.floor(F.col("target") + 0.5)).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    wanted = wanted.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size")).withColumn("ranges", F.ceil(F.col("rows") / BUCKET_ROWS))
    wanted = wanted.select(F.col("source").alias("__source"), "source_size", "weight", "target", "passes", "rest", "ranges")
    along_key = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = rows.join(wanted, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("range", F.shiftright(along_key * F.col("ranges"), 32))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__source"), F.col("range").alias("__range"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("__source")) & (F.col("range") == F.col("__range")))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead") - F.col("inside")))
    out = placed.withColumn("last", last).withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))
    return out.select("doc_id", "text_key", "source", "size", "source_size", "weight", "target", "passes", "last", "taken")


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: doc_id, source, epoch (from 0), text, a row for each time that a text of ``docs`` (doc_id, text) is taken.

    ``mixed`` is what ``mix`` gave for the same rows. A text cut by its source's
    budget keeps the white space between the words it keeps. Rows of which
    nothing is taken, null and empty texts among them, don't come out; rows
    that repeat id and text come out as often as ``mix`` takes each of them.
    """
    text = F.col("text").cast("string")
    once = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__key"), text.alias("text")).dropDuplicates(["__id", "__key"])
    taken = mixed.where("taken > 0").select("doc_id", "text_key", "source", "size", "passes", "last")
    epochs = F.expr("sequence(0L, passes - IF(last > 0, 0, 1))")
    both = taken.join(once, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))).select("*", F.explode(epochs).alias("epoch"))
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("last").cast("int")), "")
    return both.select("doc_id", "source", "epoch", F.when((F.col("epoch") < F.col("passes")) | (F.col("last") == F.col("size")), F.col("text")).otherwise(words).alias("text"))
