"""Grouping spelling variants: words one edit apart by asymmetric q-chunks.

The longer word of a pair (either, if they are equally long) gives two disjoint
chunks, its halves; one edit leaves one of them as it was. The other word gives
its positional grams of the same lengths that stand where a chunk can have
moved, by no place or by one. Chunks and grams meet by an equality join on
lengths, text and shift. Where many meet, what is left of the words outside the
shared chunk is halved again in the same way, as it must hold the edit; so no
group ever emits more than a bounded number of candidates, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut, drop_cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Candidates that one group of equal chunks may make before it is split further.
CANDIDATES = 1_024


def _without(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at.cast("int")), F.substring(word, (at + 2).cast("int"), F.length(word)))


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, typo_every: int = 97, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, n: words of at least ``least_length`` code points that occur ``least_count`` times or more in all texts.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF, only A-Z
    lower-cased. If the crc32 of ``<id>:<run>`` is divisible by ``typo_every``,
    one code point is left out. Null and empty texts have no words; a null id
    counts as an empty one; repeated rows count as often as they stand there.
    """
    low = F.translate(F.col(text_column).cast("string"), UPPER, LOWER)
    # A run too short to be a word can only become shorter.
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("of"), F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("of", F.lit(":"), "run")).alias("h"))
    word = F.when(F.col("h") % typo_every == 0, _without(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _halved(rows: DataFrame, longer: bool) -> DataFrame:
    """Each of ``rows(word, key, shift, rest)`` twice: with one half of the rest in the key and the other as the new rest.

    Both sides cut where the longer word's rest has its middle; behind the cut
    the shorter one stands ``shift`` places earlier.
    """
    length = F.length("rest") if longer else F.length("rest") + F.col("shift")
    middle = F.floor(length / 2).cast("int")
    second = middle if longer else middle - F.col("shift")
    head = lambda n: F.substring("rest", F.lit(1), n)
    tail = lambda n: F.substring("rest", n + 1, F.length("rest"))
    one = F.struct(F.concat("key", F.lit("<"), head(middle)).alias("key"), tail(middle).alias("rest"))
    two = F.struct(F.concat("key", F.lit(">"), tail(second)).alias("key"), head(second).alias("rest"))
    return rows.select("word", "shift", F.inline(F.array(one, two)))


def near_pairs(words: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """a, b (a < b): the distinct pairs of ``words(word)`` that differ by exactly one inserted, deleted or replaced code point.

    Repeated words count once, null and empty ones not at all. Groups of equal
    chunks that would make more than ``candidates`` pairs are halved further
    until they don't or a single code point is left, whose words are all near
    each other or equal.
    """
    once = words.where("word is not null and word <> ''").select("word").distinct()
    shifts = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")
    both = once.select("word", F.length("word").alias("m"), shifts, F.col("word").alias("rest"))
    # The key names the longer word's length and the shift, so all lengths of the pieces behind it are known.
    key = lambda m: F.concat(m.cast("string"), F.lit(":"), F.col("shift").cast("string"))
    chunks = cut(_halved(both.select("word", key(F.col("m")).alias("key"), "shift", "rest"), True), "chunks")
    grams = cut(_halved(both.select("word", key(F.col("m") + F.col("shift")).alias("key"), "shift", "rest"), False), "grams")
    found = None
    while True:
        many = chunks.groupBy("key").agg(F.count("*").alias("c"), F.max(F.length("rest")).alias("left")).join(grams.groupBy("key").agg(F.count("*").alias("g")), "key")
        sizes = cut(many.select("key", ((F.col("c") * F.col("g") > candidates) & (F.col("left") > 1)).alias("hot")), "sizes")
        few = chunks.join(sizes.where("not hot"), "key").select("key", "shift", F.col("word").alias("s"))
        met = few.join(grams.select("key", F.col("word").alias("t")), "key").where("shift = 1 or s < t")
        near = met.where(F.levenshtein("s", "t", 1) == 1).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
        near = cut(near, "near")
        found = near if found is None else found.unionAll(near)
        hot = sizes.where("hot").select("key")
        if hot.isEmpty():
            return found.distinct()
        chunks, grams = cut(_halved(chunks.join(hot, "key"), True), "chunks"), cut(_halved(grams.join(hot, "key"), False), "grams")


def _roots(links: DataFrame) -> DataFrame:
    """word, root: where ``links(word, form)`` lead from each word at last, the way doubled at each round."""
    now = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        new = cut(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        drop_cut(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``counts(word, n)``, one row a word.

    ``n_near`` is the number of its near words (``near_pairs``). ``form`` is the
    near word of largest n, ties to the smallest in code-point order, if that n
    is at least ``ratio`` (over 1) times the word's own; else null, as is
    ``form_n``. ``root`` is the last word that forms lead to, itself if it has
    none. An empty table gives no rows. Words of any length are compared whole.
    """
    words = cut(counts.select("word", "n"), "words")
    pairs = near_pairs(words)
    near = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "b")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= F.col("n") * ratio, F.lit(False)))
    formed = cut(formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best.b")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")), "forms")
    rooted = formed.join(_roots(formed.where("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, typo_every: int = 97, ratio: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``variants`` of the ``word_counts`` of whole texts.

    Other columns of ``docs``, whatever their names, are ignored; null, empty,
    very long texts, repeated rows and empty tables as stated in those two.
    """
    return variants(word_counts(docs, least_length, least_count, typo_every, id_column, text_column), ratio)
