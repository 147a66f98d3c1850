"""Hard-negative mining with Fagin's threshold algorithm.

Vectors become small integers. In a block of vectors each dimension has a list
sorted by value. For an anchor each list is read from the end where the sign of
the anchor's component puts the largest products. Every row met gets its whole
inner product at once (random access), in integers. The threshold, the sum over
the dimensions of the products at the depth reached, bounds the score of every
row not met yet. Reading stops when the threshold lies strictly below the kth
best score found in each of the anchor's score windows, or below the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut
from .topk import quantised

#: Components of the vectors in one block, anchors in one, at most; on fewer blocks than TASKS, anchors are split further, to ANCHORS_LEAST.
COMPONENTS, ANCHORS, ANCHORS_LEAST, TASKS = 1 << 21, 4_096, 64, 16
#: Depth of the lists that is read before the threshold is looked at first; it doubles each time.
DEPTH = 16
_ANY = 1 << 62


class SortedLists:
    """A list for each dimension of one block of integer vectors, ascending by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.value = np.take_along_axis(vectors.T, self.order, axis=1)
        self.largest = int(np.abs(vectors).max(initial=0))
        self.vectors, self.read, self.scored = vectors, 0, 0
        self._as: dict = {}

    def _kind(self, query: np.ndarray):
        """What sums of products are exact in: doubles, longs, else Python's integers."""
        most = self.largest * max((abs(int(q)) for q in query), default=0) * len(query)
        return np.float64 if most < 1 << 52 else np.int64 if most < 1 << 61 else object

    def best(self, query: np.ndarray, member: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high), both included: rows and scores of the k best of ``member`` in it, ties to the smaller id.

        What holds for k best rows holds for k best with repeated ones too, as
        a repeated row takes up more than one place.
        """
        n, dims = self.vectors.shape
        kind = self._kind(query)
        if kind not in self._as:
            self._as[kind] = self.vectors.astype(kind)
        vectors, q = self._as[kind], query.astype(kind)
        score, seen = np.zeros(n, kind), np.zeros(n, bool)
        used = np.nonzero(query)[0]
        up = query[used] > 0
        depth, step = 0, DEPTH
        while depth < n:
            stop = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[used[up], n - stop : n - depth].ravel()] = True
            met[self.order[used[~up], depth:stop].ravel()] = True
            met &= ~seen
            new = np.nonzero(met)[0]
            if 4 * len(new) > n:
                score[met] = (vectors @ q)[met]
            else:
                score[new] = vectors[new] @ q
            seen |= met
            self.read += (stop - depth) * len(used)
            depth, step = stop, 2 * step
            if seen.all() or not len(used):
                break
            at = np.where(up, self.value[used, n - depth], self.value[used, depth - 1])
            threshold = sum(int(a) * int(b) for a, b in zip(query[used], at))
            inside = score[seen & member]
            if all(threshold < low or self._settled(inside[(inside >= low) & (inside <= high)], k, threshold) for low, high in windows):
                break
        if not len(used):
            seen[:] = True  # all scores are 0
        self.scored += int(seen.sum())
        rows = np.nonzero(seen & member)[0]
        found = score[rows] if kind is object else score[rows].astype(np.int64)
        out = []
        for low, high in windows:
            take = np.nonzero((found >= low) & (found <= high))[0]
            if kind is not object and len(take) > 4 * k:
                # Nothing below the kth best score matters; its ties do.
                take = take[found[take] >= np.partition(found[take], len(take) - k)[len(take) - k]]
            first = sorted(take.tolist(), key=lambda i: (-int(found[i]), int(self.ids[rows[i]])))[:k]
            out.append((rows[first], found[first]))
        return out

    @staticmethod
    def _settled(inside: np.ndarray, k: int, threshold: int) -> bool:
        if len(inside) < k:
            return False
        kth = sorted(inside.tolist())[-k] if inside.dtype == object else np.partition(inside, len(inside) - k)[len(inside) - k]
        return threshold < int(kth)


def _lists(part: pd.DataFrame) -> SortedLists:
    return SortedLists(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.int64))


def _blocks(rows: pd.DataFrame, anchors: pd.DataFrame):
    """(rows of one length, their lists, anchors of that length)."""
    if len(rows) and len(anchors):
        of = anchors["v"].map(len)
        for dims, part in rows.groupby(rows["v"].map(len)):
            mine = anchors[of == dims]
            if len(mine):
                part = part.sort_values("vec_id", ignore_index=True)
                yield part, _lists(part), mine


def _positives(k: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("anchor_id", "anchor", "positive_id", "positive_score", "copies")}
        for part, lists, mine in _blocks(rows, anchors):
            for a, key, v in zip(mine["anchor_id"], mine["anchor"], mine["v"]):
                [(at, score)] = lists.best(np.asarray(v, np.int64), lists.ids != a, [(-_ANY, _ANY)], k)
                for i, s in zip(at, score):
                    for c, x in zip(out, (a, key, lists.ids[i], int(s), part["copies"][i])):
                        out[c].append(x)
        return pd.DataFrame(out).astype("int64")

    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("anchor_id", "anchor", "times", "place", "positive_id", "positive_score", "negative_id", "negative_score", "copies")}
        for part, lists, mine in _blocks(rows, anchors):
            labels = part["label"].to_numpy()
            for a, key, times, label, v, positives in zip(mine["anchor_id"], mine["anchor"], mine["times"], mine["label"], mine["v"], mine["positives"]):
                open_, windows = [], []
                for p in positives:
                    # low * positive <= 100 * negative <= high * positive, in whole numbers.
                    least, most = -((-low * p["score"]) // 100), high * p["score"] // 100
                    if least <= most:
                        open_.append(p)
                        windows.append((least, most))
                if windows:
                    for p, (at, score) in zip(open_, lists.best(np.asarray(v, np.int64), labels != label, windows, k)):
                        for i, s in zip(at, score):
                            for c, x in zip(out, (a, key, times, p["place"], p["positive_id"], p["score"], lists.ids[i], int(s), part["copies"][i])):
                                out[c].append(x)
        return pd.DataFrame(out).astype("int64")

    return run


def _dealt(rows: DataFrame, anchors: DataFrame, shards: Column, turns: Column, by: list[str]):
    """Blocks of rows and of anchors, each row once for each block of anchors and the reverse."""
    block = lambda of, *of_what: F.pmod(F.xxhash64(*of_what), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), (of - 1).cast("int")))
    left = rows.withColumn("shard", block(shards, "vec_id", "v", F.lit(1))).withColumn("turn", every(turns))
    right = anchors.withColumn("turn", block(turns, "anchor_id", "anchor", F.lit(2))).withColumn("shard", every(shards))
    keys = [*by, "shard", "turn"]
    # New names for the same columns: both sides come from the same rows.
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``vectors(vec_id, embedding, label)``.

    Components become floor(scale * x). Anchors are the rows whose vec_id
    ``every`` divides. A row's score is its integer inner product with the
    anchor, higher first, ties to the smaller vec_id. An anchor's positives are
    its first ``positives`` rows of the same label and another vec_id; each
    positive gets the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    Fewer if there are fewer: a positive without such rows, as any of negative
    score, gives none.

    Rows with a null vec_id, label or vector, an empty vector, or a null or
    non-finite component take no part; vectors of different lengths don't meet.
    Repeated rows all count, as anchors, positives and negatives; different
    rows of one vec_id are anchors of their own. Scores are exact; one beyond a
    long fails the query. An empty table gives no rows. Other columns, whatever
    their names, are ignored. Anchors meet the rows in blocks of bounded size
    on both sides, so a label of any size is never one task.
    """
    labelled = quantised(vectors.where("label is not null"), scale, ["label"])
    rows = cut(labelled.groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies")), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("anchor"), "label", "v", F.col("copies").alias("times"))
    components, queries = F.sum(F.size("v").cast("long")), F.count_if(F.col("vec_id") % every == 0)
    shards = lambda c: F.greatest(F.lit(1), F.ceil(c / COMPONENTS))
    turns = lambda q, s: F.greatest(F.lit(1), F.ceil(q / ANCHORS), F.least(F.ceil(q / ANCHORS_LEAST), F.ceil(F.lit(TASKS) / s)))
    # Positives: an anchor meets the rows of its own label alone; a large label is dealt to more blocks.
    labels = rows.groupBy("label").agg(components.alias("c"), queries.alias("q")).where("q > 0").withColumn("shards", shards(F.col("c"))).withColumn("turns", turns(F.col("q"), F.col("shards")))
    labels = labels.select("label", "shards", "turns")
    found = _dealt(rows.join(labels, "label"), anchors.join(labels, "label"), F.col("shards"), F.col("turns"), ["label"])
    found = found.applyInPandas(_positives(positives), "anchor_id long, anchor long, positive_id long, positive_score long, copies long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "anchor").orderBy(F.col("positive_score").desc(), "positive_id"))
    repeated = lambda df, k: df.withColumn("copy", F.explode(F.expr(f"sequence(1, int(least(copies, {k})))")))
    placed = repeated(found, positives).withColumn("place", place).where(F.col("place") <= positives)
    # At most ``positives`` rows an anchor.
    windows = placed.groupBy("anchor_id", "anchor").agg(F.collect_list(F.struct("place", "positive_id", F.col("positive_score").alias("score"))).alias("positives"))
    ready = cut(anchors.join(windows, ["anchor_id", "anchor"]), "anchors")
    c, q = rows.agg(F.coalesce(components, F.lit(0)), F.coalesce(queries, F.lit(0))).first()
    n_shards = max(1, -(-c // COMPONENTS))
    n_turns = max(1, -(-q // ANCHORS), min(-(-q // ANCHORS_LEAST), -(-TASKS // n_shards)))
    against = _dealt(rows, ready, F.lit(n_shards), F.lit(n_turns), [])
    met = against.applyInPandas(_negatives(negatives, low, high), "anchor_id long, anchor long, times long, place long, positive_id long, positive_score long, negative_id long, negative_score long, copies long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id"))
    ranked = repeated(met, negatives).withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.withColumn("time", F.explode(F.expr("sequence(1L, times)"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
