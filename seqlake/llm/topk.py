"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors become small integers. In each block of vectors a posting segment holds
those whose component in one dimension lies in one impact level. For a query,
each segment's impact is an upper bound on what it adds to a score; shifting by
the dimension's least bound makes all impacts non-negative. Segments are
processed by descending impact; what is unprocessed bounds every vector's score
from above. After each further share of the postings the bounds are compared
with the best exact scores so far, and it stops only on the proof that no vector
outside a small set can reach the best k; those possible members are scored
exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 32
#: Components of the vectors in one block and queries in one, at most; on fewer blocks than TASKS, queries are split further, to QUERIES_LEAST.
COMPONENTS, QUERIES, QUERIES_LEAST, TASKS = 1 << 21, 4_096, 128, 16
#: Shares of a block's postings after which the proof is tried.
SHARES = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 1.0)
#: Share of a block (and of k, times) up to which possible members are scored exactly without reading further postings.
ENOUGH, ENOUGH_K = 0.03, 16
_LARGE, _COUNTED = 1 << 62, 1 << 48


class ImpactIndex:
    """Posting segments of one block of integer vectors, ids ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = np.maximum(1, -(-(high - self.low + 1) // LEVELS))
        level = (vectors - self.low) // self.width
        dims = vectors.shape[1]
        order = np.argsort(level, axis=0, kind="stable")
        self.postings = np.ascontiguousarray(order.T)
        self.bounds = np.stack([np.searchsorted(level[order[:, d], d], np.arange(LEVELS + 1)) for d in range(dims)])
        #: Least and greatest value of each segment.
        self.least = self.low[:, None] + self.width[:, None] * np.arange(LEVELS)
        self.greatest = np.minimum(self.least + self.width[:, None] - 1, high[:, None])

        # Sums of products under 2**53 are exact as doubles, which numpy multiplies faster; those over 2**61 as Python's numbers alone.
        most = int(np.abs(vectors).max(initial=0))
        self.exact = np.float64 if most**2 * dims < 1 << 52 else np.int64 if most**2 * dims < 1 << 61 else object
        self.vectors = vectors.astype(self.exact)
        self.reads = self.rescored = 0

    def _score(self, take: np.ndarray, query: np.ndarray) -> np.ndarray:
        score = self.vectors[take] @ query.astype(self.exact)
        return score if self.exact is object else score.astype(np.int64)

    def _possible(self, query: np.ndarray, k: int, member: np.ndarray) -> np.ndarray:
        """Rows of ``member`` that may be among its k best, by bounds from impacts."""
        n, dims = self.vectors.shape
        greatest = np.maximum(query[:, None] * self.least, query[:, None] * self.greatest)
        size = self.bounds[:, 1:] - self.bounds[:, :-1]
        floor = np.where(size > 0, greatest, _LARGE).min(axis=1)  # the least bound of a dimension's segments
        impact = np.where(size > 0, greatest - floor[:, None], 0)
        order = np.argsort(-impact, axis=None, kind="stable")
        order = order[size.ravel()[order] > 0]
        read = np.cumsum(size.ravel()[order])
        left = np.where(size > 0, impact, -1)
        # What the segments read so far add to each vector, and _COUNTED for each of its dimensions that was read.
        added, done = np.zeros(n, np.int64), 0
        for share in SHARES:
            until = int(np.searchsorted(read, share * n * dims, "right")) if share < 1 else len(order)
            for seg in order[done:until].tolist():
                d, level = divmod(seg, LEVELS)
                added[self.postings[d, self.bounds[d, level] : self.bounds[d, level + 1]]] += impact[d, level] + _COUNTED
            left.ravel()[order[done:until]] = -1
            done = until
            open_ = np.maximum(left.max(axis=1), 0)  # what a dimension can add at most where its segment was not read
            # A vector with c dimensions read lacks at least the c least of what is open.
            closed = np.concatenate([[0], np.cumsum(np.sort(open_))])
            bound = np.where(member, int(floor.sum() + open_.sum()) + (added & (_COUNTED - 1)) - closed[added >> 48], -_LARGE)
            tried = np.argpartition(-bound, min(n - 1, 8 * k))[: 8 * k]
            tried = tried[member[tried]]
            # The exact scores of the most promising prove what the k-th best is at least.
            kth = np.partition(self._score(tried, query), len(tried) - k)[len(tried) - k]
            possible = bound >= kth
            if possible.sum() <= max(ENOUGH * n, ENOUGH_K * k):
                break
        self.reads += int(read[done - 1]) if done else 0
        return possible

    def search(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best as ids and scores."""
        rows, score = self.best(query, k, own)
        return self.ids[rows], score

    def best(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (rows, scores), ties to the smaller id; the vector with id ``own`` is left out."""
        member = self.ids != own
        if member.sum() > 8 * k and self.exact is not object and int(np.abs(query).max(initial=0)) * max(int(np.abs(self.least).max()), int(np.abs(self.greatest).max())) * len(query) < 1 << 45 and len(query) < 1 << 13:
            member = self._possible(query, k, member)
        take = np.nonzero(member)[0]
        self.rescored += len(take)
        score = self._score(take, query)
        order = np.lexsort((self.ids[take], -score)) if self.exact is not object else np.array(sorted(range(len(take)), key=lambda i: (-score[i], self.ids[take[i]])), np.int64)
        return take[order[:k]], score[order[:k]]


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("vec_id")
            dims = vectors["v"].map(len)
            for d, part in vectors.groupby(dims):
                index, copies = ImpactIndex(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()).astype(np.int64)), part["copies"].to_numpy()
                for q, v, times in zip(queries["query_id"], queries["v"], queries["times"]):
                    if len(v) == d:
                        take, score = index.best(np.asarray(v, np.int64), k, q)
                        out.append(pd.DataFrame({"query_id": q, "vec_id": index.ids[take], "score": score, "pairs": copies[take] * times}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score", "pairs")})

    return run


def quantised(vectors: DataFrame, scale: int = 256, more: list[str] | None = None) -> DataFrame:
    """vec_id, ``more`` and v = floor(scale * x) of usable vectors: no null or non-finite component, not empty."""
    x = F.transform("embedding", lambda e: F.floor(F.lit(scale) * e.cast("double")))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), *(more or []), x.alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of each vector whose id ``every`` divides.

    Queries meet the vectors in blocks of bounded size on both sides. Vectors
    that are null, empty or hold a null or non-finite component take no part;
    vectors of different lengths don't meet. Repeated rows all take part, as
    candidates and as queries, and so do different vectors of one vec_id; the
    best of all queries of one vec_id are ranked together. Scores are exact;
    one beyond a long fails the query. A block holds a bounded number of
    components, however wide the vectors. An empty table gives no rows. Other
    columns, whatever their names, are ignored.
    """
    rows = quantised(vectors, scale).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    components, queries = rows.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)), F.count_if(F.col("vec_id") % every == 0)).first()
    shards = max(1, -(-components // COMPONENTS))
    turns = max(1, -(-queries // QUERIES), min(-(-queries // QUERIES_LEAST), -(-TASKS // shards)))
    block = lambda of, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(of)).cast("int")
    steps = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = rows.select("vec_id", "v", "copies", block(shards, 1).alias("shard"), steps(turns).alias("turn"))
    right = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", F.col("copies").alias("times"), block(turns, 2).alias("turn"), steps(shards).alias("shard"))
    found = left.groupBy("shard", "turn").cogroup(right.groupBy("shard", "turn")).applyInPandas(_search(k), "query_id long, vec_id long, score long, pairs long")
    found = found.withColumn("pair", F.explode(F.expr(f"sequence(1, int(least(pairs, {k})))")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
