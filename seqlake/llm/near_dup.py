"""MinHash near-duplicate detection with exact confirmation of every link.

Universal hash minima are banded into bucket keys. In each bucket the member
that shares most buckets is the pivot; every other member is compared with it,
a pivot's set going once to each part of its pairs. Buckets that this leaves in
more than one component are compared block by block: first signatures alone,
then the sets of those that have a possible partner. Full shingle sets confirm
every link, and links are closed by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .cut import cut
from .text_arrays import LOWER, U64, chunks, let_go, mix, text_bytes, tidy, word_hash, words

BANDS, ROWS = 30, 7
#: Documents in one block of a bucket that is compared block by block: with their sets, and with signatures alone.
BLOCK, SIGNATURE_BLOCK = 256, 512
#: Pairs of one pivot that are compared in one place, about.
PAIRS = 256
#: Standard errors by which a pair's estimate may lie below the limit before it is given up.
MARGIN = 5.0

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_RNG = np.random.default_rng(77)
_A = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MULT = _RNG.integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)

SIGNED = "doc_id long, text_key long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and n + 1 offsets.

    A text with fewer words than ``width`` has its whole word sequence as its
    one shingle; one without words has none.
    """
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, doc = words(low, offsets, NOT_SPACE)
    h = word_hash(low, starts, ends)
    count = np.bincount(doc, minlength=n)
    full = max(len(h) - width + 1, 0)
    s = np.zeros(full, U64)
    for k in range(width):
        s += h[k : k + full] * _MULT[k]
    ok = doc[:full] == doc[width - 1 :] if full else np.zeros(0, bool)
    value, owner = mix(s[ok]), doc[:full][ok]
    first = np.cumsum(count) - count
    for few in range(1, width):
        short = np.nonzero(count == few)[0]
        if len(short):
            s = np.full(len(short), few, U64)
            for k in range(few):
                s += h[first[short] + k] * _MULT[k]
            value, owner = np.concatenate([value, mix(s)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def minima(values: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over one set, 8k values at a time."""
    x = (values >> U64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 8192):
        np.minimum(out, (_A[:, None] * x[None, i : i + 8192] + _B[:, None]).min(axis=1), out=out)
    return out


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            ids = batch.column(0)
            data, offsets = text_bytes(batch.column(2))
            for i, j in chunks(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                sizes = np.diff(at)
                full = np.nonzero(sizes)[0]
                sig = np.stack([minima(sets[at[k] : at[k + 1]]) for k in full]) if len(full) else np.zeros((0, len(_A)), np.uint32)
                keys = np.zeros((len(full), BANDS), U64)
                for r in range(ROWS):
                    keys += sig[:, r::ROWS].astype(U64) * _MULT[r]
                keys = mix(keys + np.arange(BANDS, dtype=U64) * _MULT[40]).view(np.int64)
                d1 = np.add.reduceat(mix(sets), at[:-1][full]) if len(full) else np.zeros(0, U64)
                d2 = np.bitwise_xor.reduceat(mix(sets * _MULT[50]), at[:-1][full]) if len(full) else np.zeros(0, U64)
                row = np.full(j - i, -1)
                row[full] = np.arange(len(full))
                take = pa.array(np.where(row < 0, 0, row), mask=row < 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(d1.view(np.int64)).take(take),
                        pa.array(d2.view(np.int64)).take(take),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())).take(take),
                        pa.array([x.tobytes() for x in (mix(sig.astype(U64)) >> U64(56)).astype(np.uint8)], pa.binary()).take(take),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "d1", "d2", "bands", "signature"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                packed = pa.array([sets[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed], names=["node", "shingles"])

    return run


def _least_alike(percent: int) -> float:
    """The share of equal minima under which a pair is given up."""
    limit = percent / 100
    return limit - MARGIN * np.sqrt(limit * (1 - limit) / len(_A))


def _open_pairs(comp, sig, size, side, percent: int) -> np.ndarray:
    """Which rows of one group may be linked and aren't in one component: a symmetric matrix."""
    open_ = comp[:, None] != comp[None, :]
    if side.any():
        open_ &= side[:, None] != side[None, :]
    small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    open_ &= 100 * small >= percent * large
    least = _least_alike(percent)
    for i in np.nonzero(open_.any(axis=1))[0]:
        j = np.nonzero(open_[i])[0]
        open_[i, j] = (sig[j] == sig[i]).mean(axis=1) >= least
    return open_ & open_.T


def _links_of(ids, comp, sig, sets, side, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different components, as (u, v), among one group's rows.

    side: rows of the first (0) and the second block (1); for a block with
    itself all are 0. Enough links are returned to join what belongs together.
    """
    size = np.array([len(s) for s in sets])
    open_ = _open_pairs(comp, sig, size, side, percent)
    rows = np.nonzero(open_.any(axis=1))[0]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.concatenate([sets[i] for i in rows])
    owner = np.repeat(np.arange(len(rows)), size[rows])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    renumber = np.cumsum(shared) - 1
    use = shared[column]
    column, owner = renumber[column[use]], owner[use]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for lo in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(column, [lo, lo + 8192])
        x = np.zeros((len(rows), min(8192, int(shared.sum()) - lo)), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    inter = both.astype(np.int64)
    union = size[rows][:, None] + size[rows][None, :] - inter
    link = (100 * inter >= percent * union) & open_[np.ix_(rows, rows)]
    label = np.arange(len(rows))
    while True:
        least_of = np.where(link, label[None, :], len(rows)).min(axis=1)
        new_label = np.minimum(label, least_of)
        new_label = new_label[new_label]
        if (new_label == label).all():
            break
        label = new_label
    moved = np.nonzero(label != np.arange(len(rows)))[0]
    return ids[rows[moved]], ids[rows[label[moved]]]


def _compare(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        tidy()
        sets = [np.frombuffer(x, U64) for x in group["shingles"]]
        sig = np.stack([np.frombuffer(x, np.uint8) for x in group["signature"]])
        u, v = _links_of(group["node"].to_numpy(), group["component"].to_numpy(), sig, sets, group["side"].to_numpy(), percent)
        return pd.DataFrame({"u": u, "v": v})

    return run


def _partnered(percent: int):
    """Those members of a group whose signature leaves some other one possible."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tidy()
        sig = np.stack([np.frombuffer(x, np.uint8) for x in group["signature"]])
        open_ = _open_pairs(group["component"].to_numpy(), sig, group["n"].to_numpy(), group["side"].to_numpy(), percent)
        return group.loc[open_.any(axis=1), ["key", "node"]]

    return run


def _confirm(percent: int):
    """Links of one pivot with the others of a part, as (u, v): signatures first, then full sets."""
    least = _least_alike(percent)

    def run(others: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
        tidy()
        none = pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        if not len(others) or not len(pivot):
            return none
        p, sig = np.frombuffer(pivot["p"].iloc[0], U64), np.frombuffer(pivot["s"].iloc[0], np.uint8)
        alike = [(np.frombuffer(t, np.uint8) == sig).mean() >= least for t in others["t"]]
        sets = [np.frombuffer(q, U64) for q, near in zip(others["q"], alike) if near]
        if not sets:
            return none
        size = np.array([len(q) for q in sets])
        q = np.concatenate(sets)
        inter = np.add.reduceat((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).astype(np.int64), np.cumsum(size) - size)
        keep = 100 * inter >= percent * (len(p) + size - inter)
        v = others["node"].to_numpy()[alike][keep]
        return pd.DataFrame({"u": np.full(len(v), pivot["u"].iloc[0]), "v": v})

    return run


def _blocks(rows: DataFrame, members: str, size: int) -> DataFrame:
    """``rows`` once for each pair of blocks (i, j) of their bucket that they take part in; ``side`` tells which they are."""
    of = F.ceil(F.col(members) / size).cast("int")
    rows = rows.withColumn("of", of).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("of").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", (F.col("block") > F.col("other")).cast("int")).drop("of", "block", "other")


def _rest_of_buckets(members: DataFrame, sets: DataFrame, shingles: DataFrame, first: DataFrame, percent: int) -> DataFrame | None:
    """Links that join components within buckets whose members the pivots left in several; None if there is no such bucket."""
    placed = members.join(first.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "members", "x1", "x2", F.coalesce("component", "node").alias("component"))
    split = placed.where("members > 2").groupBy("key").agg(F.first("members").alias("members"), F.first("x1").alias("x1"), F.first("x2").alias("x2"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    # Buckets with the same members count once.
    split = cut(split.where("lo < hi").groupBy("members", "x1", "x2").agg(F.min("key").alias("key")).select("key"), "split")
    if split.isEmpty():
        return None
    left = placed.join(split, "key").select("key", "node", "members", "component")
    signed = left.join(sets.select("node", "signature", "n"), "node")
    alike = _blocks(signed, "members", SIGNATURE_BLOCK).groupBy("key", "i", "j").applyInPandas(_partnered(percent), "key long, node long").distinct()
    alike = cut(alike.join(left, ["key", "node"]).select("key", "node", "component"), "alike")
    if alike.isEmpty():
        return None
    few = alike.groupBy("key").agg(F.count("*").alias("few"))
    whole = alike.join(few, "key").join(sets.select("node", "signature"), "node").join(shingles, "node")
    return _blocks(whole, "few", BLOCK).groupBy("key", "i", "j").applyInPandas(_compare(percent), "u long, v long")


def _near_duplicates(docs: DataFrame, width: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """The columns of ``near_duplicates`` with text_key, a hash of the text."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    signed = cut(texts.mapInArrow(_sign(width), SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # A node is a distinct set; documents with the same set stand behind it, so exact copies cost nothing further on.
    least = F.struct("doc_id", "text_key")
    sets = full.groupBy("d1", "d2").agg(F.min(least).alias("of"), F.min_by("bands", least).alias("bands"), F.min_by("signature", least).alias("signature"), F.first("n_shingles").alias("n"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", F.col("of.doc_id").alias("rep"), F.col("of.text_key").alias("text_key"), "bands", "signature", "n"), "sets")
    # Members of buckets that hold at least two.
    keys = sets.select("node", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")).where("members > 1")
    members = cut(keys.join(buckets, "key").select("key", "node", "n", "members", "x1", "x2"), "members")
    # The pivot of a bucket is the member that meets most others over all its buckets.
    score = members.groupBy("node").agg(F.sum("members").alias("score"))
    scored = members.join(score, "node")
    pivots = scored.groupBy("key").agg(F.max(F.struct("score", -F.col("node"), F.col("n"))).alias("p")).select("key", (-F.col("p")["col2"]).alias("pivot"), F.col("p.n").alias("m"))
    # Pairs of a pivot are dealt to parts by their other member; a part gets the pivot's set once.
    near_size = f"100 * least(m, n) >= {percent} * greatest(m, n)"
    pairs = members.join(pivots, "key").where(f"node <> pivot and {near_size}").groupBy("pivot", "node").agg(F.max("members").alias("members"))
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("members") / PAIRS, F.lit(1.0))))).cast("long")
    pairs = cut(pairs.select("pivot", "node", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(6)), F.col("parts"))), "pairs")
    near = members.select("node").distinct().join(sets.select("node", "rep", "text_key"), "node").select("node", F.col("rep").alias("__rep"), F.col("text_key").alias("__key"))
    opened = texts.join(near, (F.col("doc_id") == F.col("__rep")) & (F.col("text_key") == F.col("__key"))).select("node", "text")
    shingles = cut(opened.mapInArrow(_sets(width), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    known = sets.select("node", "signature").join(shingles, "node")
    left = pairs.select("pivot", "parts", "part").distinct().join(known.select(F.col("node").alias("pivot"), F.col("shingles").alias("p"), F.col("signature").alias("s")), "pivot")
    right = pairs.join(known.select("node", F.col("shingles").alias("q"), F.col("signature").alias("t")), "node")
    own = left.select(F.col("pivot").alias("u"), F.col("parts").alias("of"), F.col("part").alias("k"), "p", "s").groupBy("u", "of", "k")
    links = right.select("pivot", "parts", "part", "node", "q", "t").groupBy("pivot", "parts", "part").cogroup(own).applyInPandas(_confirm(percent), "u long, v long")
    first = connected_components(links)
    more = _rest_of_buckets(members, sets, shingles, first, percent)
    comp = first if more is None else connected_components(first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionAll(more))
    # A component's id is the smallest document id behind its nodes.
    rooted = sets.select("node", "d1", "d2", "rep").join(comp.withColumnRenamed("id", "node"), "node", "left").select("d1", "d2", "rep", F.coalesce("component", "node").alias("component"))
    smallest = rooted.groupBy("component").agg(F.min("rep").alias("component_id"))
    place = rooted.join(smallest, "component").select("d1", "d2", "component_id")
    found = full.join(place, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_key")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_key")
    return found.unionAll(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their distinct ``width``-word shingles (words without ASCII white space,
    A-Z lower-cased). ``component_id`` is the smallest id reachable over links,
    ``kept`` says that it is the document's own. Shingles are counted by 64-bit
    hashes of theirs: two given ones pass for the same by a chance of 2**-64. A
    linked pair is never looked at if it shares no band of BANDS (for 30 bands of 7
    a chance of 9e-4 at a similarity of 80 %, 1e-5 at 85 %; a group needs only
    one link to each member), or if its signatures agree MARGIN standard
    errors less than the limit.

    Null and empty texts and texts of white space alone have no shingles and no
    links. Repeated rows are linked with each other and come out as often as
    they came in; rows with one id and different texts are documents of their
    own, each linked by its own text. Rows with a null id keep n_shingles, have
    a null component and are kept. A text of any length counts whole; it and
    its set must fit in a task. Ties between pivots go to the first node; the
    result doesn't depend on them. An empty table gives no rows. Other columns
    of ``docs``, whatever their names, are ignored.
    """
    return _near_duplicates(docs, width, percent, id_column, text_column).drop("text_key")


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs``, all their columns, that are their component's smallest id.

    Rows without shingles and with a null id stay, repeated rows of a kept
    document too. Of rows with one id and different texts each is judged by its
    own text. An empty table stays empty; columns of any other name pass through.
    """
    gone = _near_duplicates(docs, width, percent, "doc_id", "text").where("not kept").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__key"]), "left_anti")
