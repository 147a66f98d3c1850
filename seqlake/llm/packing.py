"""Best-fit packing of documents into training sequences, certified by lower bounds.

Pieces are dealt to partitions by hash; each packs its own by best-fit
decreasing. A dual-feasible function maps lengths so that no full sequence maps
to more than one, so the mapped sum is a lower bound on the number of
sequences. A partition that meets its bound is certified: its sequences stand,
but for its emptiest. What is left, and all sequences with room of partitions
above their bound, are exchanged (dealt anew to fewer partitions) and packed
again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .text_arrays import chunks, text_bytes
from .word_ids import encoder

#: Pieces in a partition that is packed at once.
TOGETHER = 40_000
ROUNDS = 5


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible functions: sequences that any packing needs."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.nonzero(count)[0]
    n = count[x]
    best = -(-int((x * n).sum()) // capacity)
    for low in np.unique(np.concatenate([x[2 * x <= capacity], capacity - x[2 * x > capacity] + 1])):
        # what is over capacity - low counts as a full sequence, what is under low as nothing
        f = np.where(x > capacity - low, capacity, np.where(x < low, 0, x))
        best = max(best, -(-int((f * n).sum()) // capacity))
    for k in range(1, 12):
        # lengths rounded down to k-ths, but for exact (k + 1)-ths
        exact = (k + 1) * x % capacity == 0
        f = np.where(exact, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((f * n).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences.

    Longest first; each goes where least room is left over, if it fits
    anywhere. A bit mask of the rooms that exist finds that place.
    """
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: dict[int, list[int]] = {}
    mask, made = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = with_room[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        place[i], offset[i] = b, capacity - room
        room -= n
        if room:
            with_room.setdefault(room, []).append(b)
            mask |= 1 << room
    return place, offset, made


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            sizes = text_bytes(batch.column(1))[1]
            for i, j in chunks(sizes, 1 << 23):
                ids, at = enc.batch(batch.column(1).slice(i, j - i))
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, d in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    own = np.concatenate([ids[at[k] : at[k + 1]], end])
                    for p, lo in enumerate(range(0, len(own), capacity)):
                        part = own[lo : lo + capacity].astype("<u4")
                        doc.append(d)
                        piece.append(p)
                        start.append(lo)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def document_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and ``end_id``, cut only if over ``capacity``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return texts.mapInArrow(_pieces(path, capacity, end_id, with_ids), schema)


def _pack(capacity: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        place, offset, made = best_fit_decreasing(lengths, capacity)
        load = np.bincount(place, lengths, made)
        if last:
            done = np.ones(made, bool)
        elif made == lower_bound(lengths, capacity):
            done = np.arange(made) != np.argmin(load)
        else:
            done = load == capacity
        return group.drop(columns="part").assign(sequence_id=group["sequence_id"] + place, offset=offset, done=done[place])

    return run


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (with doc_id, piece, ids_crc32 and length up to ``capacity``) with sequence_id and offset.

    Pieces of a sequence follow each other without a gap from offset 0.
    sequence_id tells the round, the partition and the sequence apart.
    """
    alone = pieces.where(F.col("length") == capacity)
    full = alone.select(*pieces.columns, (F.lit(ROUNDS + 1).cast("long") * F.lit(1 << 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    schema = pieces.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint,done:boolean"
    out, before = [full], None
    for turn in range(ROUNDS):
        left = rest.count()
        if not left:
            break
        parts = max(1, -(-left // TOGETHER))
        last = turn == ROUNDS - 1 or parts == 1 or left == before
        before = left
        part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts))
        dealt = rest.select(*pieces.columns, part.alias("part"))
        dealt = dealt.withColumn("sequence_id", F.lit(turn + 1).cast("long") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24)).withColumn("offset", F.lit(0).cast("long")).withColumn("done", F.lit(False))
        packed = cut(dealt.groupBy("part").applyInPandas(_pack(capacity, last), schema), "packed")
        out.append(packed.where("done").drop("done"))
        rest = packed.where("not done").select(*pieces.columns)
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null and empty texts are documents of ``end_id`` alone. Repeated rows are
    packed as often as they come, rows with a null doc_id too. A text of any
    length is encoded whole and cut into pieces only by ``capacity``; it must
    fit in a task. Pieces of equal length are alike to the packing: which of
    them goes where is left open, and so are the numbers of sequences; how many
    sequences there are is not. Other columns of ``docs``, whatever their
    names, are ignored; an empty table gives no rows.
    """
    return pack(cut(document_pieces(docs, path, capacity, end_id, with_ids), "pieces"), capacity)
