"""Removal of repeated byte passages with deep-shallow suffix sorting.

Every window of ``length`` bytes is stood for by its least k-gram (leftmost of
equals), a choice that depends on the window's bytes alone, so equal windows
choose alike. A run of windows with the same choice is one record: the k-gram's
hash, where it lies, and a digest of all bytes under the run.

1. Records meet by k-gram hash. Those whose k-gram stands nowhere else are done.
   Hashes only say who meets whom; bytes decide.
2. The bytes of the others meet. Records with equal digests are sorted as whole
   strings, different ones of a k-gram window by window: multikey quicksort
   (eight bytes a step) to a shallow depth, blind tries for the groups that
   still hang together. Of strings equal to their full depth all but the first
   are repeats.
3. The covered bytes of each document are removed.

A k-gram with many different records (the edge of a passage that many documents
share) is split further, into single windows, dealt out by their own bytes; many
records with equal digests are sorted in parts, each with their first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .text_arrays import BASE, BASE_INVERSE, BYTE_CODE, U64, chunks, gather, let_go, mix, powers, prefix_sums, span_hash, text_bytes, tidy

KGRAM = 32
SHALLOW = 32
#: Different records of one k-gram that are compared together; beyond, windows are dealt out one by one.
TOGETHER = 2000
#: The same for the records of one k-gram in one batch of documents.
TOGETHER_LOCAL = 128
#: Records with one digest that are sorted together with their first.
TWINS = 1000
#: Bytes of text for each bucket, and for each partition of texts.
BUCKET_BYTES, PARTITION_BYTES = 1 << 22, 1 << 23
#: Bytes of text whose records are looked through at once.
BATCH_BYTES = 1 << 22

RECORD = np.dtype([("doc", "<i8"), ("key", "<i8"), ("at", "<i4"), ("before", "u1"), ("count", "u1"), ("gram", "<u8"), ("digest", "<u8")])
_FIELDS = RECORD.names


# ---------------------------------------------------------------- suffix sort


def _ranks(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, key), and the new group number of each place in that order."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, np.cumsum(new) - 1


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number."""
    out = np.zeros(len(at), U64)
    for k in range(8):
        out = (out << U64(8)) | text[at + k].astype(U64)
    return out


def _shared(group: np.ndarray) -> np.ndarray:
    """Which stand in groups of two and more."""
    return np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)


def _renumbered(group: np.ndarray) -> np.ndarray:
    """Groups, equal ones side by side, as 0, 1, ..."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    return np.cumsum(new) - 1


def equal_strings(text: np.ndarray, at: np.ndarray, size: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Strings text[at : at + size] that another one equals: their places in ``at`` and group numbers, in suffix order within a size.

    Multikey quicksort refines groups by eight bytes at a time to ``shallow``
    bytes; strings that stand alone drop out. The rest is ordered by blind
    tries, all groups' tries growing a level at a time: a node skips, unread by
    the order, the bytes that all its strings share and branches on the first
    that tells them apart. ``text`` needs 8 bytes of slack at its end.
    """
    who, group = _ranks(np.zeros(len(at), np.int64), size)
    at, size = at[who], size[who]
    depth = 0
    while len(at) and depth + 8 <= min(shallow, int(size.min())):
        order, group = _ranks(group, _word(text, at + depth))
        keep = _shared(group)
        order, group = order[keep], _renumbered(group[keep])
        who, at, size = who[order], at[order], size[order]
        depth += 8
    done_who, done_group, made = [], [], 0
    deep = np.full(len(at), depth)
    while len(at):
        head = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1])
        lead = np.repeat(at[head], np.diff(np.append(head, len(at))))
        agree = deep.copy()  # the depth to which each string agrees with the first of its node
        agree[lead == at] = size[lead == at]
        open_ = np.nonzero(agree < size)[0]
        while len(open_):
            a, b = at[open_] + agree[open_], lead[open_] + agree[open_]
            step = np.full(len(open_), 8)
            x = _word(text, a) ^ _word(text, b)
            for k in range(8):
                step[(step == 8) & ((x >> U64(56 - 8 * k)) & U64(255) != 0)] = k
            agree[open_] = np.minimum(agree[open_] + step, size[open_])
            open_ = open_[(step == 8) & (agree[open_] < size[open_])]
        skip = np.minimum.reduceat(agree, head)  # the node's branching depth
        branch = np.repeat(skip, np.diff(np.append(head, len(at))))
        whole = branch >= size
        if whole.any():
            done_who.append(who[whole])
            done_group.append(made + _renumbered(group[whole]))
            made = int(done_group[-1][-1]) + 1
        who, at, size, group, branch = who[~whole], at[~whole], size[~whole], group[~whole], branch[~whole]
        if not len(at):
            break
        order, group = _ranks(group, text[at + branch].astype(np.int64))
        keep = _shared(group)
        order, group = order[keep], _renumbered(group[keep])
        who, at, size, deep = who[order], at[order], size[order], branch[order] + 1
    if not done_who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_who), np.concatenate(done_group)


def equal_windows(text: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows text[p : p + length], p in ``at``, that another one equals: positions and group numbers in suffix order."""
    who, group = equal_strings(text, at, np.full(len(at), length), shallow)
    return at[who], group


# -------------------------------------------------------------------- records


def _gram_hash(data: np.ndarray) -> np.ndarray:
    """A hash of the KGRAM bytes from each position, by doubling."""
    h, n = BYTE_CODE[data], 1
    while n < KGRAM:
        h = h[:-n] * U64(BASE) + (h[n:] ^ (h[n:] >> U64(31)))
        n *= 2
    return mix(h)


def _least_at(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of ``width``."""
    v, i = value, np.arange(len(value), dtype=np.int32)
    n, parts = 1, []
    rest, off = width, 0
    while True:
        if rest & n:
            parts.append((off, v, i))
            off += n
            rest -= n
        if not rest:
            break
        right = v[n:] < v[:-n]
        v, i = np.where(right, v[n:], v[:-n]), np.where(right, i[n:], i[:-n])
        n *= 2
    m = len(value) - width + 1
    _, best, at = parts[0]
    best, at = best[:m], at[:m]
    for off, v, i in parts[1:]:
        right = v[off : off + m] < best
        best, at = np.where(right, v[off : off + m], best), np.where(right, i[off : off + m], at)
    return at


def records_of(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One record for each run of windows with the same least k-gram, and where in ``data`` it starts."""
    if len(data) < length:
        return np.zeros(0, RECORD), np.zeros(0, np.int64)
    gram = _gram_hash(data)
    least = _least_at((gram >> U64(32)).astype(np.uint32), length - KGRAM + 1)
    m = len(least)
    doc = np.repeat(np.arange(len(docs)), np.diff(offsets))[:m]
    inside = offsets[doc + 1] - np.arange(m) >= length
    p = np.nonzero(inside)[0]
    if not len(p):
        return np.zeros(0, RECORD), p
    a, d = least[p], doc[p]
    first = np.ones(len(p), bool)
    first[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    s = np.nonzero(first)[0]
    e = np.append(s[1:], len(p)) - 1
    out = np.zeros(len(s), RECORD)
    out["doc"], out["key"] = docs[d[s]], keys[d[s]]
    out["at"] = p[s] - offsets[d[s]]
    out["before"], out["count"] = a[s] - p[s], p[e] - p[s]
    out["gram"] = gram[a[s]]
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=sums[1:])
    shape = (out["before"].astype(U64) << U64(8)) | out["count"]
    out["digest"] = mix((sums[p[e] + length] - sums[p[s]]) * powers(BASE_INVERSE, len(sums))[p[s]] + mix(shape))
    return out, p[s]


def _same(r: np.ndarray, *names: str) -> np.ndarray:
    """Whether each row agrees with the row before it."""
    out = np.zeros(len(r), bool)
    out[1:] = np.logical_and.reduce([r[n][1:] == r[n][:-1] for n in names])
    return out


def _place(r: np.ndarray, *by: str) -> np.ndarray:
    """The order of records by the fields in ``by``, the last one first, then by where they stand."""
    return np.lexsort((r["at"], r["key"], r["doc"], *(r[n] for n in by)))


def _late(r: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which records stand behind the first place of their group."""
    order = np.lexsort((r["at"], r["key"], r["doc"], group))
    g = group[order]
    head = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))]
    out = np.zeros(len(r), bool)
    out[order] = np.logical_or.reduce([r[n][order] != r[n][lead] for n in ("doc", "key", "at")]) if len(g) else False
    return out


def _sorted_twins(text: np.ndarray, at: np.ndarray, r: np.ndarray, length: int) -> np.ndarray:
    """Of records with equal digests, those that an earlier one equals byte by byte."""
    who, group = equal_strings(text, at, r["count"].astype(np.int64) + length)
    r, known = r[who], len(who) == len(r)
    order = np.lexsort((group, r["digest"], r["gram"]))
    apart = ~_same(r[order], "gram", "digest")
    if not known or (np.diff(group[order])[~apart[1:]] != 0).any():
        raise RuntimeError("two different passages have one digest; change the seed of the byte codes")
    return r[_late(r, group)]


def _pack(bucket: np.ndarray, r: np.ndarray, kind: int, most: int, texts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, kind, columns one after another, bytes of texts), one row for each bucket; texts: all bytes, each record's start and length."""
    order = np.argsort(bucket, kind="stable")
    bucket, r = bucket[order], r[order]
    edge = np.append(np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1]), len(r)) if len(r) else [0]
    for lo, hi in zip(edge[:-1], edge[1:]):
        for i in range(lo, hi, most):
            j = min(hi, i + most)
            body = b""
            if texts is not None:
                data, starts, lens = texts
                body = _ZSTD.compress(data[gather(starts[order[i:j]], lens[order[i:j]])].tobytes(), asbytes=True)
            yield int(bucket[i]), kind, _columns(r[i:j]), body


_ZSTD = pa.Codec("zstd", 3)


def _columns(r: np.ndarray) -> bytes:
    """The number of records, and their columns one after another, bytes transposed, packed."""
    raw = b"".join(np.ascontiguousarray(np.frombuffer(np.ascontiguousarray(r[n]).tobytes(), np.uint8).reshape(len(r), -1).T).tobytes() for n in _FIELDS)
    return len(r).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _rows(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = _ZSTD.decompress(packed[8:], n * RECORD.itemsize)
    out, at = np.zeros(n, RECORD), 0
    for name in _FIELDS:
        size = RECORD[name].itemsize
        column = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out[name] = np.frombuffer(np.ascontiguousarray(column).tobytes(), RECORD[name])
        at += n * size
    return out


_PACKED = "bucket long, kind int, records binary, body binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("records", pa.binary()), ("body", pa.binary())])
#: What packed records are: to be compared window by window; whole repeats; k-grams that are split everywhere (in their bucket); records to be split; records to be compared as wholes.
OPEN, REPEAT, MARK, SPLIT, TWIN = 0, 1, 2, 3, 4


def _table(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "records", "body"])


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(_table(rows), schema=_PACKED_ARROW, preserve_index=False)


def _spread(r: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(r["doc"].view(U64) * U64(BASE) + r["key"].view(U64)) % U64(buckets)).astype(np.int64)


def _scan(length: int, buckets: int, most: int):
    """Records of whole texts; those that equal one before them in the batch, byte by byte, are repeats at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            docs, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in chunks(offsets, BATCH_BYTES):
                text, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                found = [records_of(text[at[i] : at[j]], at[i : j + 1] - at[i], docs[lo + i : lo + j], keys[lo + i : lo + j], length) + (at[i],) for i, j in chunks(at)]
                r, start = np.concatenate([x for x, _, _ in found]), np.concatenate([p + base for _, p, base in found])
                order = _place(r, "digest", "gram")
                r, start = r[order], start[order]
                same = _same(r, "gram", "digest")
                twin = same | np.append(same[1:], False) if len(same) else same
                slack = np.concatenate([text, np.zeros(8, np.uint8)])
                late = _sorted_twins(slack, start[twin], r[twin], length)
                rows = list(_pack(_spread(late, buckets), late, REPEAT, 1 << 16))
                # The same text may stand in several rows; its places are one.
                first = r[~same]
                grams, back, count = np.unique(first["gram"], return_inverse=True, return_counts=True)
                crowded = count[back] > most
                rows += _pack((mix(first["gram"] ^ first["digest"])[crowded] % U64(buckets)).astype(np.int64), first[crowded], SPLIT, 1 << 16)
                mark = np.zeros(int((count > most).sum()), RECORD)
                mark["gram"] = grams[count > most]
                rows += _pack((mark["gram"] % U64(buckets)).astype(np.int64), mark, MARK, 1 << 16)
                rest = first[~crowded]
                rest = rest[_place(rest)]
                rows += _pack((rest["gram"] % U64(buckets)).astype(np.int64), rest, OPEN, 1 << 16)
                yield _batch(rows)

    return run


def _classes(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first record of each digest, and all that are to be sorted as wholes: in parts of ``most``, the first in each.

    The latter have a number for their class and part in place of the k-gram's hash.
    """
    r = r[_place(r, "digest", "gram")]
    r = r[~_same(r, "gram", "digest", "doc", "key", "at")]
    same = _same(r, "gram", "digest")
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(r)))) - 1
    late = np.nonzero(same)[0]
    lead = late[place[late] % most == 0]
    twins = r[np.concatenate([late, lead - place[lead] - 1])]
    twins["gram"] = mix(twins["gram"] ^ mix(twins["digest"] + (place[np.concatenate([late, lead])] // most).astype(U64)))
    return r[~same], twins


def _meet(buckets: int, most: int, twins: int):
    """All records of a bucket of k-grams: those whose bytes are needed, and how. They go back to their documents."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tidy()
        def of(*kinds):
            return np.concatenate([np.zeros(0, RECORD), *(_rows(x) for x, k in zip(group["records"], group["kind"]) if k in kinds)])

        marked = np.unique(of(MARK)["gram"])
        first, whole = _classes(of(OPEN), twins)
        apart, whole2 = _classes(of(SPLIT), twins)
        _, back, count = np.unique(first["gram"], return_inverse=True, return_counts=True)
        split = np.isin(first["gram"], marked) | (count[back] > most)
        together = first[(count[back] > 1) & ~split]
        out = ((np.concatenate([whole, whole2]), TWIN), (together, OPEN), (np.concatenate([first[split], apart]), SPLIT), (of(REPEAT), REPEAT))
        for r, _ in out:
            r["before"] = r["digest"] = 0  # they have done their part
        return _table([x for r, kind in out for x in _pack(_spread(r, buckets), r, kind, 1 << 16)])

    return run


#: What goes back to a document: a record without its document, and a covered run of windows.
PLACE = np.dtype([("at", "<i4"), ("count", "u1"), ("kind", "u1"), ("gram", "<u8")])
RUN = np.dtype([("at", "<i4"), ("count", "u1")])


def _rows_of_documents(r: np.ndarray, kept: np.dtype, kind: np.ndarray | None = None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """A row for each document among the records: its id, its key, and the fields in ``kept`` of its records."""
    order = np.lexsort((r["key"], r["doc"]))
    r = r[order]
    edge = np.append(np.nonzero(~_same(r, "doc", "key"))[0], len(r))
    slim = np.empty(len(r), kept)
    for name in kept.names:
        slim[name] = kind[order] if name == "kind" else r[name]
    parts = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * kept.itemsize).astype(np.int32).tobytes()), pa.py_buffer(slim.tobytes())])
    return pa.array(r["doc"][edge[:-1]]), pa.array(r["key"][edge[:-1]]), parts


def _by_document(wanted: tuple[int, ...], kept: np.dtype):
    """One row for each document of a bucket of documents, from its packed rows of the kinds in ``wanted``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tidy()
        found = [(kind, _rows(packed)) for kind, packed in zip(group["kind"], group["records"]) if kind in wanted]
        kind = np.repeat([k for k, _ in found], [len(x) for _, x in found])
        docs, keys, parts = _rows_of_documents(np.concatenate([np.zeros(0, RECORD), *(x for _, x in found)]), kept, kind)
        return pd.DataFrame({"id": docs, "row_key": keys, "records": parts.to_pylist()})

    return run


def _gathered(lists: pa.ListArray, kept: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records in a column of lists of packed ones, and the row each belongs to; a null list has none."""
    sizes = np.diff(text_bytes(lists.flatten())[1])
    data = np.frombuffer(text_bytes(lists.flatten())[0].tobytes(), kept)
    per_list = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(per_list)])]
    return data, np.repeat(np.arange(len(lists)), np.diff(ends) // kept.itemsize)


def _cut_out(length: int, buckets: int):
    """The bytes under each record, packed by bucket of k-gram, or of class for those compared as wholes; records to be split as single windows by their own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            data, offsets = text_bytes(batch.column(3))
            for lo, hi in chunks(offsets, BATCH_BYTES):
                text, start = np.concatenate([data[offsets[lo] : offsets[hi]], np.zeros(8, np.uint8)]), offsets[lo:hi] - offsets[lo]
                found, owner = _gathered(batch.column(2).slice(lo, hi - lo), PLACE)
                rows = []
                for want in (OPEN, TWIN, SPLIT):
                    own = owner[found["kind"] == want]
                    r = np.zeros(len(own), RECORD)
                    for name in ("at", "count", "gram"):
                        r[name] = found[name][found["kind"] == want]
                    if not len(own):
                        continue
                    if want == SPLIT:
                        each = r["count"].astype(np.int64) + 1
                        own, places = np.repeat(own, each), gather(r["at"].astype(np.int64), each)
                        r = np.zeros(len(own), RECORD)
                        r["at"] = places
                    r["doc"], r["key"] = docs[lo:hi][own], keys[lo:hi][own]
                    first = start[own] + r["at"]
                    if want == SPLIT:
                        r["gram"] = span_hash(prefix_sums(text), first, first + length)
                        # Windows that equal one before them in the batch are repeats at once.
                        order = _place(r, "gram")
                        r, first = r[order], first[order]
                        same = _same(r, "gram")
                        twin = same | np.append(same[1:], False) if len(same) else same
                        late = _sorted_twins(text, first[twin], r[twin], length)
                        rows += _pack(_spread(late, buckets), late, REPEAT, 1 << 16)
                        r, first = r[~same], first[~same]
                    whole = text, first, r["count"].astype(np.int64) + length
                    rows += _pack((r["gram"] % U64(buckets)).astype(np.int64), r, TWIN if want == TWIN else OPEN, 1 << 14, whole)
                yield _batch(rows)

    return run


def _opened(group: pd.DataFrame, kind: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of a kind, their bytes one after another with slack, and where each starts."""
    rows = group[group["kind"] == kind]
    parts = [_rows(x) for x in rows["records"]]
    sizes = [int((r["count"].astype(np.int64) + length).sum()) for r in parts]
    text = np.concatenate([*(np.frombuffer(_ZSTD.decompress(x, n), np.uint8) for x, n in zip(rows["body"], sizes)), np.zeros(8, np.uint8)])
    r = np.concatenate([np.zeros(0, RECORD), *parts])
    return r, text, np.concatenate([[0], np.cumsum(r["count"].astype(np.int64) + length)])[:-1]


def _sort_bucket(length: int, buckets: int):
    """Records and windows of a bucket that an earlier one equals."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tidy()
        late = [np.zeros(0, RECORD), *(_rows(x) for x in group.loc[group["kind"] == REPEAT, "records"])]
        r, text, base = _opened(group, TWIN, length)
        # Parts of the bucket by class, or by k-gram, bound the arrays that are sorted at once.
        part = (r["gram"] >> U64(40)).astype(np.int64) % max(1, len(r) >> 18)
        for q in np.unique(part):
            use = part == q
            late.append(_sorted_twins(text, base[use], r[use], length))
        r, text, base = _opened(group, OPEN, length)
        del group
        count = r["count"].astype(np.int64) + 1
        part = (r["gram"] >> U64(40)).astype(np.int64) % max(1, int(count.sum()) >> 19)
        for q in np.unique(part):
            use = np.nonzero(part == q)[0]
            window = gather(base[use], count[use])
            owner = np.repeat(use, count[use])
            who, equal = equal_strings(text, window, np.full(len(window), length))
            if not len(who):
                continue
            one = np.zeros(len(who), RECORD)
            one["doc"], one["key"], one["at"] = r["doc"][owner[who]], r["key"][owner[who]], r["at"][owner[who]] + (window[who] - base[owner[who]])
            late.append(_runs(one[_late(one, equal)]))
        r = np.concatenate(late)
        r["gram"] = 0
        return _table(list(_pack(_spread(r, buckets), r, REPEAT, 1 << 16)))

    return run


def _runs(r: np.ndarray) -> np.ndarray:
    """Windows that follow each other as one record."""
    r = r[np.lexsort((r["at"], r["key"], r["doc"]))]
    if not len(r):
        return r
    follows = _same(r, "doc", "key")
    follows[1:] &= r["at"][1:] - r["at"][:-1] <= 1
    run = np.cumsum(~follows)
    start = np.nonzero(~follows)[0]
    end = np.append(start[1:], len(r)) - 1
    out = []
    lo, hi = r["at"][start].astype(np.int64), r["at"][end].astype(np.int64)
    pieces = (hi - lo) // 256 + 1
    who = np.repeat(start, pieces)
    step = gather(np.zeros(len(start), np.int64), pieces) * 256
    out = r[who]
    out["at"] = np.repeat(lo, pieces) + step
    out["count"] = np.minimum(np.repeat(hi, pieces) - out["at"], 255)
    del run
    return out


def _remaining(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets, 1 << 21):
                text, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                runs, owner = _gathered(batch.column(2).slice(lo, hi - lo), RUN)
                first = at[owner] + runs["at"]
                cover = np.bincount(first, minlength=len(text) + 1) - np.bincount(first + runs["count"] + length, minlength=len(text) + 1)
                gone = np.cumsum(cover)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = at[:-1][at[:-1] < len(text)]
                begins[heads] = gone[heads]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[at])
                spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[at])
                left = text[~gone].tobytes()
                cut = np.concatenate([[0], np.cumsum(np.diff(at) - removed)])
                kept = [left[i:j] for i, j in zip(cut[:-1], cut[1:])]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns += [batch.column(3).slice(lo, hi - lo), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
                    names += ["row_key", "kept_text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False, together: int = TOGETHER, together_local: int = TOGETHER_LOCAL, twins: int = TWINS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and row_key, kept_text).

    Removed is each byte covered by a ``length``-byte string of the same text
    that also starts earlier, in a smaller doc_id or before in the same text.
    Strings are judged on the input and never cross texts.

    Nulls are empty texts; texts under ``length`` bytes lose nothing. Of rows
    with the same doc_id, different texts are ordered by their hash; rows equal
    in both are one text and come out as often as they came in. Rows with a
    null doc_id are returned whole and compared with none. Positions are 32-bit
    numbers, which a text in one row never exceeds; a text must fit in a task.
    An empty table gives no rows. ``kept_text`` leaves out what a cut made of a
    character. Other columns, whatever their names, are ignored. ``together``,
    ``together_local`` and ``twins`` bound groups and don't change the result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("row_key"), "text")
    long = texts.where((F.octet_length("text") >= length) & F.col("id").isNotNull())
    total = long.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    # As many buckets and partitions as the texts fill, so that none grows with the input.
    buckets, parts = max(16, int(total // BUCKET_BYTES)), max(16, int(total // PARTITION_BYTES))
    scanned = long.mapInArrow(_scan(length, buckets, together_local), _PACKED)
    met = cut(scanned.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_meet(buckets, together, twins), _PACKED), "met")
    places = "id long, row_key long, records binary"
    asked = met.where(F.col("kind").isin(OPEN, SPLIT, TWIN)).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_by_document((OPEN, SPLIT, TWIN), PLACE), places)
    asked = asked.repartition(parts, "id", "row_key").groupBy("id", "row_key").agg(F.collect_list("records").alias("parts"))
    # One shuffle of the texts serves both joins, as both stand in one plan.
    dealt = long.repartition(parts, "id", "row_key")
    opened = asked.join(dealt.dropDuplicates(["id", "row_key"]), ["id", "row_key"]).select("id", "row_key", "parts", "text")
    sorted_ = opened.mapInArrow(_cut_out(length, buckets), _PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_sort_bucket(length, buckets), _PACKED)
    gone = met.where(F.col("kind") == REPEAT).unionAll(sorted_).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_by_document((REPEAT,), RUN), places)
    gone = gone.repartition(parts, "id", "row_key").groupBy("id", "row_key").agg(F.collect_list("records").alias("marks"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", row_key long, kept_text string" if with_text else "")
    # Only long texts with an id can meet a mark; the others stay where they are.
    marked = dealt.join(gone, ["id", "row_key"], "left").select("id", "text", "marks", "row_key")
    short = texts.where((F.octet_length("text") < length) | F.col("id").isNull()).select("id", "text", F.lit(None).cast("array<binary>").alias("marks"), "row_key")
    return marked.unionAll(short).mapInArrow(_remaining(length, with_text), out)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with all its columns, repeated passages taken out of ``text`` and ``n_chars`` counted anew.

    Nulls, repeated rows, null ids and short texts are as in ``remove_repeats``:
    they stay as they are. An empty table stays empty; columns of any other
    name pass through.
    """
    left = remove_repeats(docs, length, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("kept_text").alias("__text")).dropDuplicates(["__id", "__key"])
    met = (docs["doc_id"].cast("long") == left["__id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == left["__key"])
    joined = docs.join(left, met, "left")
    changed = left["__id"].isNotNull()

    def column(c: str):
        if c == "text":
            return F.when(changed, left["__text"]).otherwise(docs[c]).alias(c)
        if c == "n_chars":
            return F.when(changed, F.length(left["__text"])).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c)
        return docs[c]

    return joined.select(*[column(c) for c in docs.columns])
