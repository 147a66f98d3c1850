"""Benchmark passages in training text, found with a suffix automaton over words.

The automaton is generalised: it holds every run of words of every item. Texts
stream through it; its state is the longest run that ends at the present word
and stands in some item. A run of at least the window's length contains the
window, and the state's suffix of that length tells the items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import LOWER, chunks, held, same_spans, text_bytes, word_hash, words

#: Bytes of item text in one automaton, which goes to every task; more items make more automata.
AUTOMATON_BYTES = 4 << 20

#: Bytes of words: digits, lower-case letters and all of UTF-8 beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


class Words(NamedTuple):
    """All words of some texts: the lower-cased bytes, and each word's start, end, text number."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts, A-Z lower-cased."""
    low = LOWER[data]
    return Words(low, *words(low, offsets, IN_WORD))


class Automaton:
    """Suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        for item, sequence in items:
            state = 0
            for word in sequence:
                state = self._extend(state, word)
        # The states of all prefixes of an item, and all their suffixes, occur in it.
        short: dict[int, set[tuple[int, int]]] = {}
        for item, sequence in items:
            state = 0
            for word in sequence:
                state = self.next[state][word]
                at = state
                while at > 0 and item not in self.items[at]:
                    self.items[at].add(item)
                    at = self.link[at]
            if 0 < len(sequence) < window:
                short.setdefault(state, set()).add((len(sequence), item))
        self.shortest = min((min(len(s), window) for _, s in items if s), default=0)
        # For each state: (length, items) of windows that are a suffix of it, longest first, along its links.
        self.ends: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up, own = self.link[state], []
            if self.length[state] >= window > self.length[up]:
                own.append((window, frozenset(self.items[state])))
            by_length: dict[int, set[int]] = {}
            for n, item in short.get(state, ()):
                by_length.setdefault(n, set()).add(item)
            # A short item lies in the state of its last word, which stands for every run that always ends like it.
            own += [(n, frozenset(x)) for n, x in sorted(by_length.items(), reverse=True)]
            self.ends[state] = (*own, *self.ends[up])

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, word, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            other = self.next[at][word]
            self.link[new] = other if self.length[other] == self.length[at] + 1 else self._clone(at, word, other)
        return new

    def _clone(self, at: int, word: int, other: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[other]))
        self.link[copy], self.link[other] = self.link[other], copy
        while at >= 0 and self.next[at].get(word) == other:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        self.items.append(set())
        return len(self.length) - 1

    def stream(self, sequence: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of ``sequence`` (first word, word after the last), in order of their ends, and the items hit."""
        following, link, length, ends = self.next, self.link, self.length, self.ends
        state = matched = 0
        hits, found = [], set()
        for i, word in enumerate(sequence):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            to = following[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if ends[state]:
                longest = 0
                for n, items in ends[state]:
                    if n <= matched:
                        longest = max(longest, n)
                        found |= items
                if longest:
                    hits.append((i + 1 - longest, i + 1))
        return hits, found


class Index:
    """An automaton with the words it knows. Hashes find a word, its bytes confirm it."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        w = words_of(*text_bytes(pa.array([t for _, t in items], pa.string())))
        spelt = [w.data[s:e].tobytes() for s, e in zip(w.starts.tolist(), w.ends.tolist())]
        different = len(set(spelt))
        for self.seed in count():  # until no two words of the items have one hash
            self.vocabulary, first, code = np.unique(word_hash(w.data, w.starts, w.ends, self.seed), return_index=True, return_inverse=True)
            if len(self.vocabulary) == different:
                break
        self.text, self.starts, self.ends = w.data, w.starts[first], w.ends[first]
        bounds = np.searchsorted(w.doc, np.arange(len(items) + 1))
        self.automaton = Automaton([(i, code[bounds[k] : bounds[k + 1]].tolist()) for k, (i, _) in enumerate(items)], window)

    def hits(self, w: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """By text number: hit ranges in its words, joined, and items."""
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        doc = w.doc
        if not len(self.vocabulary) or not len(doc):
            return out
        h = word_hash(w.data, w.starts, w.ends, self.seed)
        code = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == h
        met = np.nonzero(known)[0]
        known[met] = same_spans(w.data, w.starts[met], w.ends[met], self.text, self.starts[code[met]], self.ends[code[met]])
        # Only unbroken runs of known words, long enough for a window, can hold one.
        first = known.copy()
        first[1:] &= ~known[:-1] | (doc[1:] != doc[:-1])
        last = known.copy()
        last[:-1] &= ~known[1:] | (doc[1:] != doc[:-1])
        lo, hi = np.nonzero(first)[0], np.nonzero(last)[0] + 1
        long = hi - lo >= self.automaton.shortest
        head = np.searchsorted(doc, np.arange(doc[-1] + 1))
        for a, b in zip(lo[long].tolist(), hi[long].tolist()):
            ranges, items = self.automaton.stream(code[a:b].tolist())
            if ranges:
                d = int(doc[a])
                own, ids = out.setdefault(d, ([], set()))
                ids |= items
                for s, e in ranges:
                    s, e = s + a - int(head[d]), e + a - int(head[d])
                    while own and own[-1][1] >= s:
                        s = min(s, own.pop()[0])
                    own.append((s, e))
        return out


_FOUND = "doc_id long, row_key long, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"


def _token(items: list[tuple[int, str | None]], window: int) -> str:
    return hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest()


def _built(token: str, items: list[tuple[int, str | None]], window: int) -> Index:
    """The index of ``items``, built once by each worker for all its tasks that follow each other."""
    return held(("index", token), lambda: Index(items, window))


def _find(items: list[tuple[int, str | None]], window: int):
    token = _token(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _built(token, items, window)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j in chunks(offsets):
                w = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = index.hits(w)
                spans = [[{"lo": s, "hi": e} for s, e in found.get(k, ([], ()))[0]] for k in range(j - i)]
                ids = [sorted(map(str, found.get(k, ([], ()))[1])) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.bincount(w.doc, minlength=j - i).astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(ids, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "row_key", "n_words", "spans", "items"],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, with_key: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words, items (ids as sorted strings) with windows in it.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one. Words are runs of digits, letters and non-ASCII characters,
    A-Z lower-cased. Null and empty texts have no words and no hits; null and
    wordless items have no windows; repeated items count by their id. Repeated
    rows and null ids come out as they come in, an empty table gives no rows.
    Texts of any length are read whole; one must fit in a task. Other columns,
    whatever their names, are ignored.

    The items go to the driver and to each task in parts of AUTOMATON_BYTES,
    an automaton each; the parts' hits are joined by document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), F.col("text").cast("string").alias("text"))
    sized = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-total // AUTOMATON_BYTES))
    if parts == 1:
        rows = [(r[0], r[1]) for r in sized.collect()]
        found = texts.mapInArrow(_find(rows, window), _FOUND)
        return found if with_key else found.drop("row_key")
    # Rows are told apart by their id and text, which every pass over the table sees alike.
    texts = texts.withColumn("row_key", F.xxhash64("text"))
    each = None
    for k in range(parts):
        rows = [(r[0], r[1]) for r in sized.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()]
        part = texts.mapInArrow(_find(rows, window), _FOUND)
        each = part if each is None else each.unionAll(part)
    hit = each.where(F.size("spans") > 0).groupBy("doc_id", "row_key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    base = texts.mapInArrow(_find([], window), _FOUND).select("doc_id", "row_key", "n_words")
    out = base.join(hit, (base["doc_id"].eqNullSafe(hit["doc_id"])) & (base["row_key"] == hit["row_key"]), "left")
    empty = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")
    out = out.select(base["doc_id"], base["row_key"], "n_words", _joined(F.coalesce("spans", empty)).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    return out if with_key else out.drop("row_key")


def _joined(spans):
    """Sorted spans with overlapping and touching ones made one."""
    empty = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")

    def add(done, s):
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["hi"] < s["lo"])
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))))
        return F.when(apart, F.concat(done, F.array(s))).otherwise(merged)

    return F.aggregate(F.array_sort(spans), empty, add)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["hi"] - s["lo"]).cast("long"))
    found = contamination(docs, benchmark, window).select("doc_id", "n_words", hit.alias("n_hit"), "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _cut(batch: pa.RecordBatch, coverage: float, find) -> Iterator[pa.RecordBatch]:
    """The batch without the spans that ``find(first row, row after the last, words)`` gives by text number."""
    at = batch.schema.get_field_index("text")
    data, offsets = text_bytes(batch.column(at))
    for i, j in chunks(offsets):
        base = offsets[i]
        w = words_of(data[base : offsets[j]], offsets[i : j + 1] - base)
        starts, ends = w.starts, w.ends
        found = find(i, j, w)
        many = np.bincount(w.doc, minlength=j - i)
        first = np.cumsum(many) - many
        texts = batch.column(at).slice(i, j - i).to_pylist()
        keep = np.ones(j - i, bool)
        for k, spans in found.items():
            keep[k] = sum(e - s for s, e in spans) <= coverage * many[k]
            raw, out, done = data[offsets[i + k] : offsets[i + k + 1]].tobytes(), [], 0
            shift = int(offsets[i + k] - base)
            for s, e in spans:
                out.append(raw[done : int(starts[first[k] + s]) - shift])
                done = int(ends[first[k] + e - 1]) - shift
            texts[k] = b"".join([*out, raw[done:]]).decode("utf-8", "replace")
        columns = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns)]
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))


def _strip(items: list[tuple[int, str | None]], window: int, coverage: float):
    token = _token(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _built(token, items, window)
        for batch in batches:
            yield from _cut(batch, coverage, lambda i, j, w: {k: spans for k, (spans, _) in index.hits(w).items()})

    return run


def _strip_known(coverage: float):
    """Cuts the spans in the last column, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            known = lambda i, j, w: {k: [(s["lo"], s["hi"]) for s in spans] for k, spans in enumerate(last.slice(i, j - i).to_pylist()) if spans}  # noqa: B023, E731
            yield from _cut(batch.select(batch.schema.names[:-1]), coverage, known)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5) -> DataFrame:
    """``docs``, all columns, without the spans of ``contamination`` in ``text``.

    Documents with more than ``coverage`` of their words hit go whole. n_chars,
    if there, is counted anew where text went. For items beyond AUTOMATON_BYTES
    the spans of all parts are found in the unchanged texts and joined first.
    Null texts, repeated rows and null ids stay as they come; an empty table
    stays empty; columns of any other name pass through, whichever way is taken.
    """
    sized = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    if total <= AUTOMATON_BYTES:
        rows = [(r[0], r[1]) for r in sized.collect()]
        out = docs.mapInArrow(_strip(rows, window, coverage), docs.schema)
    else:
        # Spans depend on the text alone, so repeated rows share them.
        hit = contamination(docs, benchmark, window, with_key=True).where(F.size("spans") > 0).groupBy("doc_id", "row_key").agg(F.first("spans").alias("spans"))
        # The found columns get names that no column of docs has.
        own, of, spans = (next(n for k in count() if (n := f"{name}_{k}") not in docs.columns) for name in ("id", "row", "spans"))
        hit = hit.select(F.col("doc_id").alias(own), F.col("row_key").alias(of), F.col("spans").alias(spans))
        met = docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit[own]) & (F.xxhash64(docs["text"].cast("string")) == hit[of]), "left")
        out = met.select(*[docs[c] for c in docs.columns], spans).mapInArrow(_strip_known(coverage), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
