"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie. A failure link leads from a node to what is left of
its string after the longest tokens at its front are taken off; how many those
are is precomputed. So a word's number of pieces is a sum of these counts along
one pass over its bytes, and no piece is ever built.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import chunks, text_bytes

#: Words remembered by one worker.
REMEMBERED = 500_000
#: The byte that ends a word; UTF-8 never has it.
END = 0xFF


class LongestMatch:
    """Trie with failure links and popped-token counts over byte strings; ``free`` tokens count nothing."""

    def __init__(self, tokens: list[bytes], free: frozenset[bytes] = frozenset()):
        self.go: list[dict[int, int]] = [{}]
        whole, weight = [False], [0]
        for token in tokens:
            at = 0
            for b in token:
                to = self.go[at].get(b)
                if to is None:
                    to = self.go[at][b] = len(self.go)
                    self.go.append({})
                    whole.append(False)
                    weight.append(0)
                at = to
            whole[at] = at != 0
            weight[at] = int(token not in free)
        n = len(self.go)
        #: -1: nothing can be taken off the front.
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for b, at in self.go[up].items():
                queue.append(at)
                if whole[at]:
                    self.fail[at], self.popped[at] = 0, weight[at]
                    continue
                z, count = self.fail[up], self.popped[up]
                while z >= 0 and b not in self.go[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[at], self.popped[at] = self.go[z][b], count

    def count(self, word: bytes) -> int | None:
        """Pieces of ``word``, or None if greedy matching gets stuck."""
        go, fail, popped = self.go, self.fail, self.popped
        at = total = 0
        for b in word:
            to = go[at].get(b)
            while to is None:
                if fail[at] < 0:
                    return None
                total += popped[at]
                at = fail[at]
                to = go[at].get(b)
            at = to
        while at:
            if fail[at] < 0:
                return None
            total += popped[at]
            at = fail[at]
        return total


class TokenCounter:
    """Counts of a vocabulary file whose last pieces of words bear a word end."""

    _short = re.compile(r"[!-~À-ÖØ-öø-ſ]+\Z")
    _split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"]["end_of_word_suffix"]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.any_split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        tokens = []
        for token in spec["model"]["vocab"]:
            if token not in special:
                ended = token.endswith(end) and token != end
                tokens.append(bytes(shown[c] for c in (token[: -len(end)] if ended else token)) + (bytes([END]) if ended else b""))
        # Where the longest match ends just before the word end, that is left over and no piece of its own.
        self.match = LongestMatch([*tokens, bytes([END])], frozenset([bytes([END])]))
        self.known: dict[str, tuple[int, int]] = {}

    def chunk(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text without white space; a word that gets stuck is one unknown token."""
        low = unicodedata.normalize("NFC", text).lower()
        words = (self._split if self._short.match(text) else self.any_split).findall(low)
        total = 0
        for w in words:
            n = self.known.get(w)
            if n is None:
                n = self.match.count(w.encode() + bytes([END]))
                n = 1 if n is None else n
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                if len(w) < 64:
                    self.known[w] = n
            total += n
        return len(words), total

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        codes = lists.flatten().dictionary_encode()
        each = np.array([self.chunk(x) for x in codes.dictionary.to_pylist()], np.int64).reshape(-1, 2)
        code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(each[code], axis=0)])[bounds - bounds[0]]
        return tuple(np.diff(sums, axis=0).T)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            sizes = text_bytes(batch.column(1))[1]
            for i, j in chunks(sizes, 1 << 23):
                words, tokens = count.batch(batch.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of each row: words by the vocabulary's own split, tokens by greedy longest match.

    A word end that the longest match leaves over adds no token. Null, empty and blank texts count nothing. Rows come out as they come in,
    null ids and repeated rows too; an empty table gives no rows. A text of any length is counted whole; it must fit in a task. Other columns,
    whatever their names, are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_run(path), "doc_id long, n_words long, n_tokens long")
