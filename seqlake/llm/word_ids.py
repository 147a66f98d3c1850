"""Token ids of many texts, each distinct white-space chunk of a batch encoded once."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text_arrays import gather, held

#: Words remembered by one worker.
REMEMBERED = 500_000


class WordEncoder:
    """Ids of a BPE vocabulary file with word ends, as the ``tokenizers`` library gives them.

    The vocabulary's pre-tokeniser never joins what white space parts, so the
    ids of a text are those of its chunks. Chunks of common letters go through
    byte-pair ranks, where a spare byte stands for the word end; any other
    chunk, and any that holds an added token's text, goes through the library
    itself with its default settings.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"]["end_of_word_suffix"]
        # Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.added = re.compile("|".join(map(re.escape, sorted(special))) if special else r"(?!)")
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token in special:
                continue
            ended = token.endswith(end) and token != end
            ranks[bytes(shown[c] for c in (token[: -len(end)] if ended else token)) + (b"\xff" if ended else b"")] = i
        ranks.setdefault(b"\xff", max(spec["model"]["vocab"].values()) + 1)
        self.ranks = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, list[int]] = {}

    #: Chunks of printable ASCII and Latin letters alone take the short way, with the vocabulary's own split for them.
    _common = re.compile(r"[!-~À-ÖØ-öø-ſ]+\Z")
    _split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.ranks._encode_single_piece(word.encode() + b"\xff")
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(word) < 64:
                self.known[word] = ids
        return ids

    def chunk(self, text: str) -> list[int]:
        if not self._common.match(text) or self.added.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        words = self._split.findall(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())
        if len(words) == 1:
            return self.word(words[0])
        out: list[int] = []
        for word in words:
            out += self.known.get(word) or self.word(word)
        return out

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and n + 1 offsets; null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        codes = lists.flatten().dictionary_encode()
        flat: list[int] = []
        size = []
        for text in codes.dictionary.to_pylist():
            ids = self.chunk(text)
            flat += ids
            size.append(len(ids))
        size = np.array(size, np.int64)
        start = np.cumsum(size) - size
        code = codes.indices.to_numpy(zero_copy_only=False)
        each = size[code] if len(code) else np.zeros(0, np.int64)
        ids = np.array(flat, np.uint32)[gather(start[code], each)] if len(code) else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(each)])[bounds - bounds[0]]


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker while it encodes."""
    return held(("encoder", path), lambda: WordEncoder(path))
