"""Token and code arrays: interleaving codebooks and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODEBOOK = 1024


def interleave(codes: Column) -> Column:
    """Step by step, one code of each codebook, codebook c shifted by 1024 * c."""
    steps = F.sequence(F.lit(1), F.size(F.element_at(codes, 1)))
    return F.flatten(F.transform(steps, lambda t: F.transform(codes, lambda book, c: F.element_at(book, t) + c * CODEBOOK)))


def deinterleave(tokens: Column, n: int) -> Column:
    """Codebook-major arrays of an interleaved sequence whose length ``n`` divides."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.transform(F.filter(tokens, lambda t, i: i % n == c), lambda t: t - c * CODEBOOK))


def to_sequence(codes: Column) -> Column:
    """One codebook as it is, more of them interleaved."""
    return F.when(F.size(codes) == 1, F.element_at(codes, 1)).otherwise(interleave(codes))


def separator(n: int) -> int | None:
    return n * CODEBOOK + 2 if n > 1 else None


def strip(tokens: Column, sep: int | None) -> Column:
    """Without padding and separators."""
    return F.filter(tokens, lambda t: (t > 0) & (t != sep) if sep is not None else t > 0)


def recover_codes(tokens: Column, n: int, total: int | None = None) -> Column:
    """Codes 0..1023 per codebook from model tokens; codebooks missing up to ``total`` are zeros."""
    clean = strip(tokens, separator(n))
    whole = F.slice(clean, F.lit(1), (F.floor(F.size(clean) / n) * n).cast("int"))
    books = F.transform(deinterleave(whole, n), lambda book: F.transform(book, lambda t: F.greatest(F.lit(0), F.least(t - 1, F.lit(CODEBOOK - 1)))))
    if total is None or total <= n:
        return books
    zeros = F.transform(F.element_at(books, 1), lambda _: F.lit(0))
    return F.concat(books, F.array_repeat(zeros, total - n))


def keep_codebooks(codes: Column, n: int) -> Column:
    """Codebooks from ``n`` on set to zero."""
    return F.transform(codes, lambda book, c: F.when(c < n, book).otherwise(F.transform(book, lambda _: F.lit(0))))


def codebook(codes: Column, index: int | None = None) -> Column:
    return F.element_at(codes, (index or 0) + 1)


def strided(tokens: Column, n: int) -> Column:
    return F.filter(tokens, lambda t, i: i % n == 0)


def prompt(tokens: Column, p: int) -> Column:
    return F.slice(tokens, 1, p)
