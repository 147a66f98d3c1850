"""Training sets of call sequences: split by group first, then tokens, windows and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import tokenize
from .windows import examples, sliced, split


def _examples(tokens: DataFrame, name: str, length: int, seed: int, windows: bool) -> DataFrame:
    """dataset, split, id, start, input_ids, target_ids, attention_mask of ``tokens(id, tokens)``."""
    parts = split(tokens, "id", seed)
    kept = tokens.where(F.size("tokens") > 3)
    if windows:
        cut = sliced(kept, "tokens", length, ["id"]).select("id", "start", "tokens")
    else:
        cut = kept.select("id", F.lit(0).cast("long").alias("start"), F.slice("tokens", 1, length + 1).alias("tokens"))
    # The split's side has names alone.
    made = examples(cut, length).join(parts, "id")
    return made.select(F.lit(name).alias("dataset"), "split", "id", "start", "input_ids", "target_ids", "attention_mask")


def symbolic_datasets(codas: DataFrame, calls: DataFrame, coda_keys: list[str], coda_order: list[str], call_keys: list[str], call_order: list[str], coda_length: int = 128, dialogue_length: int = 256, seed: int = 42) -> DataFrame:
    """dataset (coda, dialogue), split (train, val, test), id, start, input_ids, target_ids, attention_mask.

    ``codas`` become sequences of types alone, one for each group of
    ``coda_keys``, cut at ``coda_length`` + 1; ``calls`` become dialogues with
    pauses and individuals, in windows of ``dialogue_length`` + 1 that overlap
    by half. Groups are split 80/10/10 in the order of a seeded hash before
    sequences of three tokens or fewer are left out, so a group is in one split
    with all its windows. Groups of fewer than three rows and those with a null
    key have no sequence. ``id`` is the keys joined by colons.
    """
    name = lambda keys: F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("id")
    types = tokenize(codas, coda_keys, coda_order, pauses=False, whales=False).select(name(coda_keys), "tokens")
    whole = tokenize(calls, call_keys, call_order).select(name(call_keys), "tokens")
    return _examples(types, "coda", coda_length, seed, False).unionByName(_examples(whole, "dialogue", dialogue_length, seed, True))
