"""The vocabulary of call sequences as column expressions and a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Token ids and call types of the published annotation scheme.
PAD, BOS, EOS = 0, 1, 2
PAUSE_BINS = (0.5, 2.0, 5.0, 15.0)
PAUSE_FIRST = 3
WHALE_OFFSET, MAX_WHALES = 8, 20
CODA_OFFSET = 28
CODA_TYPES = (
    "1+1+3 1+31 1+32 2+3 3D 3R 4D 4R1 4R2 5R1 5R2 5R3 6R 6i 7D1 7D2 7R 7i 8D 8R 8i 9R 9i 10R 10i "
    "1-NOISE 2-NOISE 3-NOISE 4-NOISE 5-NOISE 6-NOISE 7-NOISE 8-NOISE 9-NOISE 10-NOISE "
    "clicks:1 clicks:2 clicks:3 clicks:4 clicks:5 clicks:6 clicks:7 clicks:8 clicks:9 clicks:10 clicks:11+"
).split()
VOCAB_SIZE = CODA_OFFSET + len(CODA_TYPES)
_PAUSE_TEXT = ("<pause:0-0.5s>", "<pause:0.5-2s>", "<pause:2-5s>", "<pause:5-15s>", "<pause:>15s>")


def vocabulary(spark: SparkSession) -> DataFrame:
    """token_id, kind, text of all tokens."""
    rows = [(PAD, "special", "<pad>"), (BOS, "special", "<bos>"), (EOS, "special", "<eos>")]
    rows += [(PAUSE_FIRST + i, "pause", t) for i, t in enumerate(_PAUSE_TEXT)]
    rows += [(WHALE_OFFSET + i, "whale", f"<whale:{i + 1}>") for i in range(MAX_WHALES)]
    rows += [(CODA_OFFSET + i, "coda", t) for i, t in enumerate(CODA_TYPES)]
    return spark.createDataFrame(rows, "token_id int, kind string, text string")


def pause_token(gap: Column) -> Column:
    """Bucket of a positive gap in seconds; null for none (null, NaN, zero or less)."""
    g = F.nanvl(gap.cast("double"), F.lit(None))
    out = F.when(g > 0, F.lit(PAUSE_FIRST) + sum((g >= b).cast("int") for b in PAUSE_BINS))
    return out.cast("int")


def whale_token(whale: Column) -> Column:
    """8.. for individuals 1 to 20, else null."""
    return F.when(whale.between(1, MAX_WHALES), WHALE_OFFSET - 1 + whale).cast("int")


def coda_token(coda_type: Column) -> Column:
    """Id of a type name, null if unknown."""
    names = F.create_map(*[F.lit(x) for i, t in enumerate(CODA_TYPES) for x in (t, CODA_OFFSET + i)])
    return F.try_element_at(names, coda_type)


def click_key(n_clicks: Column) -> Column:
    return F.when(n_clicks > 10, F.lit("clicks:11+")).otherwise(F.concat(F.lit("clicks:"), n_clicks.cast("string")))


def type_token(coda_type: Column, n_clicks: Column | None = None) -> Column:
    """The type's id; the click count decides only where no type is given (null, empty or 'nan')."""
    missing = coda_type.isNull() | coda_type.isin("", "nan")
    if n_clicks is None:
        return F.when(~missing, coda_token(coda_type))
    return F.when(~missing, coda_token(coda_type)).otherwise(coda_token(click_key(n_clicks)))


def decode_token(token: Column) -> Column:
    """Text of an id, ``<unk:N>`` for ids that are none."""
    t = token
    pauses = F.array(*[F.lit(x) for x in _PAUSE_TEXT])
    names = F.array(*[F.lit(x) for x in CODA_TYPES])
    return (
        F.when(t == PAD, "<pad>").when(t == BOS, "<bos>").when(t == EOS, "<eos>")
        .when(t.between(PAUSE_FIRST, PAUSE_FIRST + 4), F.try_element_at(pauses, (t - PAUSE_FIRST + 1).cast("int")))
        .when(t.between(WHALE_OFFSET, CODA_OFFSET - 1), F.concat(F.lit("<whale:"), (t - WHALE_OFFSET + 1).cast("string"), F.lit(">")))
        .when(t.between(CODA_OFFSET, VOCAB_SIZE - 1), F.try_element_at(names, (t - CODA_OFFSET + 1).cast("int")))
        .otherwise(F.concat(F.lit("<unk:"), t.cast("string"), F.lit(">")))
    )


def is_coda(token: Column) -> Column:
    return token >= CODA_OFFSET


def is_pause(token: Column) -> Column:
    return token.between(PAUSE_FIRST, PAUSE_FIRST + 4)


def is_whale(token: Column) -> Column:
    return token.between(WHALE_OFFSET, WHALE_OFFSET + MAX_WHALES - 1)
