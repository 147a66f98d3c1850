"""Recordings of any length as rows of blocks: filters, loudness, cuts at silences.

A recording is rows (key, block, samples): blocks numbered from 0, all of
``size`` samples but the last. No step holds a recording in one row; what is
summed, ranked or joined across blocks are frames' energies, filter states,
silences and cuts, never samples. Samples move once, in slices of chunks.
Rows with a null key, block or samples take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.staging import staged
from . import signal as G
from .selection import quantiles
from .windows import running_sum

#: Quiet frames of a recording that are ranked in one task.
SPAN = 65_536


def blocked(recordings: DataFrame, key: str, size: int) -> DataFrame:
    """Whole recordings (``key``, samples) as block rows, for those that are short enough to be rows."""
    starts = F.sequence(F.lit(1), F.size("samples"), F.lit(size))
    return recordings.where(F.size("samples") > 0).select(key, F.posexplode(F.transform(starts, lambda a: F.slice("samples", a, F.lit(size)))).alias("block", "samples"))


def _sound(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.where(F.col(key).isNotNull() & F.col("block").isNotNull() & (F.size("samples") > 0))


# ------------------------------------------------------------------- filters


def _by_length(samples: pd.Series, of) -> pd.Series:
    """``of(blocks as rows, their places)`` of all blocks of one length at once, up to a million samples."""
    out, sizes = [None] * len(samples), samples.map(len).to_numpy()
    for n in np.unique(sizes):
        same, at_once = np.flatnonzero(sizes == n), max(1, 1_000_000 // int(n))
        for i in range(0, len(same), at_once):
            rows = same[i : i + at_once]
            for place, y in zip(rows, of(np.stack(samples.iloc[rows]).astype(np.float64), rows)):
                out[place] = y
    return pd.Series(out)


def _from_rest(sos: np.ndarray):
    @pandas_udf(ArrayType(DoubleType()))
    def run(samples: pd.Series) -> pd.Series:
        return _by_length(samples, lambda x, _: G.sos_states_of(sos, x)[1].reshape(len(x), -1))

    return run


def _from_state(sos: np.ndarray):
    @pandas_udf(ArrayType(DoubleType()))
    def run(samples: pd.Series, state: pd.Series) -> pd.Series:
        return _by_length(samples, lambda x, rows: G.sos_states_of(sos, x, np.stack(state.iloc[rows]))[0])

    return run


def _times(matrix: np.ndarray, v: Column) -> Column:
    """A constant matrix times an array column; terms that underflow to zero are left out."""
    rows = []
    for row in matrix:
        terms = [F.lit(float(m)) * F.element_at(v, j + 1) for j, m in enumerate(row) if m]
        rows.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return F.array(*rows)


def entering_states(leaving: DataFrame, key: str, step: np.ndarray, most: int) -> DataFrame:
    """``leaving(key, block, state)`` with ``state`` replaced by the state in which each block is entered.

    ``state`` is what a block leaves behind if entered at rest, and ``step``
    carries a state over a whole block, so block i is entered in the sum of
    step**(i - 1 - j) applied to the states of all j before it. The sum is a
    prefix scan by doubling: in round r each block adds what the block 2**r
    before it has gathered, carried over 2**r blocks. All rounds use one
    partitioning and one order, so the states are shuffled once. ``most`` is
    the greatest number of blocks of a recording.
    """
    w = Window.partitionBy(key).orderBy("block")
    zero = F.array(*[F.lit(0.0)] * len(step))
    # Entered at rest but for the block before: the scan's start.
    out = leaving.withColumn("state", F.coalesce(F.lag("state", 1).over(w), zero))
    far, power = 1, step
    while far < most:
        gathered = F.coalesce(F.lag("state", far).over(w), zero)
        out = out.withColumn("__g", gathered).withColumn("state", F.zip_with("state", _times(power, F.col("__g")), lambda a, b: a + b)).drop("__g")
        far, power = 2 * far, power @ power
        power[np.abs(power) < 1e-300] = 0.0
        if not power.any():
            break  # what is further back has died away
    return out


def filtered(blocks: DataFrame, key: str, size: int, sos: np.ndarray) -> DataFrame:
    """Block rows after a cascade of second-order sections, as if each recording had been filtered whole.

    A cascade is linear: a block's leaving state is a fixed matrix times the
    state it is entered in, plus its response from rest. The responses are
    computed block by block, the entering states by a prefix scan of a few
    numbers a block (``entering_states``), then each block is filtered from its
    exact state. ``blocks`` is read twice; the samples are not shuffled unless
    the states are too many to be sent to all tasks.
    """
    sound = _sound(blocks, key)
    leaving = staged(sound.select(key, F.col("block").cast("long").alias("block"), _from_rest(sos)("samples").alias("state")))
    most = leaving.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    states = entering_states(leaving, key, np.linalg.matrix_power(G.sos_step(sos), size), most)
    met = sound.join(states.select(key, F.col("block").alias("__b"), "state").hint("shuffle_hash"), [sound[key] == states[key], F.col("block") == F.col("__b")]).select(sound[key], "block", "samples", "state")
    return met.select(key, "block", _from_state(sos)("samples", "state").alias("samples"))


def bandpassed(blocks: DataFrame, key: str, size: int, sr: int, low_hz: float = 80, high_hz: float = 20000, order: int = 5, limit: float = 0.95) -> DataFrame:
    """Block rows of one rate, band-passed like ``signal.bandpass`` does whole recordings."""
    low, high = min(low_hz / (sr / 2), limit), min(high_hz / (sr / 2), limit)
    return filtered(blocks, key, size, G.butterworth_band(order, low, high)) if low < high else _sound(blocks, key)


# ---------------------------------------------------------- sums over windows


def _window_sums(frame: int, hop: int):
    """(key, frame_no, sq, n) of rows (key, samples, ranges): sums of squares over the part of each window that lies in a range.

    A range is (at, n, place): n samples from ``at`` in the block stand at
    ``place`` of the signal. n counts samples, once for each range.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, nos, sums, counts = [], [], [], []
            for row, (samples, ranges) in enumerate(zip(b.iloc[:, 1], b.iloc[:, 2])):
                x = np.asarray(samples, np.float64)
                for r in ranges:
                    part, place = x[r["at"] : r["at"] + r["n"]], r["place"]
                    sq, n = part * part, len(part)
                    first, last = max(0, (place - frame) // hop + 1), (place + n - 1) // hop
                    no = np.arange(first, last + 1)
                    lo, hi = np.maximum(no * hop - place, 0), np.minimum(no * hop + frame - place, n)
                    keep = hi > lo
                    no, lo, hi = no[keep], lo[keep], hi[keep]
                    whole = hi - lo == frame
                    total = np.zeros(len(no))
                    if whole.any():
                        total[whole] = np.lib.stride_tricks.sliding_window_view(sq, frame)[lo[whole]].sum(axis=1)
                    for i in np.nonzero(~whole)[0]:
                        total[i] = sq[lo[i] : hi[i]].sum()
                    rows += [row] * (len(no) + 1)
                    nos += [*no.tolist(), -1]
                    sums += [*total.tolist(), 0.0]
                    counts += [0] * len(no) + [n]
            yield pd.DataFrame({"k": b.iloc[rows, 0].reset_index(drop=True), "frame_no": np.array(nos, np.int64), "sq": np.array(sums, np.float64), "n": np.array(counts, np.int64)})

    return run


def window_sums(ranged: DataFrame, key: str, frame: int, hop: int) -> DataFrame:
    """key, frame_no, sq, n: sums of squares of windows of ``frame`` every ``hop``; the row with frame_no -1 has the number of samples.

    A window over the edge of two blocks gets its sum from both: numbers meet,
    not samples.
    """
    kind = ranged.schema[key].dataType.simpleString()
    parts = ranged.select(key, "samples", "ranges").mapInPandas(_window_sums(frame, hop), f"k {kind}, frame_no long, sq double, n long")
    return parts.groupBy(F.col("k").alias(key), "frame_no").agg(F.sum("sq").alias("sq"), F.sum("n").alias("n"))


def _whole(blocks: DataFrame, key: str, size: int) -> DataFrame:
    whole = F.array(F.struct(F.lit(0).alias("at"), F.size("samples").alias("n"), (F.col("block").cast("long") * size).alias("place")))
    return _sound(blocks, key).select(key, "samples", whole.alias("ranges"))


def energies(sums: DataFrame, totals: DataFrame, key: str, frame: int, hop: int) -> DataFrame:
    """key, frame_no, energy (RMS), frames: the max(1, (n - frame) // hop) frames of a signal of ``total`` samples."""
    frames = F.greatest(F.lit(1).cast("long"), F.floor((F.col("total") - frame) / hop))
    met = sums.where("frame_no >= 0").join(totals, key).withColumn("frames", frames).where("frame_no < frames")
    return met.select(key, "frame_no", F.sqrt(F.col("sq") / F.least(F.lit(frame), F.col("total"))).alias("energy"), "frames")


def loudness(blocks: DataFrame, key: str, size: int, sr: int) -> DataFrame:
    """key, loudness (LUFS) of block rows of one rate, like ``signal.integrated_loudness`` of the whole; null where nothing is loud enough to measure."""
    frame, hop = int(0.4 * sr), int(0.1 * sr)
    weighted = filtered(blocks, key, size, G.loudness_sections(sr))
    sums = window_sums(_whole(weighted, key, size), key, frame, hop)  # one shuffle for all that follows
    totals = sums.groupBy(key).agg(F.sum("n").alias("total"))
    power = sums.where("frame_no >= 0").join(totals, key).where(F.col("frame_no") * hop + frame <= F.col("total")).select(key, (F.col("sq") / frame).alias("p"))
    level = lambda p: F.log10(p) * 10 - 0.691
    loud = power.where(level(F.col("p")) > -70)
    gates = loud.groupBy(key).agg((level(F.avg("p")) - 10).alias("gate"))
    found = loud.join(gates, key).where(level(F.col("p")) > F.col("gate")).groupBy(key).agg(level(F.avg("p")).alias("loudness"))
    return totals.select(key).join(found, key, "left")


def loudness_normalized(blocks: DataFrame, key: str, size: int, sr: int, target: float = -20.0) -> DataFrame:
    """Block rows at the target loudness, half scale where there is none to measure, clipped to [-1, 1]."""
    sound = _sound(blocks, key)
    peaks = sound.groupBy(key).agg(F.max(F.array_max(F.transform("samples", lambda x: F.abs(x)))).alias("peak"))
    gain = F.when(F.col("loudness").isNotNull(), F.pow(F.lit(10.0), (F.lit(target) - F.col("loudness")) / 20)).when(F.col("peak") > 0, 0.5 / F.col("peak")).otherwise(F.lit(1.0))
    gains = loudness(sound, key, size, sr).join(peaks, key).select(key, gain.alias("__g"))
    return sound.join(gains, key).select(key, "block", F.transform("samples", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.col("__g")))).alias("samples"))


def resampled_blocks(blocks: DataFrame, key: str, sr: int, target: int) -> DataFrame:
    """Block rows at another rate, each block resampled by itself, so with edge effects where blocks meet; nothing is shuffled."""
    sound = _sound(blocks, key)
    return sound if sr == target else sound.select(key, "block", G.resampled(target)("samples", F.lit(sr)).alias("samples"))


# ---------------------------------------------------------- cuts at silences


def quiet_runs(energy: DataFrame, thresholds: DataFrame, key: str) -> DataFrame:
    """key, first, end (exclusive), open of maximal runs of frames strictly under their recording's threshold.

    Consecutive frame numbers have in common what is left when their rank is
    taken off; ranks are counted in spans, so a recording's frames are never
    sorted in one task.
    """
    quiet = energy.join(thresholds, key).where(F.col("energy") < F.col("threshold")).select(key, "frame_no", "frames")
    ranked = running_sum(quiet, key, ["frame_no"], F.lit(1), "rank", [F.expr(f"frame_no div {SPAN}")])
    runs = ranked.groupBy(key, (F.col("frame_no") - F.col("rank")).alias("__i")).agg(F.min("frame_no").alias("first"), (F.max("frame_no") + 1).alias("end"), F.max("frames").alias("frames"))
    return runs.select(key, "first", "end", (F.col("end") == F.col("frames")).alias("open"))


def _latest(queries: DataFrame, candidates: DataFrame, key: str, most: int) -> DataFrame:
    """``queries(key, x)`` with ``found``, the last candidate m in (x - most, x], null if there is none.

    Candidates go to their stretch of ``most`` samples and the next one; a
    query looks in its own stretch alone.
    """
    c = candidates.select(key, F.explode(F.array(F.expr(f"m div {most}"), F.expr(f"m div {most} + 1"))).alias("__s"), F.col("m").alias("x"), F.lit(0).alias("asks"), F.col("m").alias("m"))
    q = queries.withColumns({"__s": F.expr(f"x div {most}"), "asks": F.lit(1), "m": F.lit(None).cast("long")})
    rest = [n for n in queries.columns if n not in (key, "x")]
    both = q.select(key, "__s", "x", "asks", "m", *rest).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(key, "__s").orderBy("x", "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("found", F.last("m", ignorenulls=True).over(w)).where("asks = 1")
    return seen.select(*queries.columns, F.when(F.col("found") > F.col("x") - most, F.col("found")).alias("found"))


def _next(queries: DataFrame, candidates: DataFrame, key: str, most: int) -> DataFrame:
    """``queries(key, x)`` with ``after``, the first candidate beyond x, null if there is none."""
    rest = [n for n in queries.columns if n != key]
    c = candidates.select(F.col(key).alias("__k"), F.col("m"), F.expr(f"m div {most}").alias("__t"))
    q = queries.withColumn("__s", F.expr(f"x div {most}"))
    near = q.join(c, [F.col(key) == F.col("__k"), F.col("__s") == F.col("__t"), F.col("m") > F.col("x")], "left").groupBy(key, *rest, "__s").agg(F.min("m").alias("near"))
    # The first candidate of each later stretch: one row for each stretch that has any.
    lows = c.groupBy(F.col("__k").alias(key), F.col("__t").alias("__s")).agg(F.min("m").alias("low")).withColumn("asks", F.lit(0))
    both = near.withColumn("asks", F.lit(1)).unionByName(lows, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("__s"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("far", F.last("low", ignorenulls=True).over(w)).where("asks = 1").select(*queries.columns, F.coalesce("near", "far").alias("after"))


def cut_positions(totals: DataFrame, candidates: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """key, at: where chunks of signals of ``totals(key, total)`` start: at 0, then each at the latest of ``candidates(key, m)`` within [least, most] of the last, else at most.

    Every possible start, 0 and the candidates, points to the next candidate
    that a cut falls on, with so many cuts at ``most`` before it. Which of them
    are reached from 0 is found by pointer doubling: a set of starts grows by
    the starts 1, 2, 4, ... steps further on, in as many joins as the number of
    cuts has binary digits. A stretch without candidates, however long, is one
    pointer.
    """
    cands = candidates.select(key, "m").distinct()
    nodes = totals.select(key, F.lit(0).cast("long").alias("node"), "total").unionByName(cands.join(totals, key).where("m > 0 and m < total").select(key, F.col("m").alias("node"), "total"))
    cands = staged(cands.where("m > 0"))
    # ``times``: cuts at ``most`` that come before the place looked at.
    open_, done = staged(nodes.withColumn("times", F.lit(0).cast("long"))), []
    while True:
        place = F.col("node") + F.col("times") * most
        ended = F.col("total") - place <= most
        asked = _latest(open_.where(~ended).withColumn("x", place + most), cands, key, most).withColumn("hit", (F.col("found") >= F.col("x") - most + least) & (F.col("found") < F.col("total")))
        asked = staged(asked.withColumn("hit", F.coalesce("hit", F.lit(False))))
        done += [open_.where(ended).select(key, "node", "times", F.lit(None).cast("long").alias("next")), asked.where("hit").select(key, "node", "times", F.col("found").alias("next"))]
        missed = asked.where("not hit")
        if missed.isEmpty():
            break
        onward = _next(missed.select(key, "node", "total", "times", "x"), cands, key, most)
        # The cut at x is made; further ones while the next candidate lies beyond ``most`` of the last.
        to = F.when(F.col("after").isNull() | (F.col("after") >= F.col("total")), F.col("total")).otherwise(F.col("after"))
        open_ = staged(onward.select(key, "node", "total", (F.ceil((to - F.col("node")) / most) - 1).alias("times")))
    edges = done[0]
    for d in done[1:]:
        edges = edges.unionByName(d)
    edges = staged(edges)
    jump = edges.where("next is not null").select(key, "node", "next")
    reached = totals.select(key, F.lit(0).cast("long").alias("node"))
    while True:
        further = reached.join(jump, [key, "node"]).select(key, F.col("next").alias("node"))
        grown = staged(reached.unionByName(further).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        two = jump.select(key, F.col("node").alias("next"), F.col("next").alias("onward"))
        jump = staged(jump.join(two, [key, "next"]).select(key, "node", F.col("onward").alias("next")))
    return reached.join(edges, [key, "node"]).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times"))).alias("i"), "node").select(key, (F.col("node") + F.col("i") * most).alias("at"))


def segment_blocks(
    blocks: DataFrame, key: str, size: int, sr: int, longest: float = 30.0, shortest: float = 2.0, max_silence: float = 4.0, fill: float = 0.5,
    threshold: float | None = None, shorten_short: bool = False, close_trailing: bool = False,
) -> DataFrame:
    """key, chunk, start, stop, samples: the chunks that ``segments.segment_long`` cuts, from block rows.

    Energies of frames are summed from the blocks that they lie in; thresholds
    are exact quartiles by radix selection; silences are runs of ranked frames;
    a shortened signal is a list of kept pieces with their new places, and its
    frames are measured again only where something was taken out; the cuts come
    from ``cut_positions``. Only chunks, of ``longest`` at most, are rows with
    samples that meet. Long silences of a recording, one for each
    ``max_silence`` seconds at most, are sorted in one task, as numbers.
    """
    frame, hop = int(0.025 * sr), int(0.010 * sr)
    most, least, zeros = int(longest * sr), int(shortest * sr), int(fill * sr)
    if frame < 1 or hop < 1:
        raise ValueError("the rate is too low for frames of 25 ms every 10 ms")
    sums = staged(window_sums(_whole(blocks, key, size), key, frame, hop))
    totals = staged(sums.groupBy(key).agg(F.sum("n").alias("total")).where(F.col("total") >= max(least, 1)))
    energy = energies(sums, totals, key, frame, hop)
    if threshold is not None:
        levels = totals.select(key, F.lit(float(threshold)).alias("threshold"))
    else:
        levels = staged(quantiles(energy, [key], "energy", [0.25]).select(key, F.greatest("quantile", F.lit(1e-6)).alias("threshold")))
    # What is left of each recording: kept pieces (old place, n, new place) and zeros.
    far = quiet_runs(energy, levels, key).select(key, (F.col("first") * hop).alias("a"), (F.col("end") * hop).alias("b")).where((F.col("b") - F.col("a")) / sr > max_silence)
    if not shorten_short:
        far = far.join(totals.where(F.col("total") > most).select(key), key, "left_semi")
    order = Window.partitionBy(key).orderBy("a")
    gone = F.coalesce(F.sum(F.col("b") - F.col("a") - zeros).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    far = staged(far.select(key, "a", "b", gone.alias("gone"), F.coalesce(F.lag("b").over(order), F.lit(0).cast("long")).alias("since")))
    ends = far.groupBy(key).agg(F.max("b").alias("since"), F.sum(F.col("b") - F.col("a") - zeros).alias("gone"))
    tail = totals.join(ends, key, "left").select(key, F.coalesce("since", F.lit(0).cast("long")).alias("old"), F.col("total").alias("until"), F.coalesce("gone", F.lit(0).cast("long")).alias("gone"))
    pieces = far.select(key, F.col("since").alias("old"), F.col("a").alias("until"), "gone").unionByName(tail).where("until > old")
    pieces = staged(pieces.select(key, "old", (F.col("until") - F.col("old")).alias("n"), (F.col("old") - F.col("gone")).alias("place"), F.lit(False).alias("zeros")))
    filled = far.select(key, F.lit(0).cast("long").alias("old"), F.lit(zeros).cast("long").alias("n"), (F.col("a") - F.col("gone")).alias("place"), F.lit(True).alias("zeros")).where("n > 0")
    left = staged(totals.join(ends, key, "left").select(key, (F.col("total") - F.coalesce("gone", F.lit(0))).alias("total"), F.col("gone").isNotNull().alias("shortened")).where(F.col("total") >= max(least, 1)))
    # Frames of the shortened signals.
    changed = left.where("shortened").select(key)
    again = window_sums(_sound(blocks, key).join(_in_blocks(pieces.join(changed, key, "left_semi"), key, size), [key, "block"]).select(key, "samples", "ranges"), key, frame, hop)
    empty = filled.select(key, F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("place") - frame) / hop) + 1), F.expr(f"(place + n - 1) div {hop}"))).alias("frame_no"), F.lit(0.0).alias("sq"), F.lit(0).cast("long").alias("n"))
    again = again.unionByName(empty).groupBy(key, "frame_no").agg(F.sum("sq").alias("sq"), F.sum("n").alias("n"))
    now = energies(sums.join(changed, key, "left_anti").unionByName(again), left.where(F.col("total") > most).select(key, "total"), key, frame, hop)
    silent = quiet_runs(now, levels, key)
    silent = silent if close_trailing else silent.where("not open")
    silent = silent.select(key, (F.col("first") * hop).alias("a"), (F.col("end") * hop).alias("b")).where((F.col("b") - F.col("a")) / sr >= 0.1)
    long = left.where(F.col("total") > most).select(key, "total")
    starts = cut_positions(long, silent.select(key, F.expr("(a + b) div 2").alias("m")), key, max(least, 1), most)
    along = Window.partitionBy(key).orderBy("start")
    cuts = starts.join(long, key).select(key, F.col("at").alias("start"), "total").withColumn("stop", F.coalesce(F.lead("start").over(along), F.col("total"))).where(F.col("stop") - F.col("start") >= least)
    short = left.where(F.col("total") <= most).select(key, F.lit(0).cast("long").alias("start"), F.col("total").alias("stop"))
    chunks = cuts.select(key, "start", "stop").unionByName(short).withColumn("chunk", F.row_number().over(along) - 1)
    # Chunks meet the pieces that they are made of in stretches of ``most`` samples; the stretch of their common start counts.
    stretch = lambda place, n: F.explode(F.sequence(F.expr(f"{place} div {most}"), F.expr(f"({place} + {n} - 1) div {most}"))).alias("__s")
    made = pieces.unionByName(filled).select("*", stretch("place", "n"))
    wanted = chunks.select(key, "chunk", "start", "stop", stretch("start", "(stop - start)"))
    met = wanted.join(made, [key, "__s"]).withColumn("from", F.greatest("start", "place")).withColumn("to", F.least("stop", F.col("place") + F.col("n"))).where((F.col("to") > F.col("from")) & (F.expr(f"from div {most}") == F.col("__s")))
    parts = met.select(key, "chunk", "start", "stop", "zeros", (F.col("old") + F.col("from") - F.col("place")).alias("old"), (F.col("to") - F.col("from")).alias("n"), F.col("from").alias("place"))
    kept = _in_blocks(parts.where("not zeros"), key, size, ["chunk", "start", "stop"])
    slices = _sound(blocks, key).join(kept, [key, "block"]).select(key, F.inline(F.transform("ranges", lambda r: F.struct(r["chunk"].alias("chunk"), r["start"].alias("start"), r["stop"].alias("stop"), r["place"].alias("place"), F.slice("samples", r["at"] + 1, r["n"]).alias("x")))))
    silence = parts.where("zeros").select(key, "chunk", "start", "stop", "place", F.array_repeat(F.lit(0.0), F.col("n").cast("int")).alias("x"))
    whole = slices.unionByName(silence).groupBy(key, "chunk", "start", "stop").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("parts"))
    return whole.select(key, "chunk", "start", "stop", F.flatten(F.transform("parts", lambda p: p["x"])).alias("samples"))


def _in_blocks(pieces: DataFrame, key: str, size: int, more: list[str] | None = None) -> DataFrame:
    """key, block, ranges (at, n, place and ``more``) of pieces (old, n, place): the small side of a join with the samples."""
    more = more or []
    spread = pieces.select("*", F.explode(F.sequence(F.expr(f"old div {size}"), F.expr(f"(old + n - 1) div {size}"))).alias("block"))
    begin = F.greatest(F.col("old"), F.col("block") * size)
    stop = F.least(F.col("old") + F.col("n"), (F.col("block") + 1) * size)
    ranges = F.struct((begin - F.col("block") * size).cast("int").alias("at"), (stop - begin).cast("int").alias("n"), (F.col("place") + begin - F.col("old")).alias("place"), *more)
    return spread.groupBy(key, "block").agg(F.collect_list(ranges).alias("ranges")).hint("shuffle_hash")
