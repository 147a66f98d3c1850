"""Recordings as block rows against the same recordings as single rows; quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import blocks as B
from seqlake.operators import segments as S
from seqlake.operators import selection
from seqlake.operators import signal as P


def recordings(spark, seed, sizes, quiet):
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(sizes):
        x = rng.normal(0, 0.3, n)
        at = 0
        while at < n:  # stretches of noise and of near silence, short and long
            at += int(rng.integers(50, 900))
            k = int(rng.choice(quiet))
            x[at : at + k] *= 0.01
            at += k
        rows.append((f"r{i}", [float(v) for v in x]))
    return rows, spark.createDataFrame(rows, "id string, samples array<double>")


@pytest.mark.parametrize("size", [64, 1000, 5000])
def test_filter_states_join_blocks(spark, size):
    rows, df = recordings(spark, 1, [1, 63, 64, 65, 3000, 4999, 12000], [10])
    sos = P.butterworth_band(5, 0.02, 0.8)
    got = {}
    for r in B.filtered(B.blocked(df, "id", size), "id", size, sos).orderBy("id", "block").collect():
        got.setdefault(r["id"], []).extend(r["samples"])
    for k, x in rows:
        assert np.abs(np.array(got[k]) - P.sos_filter(sos, x)).max() < 1e-9


def test_state_of_a_cascade_is_linear():
    rng = np.random.default_rng(4)
    sos, x = P.butterworth_band(4, 0.05, 0.5), rng.normal(0, 1, 777)
    y, end = P.sos_states(sos, x)
    for cut in (1, 255, 256, 257, 512, 776):
        a, s = P.sos_states(sos, x[:cut])
        b, t = P.sos_states(sos, x[cut:], s)
        assert np.abs(np.concatenate([a, b]) - y).max() < 1e-12 and np.abs(t - end).max() < 1e-12
    s = rng.normal(0, 1, (4, 2))
    assert np.abs(np.linalg.matrix_power(P.sos_step(sos), 300) @ s.ravel() - P.sos_states(sos, np.zeros(300), s)[1].ravel()).max() < 1e-10


def test_loudness_of_blocks(spark):
    rows, df = recordings(spark, 2, [5000, 9000, 40001, 300], [10, 4000])
    rows.append(("still", [0.0] * 2000))
    df = df.unionByName(spark.createDataFrame(rows[-1:], df.schema))
    sr = 8005  # four tenths aren't four times a tenth
    got = {r["id"]: r["loudness"] for r in B.loudness(B.blocked(df, "id", 700), "id", 700, sr).collect()}
    for k, x in rows:
        want = P.integrated_loudness(np.array(x), sr)
        assert got[k] is None if not np.isfinite(want) else abs(got[k] - want) < 1e-9
    y = {r["id"]: r["m"] for r in B.loudness_normalized(B.blocked(df, "id", 700), "id", 700, sr).groupBy("id").agg(F.max(F.array_max(F.transform("samples", lambda v: F.abs(v)))).alias("m")).collect()}
    whole = {r["id"]: max(map(abs, r["y"])) for r in df.select("id", P.loudness_normalized()("samples", F.lit(sr)).alias("y")).collect()}
    assert all(abs(y[k] - whole[k]) < 1e-9 for k in whole) and abs(y["r3"] - 0.5) < 1e-9 and y["still"] == 0


LIMITS = dict(longest=0.5, shortest=0.05, max_silence=0.2, fill=0.05)


@pytest.mark.parametrize("seed,size,more", [(3, 700, {}), (4, 128, dict(threshold=0.05, shorten_short=True, close_trailing=True)), (5, 4000, dict(longest=0.3, shortest=0.12))])
def test_chunks_of_blocks_are_those_of_rows(spark, seed, size, more):
    limits = {**LIMITS, **more}
    rows, df = recordings(spark, seed, [40, 120, 500, 501, 6000, 9000, 14000], [20, 110, 150, 260, 700])
    loud = [float(v) for v in np.random.default_rng(9).normal(0, 0.3, 7000)]  # long without any silence, then some in the holes between possible cuts
    loud[3020:3140] = [0.0] * 120
    df = df.unionByName(spark.createDataFrame([("loud", loud), (None, loud), ("none", None), ("empty", [])], df.schema))
    want = sorted((r["id"], r["chunk"], r["start"], r["stop"], r["samples"]) for r in S.segment_long(df.where("id is not null"), 1000, **limits).collect())
    got = sorted((r["id"], r["chunk"], r["start"], r["stop"], r["samples"]) for r in B.segment_blocks(B.blocked(df, "id", size), "id", size, 1000, **limits).collect())
    assert len(want) > 40 and [x[:4] for x in got] == [x[:4] for x in want]
    assert got == want


def brute_cuts(total, candidates, least, most):
    at = [0]
    while total - at[-1] > most:
        fine = [m for m in candidates if at[-1] + least <= m <= at[-1] + most]
        at.append(max(fine) if fine else at[-1] + most)
    return at


def test_cut_positions(spark):
    rng = np.random.default_rng(6)
    cases = [(1000, []), (50, [20]), (10_000, [5005, 5006, 9000])]
    cases += [(int(rng.integers(100, 3000)), sorted({int(m) for m in rng.integers(0, 3000, int(rng.integers(0, 40)))})) for _ in range(40)]
    totals = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "k int, total long")
    cands = spark.createDataFrame([(i, m) for i, (_, c) in enumerate(cases) for m in c], "k int, m long")
    for least, most in ((20, 100), (90, 100), (1, 333)):
        got = {}
        for r in B.cut_positions(totals, cands, "k", least, most).collect():
            got.setdefault(r["k"], []).append(r["at"])
        assert {k: sorted(v) for k, v in got.items()} == {i: brute_cuts(n, [m for m in c if m < n], least, most) for i, (n, c) in enumerate(cases)}


def test_quantiles(spark):
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(0, 1, 3000), "equal": np.full(2000, 0.1), "two": np.array([1.0, 2.0] * 500), "one": np.array([-3.5]), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500)), np.zeros(9)]),
        "near": 1 + rng.integers(0, 5, 4000) * 2.0**-52, None: rng.uniform(5, 6, 777),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None), ("normal", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): r["quantile"] for r in selection.quantiles(df, ["g"], "v", shares, width=16).collect()}
    assert len(got) == len(groups) * len(shares)
    for k, x in groups.items():
        for s in shares:
            want = np.quantile(x, s)
            assert got[k, s] == pytest.approx(want, rel=1e-12)
    assert selection.quantiles(df.limit(0), ["g"], "v", shares).count() == 0
    assert selection.quantiles(df, [], "v", [0.5]).first()["quantile"] == pytest.approx(np.median(np.concatenate(list(groups.values()))), rel=1e-12)
