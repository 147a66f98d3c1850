"""Whole recordings: segmentation, blocks, detector and the per-file jobs against direct versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import segments as S
from seqlake.operators import signal as P
from seqlake.plans import pipelines
from seqlake.sources import readers, sinks

SR = 1000


def recording(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.3 if rng.random() < 0.75 else 0.001, rng.integers(60, 400)) for _ in range(rng.integers(3, 12))]
    return np.concatenate(parts)


def stretches(x, level, close):
    e = [np.sqrt(np.mean(x[i * 10 : i * 10 + 25] ** 2)) for i in range(max(1, (len(x) - 25) // 10))]
    t = max(np.percentile(e, 25), 1e-6) if level is None else level
    marks = "".join("q" if v < t else "l" for v in e)
    out, at = [], 0
    for run in marks.replace("lq", "l|q").replace("ql", "q|l").split("|"):
        if run[0] == "q" and (close or at + len(run) < len(marks)):
            out.append((at * 10, (at + len(run)) * 10))
        at += len(run)
    return out, t


def direct(x, level, short, close, longest=500, shortest=50, far=0.2, fill=50):
    if len(x) < shortest:
        return []
    t = level
    if len(x) > longest or short:
        found, t = stretches(x, level, True)
        gone = np.zeros(len(x), bool)
        put = []
        for a, b in found:
            if (b - a) / SR > far:
                gone[a:b] = True
                put += [a] * fill
        x = np.insert(x, put, 0.0)[~np.insert(gone, put, False)]
    if len(x) <= longest:
        return [(0, len(x))] if len(x) >= shortest else []
    middles = [(a + b) // 2 for a, b in stretches(x, t, close)[0] if (b - a) / SR >= 0.1]
    out, at = [], 0
    while len(x) - at > longest:
        to = max([m for m in middles if shortest <= m - at <= longest], default=at + longest)
        out.append((at, to))
        at = to
    return [p for p in [*out, (at, len(x))] if p[1] - p[0] >= shortest]


@pytest.mark.parametrize("level,short,close", [(None, False, False), (None, False, True), (0.02, True, True), (0.02, False, False)])
def test_long_segmentation(spark, level, short, close):
    signals = {i: recording(i) for i in range(30)} | {90: np.zeros(0), 91: np.ones(40), 92: np.zeros(1200), 93: np.ones(500)}
    df = spark.createDataFrame([(i, x.tolist(), "kept") for i, x in signals.items()] + [(99, None, "kept")], "id int, samples array<double>, start_note string")
    got = {}
    rows = S.segment_long(df, SR, 0.5, 0.05, 0.2, 0.05, level, short, close).collect()
    for r in sorted(rows, key=lambda r: (r["id"], r["chunk"])):
        assert len(r["samples"]) == r["stop"] - r["start"] and r["start_note"] == "kept"
        got.setdefault(r["id"], []).append((r["start"], r["stop"]))
    assert got == {i: w for i, x in signals.items() if (w := direct(x, level, short, close))}


def test_rate_too_low(spark):
    with pytest.raises(ValueError, match="too low"):
        S.segment_long(spark.createDataFrame([(1, [0.0])], "id int, samples array<double>"), 64)


def test_blocks_are_resampled_one_by_one(spark):
    x = np.sin(np.arange(1000) / 5)
    rows = [(1, x.tolist(), 800), (2, x[:30].tolist(), 500), (3, [], 800), (4, x[:161].tolist(), 800)]
    got = {r["id"]: r for r in S.resampled_in_blocks(spark.createDataFrame(rows, "id int, samples array<double>, sr int"), "id", 500, 0.2).collect()}
    want = np.concatenate([P.resample(x[a : a + 160], 800, 500) for a in range(0, 1000, 160)])
    assert np.allclose(got[1]["samples"], want) and got[2]["samples"] == x[:30].tolist() and got[3]["samples"] == []
    assert np.allclose(got[4]["samples"], [*P.resample(x[:160], 800, 500), *P.resample(x[160:161], 800, 500)]) and all(r["sr"] == 500 for r in got.values())


def test_detector_windows_and_failures(spark):
    df = spark.createDataFrame([(1, [0.5] * 25), (2, [0.5] * 9), (3, [9.0] * 20), (4, None)], "id int, samples array<double>")

    def score(windows):
        if windows.max() > 1:
            raise RuntimeError("out of range")
        return windows.sum(axis=1)

    got = {r["id"]: r["s"] for r in df.select("id", S.detector(score, 100, 10)("samples", F.lit(100)).alias("s")).collect()}
    assert got == {1: 5.0, 2: None, 3: None, 4: None}


def test_filter_blocks_equal_the_plain_recurrence():
    sos, x = P.butterworth_band(5, 0.01, 0.6), np.random.default_rng(1).normal(size=700)
    want = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        y = np.zeros(len(x) + 2)
        v = np.concatenate([[0, 0], want])
        for i in range(2, len(y)):
            y[i] = b0 * v[i] + b1 * v[i - 1] + b2 * v[i - 2] - a1 * y[i - 1] - a2 * y[i - 2]
        want = y[2:]
    assert np.allclose(P.sos_filter(sos, x), want) and np.allclose(P.sos_filter(sos, x, 64), want) and len(P.sos_filter(sos, x[:0])) == 0


def test_chain_of_a_recording(spark):
    rate, rng = 8000, np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.2, 3000), np.zeros(2500), rng.normal(0, 0.05, 2000), rng.normal(0, 0.3, 1500)])
    df = spark.createDataFrame([("r", x.tolist(), rate)], "id string, samples array<double>, sr int")
    got = pipelines.heard(df, "id", rate, 0.05, (80, 3800), longest=0.5, shortest=0.05, max_silence=0.2, fill=0.02)
    rows = sorted(pipelines.hydrophone_chunks(got, "id", (200, 3500), 256, 64, 0.0, frame_seconds=0.05).collect(), key=lambda r: r["chunk"])
    assert rows
    kept = {r["chunk"]: np.array(r["samples"]) for r in got.collect()}
    for r in rows:
        c = kept[r["chunk"]]
        assert abs(np.abs(c).max() - 0.9) < 1e-9
        band = P.sos_filter(P.butterworth_band(5, 200 / 4000, 3500 / 4000), c)
        n = len(band) // 400
        levels = np.sqrt((band[: n * 400].reshape(n, 400) ** 2).mean(axis=1)) if n else np.zeros(0)
        assert np.isclose(r["whale_cv"], levels.std() / levels.mean() if n >= 3 else 0.0) and np.isclose(r["whale_rms"], np.sqrt((band**2).mean()))
        spectrum = P.stft_magnitude(c, 256, 64) ** 2
        f = np.fft.rfftfreq(256, 1 / rate)
        assert np.isclose(r["energy_ratio"], spectrum[(f >= 200) & (f <= 3500)].sum() / spectrum.sum())
    most = max(r["whale_cv"] for r in rows)
    left = pipelines.hydrophone_chunks(got, "id", (200, 3500), 256, 64, most, frame_seconds=0.05).collect()
    assert [r["whale_cv"] for r in left] == [most]


def test_tokens_gates_and_denoised_files(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("/in/a/x.wav", rng.normal(0, 0.2, 4000).tolist(), 8000), ("/in/y.wav", rng.normal(0, 0.2, 4000).tolist(), 4000)], "path string, samples array<double>, sr int")
    chunks = pipelines.heard(df.withColumnRenamed("path", "id"), "id", 8000, 0.0, (80, 3800), longest=0.2, shortest=0.02)
    t = pipelines.chunk_tokens(chunks, P.residual_quantiser(2), 2).collect()
    size = {(r["id"], r["chunk"]): len(r["samples"]) for r in chunks.collect()}
    assert {(r["id"], r["chunk"]): len(r["tokens"]) // 2 for r in t} == size
    g = pipelines.gated_chunks(chunks, 0.0).collect()
    raw = {(r["id"], r["chunk"]): np.array(r["samples"]) for r in chunks.collect()}
    for r in g:
        x = raw[(r["id"], r["chunk"])]
        y = P.spectral_gate(P.spectral_gate(x, 0.90, True), 0.75, False)
        assert np.isclose(r["retention"], np.sqrt((y**2).mean() / (x**2).mean()))
    top = sorted(r["retention"] for r in g)[-1]
    assert len(pipelines.gated_chunks(chunks, top).collect()) < len(g) or len(set(r["retention"] for r in g)) == 1
    d = {r["path"]: r for r in pipelines.denoised_tree(df, "/in", "/out", 8000, 4000).collect()}
    assert set(d) == {"/out/a/x.wav", "/out/y.wav"} and len(d["/out/y.wav"]["samples"]) == 8000
    assert [r["path"] for r in pipelines.denoised_tree(df, "/in", "/out", 8000, 5000).collect()] == ["/out/a/x.wav"]


def test_graded_source(spark):
    x = np.concatenate([np.zeros(700), np.random.default_rng(2).normal(0, 0.3, 600), np.zeros(700)])
    df = spark.createDataFrame([("s", "f", x.tolist())], "source string, name string, samples array<double>")
    g = pipelines.source_grades(df, "name", SR, longest=1.0, shortest=0.1).collect()
    found = P.active_segments(df, SR, 1.0, 0.1, key="name").collect()
    assert len(g) == len(found) == 1 and g[0]["file"] == "f" and g[0]["segment_idx"] == 0
    part = x[found[0]["start"] : found[0]["stop"]]
    assert np.isclose(g[0]["rms_energy"], np.sqrt((part**2).mean())) and np.isclose(g[0]["spectral_flatness"], P.spectral_measures(part, SR)[0])


def test_lengths_without_content(spark, tmp_path):
    np.save(tmp_path / "a_1.npy", np.arange(5, dtype=np.int32))
    np.save(tmp_path / "a_2.npy", np.zeros((4, 9), np.int32))
    np.save(tmp_path / "a_3.npy", np.arange(2, dtype=np.int32))
    got = {r["stem"]: r["steps"] for r in readers.token_lengths(spark, str(tmp_path)).collect()}
    assert got == {"a_1": 5, "a_2": 36}
    assert {r["stem"]: r["steps"] for r in readers.token_lengths(spark, str(tmp_path), codebooks=4).collect()} == {"a_2": 9}


def test_newest_checkpoint_is_never_unlinked(spark):
    losses = np.random.default_rng(4).integers(0, 12, 60).tolist()
    saved, disk = [], set()
    for step, loss in enumerate(losses):
        disk.add(step)
        saved = sorted([*saved, (loss, step)])
        if len(saved) > 3:
            worst = saved.pop()[1]
            disk -= {worst} - {step}
    out = sinks.retained(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(losses)] + [("b", 0, 50.0)], "run string, step long, val_loss double"), 3, ("run",)).collect()
    assert {r["step"] for r in out if r["on_disk"] and r["run"] == "a"} == disk
    assert {r["step"] for r in out if r["keep"] and r["run"] == "a"} == {s for _, s in saved} and [r["keep"] for r in out if r["run"] == "b"] == [True]


def test_resampling_keeps_rows_of_any_rate_and_key(spark):
    x = [float(v) for v in np.sin(np.arange(200) / 7)]
    df = spark.createDataFrame([("a", x, 1000), ("a", x[:64], 1000), ("b", x, None), ("c", None, 1000), ("d", x, 500), (None, x, 1000)], "k string, samples array<double>, sr int")
    got = sorted(((r["k"] or "", r["sr"] or 0, -1 if r["samples"] is None else len(r["samples"])) for r in S.resampled_in_blocks(df, "k", 500, 0.05).collect()))
    assert got == [("", 500, 100), ("a", 500, 32), ("a", 500, 100), ("b", 0, -1), ("c", 500, 0), ("d", 500, 200)]


def test_detector_counts_failures(spark):
    def score(w):
        if w.mean() > 0.5:
            raise ValueError("no model")
        return w.mean(axis=1)

    n = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, [0.1] * 20), (2, [0.9] * 20), (3, [0.1] * 3)], "id int, samples array<double>")
    got = {r["id"]: r["s"] for r in df.select("id", S.detector(score, 10, 10, n)("samples", F.lit(10)).alias("s")).collect()}
    assert got[1] is not None and got[2] is None and got[3] is None and n.value == 1
