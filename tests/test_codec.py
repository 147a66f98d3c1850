"""The residual quantiser: fitting, round trips with each number of codebooks, measures against numpy."""

import numpy as np
from pyspark.sql import functions as F

from seqlake.functions import scores as Q
from seqlake.operators import codec as C
from seqlake.operators import signal as P


def clips_of(spark, n=24):
    rng = np.random.default_rng(12)
    rows = [(i, [float(v) for v in np.sin(np.arange(1500 + 13 * i) * rng.uniform(0.02, 0.5)) * rng.uniform(0.2, 0.9) + rng.normal(0, 0.02, 1500 + 13 * i)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, samples array<double>")


def test_each_codebook_lessens_the_error(spark):
    rows, df = clips_of(spark)
    odd = spark.createDataFrame([(100, None), (101, []), (102, [0.5])], df.schema)
    c = C.fit(df.unionByName(odd), 8, books=3, levels=16, rounds=4)
    again = C.fit(df.unionByName(odd).repartition(5), 8, books=3, levels=16, rounds=4)
    assert c.books.shape == (3, 16, 8) and np.abs(c.books - again.books).max() < 1e-9
    got = C.round_trips(df.unionByName(odd), c, [1, 2, 3, 7]).collect()
    assert {r["id"] for r in got} == {i for i, _ in rows} | {102} and {r["books"] for r in got} == {1, 2, 3}
    error = {n: sum(float(((np.array(r["samples"]) - np.array(r["copy"])) ** 2).sum()) for r in got if r["books"] == n) for n in (1, 2, 3)}
    assert error[1] > 1.5 * error[2] > 1.5 * 1.2 * error[3]
    for r in got:
        x = np.array(r["samples"])
        codes = c.encode(x)
        assert codes.min() >= 1 and codes.max() <= 16
        assert np.allclose(r["copy"], c.decode(codes[: r["books"]], len(x))) and len(r["copy"]) == len(x)
        # Zeroed codebooks decode like missing ones.
        zeroed = codes.copy()
        zeroed[r["books"] :] = 0
        assert np.allclose(c.decode(zeroed, len(x)), r["copy"])


def test_k_means_is_lloyds(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (4, 2))
    x = np.concatenate([centres[rng.integers(0, 4, 200)] + rng.normal(0, 0.01, (200, 2))]).reshape(-1)
    df = spark.createDataFrame([([float(v) for v in x[i : i + 40]],) for i in range(0, len(x), 40)], "samples array<double>")
    book = C.fit(df, 2, books=1, levels=4, rounds=8).books[0]
    frames = x.reshape(-1, 2)
    code = C.nearest(frames, book)
    for k in range(4):
        if (code == k).any():
            assert np.allclose(book[k], frames[code == k].mean(axis=0), atol=1e-6)
    assert C.fit(df.limit(0), 2, 1, 4, 1).books.tolist() == np.zeros((1, 4, 2)).tolist()


def test_trimmed_codes_and_measures_of_the_grid(spark):
    _, df = clips_of(spark, 6)
    c = C.fit(df, 8, books=2, levels=16, rounds=2)
    short = spark.createDataFrame([(50, [0.1] * 23), (51, [0.1] * 24), (52, None)], df.schema)
    steps = {r["id"]: None if r["codes"] is None else len(r["codes"][0]) for r in C.batched_codes(df.unionByName(short), c).collect()}
    assert steps[50] is None and steps[51] == 3 and steps[52] is None and steps[5] == (1500 + 65) // 8
    g = C.round_trips(df, c, [1, 2]).select(
        "id", "books", "samples", "copy", Q.snr_db(F.col("samples"), F.col("copy")).alias("snr"), P.spectral_convergence("samples", "copy").alias("sc"), P.log_spectral_distance("samples", "copy").alias("lsd"),
        P.mel_cepstral_distortion(8000)("samples", "copy").alias("mcd"), P.mel_cepstral_distortion(8000, False)("samples", "copy").alias("mcd2"),
    ).collect()
    for r in g:
        a, b = np.array(r["samples"]), np.array(r["copy"])
        assert np.isclose(r["snr"], 10 * np.log10((a**2).mean() / ((a - b) ** 2).mean()))
        s, t = P.stft_magnitude(a), P.stft_magnitude(b)
        assert np.isclose(r["sc"], np.linalg.norm(s - t) / np.linalg.norm(s))
        d = P.mfcc(a, 8000) - P.mfcc(b, 8000)
        assert np.isclose(r["mcd"], np.sqrt((d**2).sum(axis=0)).mean()) and np.isclose(r["mcd2"], np.sqrt(2 * (d**2).mean()))
    by = {(r["id"], r["books"]): r["snr"] for r in g}
    assert np.mean([by[i, 2] for i in range(6)]) > np.mean([by[i, 1] for i in range(6)])
