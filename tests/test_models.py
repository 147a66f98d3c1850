"""Blocked attention, mel tables and back-off generation against direct versions."""

import hashlib

import numpy as np

from seqlake.operators import attention as T
from seqlake.operators import generation as N
from seqlake.operators import signal as P
from seqlake.operators import spectra as Y


def test_blocked_attention(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(p), *[[float(v) for v in rng.normal(0, 3 if p % 7 else 40, 6)] for _ in range(3)]) for s, n in (("a", 57), ("b", 5), ("c", 1)) for p in range(n) if (s, p) not in {("a", 20), ("a", 21)}]
    more = [("d", 0, None, [1.0] * 6, [1.0] * 6), (None, 0, [1.0] * 6, [1.0] * 6, [1.0] * 6)]
    df = spark.createDataFrame(rows + more, "seq string, pos int, q array<double>, k array<double>, v array<double>")
    for window, block in ((9, 4), (9, 16), (1, 3), (200, 10)):
        got = {(r["seq"], r["pos"], r["head"]): r["output"] for r in T.banded_attention(df, window, heads=2, block=block).collect()}
        assert len(got) == 2 * len(rows)
        for s, p, q, _, _ in rows:
            band = [r for r in rows if r[0] == s and p - window < r[1] <= p]
            for h in range(2):
                cut = slice(3 * h, 3 * h + 3)
                z = np.array([np.dot(q[cut], r[3][cut]) / np.sqrt(3) for r in band])
                w = np.exp(z - z.max())
                assert np.allclose(got[s, p, h], (w[:, None] * np.array([r[4][cut] for r in band])).sum(axis=0) / w.sum(), atol=1e-9)


def test_mel_rows_are_the_dense_product(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, n)]) for i, n in enumerate((3000, 4096, 700))] + [(7, [0.0] * 900), (8, None), (9, [])]
    got = {}
    for r in Y.mel_rows(spark.createDataFrame(rows, "id int, x array<double>").withColumnRenamed("x", "samples"), "id", 16000, 128, 1024, 256).collect():
        got.setdefault(r["id"], {})[r["frame"], r["mel"]] = r["db"]
    assert set(got) == {0, 1, 2, 7}
    for i, x in rows[:4]:
        m = P.mel_filters(16000, 1024, 128) @ P.stft_magnitude(np.array(x), 1024, 256) ** 2
        db = 10 * np.log10(np.maximum(m, 1e-10)) - 10 * np.log10(max(m.max(), 1e-10))
        db = np.maximum(db, -80)
        assert len(got[i]) == m.size and all(abs(got[i][t, k] - db[k, t]) < 1e-8 for t in range(m.shape[1]) for k in range(128))


def test_comparison_and_bars(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.5]), (2, None, [4.0]), (3, None, None)], "id int, original array<double>, copy array<double>")
    assert sorted(tuple(r) for r in Y.comparison_rows(df, "id", 2.0).where("id = 1").collect()) == [(1, 0, 0.0, 1.0, 1.5), (1, 1, 0.5, 2.0, None), (1, 2, 1.0, 3.0, None)]
    real = spark.createDataFrame([("b", 3), ("a", 1)], "coda string, n long")
    made = spark.createDataFrame([("b", 1), ("z", 1)], "coda string, n long")
    assert [tuple(r) for r in Y.distribution_bars(real, made).orderBy("place").collect()] == [(1, "a", 0.25, 0.0), (2, "b", 0.75, 0.5)]
    assert [r["made"] for r in Y.distribution_bars(real).collect()] == [None, None]


def test_generation_backs_off_and_stops(spark):
    seqs = [[1, 5, 6, 7, 2], [1, 5, 6, 8, 2], [1, 5, 9, 2], [3, 6, 7, 2], None, []]
    df = spark.createDataFrame([(s,) for s in seqs], "tokens array<int>")
    model = {r["context"]: [(x["token"], x["n"]) for x in r["next"]] for r in N.backoff_table(df, top_k=2).collect()}
    assert model["1 5 6"] == [(7, 1), (8, 1)] and model["6"] == [(7, 2), (8, 1)] and model[""][0] == (2, 4) and len(model[""]) == 2
    prompts = [("p", [1]), ("q", [4, 5]), ("r", [77]), ("s", [])]

    def walk(name, tokens):
        tokens = list(tokens)
        for step in range(6):
            for k in (3, 2, 1, 0):
                key = " ".join(map(str, tokens[-k:] if k else []))
                if len(tokens) >= k and key in model:
                    break
            u = int(hashlib.md5(f"9:{step}:{name}".encode()).hexdigest()[:8], 16) / 2**32
            total, c = sum(n for _, n in model[key]), 0
            for token, n in model[key]:
                c += n
                if u * total < c:
                    break
            tokens.append(token)
            if token == 2:
                return tokens, True
        return tokens, False

    p = spark.createDataFrame(prompts, "id string, tokens array<int>")
    got = {r["id"]: (r["tokens"], r["done"]) for r in N.continued(p, N.backoff_table(df, top_k=2), 6, 9, 2).collect()}
    assert got == {name: walk(name, t) for name, t in prompts}
    assert N.continued(p.limit(0), N.backoff_table(df), 6, 9, 2).count() == 0
