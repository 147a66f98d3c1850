"""Findings of reviews: odd rows and steps that grew too fast, against SQL or the plain way."""

import os

import duckdb
import pytest

from seqlake.plans import registry

TEXTS = ["", "a", "ab", "abc", "x" * 300, "déjà vu " * 60, "日本語🐋" * 40, None]


@pytest.fixture(scope="module")
def long_numbers(spark, tmp_path_factory):
    """documents whose numbers pass five and six digits, with odd texts."""
    ids = [7, 99_998, 99_999, 100_000, 123_456, 999_999, 1_000_001, 1_234_567, 1_234_568, 1_234_569, 2_000_003, 3_000_001, 3_000_002]
    rows = [(i, TEXTS[k % len(TEXTS)], "en" if k % 2 else "de", "src1", 200) for k, i in enumerate(ids)]
    folder = str(tmp_path_factory.mktemp("numbers"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def agrees(spark, folder, name):
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table[:-8]} AS SELECT * FROM '{folder}/{table}/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = registry.queries()[name](spark, folder).select(*columns).collect()
    text = lambda rows: sorted(tuple("null" if v is None else str(v) for v in r) for r in rows)
    assert text(got) == text(cur.fetchall())


def test_plan_names_of_long_numbers(spark, long_numbers):
    agrees(spark, long_numbers, "download_plan")


@pytest.mark.parametrize("name", ["simple_windows", "window_splits", "batches", "prompt_prefixes", "token_statistics"])
def test_token_files_of_long_numbers(spark, long_numbers, name):
    agrees(spark, long_numbers, name)


def test_windows_within_a_file_are_not_gathered(spark):
    from pyspark.sql import functions as F

    from seqlake.operators import windows as W

    lengths = [3, 40, 4, 3, 17, 2, 6, 3]
    files = spark.createDataFrame([(0, f"s_{i:03}", [1000 * i + k if k else None for k in range(n)]) for i, n in enumerate(lengths)], "dir_ordinal int, stem string, tokens array<int>")
    flat = sum(([*(1000 * i + k if k else None for k in range(n)), 99] for i, n in enumerate(lengths) if n > 2), [])[:-1]
    want = {}
    for no, a in enumerate([*range(0, len(flat) - 6, 3), len(flat) - 7]):
        w = flat[a : a + 7]
        want[no] = (a, w[:-1] if w[-1] == 99 else w)
    df = W.concat_windows(files, 6, 99)
    assert {r["window_no"]: (r["start"], r["tokens"]) for r in df.collect()} == want
    # Two equal names, told apart by a column of their own.
    twice = spark.createDataFrame([(0, "s_1", [1, 2, 3], 5), (0, "s_1", [4, 5, 6], 4)], "dir_ordinal int, stem string, tokens array<int>, id int")
    lengths = twice.withColumn("n", F.size("tokens")).drop("tokens")
    assert [r["tokens"] for r in W.concat_windows(twice, 20, 99, lengths, ("id",)).collect()] == [[4, 5, 6, 99, 1, 2, 3]]


def test_blocks_of_all_lengths_are_filtered_at_once():
    import numpy as np
    import pandas as pd

    from seqlake.operators import blocks as B
    from seqlake.operators import signal as G

    sos, rng = G.loudness_sections(4000), np.random.default_rng(1)
    x = [rng.normal(size=n) for n in (64, 3, 64, 700, 1, 700, 256)]
    states = [rng.normal(size=4) for _ in x]
    for got, a, s in zip(B._from_state(sos).func(pd.Series(x), pd.Series(states)), x, states):
        t = s.reshape(2, 2).copy()
        want = []
        for v in a:  # sample by sample
            for (b0, b1, b2, _, a1, a2), z in zip(sos, t):
                y = b0 * v + z[0]
                z[:] = b1 * v - a1 * y + z[1], b2 * v - a2 * y
                v = y
            want.append(v)
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    for got, a in zip(B._from_rest(sos).func(pd.Series(x)), x):
        np.testing.assert_allclose(got, G.sos_states(sos, a, None, 64)[1].ravel(), rtol=1e-9, atol=1e-12)
    # The tables of a section are made once, not once for each block.
    G._responses.cache_clear()
    B._from_rest(sos).func(pd.Series([np.ones(64)] * 100))
    assert G._responses.cache_info().misses == len(sos)


def test_hashes_of_places_are_md5():
    import hashlib

    from seqlake.operators import windows as W

    names, n = ["5:a", "5:日本", "x" * 60, "y" * 200], 10_020
    for k, name in enumerate(names):
        got = W._hashes(names, [n] * 4)[:, k * n : (k + 1) * n]
        for i in (0, 9, 10, 99, 100, 4095, 4096, 8191, 8192, 9999, 10_000, 10_019):
            digest = hashlib.md5(f"{name}:{i}".encode()).hexdigest()
            assert [int(digest[8 * j : 8 * j + 8], 16) for j in range(4)] == got[:, i].tolist()


def test_augmented_tokens_of_odd_texts(spark, long_numbers):
    agrees(spark, long_numbers, "augmented_tokens")


def test_codec_fits_many_clips_at_once():
    import numpy as np
    import pandas as pd

    from seqlake.operators import codec as C
    from seqlake.operators import signal as G

    rng = np.random.default_rng(2)
    clips = [rng.normal(size=n) for n in rng.integers(1, 70, 1100)]
    batch = pd.DataFrame({"samples": clips})
    frames = np.concatenate([C.frames_of(x, 8) for x in clips])
    got = list(C._sampled([], 8)(iter([batch])))
    assert len(got) == 3  # 512 clips at a time, not a table for each clip
    np.testing.assert_array_equal(np.concatenate([np.stack(g["frame"]) for g in got]), frames)
    centres = rng.normal(size=(5, 8))
    (sums,) = C._gathered([], 8, centres)(iter([batch]))
    code = C.nearest(frames, centres)
    assert sums["n"].tolist() == np.bincount(code, minlength=5).tolist()
    np.testing.assert_allclose(np.stack(sums["total"]), [frames[code == i].sum(axis=0) for i in range(5)])
    assert G.mel_filters(8000, 2048, 80) is G.mel_filters(8000, 2048, 80)
