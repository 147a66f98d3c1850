"""Small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.functions import arrays as A
from seqlake.functions import scores as Q
from seqlake.functions import vocabulary as V
from seqlake.operators import catalog as C
from seqlake.operators import grading as G
from seqlake.operators import kernels as K
from seqlake.operators import sequences as S
from seqlake.operators import signal as P
from seqlake.operators import windows as W

CALLS = "REC string, i int, TsTo double, Whale int, Duration double, nClicks int, CodaType string"


def test_worked_example_of_tokens(spark):
    rows = [("r", 0, 0.0, 1, 0.0, 5, "5R1"), ("r", 1, 3.0, 2, 0.0, 5, "1-NOISE"), ("r", 2, 10.0, 21, 1.0, 4, None)]
    t = S.tokenize(spark.createDataFrame(rows, CALLS), ["REC"], ["TsTo", "i"]).collect()
    assert [(r["n_codas"], r["tokens"]) for r in t] == [(3, [1, 8, 37, 6, 66, 2])]


def test_nan_gaps_unknown_types_and_small_groups(spark):
    nan = float("nan")
    rows = [("a", 0, 0.0, 1, 0.0, 3, "5R1"), ("a", 1, 1.0, 1, nan, 3, "other"), ("a", 2, 2.0, 0, 0.0, 0, ""), ("a", 3, None, 3, 0.0, 12, "nan"), ("b", 0, 0.0, 1, 0.0, 1, "5R1"), (None, 0, 0.0, 1, 0.0, 1, "5R1")]
    t = {r["REC"]: r["tokens"] for r in S.tokenize(spark.createDataFrame(rows, CALLS), ["REC"], ["i"]).collect()}
    # NaN duration: no pause; unknown type: nothing; no clicks: nothing; a missing time gives no pause.
    assert t == {"a": [1, 8, 37, 8, 4, 10, 73, 2]}


def test_null_whale_fails(spark):
    df = S.require_whales(spark.createDataFrame([("1.5", 1), ("x", None)], "TsTo string, Whale int"))
    with pytest.raises(Exception, match="Whale is null"):
        df.collect()


def test_vocabulary(spark):
    v = V.vocabulary(spark)
    assert v.count() == V.VOCAB_SIZE == 74
    bad = v.withColumn("t", V.decode_token(F.col("token_id"))).where("t <> text").count()
    assert bad == 0
    assert spark.range(1).select(V.decode_token(F.lit(99)).alias("t")).first()["t"] == "<unk:99>"


@pytest.mark.parametrize("n,length,want", [(13, 8, [(0, 9), (4, 13), (4, 13)]), (20, 8, [(0, 9), (4, 13), (8, 17), (11, 20)]), (9, 8, [(0, 9)]), (3, 8, [(0, 3)])])
def test_windows(spark, n, length, want):
    df = spark.createDataFrame([(n,)], "n int")
    assert sorted((r["start"], r["end"]) for r in W.sliding(df, F.col("n"), length).collect()) == want


def test_windows_carry_their_own_tokens_alone(spark):
    df = spark.createDataFrame([("a", list(range(20))), ("b", [7, 8, 9]), ("c", None)], "k string, tokens array<int>")
    got = sorted((r["k"], r["window_no"], r["start"], r["end"], r["tokens"]) for r in W.sliced(df, "tokens", 8, ["k"]).collect())
    assert got == [("a", i, s, s + 9, list(range(s, s + 9))) for i, s in enumerate([0, 4, 8, 11])] + [("b", 0, 0, 3, [7, 8, 9])]


def test_augment_of_a_long_sequence(spark):
    df = spark.range(12).select(F.concat(F.lit("k"), "id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: i % 1000 + 1).alias("tokens"))
    sizes = [r["n"] for r in W.augment(df, "k", "tokens", 1025, 5).select(F.size("tokens").alias("n")).collect()]
    assert all(180_000 <= n <= 220_000 for n in sizes) and len(set(sizes)) > 2


def test_concat_windows_drop_a_last_separator(spark):
    files = spark.createDataFrame([(0, f"s_{i}", [10 * i + k for k in range(1, 6)]) for i in range(3)] + [(0, "t", [1, 2])], "dir_ordinal int, stem string, tokens array<int>")
    got = {r["start"]: r["tokens"] for r in W.concat_windows(files, 5, 99).collect()}
    flat = [1, 2, 3, 4, 5, 99, 11, 12, 13, 14, 15, 99, 21, 22, 23, 24, 25]
    want = {}
    for a in [*range(0, len(flat) - 5, 2), len(flat) - 6]:
        w = flat[a : a + 6]
        want[a] = w[:-1] if w[-1] == 99 else w
    assert got == want


def test_examples_pad_and_mask(spark):
    e = W.examples(spark.createDataFrame([([5, 6, 7],)], "tokens array<int>"), 4).first()
    assert (e["input_ids"], e["target_ids"], e["attention_mask"]) == ([5, 6, 7, 0], [6, 7, 0, 0], [1, 1, 1, 0])


def test_interleave_and_back(spark):
    r = spark.createDataFrame([([[1, 2], [3, 4], [5, 6]],)], "c array<array<int>>").select(A.interleave(F.col("c")).alias("t"), A.deinterleave(A.interleave(F.col("c")), 3).alias("b"), A.recover_codes(A.interleave(F.col("c")), 3, 4).alias("r")).first()
    assert r["t"] == [1, 1027, 2053, 2, 1028, 2054] and r["b"] == [[1, 2], [3, 4], [5, 6]] and r["r"] == [[0, 1], [2, 3], [4, 5], [0, 0]]


def test_ranks_and_splits(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "a int, b int")
    got = [r["b"] for r in W.global_rank(df, ["-a", "b"], "p").orderBy("p").collect()]
    assert got == [b for _, b in sorted(((-(i % 7), i) for i in range(100)))]
    s = W.split(df.select("b"), "b", 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in s} == {"train": 80, "val": 10, "test": 10}


def test_running_sums_in_buckets(spark):
    rows = [("a" if i % 3 else None, i // 7 if i % 5 else None, i, i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, b int, i int, v int")
    got = {r["i"]: r["s"] for r in W.running_sum(df, "k", ["i"], F.col("v"), "s", [F.coalesce("b", F.floor(F.col("i") / 7).cast("int"))]).collect()}
    assert got == {i: sum(v for k2, _, j, v in rows if k2 == k and j < i) for k, _, i, _ in rows}
    nulls = spark.createDataFrame([(1, None, 1), (1, None, 2), (1, 3, 3)], "k int, b int, i int")
    assert sorted((r["i"], r["s"]) for r in W.running_sum(nulls, "k", ["i"], F.lit(1), "s", [F.col("b")]).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_rotary_table(spark):
    t = {(r["pos"], r["i"]): (r["cos"], r["sin"]) for r in K.rotary_table(spark, 3, 4).collect()}
    assert len(t) == 6 and math.isclose(t[2, 1][1], math.sin(2 / 100)) and t[0, 0] == (1.0, 0.0)


def test_file_names_species_and_groups(spark):
    names = [("SanctSound_HI01_01_671129638_20181115T000002Z.flac",), ("SanctSound_HI01_01_671129638_191201000002.flac",), ("nothing.flac",)]
    got = [str(r[0]) for r in spark.createDataFrame(names, "name string").select(C.file_time(F.col("name"))).collect()]
    assert got == ["2018-11-15 00:00:02", "2019-12-01 00:00:02", "None"]
    f = spark.createDataFrame([("watkins", "d/audio/Sperm_Whale/1.wav"), ("watkins", "x.wav"), ("orcasound", "a/SRKW_1.wav"), ("new", "a")], "source string, path string")
    assert [r[0] for r in f.select(C.species(F.col("source"), F.col("path"))).collect()] == ["Sperm Whale", "Unknown", "Orca", "Unknown"]
    assert sorted(r["group_name"] for r in C.group_members(f).collect()) == ["sperm", "toothed", "toothed"]


def test_masks_and_sampling(spark):
    r = spark.createDataFrame([([5.0, 4.0, 4.0, 3.0],)], "l array<double>").select(K.top_k_mask(F.col("l"), 2).alias("m"), K.nucleus(F.col("l"), 0.0).alias("n"), K.sample(F.col("l"), F.lit(0.999999), 1.0, 2).alias("s"), K.sample(F.col("l"), F.lit(0.0), 0).alias("g")).first()
    assert r["m"] == [5, 4, 4, None] and r["n"] == [5, None, None, None] and r["s"] == 2 and r["g"] == 0


def test_learning_rate_and_grades(spark):
    r = spark.range(1).select(Q.learning_rate(F.lit(50), 1.0, 100, 200, 0.1).alias("a"), Q.learning_rate(F.lit(200), 1.0, 100, 200, 0.1).alias("b"), Q.grade(F.lit(0.6)).alias("g"), Q.grade_rank(F.lit("Z")).alias("z")).first()
    assert (r["a"], r["g"], r["z"]) == (0.5, "B", 0) and math.isclose(r["b"], 0.1)


def test_unknown_least_grade_lets_all_pass(spark):
    g = spark.createDataFrame([("s", "f", 1, "F")], "source string, file string, segment_idx int, grade string")
    assert G.at_least(g, "?").count() == 1 and G.at_least(g, "A").count() == 0


def test_quartile_threshold(spark):
    e = spark.createDataFrame([(1, i, float(i * i)) for i in range(11)], "id int, frame_no int, energy double")
    assert P.silence_threshold(e).first()["threshold"] == 6.5


def test_greedy_splits(spark):
    c = F.array(*[F.lit(x).cast("long") for x in (12, 28, 33, 55, 61, 90)])
    assert spark.range(1).select(P.split_starts(F.lit(100), c, 2, 30).alias("s")).first()["s"] == [0, 28, 55, 61, 90]


def test_bandpass_passes_the_band():
    sr = 8000
    t = np.arange(sr) / sr
    sos = P.butterworth_band(5, 400 / 4000, 1500 / 4000)
    level = lambda f: np.sqrt(np.mean(P.sos_filter(sos, np.sin(2 * np.pi * f * t))[sr // 2 :] ** 2)) * np.sqrt(2)
    assert abs(level(800) - 1) < 0.02 and abs(level(400) - 0.7071) < 0.02 and abs(level(1500) - 0.7071) < 0.02 and level(50) < 1e-3 and level(3800) < 1e-3


def test_loudness_of_a_sine():
    sr = 48000
    x = np.sin(2 * np.pi * 997 * np.arange(sr * 2) / sr)
    assert abs(P.integrated_loudness(x, sr) + 3.01) < 0.05
    assert P.integrated_loudness(np.zeros(sr), sr) == -np.inf


def test_gates_keep_length_and_lower_noise():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, 9000)
    for y in (P.spectral_gate(x, 0.9, True), P.spectral_gate(x, 0.75, False), P.spectral_subtraction(x), P.wiener(x)):
        assert len(y) == len(x) and np.sqrt(np.mean(y**2)) < np.sqrt(np.mean(x**2))


def test_silence_table_function(spark):
    df = spark.createDataFrame([(1, [0.5] * 300 + [0.0] * 100 + [0.5] * 300)], "id int, samples array<double>")
    got = [(r["chunk"], r["start"], r["stop"]) for r in df.lateralJoin(P.SegmentAtSilence(F.col("samples").outer(), F.lit(100), F.lit(1.0), F.lit(4.0))).collect()]
    assert got[0][:2] == (0, 0) and got[-1][2] == 700 and all(b - a <= 400 for _, a, b in got)
