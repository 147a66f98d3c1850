"""Readers, sinks, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import catalog as C
from seqlake.operators import signal as P
from seqlake.plans import pipelines
from seqlake.sources import npy, readers, sinks
from seqlake.streaming import ingest as I


def test_csv_with_a_byte_order_mark_and_bad_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿Date,Unit,UnitNum,codaNUM2018,CodaType\n2014,A,1,2,5R1\n2014,A,x,3,\n", encoding="utf-8")
    got = [tuple(r) for r in readers.codas(spark, str(tmp_path / "c.csv")).select("Date", "UnitNum", "codaNUM2018", "CodaType", "Duration").collect()]
    assert got == [("2014", 1, 2, "5R1", None), ("2014", None, 3, None, None)]


def test_detections(spark, tmp_path):
    (tmp_path / "d.csv").write_text('t,p\n"2019-01-01T05:00:00Z",0.9\n"bad",0.9\n2019-01-01T06:00:00Z,low\n2019-01-01T07:00:00Z,0.5\n')
    d = C.detection_hours(readers.detections(spark, str(tmp_path / "d.csv")))
    assert [r["hour"] for r in d.collect()] == ["2019-01-01T05"]


def test_arrays_and_data_source(spark, tmp_path):
    np.save(tmp_path / "a_1.npy", np.arange(5, dtype=np.int32))
    np.save(tmp_path / "a_2.npy", np.arange(8, dtype=np.int16).reshape(2, 4))
    np.save(tmp_path / "a_3.npy", np.arange(2))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    got = {r["stem"]: (r["shape"], r["tokens"]) for r in readers.token_arrays(spark, str(tmp_path)).collect()}
    assert got == {"a_1": ([5], [0, 1, 2, 3, 4]), "a_2": ([2, 4], list(range(8)))}
    spark.dataSource.register(npy.NpySource)
    assert spark.read.format("npy").option("path", str(tmp_path)).load().count() == 4


def test_wav_round_trip(spark, tmp_path):
    x = [float(v) for v in np.sin(np.arange(400) / 9) * 0.5]
    raw = spark.createDataFrame([(x, 8000)], "samples array<double>, sr int").select(P.encode_wav("samples", "sr").alias("b")).first()["b"]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.wav").write_bytes(raw)
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "bad.wav").write_bytes(b"RIFFno")
    got = {r["name"]: r for r in readers.wav_clips(spark, str(tmp_path)).collect()}
    assert set(got) == {"x.wav", "bad.wav"} and got["bad.wav"]["samples"] is None
    assert got["x.wav"]["sr"] == 8000 and np.abs(np.array(got["x.wav"]["samples"]) - x).max() < 1e-4


def test_scores_are_appended_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0)], "name string, score double")
    for _ in range(2):
        sinks.append_scores(df, str(tmp_path / "s"), ["name"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_retained(spark):
    c = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 3, 4, 1, 3])], "step long, val_loss double")
    assert sorted(r["step"] for r in sinks.retained(c, 3).where("keep").collect()) == [1, 3, 4]


def test_files_are_ingested_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.bin").write_bytes(b"x" * (i + 1))

    def run():
        q = I.ingest(I.new_files(spark, src, "*.bin", 2), lambda b: b.select("path", "length"), out, ck, ["path"])
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 3 and run() == 3
    (tmp_path / "in" / "9.bin").write_bytes(b"y")
    assert run() == 4


def test_event_time_windows_and_state(spark, tmp_path):
    rows = [("r", float(t), 0.0, 1, c, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}") for t, c in [(0, "5R1"), (3, "1-NOISE"), (10, "5R1"), (40, None)]]
    spark.createDataFrame(rows, "REC string, TsTo double, Duration double, Whale int, CodaType string, at string").coalesce(1).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("REC string, TsTo double, Duration double, Whale int, CodaType string, at string").parquet(str(tmp_path / "e")).withColumn("ts", F.to_timestamp("at")).withColumn("hit", F.lit(True))

    def result(df, mode, name):
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert [r["n"] for r in result(I.hourly(s), "complete", "hourly")] == [4]
    # The watermark comes to 39 s: the first session, over at 25 s, is closed, the second is not.
    assert result(I.sessions(s, late="1 second"), "append", "sessions")[0]["n"] == 3
    live = sorted(result(I.live_tokens(s), "append", "live"), key=lambda r: r["TsTo"])
    assert [(r["TsTo"], r["pause"]) for r in live] == [(0.0, None), (10.0, 6), (40.0, 7)]
    assert [r["tokens"] for r in live] == [[8, 37], [6, 8, 37], [7, 8]]


def test_pipelines(spark):
    clips = spark.createDataFrame([("s", "f", i, [0.1 * ((i + k) % 7 - 3) for k in range(200)]) for i in range(4)], "source string, file string, segment_idx int, samples array<double>")
    g = pipelines.graded(clips)
    assert g.count() == 4 and set(r["grade"] for r in g.collect()) <= set("ABCDF")
    t = pipelines.tokenised(clips, P.residual_quantiser(2), 2, clips.where("segment_idx < 3").select("source", "file", "segment_idx"), ["source", "file", "segment_idx"])
    assert sorted(r["name"] for r in t.collect()) == ["s_000000", "s_000001", "s_000002"]
    assert all(len(r["tokens"]) == 400 and max(r["tokens"]) <= 2048 for r in t.collect())


def test_prepared_and_trimmed(spark):
    clips = spark.createDataFrame([([0.1 * (k % 5 - 2) for k in range(300)], 100)], "samples array<double>, sr int")
    x = pipelines.prepared(clips, 2.0, 5, 40).first()["samples"]
    assert len(x) == 200 and abs(max(map(abs, x)) - 0.9) < 1e-9
    c = spark.createDataFrame([([[1, 2, 3, 4], [5, 6, 7, 8]], 31), ([[1, 2, 3, 4]], 29)], "c array<array<int>>, n int").select(P.trimmed(F.col("c"), F.col("n"), 10).alias("t"))
    assert [r["t"] for r in c.collect()] == [[[1, 2, 3], [5, 6, 7]], None]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert readers.config(str(tmp_path / "c.json")) == {"a": {"b": 1}}
    with pytest.raises((ImportError, FileNotFoundError)):
        readers.config(str(tmp_path / "none.yaml"))
