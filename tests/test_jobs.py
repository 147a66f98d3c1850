"""The exactly-once sink, headers, ordered streams, and jobs from files to files that break off and go on."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import sequences as S
from seqlake.operators import signal as P
from seqlake.plans import jobs
from seqlake.sources import npy, once, readers, sinks
from seqlake.streaming import ingest as I


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_batches_are_written_once(spark, tmp_path):
    out, rows = str(tmp_path / "o"), [(i, f"a,{i}\n\"é\"", None if i % 3 else float(i), [1, i]) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, t string, x double, a array<int>").repartition(3)
    once.write_once(df, out, "b1")
    before = files_below(out)
    once.write_once(df.limit(3), out, "b1")
    assert files_below(out) == before and not any("_scratch/" in f for f in before)
    once.write_once(df.drop("a").where("i < 5"), out, "b2", "csv")
    got = [tuple(r) for r in once.read_once(spark, out, "i long, t string, x double").collect()]
    assert sorted(got, key=str) == sorted([r[:3] for r in rows] + [r[:3] for r in rows if r[0] < 5], key=str)
    assert {r["batch"]: (r["kind"], r["rows"]) for r in once.ledger(spark, out).collect()} == {"b1": ("json", 50), "b2": ("csv", 5)}
    once.write_once(df.where("i < 0"), out, "none")
    assert once.ledger(spark, out).where("batch = 'none'").first()["rows"] == 0
    assert once.ledger(spark, str(tmp_path / "nothing")).count() == 0


def test_a_failing_task_leaves_nothing_behind(spark, tmp_path):
    out = str(tmp_path / "o")
    df = spark.range(0, 40, 1, 4).select("id", F.when(F.col("id") == 35, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="broken"):
        once.write_once(df, out, "b")
    # A task that outlives the failed try may still write into the scratch folder, which nobody reads.
    assert [f for f in files_below(out) if not f.startswith("_scratch/")] == [] and once.ledger(spark, out).count() == 0
    # A task whose commit message never arrives: what it wrote isn't part of the batch.
    w = once.OnceWriter(out, "b", "json", ["id"])
    lost, kept = w.write(iter([{"id": 1}])), w.write(iter([{"id": 2}, {"id": 3}]))
    assert lost.rows == 1
    # A try that moved its files and ended before its ledger row.
    os.makedirs(f"{out}/b", exist_ok=True)
    (tmp_path / "o" / "b" / "old.json").write_text('{"id": 9}\n')
    assert once.read_once(spark, out, "id long").count() == 0
    w.commit([kept, None])
    assert sorted(r["id"] for r in once.read_once(spark, out, "id long").collect()) == [2, 3] and len(files_below(out)) == 2
    with pytest.raises(ValueError, match="same file name"):
        f = once.OnceWriter(out, "c", "files", ["name", "content"])
        f.commit([f.write(iter([{"name": "x", "content": b"1"}, {"name": "x", "content": b"2"}]))])
    assert len(files_below(out)) == 2


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        b = super().read(n)
        self.taken += len(b)
        return b


def test_headers_of_any_kind(spark, tmp_path):
    arrays = {"a": np.arange(9, dtype=np.int16), "b": np.arange(12, dtype=np.int64).reshape(3, 4), "c": np.asfortranarray(np.arange(12, dtype=np.int32).reshape(2, 6)), "short": np.arange(2), "scalar": np.array(5), "big": np.zeros(100_000, np.int64)}
    for n, a in arrays.items():
        np.save(tmp_path / f"{n}.npy", a)
    head = repr({"descr": "<i4", "fortran_order": False, "shape": (7,)}).ljust(5000) + "\n"
    (tmp_path / "long.npy").write_bytes(b"\x93NUMPY\x02\x00" + len(head).to_bytes(4, "little") + head.encode() + np.arange(7, dtype="<i4").tobytes())
    (tmp_path / "bad.npy").write_bytes(b"\x93NUMPY\x01")
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "deep" / "d.npy", np.arange(4, dtype=np.uint8))
    spark.dataSource.register(npy.NpySource)
    r = spark.read.format("npy").option("path", str(tmp_path))
    heads = {x["stem"]: (x["shape"], x["dtype"], x["fortran"], x["steps"]) for x in r.schema("stem string, shape array<int>, dtype string, fortran boolean, steps long").load().collect()}
    assert heads == {"a": ([9], "<i2", False, 9), "b": ([3, 4], "<i8", False, 4), "c": ([2, 6], "<i4", True, 6), "short": ([2], "<i8", False, 2), "scalar": ([], "<i8", False, None), "big": ([100_000], "<i8", False, 100_000), "long": ([7], "<i4", False, 7), "bad": (None, None, None, None), "d": ([4], "|u1", False, 4)}
    tokens = {x["stem"]: x["tokens"] for x in r.schema("tokens array<int>, stem string").load().where("stem in ('c', 'long', 'bad')").collect()}
    assert tokens == {"c": list(range(12)), "long": list(range(7)), "bad": None}
    assert {x["stem"]: x["steps"] for x in readers.token_headers(spark, [str(tmp_path)]).collect()} == {k: v[3] for k, v in heads.items() if v[3] and v[3] > 2}
    for n in ("big", "long"):
        f = Counting((tmp_path / f"{n}.npy").read_bytes())
        assert npy.header_of(f) is not None and f.taken <= 5100
    with pytest.raises(Exception, match="no column"):
        r.schema("what int").load().collect()


def test_token_and_audio_files(spark, tmp_path):
    df = spark.createDataFrame([("s/a", [1, 2, 3], [[1, 2, 3], [4, 5, 6]]), ("b", [7], None), ("c", None, None)], "name string, tokens array<int>, codes array<array<int>>")
    sinks.write_tokens(df, str(tmp_path / "t"), "r")
    sinks.write_tokens(df, str(tmp_path / "c"), "r", tokens="codes")
    assert np.load(tmp_path / "t/s/a.npy").tolist() == [1, 2, 3] and np.load(tmp_path / "t/b.npy").tolist() == [7] and np.load(tmp_path / "c/s/a.npy").tolist() == [[1, 2, 3], [4, 5, 6]]
    assert [f for f in files_below(tmp_path / "c") if f.endswith(".npy")] == ["s/a.npy"]
    sinks.write_csv(df.select("name"), str(tmp_path / "csv"))
    sinks.write_json(df, str(tmp_path / "json"))
    assert {r["name"] for r in readers.csv(spark, str(tmp_path / "csv"), "name string").collect()} == {"s/a", "b", "c"}
    assert spark.read.json(str(tmp_path / "json")).where("name = 'b'").first()["tokens"] == [7]


def calls_of(rec, seed, n=40):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([0.5, 4.0, 9.0, 21.0], n))
    return [(rec, float(x), float(rng.choice([0.2, 1.0])), int(rng.integers(0, 23)), str(rng.choice(["5R1", "1+1+3", "1-NOISE", "odd"])) if rng.random() < 0.9 else None) for x in t]


def test_late_and_disordered_calls_come_out_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = calls_of("r1", 1) + calls_of("r2", 2)
    order = sorted(rows, key=lambda r: r[1])
    rng = np.random.default_rng(3)
    mixed = [order[i] for i in np.argsort(np.arange(len(order)) + rng.uniform(0, 6, len(order)))]
    end = [("z", 3000.0, 0.0, 1, "5R1"), ("z", 9000.0, 0.0, 1, "5R1")]  # carries the watermark on
    late = [("r1", 1.0, 0.0, 1, "5R1")]  # when its recording's calls have left
    schema = "REC string, TsTo double, Duration double, Whale int, CodaType string"

    def put(rows, n):
        os.makedirs(tmp_path / "in", exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(dict(zip(("REC", "TsTo", "Duration", "Whale", "CodaType"), r))) + "\n" for r in rows))
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis((F.col("TsTo") * 1000 + 1_704_067_200_000).cast("long")))
        q = I.ordered_tokens(s, "200 seconds", 60.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        k = len(mixed) // 3
        put(mixed[:k], 1)
        put(mixed[k : 2 * k], 2)
        run()
        put(mixed[2 * k :], 3)
        put(end[:1], 4)
        put(late, 5)
        put(end[1:], 6)
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).where("REC <> 'z'").orderBy("REC", "TsTo").collect():
        got.setdefault(r["REC"], []).append(r["tokens"])
    batch = S.tokenize(spark.createDataFrame([(*r, i) for i, r in enumerate(order)], schema + ", i int"), ["REC"], ["TsTo", "i"]).collect()
    assert {k: [t for call in v for t in call] for k, v in got.items()} == {r["REC"]: r["tokens"][1:-1] for r in batch}


def test_folder_jobs_go_on_where_they_broke_off(spark, tmp_path):
    rng = np.random.default_rng(5)
    make = lambda x, sr: spark.createDataFrame([([float(v) for v in x], sr)], "samples array<double>, sr int").select(P.encode_wav("samples", "sr").alias("b")).first()["b"]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(5):
        x = np.sin(np.arange(9000) * (0.05 + 0.1 * i)) * np.repeat(rng.choice([0.01, 0.6], 9), 1000)
        (folder / f"src{i % 2}").mkdir(parents=True, exist_ok=True)
        (folder / f"src{i % 2}" / f"f{i}.wav").write_bytes(make(x, 8000 if i else 4000))
    (folder / "bad.wav").write_bytes(b"RIFFno")

    broken = {"yes": True}

    def breaks(todo, run):
        if broken["yes"]:
            raise RuntimeError("half-way")

    outputs = {
        "grades": jobs.grades_output(out, 8000, longest=0.6, shortest=0.1, threshold=0.1),
        "tokens": jobs.tokens_output(out, P.residual_quantiser(2), 2, 0.1, (200, 3000)),
        "breaks": breaks,
        "denoised": jobs.denoised_output(out, str(folder), 8000, 8000),
        "hydrophone": jobs.hydrophone_output(out, P.residual_quantiser(2), 2, 8000, score_rate=8000, score_window=512, least_score=0.02, heard=dict(band=(200, 3500), longest=0.3, shortest=0.05, max_silence=0.1, fill=0.02), chosen=dict(band=(200, 3500), n_fft=256, hop=64, least_cv=0.05, frame_seconds=0.01)),
    }
    with pytest.raises(RuntimeError, match="half-way"):
        jobs.run_folder(spark, str(folder), out, outputs, most=3)
    first = files_below(tmp_path / "out" / "tokens")
    assert any(f.endswith(".npy") for f in first) and once.ledger(spark, f"{out}/done").count() == 0
    (folder / "aaa.wav").write_bytes(make(np.sin(np.arange(2000) / 5), 8000))  # would stand first in a new plan
    stamps = {f: os.stat(tmp_path / "out" / "tokens" / f).st_mtime_ns for f in first}
    broken["yes"] = False
    assert [jobs.run_folder(spark, str(folder), out, outputs, most=3) for _ in range(4)] == [3, 3, 1, 0]
    assert {f: os.stat(tmp_path / "out" / "tokens" / f).st_mtime_ns for f in first} == stamps
    done = [os.path.basename(r["path"]) for r in once.read_once(spark, f"{out}/done", "path string").collect()]
    assert sorted(done) == sorted(["bad.wav", "aaa.wav", *(f"f{i}.wav" for i in range(5))])
    tokens = [f for f in files_below(tmp_path / "out" / "tokens") if f.endswith(".npy")]
    assert tokens == sorted(["aaa.npy", *(f"src{i % 2}/f{i}.npy" for i in range(5))])
    assert all(np.load(tmp_path / "out" / "tokens" / f).shape[0] > 2 for f in tokens)
    wavs = [f for f in files_below(tmp_path / "out" / "denoised") if f.endswith(".wav")]
    assert wavs == sorted(["aaa.wav", *(f"src{i % 2}/f{i}.wav" for i in range(1, 5))])  # one has too low a rate
    grades = once.read_once(spark, f"{out}/grades", readers.GRADES.replace("species string, ", ""))
    assert {r["source"] for r in grades.collect()} >= {"src0", "src1"} and grades.where("grade not in ('A', 'B', 'C', 'D', 'F')").count() == 0
    scores = once.read_once(spark, f"{out}/scores", "npy_file string, path string, chunk int, whale_cv double, energy_ratio double, whale_rms double, detector_score double").collect()
    chunks = [f for f in files_below(tmp_path / "out" / "chunks") if f.endswith(".npy")]
    assert scores and sorted(r["npy_file"] for r in scores) == sorted(chunks)
    assert all(r["detector_score"] is None or r["detector_score"] >= 0.02 for r in scores)
