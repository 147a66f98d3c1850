"""Incremental jobs: each file once, restart-safe, bounded per run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vocabulary as V


def new_files(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 50, archive: str | None = None, delete: bool = False) -> DataFrame:
    """A stream of files (path, modificationTime, length, content); with ``archive`` they move there once read, with ``delete`` they go."""
    r = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).schema("path string, modificationTime timestamp, length long, content binary")
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif delete:
        r = r.option("cleanSource", "delete")
    return r.load(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Process what is there and end. The checkpoint is the ledger; a batch that runs again replaces its own output.

    Rows carry their batch number as a partition, so a repeated batch
    overwrites itself; a key that another batch has written is left out, as is
    a second row of a key, so no key comes twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        from ..sources.files import exists

        spark, new = batch.sparkSession, transform(batch).dropDuplicates(key)
        if exists(spark, output):
            have = spark.read.option("basePath", output).parquet(output).where(F.col("batch") != number).select(*key)
            new = new.join(have, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, n, share of detections by event time, with a watermark for late rows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"))
    return w.agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("proportion")).select(F.col("window.start").alias("hour"), "n", "proportion")


def sessions(events: DataFrame, gap: str = "15 seconds", late: str = "1 minute") -> DataFrame:
    """REC, start, end, n of calls without a pause over ``gap``."""
    s = events.withWatermark("ts", late).groupBy("REC", F.session_window("ts", gap).alias("s"))
    return s.agg(F.count("*").alias("n")).select("REC", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def live_tokens(calls: DataFrame) -> DataFrame:
    """REC, TsTo, pause, tokens of each call as it comes: the last time of each recording is the state.

    tokens: pause, whale and call type, those there are.

    ``calls`` has REC, TsTo, Duration, Whale, CodaType and comes in order
    within a recording. Noise gives no tokens and leaves the state.
    """
    import pandas as pd

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for r in frame.sort_values("TsTo", kind="stable").itertuples(index=False):
                if isinstance(r.CodaType, str) and "NOISE" in r.CodaType:
                    continue
                gap = r.TsTo - last - r.Duration if last is not None else None
                whale = int(r.Whale) if pd.notna(r.Whale) else None
                out.append((key[0], r.TsTo, gap, whale, r.CodaType if isinstance(r.CodaType, str) else None))
                last = r.TsTo
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["REC", "TsTo", "gap", "Whale", "CodaType"]).astype({"Whale": "Int32"})

    from pyspark.sql.streaming.state import GroupStateTimeout

    gaps = calls.groupBy("REC").applyInPandasWithState(step, "REC string, TsTo double, gap double, Whale int, CodaType string", "last double", "append", GroupStateTimeout.NoTimeout)
    pause = V.pause_token(F.col("gap"))
    parts = F.array(pause, V.whale_token(F.col("Whale")), V.type_token(F.col("CodaType")))
    return gaps.select("REC", "TsTo", pause.alias("pause"), F.array_compact(parts).alias("tokens"))


_CALL = "TsTo double, Duration double, Whale int, CodaType string"


def _processor(idle_ms: int):
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class OrderedCalls(StatefulProcessor):
        """Calls of one recording wait in a list until the watermark has passed them, then leave it in order."""

        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at long, " + _CALL)
            self.last = handle.getValueState("last", "at long, TsTo double")

        def handleInputRows(self, key, rows, timerValues):
            got = [(int(at.value // 1_000_000), t, d, w, c) for b in rows for at, t, d, w, c in zip(b["ts"], b["TsTo"], b["Duration"], b["Whale"], b["CodaType"])]
            last = self.last.get() if self.last.exists() else None
            plain = lambda x: None if pd.isna(x) else x
            # What is older than a call that has left can't take its place any more.
            fresh = [(at, float(t), float(d), None if pd.isna(w) else int(w), plain(c)) for at, t, d, w, c in got if last is None or at >= last[0]]
            if fresh:
                self.waiting.appendList(fresh)
                self._wake(min(at for at, *_ in fresh), timerValues)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs()
            rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
            ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
            last, out = self.last.get() if self.last.exists() else None, []
            at, before = (last[0], last[1]) if last is not None else (None, None)
            for at_, t, d, w, c in ready:
                if c is not None and "NOISE" in c:
                    continue  # gives no tokens and leaves the state as it is
                out.append((key[0], t, t - before - d if before is not None else None, w, c))
                at, before = at_, t
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if not later and (at is None or at + idle_ms <= now):
                self.last.clear()  # the recording has ended
            else:
                if at is not None:
                    self.last.update((at, before))
                self._wake(min(r[0] for r in later) if later else at + idle_ms, timerValues)
            frame = pd.DataFrame(out, columns=["REC", "TsTo", "gap", "Whale", "CodaType"]).astype({"TsTo": "float64", "gap": "float64", "Whale": "Int32"})
            if out:
                yield frame

        def _wake(self, at: int, timers) -> None:
            self.handle.registerTimer(max(at, timers.getCurrentWatermarkInMs() + 1))

        def close(self) -> None:
            pass

    return OrderedCalls()


def ordered_tokens(calls: DataFrame, late: str = "1 minute", idle_seconds: float = 600.0) -> DataFrame:
    """REC, TsTo, pause, tokens of calls that may come late and in any order, in the order of their times.

    ``calls`` has REC, ts (event time), TsTo, Duration, Whale, CodaType. Calls
    wait in their recording's list state until the watermark, ``late`` behind
    the newest call of all, has passed them; event-time timers let them go in
    order, so pauses are those of the batch tokeniser. A call later than that
    is dropped. A recording's state goes ``idle_seconds`` after its last call,
    so what is kept grows with the recordings that are going on, not with all
    ever seen; calls of a recording that comes back count as its first. Rows
    with a null REC, ts or TsTo take no part. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    sound = calls.where("REC is not null and ts is not null and TsTo is not null").select("REC", "ts", F.col("TsTo").cast("double").alias("TsTo"), F.coalesce(F.col("Duration").cast("double"), F.lit(float("nan"))).alias("Duration"), F.col("Whale").cast("int").alias("Whale"), F.col("CodaType").cast("string").alias("CodaType"))
    gaps = sound.withWatermark("ts", late).groupBy("REC").transformWithStateInPandas(_processor(int(idle_seconds * 1000)), "REC string, TsTo double, gap double, Whale int, CodaType string", "Append", "EventTime")
    pause = V.pause_token(F.col("gap"))
    parts = F.array(pause, V.whale_token(F.col("Whale")), V.type_token(F.col("CodaType")))
    return gaps.select("REC", "TsTo", pause.alias("pause"), F.array_compact(parts).alias("tokens"))
