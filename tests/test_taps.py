"""Ticks of real runs, and previews of streams."""

import time

import pytest
from pyspark.sql import functions as F

from veilframe.streaming.taps import Limited, Preview, Progress


def test_rate_and_last():
    now, told = [0.0], []
    limit = Limited(told.append, 0.25, lambda: now[0])
    for k in range(10):
        now[0] = k * 0.1
        limit.offer(k)
    limit.close()
    limit.close()
    assert told == [0, 3, 6, 9]
    now[0] += 0.01
    limit.offer(10)
    limit.close()
    assert told[-1] == 10


def slow(batches):
    for b in batches:
        time.sleep(0.4)
        yield b


def test_ticks_of_a_run(spark, tmp_path):
    frames = spark.range(0, 120, 1, 12).withColumnRenamed("id", "frame_idx")
    ticks = []
    with Progress(spark, 120, ticks.append, 0.1) as p:
        p.counted(frames.mapInArrow(slow, frames.schema)).write.parquet(str(tmp_path / "out"))
    assert len(ticks) >= 3 and [t.final for t in ticks] == [False] * (len(ticks) - 1) + [True]
    assert ticks[-1].frames == 120 and ticks[-1].pct == 100.0
    assert [t.frames for t in ticks] == sorted(t.frames for t in ticks) and len({t.frames for t in ticks[:-1]}) == len(ticks) - 1
    assert all(b.at_ms - a.at_ms >= 95 for a, b in zip(ticks[:-2], ticks[1:-1]))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120


def test_last_tick_of_a_failed_run(spark):
    ticks = []

    def fails(batches):
        for b in batches:
            if b.num_rows and b.column(0)[0].as_py() >= 50:
                raise ValueError("no")
            yield b

    frames = spark.range(0, 100, 1, 4)
    with pytest.raises(Exception, match="no"):
        with Progress(spark, 100, ticks.append) as p:
            p.counted(frames).mapInArrow(fails, frames.schema).collect()
    assert ticks[-1].final and ticks[-1].frames <= 100


def test_previews_of_a_stream(spark, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10, 1, 1).withColumnRenamed("id", "frame_idx").write.mode("append").parquet(str(tmp_path / "in"))
    shown, written, now = [], [], [0.0]

    def clock():
        now[0] += 0.1
        return now[0]

    def write(batch, k):
        written.append((k, batch.agg(F.count("*")).first()[0]))

    preview = Preview(lambda r: shown.append(r.frame_idx), every=0.25, write=write, clock=clock)
    stream = spark.readStream.schema("frame_idx long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(preview).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    preview.close()
    assert sum(n for _, n in written) == 40 and shown[0] in (9, 19, 29, 39) and len(shown) == 2
