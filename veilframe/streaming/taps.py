"""What a running job tells: ticks of progress at most every quarter of a second with the last one always, and a stream's
frames as previews.

A batch job's rows are counted where they pass, by an accumulator that tasks add to as they end; a thread of the driver
reads it while the job runs. A task that is run again counts again, so a tick never says more than the total until the
job has ended. Streams are tapped between micro-batches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 0.25


@dataclass(frozen=True)
class Tick:
    """State of a run: milliseconds since its start, rows so far, of how many, and whether it is the last one."""

    at_ms: int
    frames: int
    total: int
    final: bool

    @property
    def pct(self) -> float:
        return round(min(self.frames, self.total) * 100.0 / max(self.total, 1), 3)


class Limited:
    """Passes on at most one value in `every` seconds, the newest, and the last one always."""

    def __init__(self, tell: Callable, every: float = EVERY, clock: Callable[[], float] = time.monotonic):
        self.tell, self.every, self.clock = tell, every, clock
        self.told_at: float | None = None
        self.waiting: list = []

    def offer(self, value) -> bool:
        """Whether it was passed on now; else it waits for close() or makes way for a newer one."""
        now = self.clock()
        if self.told_at is not None and now - self.told_at < self.every:
            self.waiting[:] = [value]
            return False
        self.waiting.clear()
        self.told_at = now
        self.tell(value)
        return True

    def close(self) -> None:
        if self.waiting:
            self.tell(self.waiting.pop())


class Progress:
    """Ticks of the jobs that run in its block over rows passed through counted().

    with Progress(spark, total, tell) as p: p.counted(frames).write.parquet(...)"""

    def __init__(self, spark: SparkSession, total: int, tell: Callable[[Tick], None], every: float = EVERY):
        self.spark, self.total, self.every = spark, total, every
        self.seen = spark.sparkContext.accumulator(0)
        self.limited = Limited(tell, every)
        self.done = threading.Event()
        self.last = -1

    def counted(self, df: DataFrame) -> DataFrame:
        """The same rows; each task adds those it has passed on."""
        seen = self.seen

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                seen.add(b.num_rows)

        return df.mapInArrow(run, df.schema)

    def _tick(self, final: bool) -> Tick:
        n = int(self.seen.value)
        return Tick(int((time.monotonic() - self.began) * 1000), n if final else min(n, self.total), self.total, final)

    def _watch(self) -> None:
        while not self.done.wait(self.every):
            t = self._tick(False)
            if t.frames != self.last:
                self.last = t.frames
                self.limited.offer(t)

    def __enter__(self) -> Progress:
        self.began = time.monotonic()
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *error) -> None:
        """The last tick comes whether the job ended or failed."""
        self.done.set()
        self.thread.join()
        self.limited.waiting.clear()
        self.limited.tell(self._tick(True))


class Preview:
    """A foreachBatch tap: the newest row of each micro-batch (by `order`), at most one in `every` seconds, the last one
    always; then the batch goes on to `write`, if there is one.

    query = stream.writeStream.foreachBatch(preview).start(); ...; preview.close()"""

    def __init__(self, show: Callable, order: tuple[str, ...] = ("frame_idx",), every: float = EVERY, write: Callable[[DataFrame, int], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self.order, self.write, self.limited = order, write, Limited(show, every, clock)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        newest = batch.orderBy(*(F.desc(c) for c in self.order)).limit(1).collect()
        if newest:
            self.limited.offer(newest[0])
        if self.write is not None:
            self.write(batch, batch_id)

    def close(self) -> None:
        self.limited.close()
