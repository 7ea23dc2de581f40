"""Tracking over a stream: each video's tracker is keyed state that leaves with its video.

State is a packed tracker and the number of its last frame. A video's end (a row whose `ended` is true) clears it at
once; with idle_ms, a timer clears that of a video from which nothing came for so long. Frames at or before the last
one seen are passed over, so a source that repeats some after a restart changes nothing. A stream may begin warm, from
trackers that operators.track.states() took at some frame of each video, or cold.

Many small videos are dealt to lanes: the state of a lane is that of its videos, which are advanced side by side."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.groups import matrix
from ..functions.shared import shared_dir, spread
from ..operators.track import INPUT, NAMES, SCHEMA, Tracker, advance_videos, marked_rows

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows as bytes, so that a video's rows come to its state as one value and leave it as one.
_IN = np.dtype([("frame", "<i8"), ("det", "<i8"), ("cols", "<f8", 8)])
_OUT = np.dtype([(c.split()[0], "<i4" if c.endswith("int") else "<f8" if c.endswith("double") else "<i8") for c in SCHEMA.split(", ")])
#: Rows in one value that leaves.
_MOST = 1 << 16


def _packed(rows: DataFrame) -> DataFrame:
    """(video_id, rows, ended): the columns of INPUT, a value for each video of an Arrow batch."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            made = np.empty(b.num_rows, _IN)
            made["frame"], made["det"] = b.column(1).to_numpy(), b.column(2).fill_null(0).to_numpy()
            made["cols"] = matrix(b, *INPUT[2:])
            made["cols"][:, 0] = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            made, ids, ended = made[order], ids[order], b.column(10).fill_null(False).to_numpy(zero_copy_only=False)[order]
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            raw, edges = made.tobytes(), (np.append(starts, len(ids)) * _IN.itemsize).tolist()
            values = [raw[a:z] for a, z in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts], pa.int64()), pa.array(values, pa.binary()), pa.array(np.logical_or.reduceat(ended, starts) if len(ids) else ended, pa.bool_())], names=["video_id", "rows", "ended"])

    return rows.mapInArrow(run, "video_id long, rows binary, ended boolean")


def _unpacked(values: DataFrame) -> DataFrame:
    """SCHEMA of (tracks)."""

    def run(batches):
        for b in batches:
            got = np.frombuffer(b"".join(b.column(0).to_pylist()), _OUT)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[c])) for c in NAMES], names=NAMES)

    return values.mapInArrow(run, SCHEMA)


def _advanced(rows: pd.DataFrame, known: dict[int, tuple[int, Tracker]], options: dict) -> list[np.ndarray]:
    """Columns of SCHEMA, or none, of packed rows of some videos, whose last frames and trackers are those known, and are known after it."""
    values = rows["rows"].tolist()
    sizes = np.array([len(x) for x in values], np.int64) // _IN.itemsize
    new, ids = np.frombuffer(b"".join(values), _IN), np.repeat(rows["video_id"].to_numpy(np.int64), sizes)
    videos, of = np.unique(ids, return_inverse=True)
    last = np.array([known[v][0] if v in known else -(1 << 62) for v in videos.tolist()], np.int64)
    at = np.flatnonzero(new["frame"] > last[of]) if len(ids) else of
    at = at[np.lexsort((new["det"][at], new["cols"][at, 0], new["frame"][at], of[at]))]
    if not len(at):
        return []
    new, ids = new[at], ids[at]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    own = ids[starts].tolist()
    trackers = [known[v][1] if v in known else Tracker(**options) for v in own]
    got = advance_videos(trackers, ids[starts], starts, new["frame"], new["det"], new["cols"])
    known.update(zip(own, zip(new["frame"][np.append(starts[1:], len(ids)) - 1].tolist(), trackers)))
    return got


class VideoTracker(StatefulProcessor):
    """One video's rows of a micro-batch through its tracker."""

    def __init__(self, idle_ms: int | None = None, **options):
        self.idle_ms, self.options = idle_ms, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "frame long, tracker binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows, known = pd.concat(rows), {}
        if (had := self.state.get()) is not None:
            known[key[0]] = had[0], Tracker.unpack(bytes(had[1]), **self.options)
        if got := _advanced(rows, known, self.options):
            out = np.empty(len(got[0]), _OUT)
            for c, x in zip(NAMES, got):
                out[c] = x
            yield pd.DataFrame({"tracks": [out[i : i + _MOST].tobytes() for i in range(0, len(out), _MOST)]})
        if rows["ended"].any():
            self._leave()
            return
        last, tracker = known.get(key[0]) or (-(1 << 62), Tracker(**self.options))
        self.state.update((last, tracker.pack()))
        if self.idle_ms is not None:
            self._stop_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        first = initialState.iloc[0]
        self.state.update((int(first["frame_idx"]), bytes(first["tracker"])))

    def _leave(self) -> None:
        if self.state.exists():
            self.state.clear()
        self._stop_timers()

    def _stop_timers(self) -> None:
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def close(self) -> None:
        pass


class LaneTracker(VideoTracker):
    """Several videos' rows of a micro-batch through their trackers, side by side. The state of a lane is one value: a
    row (video, last frame, time of its last rows, bytes) for each video, and their trackers one after the other."""

    _ROW = np.dtype([("video", "<i8"), ("frame", "<i8"), ("at", "<i8"), ("size", "<i8")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "videos binary, trackers binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows, packed = pd.concat(rows), self._read()
        ids = set(rows["video_id"].tolist())
        known = {v: (packed[v][0], Tracker.unpack(packed[v][2], **self.options)) for v in ids & packed.keys()}
        if got := _advanced(rows, known, self.options):
            yield pd.DataFrame(dict(zip(NAMES, got)), copy=False)
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        for v in ids:
            last, tracker = known.get(v) or (-(1 << 62), Tracker(**self.options))
            packed[v] = last, now, tracker
        for v in set(rows["video_id"][rows["ended"]].tolist()):
            del packed[v]
        self._write({v: (last, at, t.pack() if isinstance(t, Tracker) else t) for v, (last, at, t) in packed.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        self._write({v: x for v, x in self._read().items() if x[1] + self.idle_ms > now})
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        begun = zip(initialState["video_id"].tolist(), initialState["frame_idx"].tolist(), initialState["tracker"].tolist())
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        self._write({**self._read(), **{v: (f, now, bytes(t)) for v, f, t in begun}})

    def _read(self) -> dict[int, tuple[int, int, bytes]]:
        if (had := self.state.get()) is None:
            return {}
        rows, raw = np.frombuffer(bytes(had[0]), self._ROW), bytes(had[1])
        ends = np.cumsum(rows["size"]).tolist()
        return {v: (f, at, raw[z - n : z]) for (v, f, at, n), z in zip(rows.tolist(), ends)}

    def _write(self, packed: dict[int, tuple[int, int, bytes]]) -> None:
        if not packed:
            self._leave()
            return
        rows = np.array([(v, f, at, len(raw)) for v, (f, at, raw) in packed.items()], self._ROW)
        self.state.update((rows.tobytes(), b"".join(raw for _, _, raw in packed.values())))
        if self.idle_ms is not None:
            self._stop_timers()
            self.handle.registerTimer(int(rows["at"].min()) + self.idle_ms)


def track_stream(frames: DataFrame, start: DataFrame | None = None, idle_ms: int | None = None, lanes: int | None = None, **options) -> DataFrame:
    """Tracks (SCHEMA) of a streaming DataFrame (video_id, frame_idx, det_id, score, x1, y1, x2, y2, dx, dy and, if it has
    one, ended). start: (video_id, frame_idx, tracker) of trackers to go on with. lanes: how many lanes the videos are
    dealt to, the same for all runs on a checkpoint; without, each video is its own. A lane's rows of a micro-batch and
    its videos' trackers are held at a time: SIDE videos a lane are enough for most of the gain.

    A micro-batch must hold whole frames, and a video's frames must arrive in order. The session's state store must be
    the one that keeps timers (use_timed_state)."""
    rows = frames if "ended" in frames.columns else frames.withColumn("ended", F.lit(False))
    mode = "none" if idle_ms is None else "processingTime"
    grouped = lambda df: df.withColumn("lane", F.pmod(F.xxhash64("video_id"), F.lit(lanes))).groupBy("lane") if lanes else df.groupBy("video_id")
    begun = grouped(start.select("video_id", "frame_idx", "tracker")) if start is not None else None
    packed = grouped(_packed(rows.select(*INPUT, "ended")))
    if lanes:
        return packed.transformWithStateInPandas(LaneTracker(idle_ms, **options), SCHEMA, "append", mode, begun)
    return _unpacked(packed.transformWithStateInPandas(VideoTracker(idle_ms, **options), "tracks binary", "append", mode, begun))


#: Videos that are advanced side by side.
SIDE = 16


def use_timed_state(spark: SparkSession) -> None:
    """Streams begun from now on keep their state where timers are known; timers fire in batches with data, since a run
    over what is available would else go on for their sake for ever."""
    spark.conf.set(_STORE, _ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def stream_once(detections: DataFrame, frames: DataFrame, motion: DataFrame | None = None, parts: int = 4, base: str | None = None, **options) -> DataFrame:
    """Batch rows as a stream in frame order that is stopped and taken up again from its checkpoint `parts` times; the
    result as a table. A video ends with its last frame. base: a new folder for input, output and state."""
    spark: SparkSession = detections.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    use_timed_state(spark)
    # rows stand by video: the windows move none
    named = spread(frames.select("video_id", "frame_idx"), "video_id").withColumn("ended", F.col("frame_idx") == F.max("frame_idx").over(Window.partitionBy("video_id")))
    rows = marked_rows(detections, named, motion, ("ended",)).withColumn("_named", F.max(F.col("det_id").isNull()).over(Window.partitionBy("video_id", "frame_idx"))).where("_named").drop("_named")
    first, last, n_videos = frames.agg(F.min("frame_idx"), F.max("frame_idx"), F.approx_count_distinct("video_id")).first()
    # lanes of few videos, but enough for all tasks
    lanes = max(1, -(-n_videos // SIDE), min(n_videos, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    step = max(1, -(-((last or 0) - (first or 0) + 1) // parts))
    schema = rows.schema
    for k in range(parts):
        rows.where(F.floor((F.col("frame_idx") - F.lit(first)) / step) == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        query = track_stream(stream, lanes=lanes, **options).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{base}/out")
