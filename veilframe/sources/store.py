"""Stored masks, edits, jobs and model lists, and the sinks of reports: tables in a shared folder.

Masks and edits are append-only Parquet, written by Spark's own commit protocol, so a failed write leaves nothing
behind. Of several writes for a frame the latest counts; undoing a frame's edits is one more row. compact() writes
what counts into a new folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.runs import Masks
from ..functions.shared import shuffled
from ..operators import masks as mask_ops

MASKS = "frame_idx long, written long, w int, h int, data binary"
EDITS = "seq long, frame_idx long, op string, w int, h int, data binary"
#: Frames a folder of the mask store; scans of a range of frames read only its folders.
FOLDER_FRAMES = 10_000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def save_masks(masks: DataFrame, path: str, written: int) -> None:
    """Append masks (frame_idx, w, h, data: runs in their byte form); a larger `written` replaces earlier ones."""
    rows = masks.select("frame_idx", F.lit(written).cast("long").alias("written"), "w", "h", "data")
    rows.withColumn("folder", F.floor(F.col("frame_idx") / FOLDER_FRAMES)).write.mode("append").partitionBy("folder").parquet(path)


def stored_masks(spark: SparkSession, path: str) -> DataFrame:
    """The latest mask of each frame (frame_idx, w, h, data)."""
    rows = _read(spark, path, MASKS + ", folder long")
    last = rows.groupBy("folder", "frame_idx").agg(F.max(F.struct("written", "w", "h", "data")).alias("m"))
    return last.select("frame_idx", "m.w", "m.h", "m.data")


def load_masks(frames: DataFrame, path: str, w: int, h: int) -> DataFrame:
    """frames (frame_idx) with w, h, spans (null where there is no mask) and state: 'ok', 'missing', 'corrupt', or
    'size' where the mask is one of another frame size."""
    stored = stored_masks(frames.sparkSession, path)
    m = mask_ops.from_files(stored).select("frame_idx", F.col("w").alias("_w"), F.col("h").alias("_h"), F.col("spans").alias("_spans"), "whole")
    state = F.when(F.col("whole").isNull(), "missing").when((F.col("_w") != w) | (F.col("_h") != h), "size").when(~F.col("whole"), "corrupt").otherwise("ok")
    out = frames.join(shuffled(m), "frame_idx", "left").withColumn("state", state)
    return out.withColumns({"w": F.lit(w), "h": F.lit(h), "spans": F.when(F.col("state") == "ok", F.col("_spans"))}).drop("_w", "_h", "_spans", "whole")


# instances and what a store is of

INSTANCES = "frame_idx long, written long, w int, h int, instance_id long, kind int, score double, x1 double, y1 double, x2 double, y2 double, spans array<int>"
META = "written long, w int, h int, fps double, total_frames long"


def save_instances(frames: DataFrame, instances: DataFrame, path: str, written: int, w: int, h: int) -> None:
    """Append each frame's instances (frame_idx, instance_id, kind, score, box, spans); a larger `written` replaces a
    frame's earlier ones. frames (frame_idx) names those that were looked at: one without instances is stored as such."""
    cols = ("instance_id", "kind", "score", "x1", "y1", "x2", "y2", "spans")
    rows = frames.select("frame_idx").distinct().join(shuffled(instances.select("frame_idx", *cols)), "frame_idx", "left")
    typed = rows.select("frame_idx", F.lit(written).cast("long").alias("written"), F.lit(w).alias("w"), F.lit(h).alias("h"), *cols)
    typed.withColumn("folder", F.floor(F.col("frame_idx") / FOLDER_FRAMES)).write.mode("append").partitionBy("folder").parquet(path)


def load_instances(frames: DataFrame, path: str, w: int, h: int) -> DataFrame:
    """frames (frame_idx) with state ('ok', 'missing', or 'size' where they are of another frame size) and instances, an
    array in order of instance_id; null unless ok. A frame's instances lie in one folder and are few."""
    rows = _read(frames.sparkSession, path, INSTANCES + ", folder long")
    one = F.struct("instance_id", "kind", "score", "x1", "y1", "x2", "y2", "spans")
    per = rows.groupBy("folder", "frame_idx", "written").agg(F.max("w").alias("_w"), F.max("h").alias("_h"), F.sort_array(F.collect_list(F.when(F.col("instance_id").isNotNull(), one))).alias("instances"))
    last = per.groupBy("folder", "frame_idx").agg(F.max_by(F.struct("_w", "_h", "instances"), "written").alias("m")).select("frame_idx", "m.*", F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when((F.col("_w") != w) | (F.col("_h") != h), "size").otherwise("ok")
    out = frames.join(shuffled(last), "frame_idx", "left").withColumn("state", state)
    return out.withColumn("instances", F.when(F.col("state") == "ok", F.col("instances"))).drop("_w", "_h", "_there")


def instance_image(loaded: DataFrame, w: int, h: int) -> DataFrame:
    """(frame_idx, instance_id, w, h, spans): of each frame of load_instances() the pixels that show each instance, the
    later of two above the earlier: an image of numbers as runs."""

    def run(batches):
        for b in batches:
            keys, ids, parts = [], [], []
            for k, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                above = None
                for x in reversed(found or []):
                    m = Masks.read(pa.array([x["spans"]], pa.list_(pa.int32())), [w], [h])
                    keys.append(k)
                    ids.append(x["instance_id"])
                    parts.append(m if above is None else m.minus(above))
                    above = m if above is None else above.union(m)
            side = lambda v: pa.array([v] * len(keys), pa.int32())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), side(w), side(h), Masks.joined(parts).write() if parts else pa.array([], pa.list_(pa.int32()))], names=["frame_idx", "instance_id", "w", "h", "spans"])

    return loaded.select("frame_idx", "instances").mapInArrow(run, "frame_idx long, instance_id long, w int, h int, spans array<int>")


def save_meta(spark: SparkSession, path: str, written: int, w: int, h: int, fps: float, total_frames: int) -> None:
    """What a store is of; a larger `written` replaces it."""
    spark.createDataFrame([(written, w, h, float(fps), total_frames)], META).coalesce(1).write.mode("append").parquet(path)


class MetaMismatch(ValueError):
    """A store of another video than the one at hand."""


def check_meta(spark: SparkSession, path: str, w: int, h: int, total_frames: int | None = None) -> dict | None:
    """The store's meta, or None where there is none; another frame size or number of frames is an error that names both."""
    found = _read(spark, path, META).orderBy(F.desc("written")).limit(1).collect()
    if not found:
        return None
    m = found[0].asDict()
    if (m["w"], m["h"]) != (w, h):
        raise MetaMismatch(f"stored for {m['w']} x {m['h']}, not {w} x {h}")
    if total_frames is not None and m["total_frames"] != total_frames:
        raise MetaMismatch(f"stored for {m['total_frames']} frames, not {total_frames}")
    return m


def analyzed_frames(spark: SparkSession, path: str) -> int:
    """The largest stored frame + 1: where an analysis goes on."""
    last = _read(spark, path, MASKS).agg(F.max("frame_idx")).first()[0]
    return 0 if last is None else int(last) + 1


def append_edits(edits: DataFrame, path: str) -> None:
    """Append edits (seq, frame_idx, op 'add' or 'erase', w, h, spans), as run lengths in their file form."""
    op = F.when(F.col("op") == "add", 1).otherwise(0).cast("long").alias("op")
    rows = mask_ops.to_files(edits.select("seq", "frame_idx", op, "w", "h", "spans"), ("seq", "frame_idx", "op"))
    _write_edits(rows.withColumn("op", F.when(F.col("op") == 1, "add").otherwise("erase")), path)


def _write_edits(rows: DataFrame, path: str) -> None:
    rows.select("seq", "frame_idx", "op", "w", "h", "data").write.mode("append").parquet(path)


def clear_frame(spark: SparkSession, path: str, frame_idx: int, seq: int) -> None:
    """Undo every edit of a frame up to seq."""
    _write_edits(spark.createDataFrame([(seq, frame_idx, "clear", None, None, None)], EDITS), path)


def _kept_edits(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark, path, EDITS)
    cleared = rows.where("op = 'clear'").groupBy("frame_idx").agg(F.max("seq").alias("_clear"))
    return rows.where("op <> 'clear'").join(cleared, "frame_idx", "left").where(F.col("_clear").isNull() | (F.col("seq") > F.col("_clear"))).drop("_clear")


def stored_edits(spark: SparkSession, path: str) -> DataFrame:
    """Edits that count, in the columns that masks.replay() reads; spoiled ones are passed over."""
    add = F.when(F.col("op") == "add", 1).otherwise(0).cast("long").alias("op")
    read = mask_ops.from_files(_kept_edits(spark, path).select("seq", "frame_idx", add, "w", "h", "data"), ("seq", "frame_idx", "op"))
    return read.where("whole").select("seq", "frame_idx", F.when(F.col("op") == 1, "add").otherwise("erase").alias("op"), "w", "h", "spans")


def compact(spark: SparkSession, masks: str, edits: str, into: str) -> None:
    """What counts of a mask store and an edit log, in new folders into/masks and into/edits."""
    save_masks(stored_masks(spark, masks), f"{into}/masks", 0)
    _write_edits(_kept_edits(spark, edits), f"{into}/edits")


def in_order(results: DataFrame, stream: str = "video_id", at: str = "frame_idx") -> DataFrame:
    """Results that came out of order, with `ready`: no frame before them is missing, from each stream's first frame 0 on."""
    w = Window.partitionBy(stream).orderBy(at)
    return results.withColumn("ready", F.col(at) == F.row_number().over(w) - 1)


# queue and models


def save_pending(jobs: DataFrame, path: str) -> None:
    """Jobs that wait, as JSON; others are done with, or begin anew."""
    jobs.where("state = 'pending'").drop("state").write.mode("overwrite").json(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """(name, file, sha256, bytes) of a JSON list of models {"models": [...]}."""
    entry = "struct<name:string,file:string,sha256:string,bytes:bigint>"
    j = spark.read.schema(f"models array<{entry}>").option("multiLine", True).json(path)
    return j.select(F.explode("models").alias("m")).select("m.*")


def readiness(models: DataFrame, found: DataFrame) -> DataFrame:
    """One row: listed models, how many are found whole (file, bytes), and bytes of all and of those."""
    f = found.groupBy("file").agg(F.max("bytes").alias("_have"))
    m = models.join(f, "file", "left").withColumn("_ok", F.col("_have") == F.col("bytes"))
    return m.agg(F.count(F.lit(1)).alias("models"), F.count_if("_ok").alias("ready"), F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("bytes"))), F.lit(0)).alias("ready_bytes"))


# reports

REPORT_FORMATS = {"fps": "%.2f", "mean_persons": "%.3f", "mean_faces": "%.3f", "mask_cov_pct": "%.3f", "held_pct": "%.2f"}


def report_rows(rows: DataFrame) -> DataFrame:
    """A sweep's rows (label and the numbers of REPORT_FORMATS) as text of fixed places."""
    return rows.select("label", *(F.format_string(f, F.col(c).cast("double")).alias(c) for c, f in REPORT_FORMATS.items()))


def write_sweep(rows: DataFrame, path: str) -> None:
    """path/csv with a header and labels in quotes, and path/json with numbers as they are."""
    report_rows(rows).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(f"{path}/csv")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/json")


class SinkFailed(Exception):
    """A sink could not take the rows; the next candidate may."""


def write_first(rows: DataFrame, sinks: list[tuple[str, Callable[[DataFrame], None]]]) -> str:
    """The name of the first sink that takes the rows. Only SinkFailed falls through; any other error is the job's own."""
    failed = []
    for name, write in sinks:
        try:
            write(rows)
            return name
        except SinkFailed as e:
            failed.append(f"{name}: {e}")
    raise SinkFailed("; ".join(failed) or "no sink")


def progress_of(done: DataFrame, total: int, every_ms: int = 250) -> DataFrame:
    """Ticks of a run (done: at_ms, frames so far): the last state of each quarter of a second, and the last one of all."""
    last = done.groupBy(F.floor(F.col("at_ms") / every_ms).alias("tick")).agg(F.max(F.struct("at_ms", "frames")).alias("m"))
    return last.select("tick", "m.at_ms", "m.frames", F.round(F.col("m.frames") * 100.0 / max(total, 1), 3).alias("pct"), (F.col("m.frames") >= total).alias("final"))
