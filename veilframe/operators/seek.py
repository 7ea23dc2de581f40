"""The frame shown at a time: an as-of lookup of many times in many videos, with a second try a little earlier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of film that are sorted together; how much earlier a second try is made.
STRETCH_MS, EARLIER_MS = 10_000, 250.0


def clamped(at: Column, end: Column, frame_ms: float) -> Column:
    """A time within a clip less a frame and a half at its end, not before its start."""
    return F.greatest(F.least(at, end - 1.5 * frame_ms), F.lit(0.0))


def as_of(frames: DataFrame, asks: DataFrame, value: str, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """asks (keys, t_ms, ...) with `value` of the last of frames (keys, t_ms, value) at or before their time, of equal
    times the largest value; null where there is none.

    Times and frames meet in the stretch of film they fall in, sorted by time; where no frame of it comes before, the
    last one of earlier stretches holds. A window's rows are those of one stretch of one video, or one row a stretch of
    one video: no range join, and no video in one task."""
    stretch = F.floor(F.col("t_ms") / STRETCH_MS)
    f = frames.select(*keys, "t_ms", F.struct("t_ms", F.col(value).alias("v")).alias("_seen"))
    names = [c for c in asks.columns if c != value]
    last = f.groupBy(*keys, stretch.alias("_s")).agg(F.max("_seen").alias("_last"))
    wanted = asks.select(*keys, stretch.alias("_s")).distinct()
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.join(last, [*keys, "_s"], "full").select(*keys, "_s", F.max("_last").over(before).alias("_before"))
    kept = F.struct(*names)
    rows = f.select(*keys, "t_ms", "_seen", F.lit(None).cast(asks.select(kept.alias("a")).schema["a"].dataType).alias("_ask"))
    rows = rows.unionByName(asks.select(*keys, "t_ms", F.lit(None).cast(f.schema["_seen"].dataType).alias("_seen"), kept.alias("_ask"))).withColumn("_s", stretch)
    # frames before asks of the same time
    upto = Window.partitionBy(*keys, "_s").orderBy("t_ms", F.col("_ask").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_here", F.max("_seen").over(upto)).where("_ask IS NOT NULL").join(carried, [*keys, "_s"], "left")
    return seen.select("_ask.*", F.coalesce("_here", "_before").getField("v").alias(value))


def frames_at(frames: DataFrame, asks: DataFrame, fps: float, value: str = "frame_idx", good: str = "good", keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """asks (keys, at_ms, ...) with `value`, the frame to show, and tries (1 or 2): of frames (keys, t_ms, value, good)
    the one at the clamped time; where that cannot be read, the one EARLIER_MS before; null where neither can, or the
    video has no frame."""
    ends = frames.groupBy(*keys).agg(F.max("t_ms").alias("_end"))
    names = [c for c in asks.columns if c not in (value, "tries")]
    timed = asks.select(*names).join(ends, list(keys), "left").withColumn("t_ms", clamped(F.col("at_ms"), F.col("_end"), 1000.0 / fps)).drop("_end")
    shown = frames.select(*keys, "t_ms", F.struct(F.col(value).alias("f"), F.col(good).alias("g")).alias("_f"))
    first = as_of(shown, timed.where("t_ms IS NOT NULL"), "_f", keys)
    fine = F.coalesce(F.col("_f.g"), F.lit(False))
    out = first.where(fine).select(*names, F.col("_f.f").alias(value), F.lit(1).alias("tries"))
    again = as_of(shown, first.where(~fine).select(*names, F.greatest(F.col("t_ms") - EARLIER_MS, F.lit(0.0)).alias("t_ms")), "_f", keys)
    out = out.unionByName(again.select(*names, F.when(fine, F.col("_f.f")).alias(value), F.lit(2).alias("tries")))
    return out.unionByName(timed.where("t_ms IS NULL").select(*names, F.lit(None).cast(frames.schema[value].dataType).alias(value), F.lit(2).alias("tries")))
