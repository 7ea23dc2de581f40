"""Joins and filters between faces and persons of a frame. All carry the frame as an equi key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, holds_center, iou
from ..functions.shared import shuffled

_BOX = ("x1", "y1", "x2", "y2")


def _as(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("frame_idx", *(F.col(n).alias(prefix + n) for n in ("det_id", *_BOX, *more)))


def gate(faces: DataFrame, persons: DataFrame, alone: float) -> DataFrame:
    """Faces that score `alone` by themselves, or whose centre lies in a person widened by 8 %."""
    p = _as(persons, "p_").alias("p")
    f = faces.alias("f")
    inside = f.join(shuffled(p), (F.col("f.frame_idx") == F.col("p.frame_idx")) & holds_center(box("p_"), tuple(F.col("f." + n) for n in _BOX), 0.08) & (F.col("f.score") < alone), "left_semi")
    return faces.where(F.col("score") >= alone).unionByName(inside.where(F.col("score") < alone))


def hosts(faces: DataFrame, persons: DataFrame, margin: float, how: str = "left", *more: str) -> DataFrame:
    """Each face with the first person (smallest det_id) whose box, widened, holds its centre."""
    p = _as(persons, "p_", *more)
    first = faces.join(shuffled(p), "frame_idx").where(holds_center(box("p_"), box(), margin)).groupBy("frame_idx", "det_id").agg(F.min(F.struct(*(c for c in p.columns if c != "frame_idx"))).alias("host"))
    return faces.join(shuffled(first), ["frame_idx", "det_id"], how)


def plausible(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces about as wide as high and, in their first host person, at most half as high as it."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    shaped = faces.where((w > 0) & (h > 0) & (w / h).between(0.5, 1.8))
    host_h = F.col("host.p_y2") - F.col("host.p_y1")
    return hosts(shaped, persons, 0.0).where(F.col("host").isNull() | (host_h <= 0) | (h / host_h <= 0.5)).drop("host")


def best_overlap(left: DataFrame, right: DataFrame, min_iou: float) -> DataFrame:
    """Each left box with the best scored right box that it overlaps by more than min_iou; the later of equals."""
    r = _as(right, "r_", "score")
    pairs = left.join(shuffled(r), "frame_idx").withColumn("iou", iou(box(), box("r_"))).where(F.col("iou") > min_iou)
    best = pairs.groupBy("frame_idx", "det_id").agg(F.max(F.struct("r_score", "r_det_id", "iou")).alias("m"))
    return left.join(shuffled(best), ["frame_idx", "det_id"], "left")
