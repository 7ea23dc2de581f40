"""Raw model outputs to boxes, as Column expressions over float arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchors(df: DataFrame, tensor: str, n: int, score_row: int, conf: float) -> DataFrame:
    """Anchor-major output: attribute k of anchor c stands at k * n + c. Rows (.., anchor, score, x1, y1, x2, y2)
    of the anchors whose score reaches conf; only their numbers are read further."""
    t = F.col(tensor)
    at = lambda k, c: F.get(t, F.lit(k * n) + c).cast("double")
    hits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: at(score_row, c) >= conf)
    rows = df.withColumn("anchor", F.explode(hits))
    cx, cy, w, h = (at(k, F.col("anchor")) for k in range(4))
    return rows.select(*(c for c in df.columns if c != tensor), "anchor", at(score_row, F.col("anchor")).alias("score"), (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def finished(df: DataFrame, tensor: str, stride: int, conf: float) -> DataFrame:
    """Outputs with a box, score and class in each stride of numbers: class 0 at conf or over."""
    t = F.col(tensor)
    rows = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.size(t) / stride).cast("int") - 1)))
    at = lambda i: F.get(t, F.col("k") * stride + i).cast("double")
    rows = rows.select(*(c for c in df.columns if c != tensor), "k", *(at(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "score", "cls"))))
    return rows.where((F.col("cls") == 0) & (F.col("score") >= conf)).drop("cls")


def grid_face(cls: Column, obj: Column, dx: Column, dy: Column, dw: Column, dh: Column, col: Column, row: Column, stride: int) -> dict[str, Column]:
    """A face of one grid cell: score from class and objectness, centre from the cell, size by exponents."""
    one = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    cx, cy, w, h = (col + dx) * stride, (row + dy) * stride, F.exp(dw) * stride, F.exp(dh) * stride
    return {"score": F.sqrt(one(cls) * one(obj)), "x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


# Grids of priors, as steps in pixels and the sides of the two boxes of each cell.
PRIORS = ((8, (16, 32)), (16, (64, 128)), (32, (256, 512)))


def priors_of(images: DataFrame, grids=PRIORS) -> DataFrame:
    """images (w, h, ...) with a row for each prior box: step, row, col, size, and cx, cy, pw, ph relative to the image."""
    w, h = F.col("w"), F.col("h")
    kinds = F.explode(F.array(*(F.struct(F.lit(step).alias("step"), F.lit(size).alias("size")) for step, sizes in grids for size in sizes)))
    k = images.withColumn("_g", kinds).withColumn("step", F.col("_g.step")).withColumn("size", F.col("_g.size")).drop("_g")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(n / F.col("step")).cast("int") - 1))
    k = k.withColumn("row", cells(h)).withColumn("col", cells(w))
    at = lambda c, n: (F.col(c) + 0.5) * F.col("step") / n
    return k.select("*", at("col", w).alias("cx"), at("row", h).alias("cy"), (F.col("size") / w.cast("double")).alias("pw"), (F.col("size") / h.cast("double")).alias("ph"))


def with_variance(cx, cy, pw, ph, dx, dy, dw, dh, center: float = 0.1, size: float = 0.2) -> tuple[Column, ...]:
    """A prior moved and scaled by a model's offsets: x1, y1, x2, y2, relative."""
    x, y, w, h = cx + dx * center * pw, cy + dy * center * ph, pw * F.exp(dw * size), ph * F.exp(dh * size)
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def gathered(out: Column, n_in: Column, n_out: Column) -> Column:
    """Index of the source cell of an output cell in nearest resampling: whole-number scaling."""
    return F.floor(out * n_in / n_out).cast("int")
