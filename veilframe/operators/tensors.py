"""What models take and give: frames and crops as normalised tensors, tiles, faces with eyes out of raw outputs, and
masks back to frame size. Kernels are numpy over Arrow batches; boxes and tiles are columns.

Frames that are null or of a wrong size, and crops under eight pixels a side, give no tensor (null)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from .frames import planes
from .suppress import greedy

LEAST_CROP, LEAST_TILE = 8, 64

# Means and deviations that models were trained with, in red, green, blue, of values 0 to 1 or 0 to 255.
COLOUR_MEAN, COLOUR_DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
FACE_MEAN = (123.0, 117.0, 104.0)


@dataclass(frozen=True)
class Spec:
    """How a frame becomes a tensor. fit: 'letterbox' (into side x side, padded), 'stretch' (to side x side, or to
    `sides`), 'long' (longer side to `side`), 'same'; then (value / scale - mean) / deviation; blue first, if bgr."""

    fit: str
    side: int = 0
    sides: tuple[int, int] | None = None
    scale: float = 1.0
    mean: tuple[float, float, float] = (0.0, 0.0, 0.0)
    deviation: tuple[float, float, float] = (1.0, 1.0, 1.0)
    bgr: bool = False
    pad: float = 114.0


SPECS = {
    "boxes": Spec("letterbox", 640, scale=255.0),
    "faces": Spec("stretch", 640, bgr=True),
    "phrases": Spec("long", 800, scale=255.0, mean=COLOUR_MEAN, deviation=COLOUR_DEVIATION),
    "tiles": Spec("same", mean=FACE_MEAN, bgr=True),
    "segments": Spec("stretch", 1024, scale=255.0, mean=COLOUR_MEAN, deviation=COLOUR_DEVIATION),
    "looks": Spec("stretch", sides=(128, 256), scale=255.0, mean=COLOUR_MEAN, deviation=COLOUR_DEVIATION),
}


def resampled(nv12: bytes, w: int, h: int, out_w: int, out_h: int, step_x: float, step_y: float, flip: bool = False) -> np.ndarray:
    """Red, green and blue (0 to 255) [out_h, out_w, 3]: luma between its four neighbours, chroma of the nearest pixel,
    at pixel centres `step` source pixels apart."""
    y, uv = planes(nv12, w, h)

    def axis(n: int, step: float, size: int, mirror: bool):
        at = (np.arange(n, dtype=np.float32) + np.float32(0.5)) * np.float32(step) - np.float32(0.5)
        if mirror:
            at = np.float32(size - 1.0) - at
        low = np.maximum(np.floor(at), 0).astype(np.int64)
        return np.minimum(low, size - 1), np.minimum(low + 1, size - 1), np.clip(at - low, 0, 1), np.clip(((at + 0.5) * 0.5).astype(np.int64), 0, size // 2 - 1)

    x0, x1, fx, cx = axis(out_w, step_x, w, flip)
    y0, y1, fy, cy = axis(out_h, step_y, h, False)
    luma = y.astype(np.float32)
    rows = luma[y0] * (1 - fy)[:, None] + luma[y1] * fy[:, None]
    v = (rows[:, x0] * (1 - fx) + rows[:, x1] * fx - 16.0) * 1.1644
    u, w_ = (uv[np.ix_(cy, cx)][..., k].astype(np.float32) - 128.0 for k in (0, 1))
    return np.clip(np.stack([v + 1.5960 * w_, v - 0.3917 * u - 0.8130 * w_, v + 2.0172 * u], axis=-1), 0, 255)


def tensor(nv12: bytes, w: int, h: int, spec: Spec, flip: bool = False) -> np.ndarray:
    """[3, rows, columns] float32."""
    if spec.fit == "letterbox":
        scale = min(spec.side / w, spec.side / h)
        new_w, new_h = (max(1, int(np.floor(n * scale + 0.5))) for n in (w, h))
        out = np.full((spec.side, spec.side, 3), spec.pad, np.float32)
        px, py = (spec.side - new_w) // 2, (spec.side - new_h) // 2
        out[py : py + new_h, px : px + new_w] = resampled(nv12, w, h, new_w, new_h, 1 / scale, 1 / scale, flip)
    else:
        scale = spec.side / max(w, h) if spec.fit == "long" else 1.0
        new_w, new_h = spec.sides or ((spec.side, spec.side) if spec.fit == "stretch" else tuple(max(1, int(np.floor(n * scale + 0.5))) for n in (w, h)))
        out = resampled(nv12, w, h, new_w, new_h, w / new_w, h / new_h, flip)
    out = (out / spec.scale - np.array(spec.mean)) / np.array(spec.deviation)
    return np.ascontiguousarray(out[..., ::-1 if spec.bgr else 1].transpose(2, 0, 1).astype(np.float32))


def _map(df: DataFrame, name: str, kind: T.DataType, change) -> DataFrame:
    """df with a column made by change(row as a dict), row by row over Arrow batches."""
    names = df.columns
    made_of = pa.binary() if isinstance(kind, T.BinaryType) else pa.list_(pa.float32())

    def run(batches):
        for b in batches:
            made = [change({n: b.column(i)[k].as_py() for i, n in enumerate(names)}) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, made_of)], names=[*names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def _fits(r: dict) -> bool:
    return bool(r["nv12"] is not None and r["w"] and r["h"] and len(r["nv12"]) == r["w"] * r["h"] * 3 // 2)


def to_tensors(frames: DataFrame, spec: str | Spec, flip: bool = False) -> DataFrame:
    """frames (w, h, nv12, ...) with tensor (array of float, channel by channel)."""
    s = SPECS[spec] if isinstance(spec, str) else spec
    return _map(frames, "tensor", T.ArrayType(T.FloatType()), lambda r: tensor(r["nv12"], r["w"], r["h"], s, flip).ravel() if _fits(r) else None)


def crops(frames: DataFrame, rois: DataFrame, on: list[str], w: int, h: int, least: int = LEAST_CROP) -> DataFrame:
    """A row for each region (x1, y1, x2, y2 in frame pixels) of rois with its own nv12, w and h, and ox, oy, its
    place in the frame; regions under `least` pixels a side are left out."""
    ox, oy, cw, ch = G.crop_span(G.box(), w, h)
    r = rois.select(*on, *(c for c in rois.columns if c not in on), ox.alias("ox"), oy.alias("oy"), (cw - cw % 2).alias("_cw"), (ch - ch % 2).alias("_ch")).where((F.col("_cw") >= least) & (F.col("_ch") >= least))
    both = r.join(frames.select(*on, "w", "h", "nv12"), on)

    def cut(row: dict):
        return cropped(row["nv12"], row["w"], row["h"], row["ox"], row["oy"], row["_cw"], row["_ch"]) if _fits(row) else None

    made = _map(both, "crop", T.BinaryType(), cut)
    return made.select(*r.columns[: -2], F.col("_cw").cast("int").alias("w"), F.col("_ch").cast("int").alias("h"), F.col("crop").alias("nv12"))


def cropped(nv12: bytes, w: int, h: int, x: int, y: int, cw: int, ch: int) -> bytes:
    """The even-sided part of a frame at an even column x and a row y, as a frame of its own."""
    luma, uv = planes(nv12, w, h)
    rows = np.minimum(np.arange(y, y + ch), h - 1)
    return luma[rows][:, x : x + cw].tobytes() + uv[np.minimum(np.arange(ch // 2) + y // 2, len(uv) - 1)][:, x // 2 : (x + cw) // 2].tobytes()


def halved(nv12: bytes, w: int, h: int) -> tuple[bytes, int, int]:
    """Every second pixel of a frame: (nv12, w, h), sides even."""
    luma, uv = planes(nv12, w, h)
    hw, hh = w // 4 * 2, h // 4 * 2
    return luma[::2, ::2][:hh, :hw].tobytes() + uv[::2, ::2][: hh // 2, : hw // 2].tobytes(), hw, hh


def tiles(frames: DataFrame, tile: int = 1280, overlap: int = 320, least: int = LEAST_TILE) -> DataFrame:
    """A row for each tile (x1, y1, x2, y2) of each frame (w, h, ...), row by row, the last ones cut to the frame;
    tiles under `least` pixels a side are left out."""
    step = tile - overlap
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil((n - tile) / F.lit(float(step))), F.lit(0)).cast("int") * step, F.lit(step))
    t = frames.withColumn("y1", F.explode(starts(F.col("h")))).withColumn("x1", F.explode(starts(F.col("w"))))
    t = t.withColumn("x2", F.least(F.col("x1") + tile, "w")).withColumn("y2", F.least(F.col("y1") + tile, "h"))
    return t.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def back_to_frame(boxes: DataFrame, factor: float = 1.0) -> DataFrame:
    """Boxes found in a crop at (ox, oy), or in a frame scaled down by `factor`, in the whole frame's pixels."""
    at = {"x": F.coalesce(F.col("ox"), F.lit(0)) if "ox" in boxes.columns else F.lit(0), "y": F.coalesce(F.col("oy"), F.lit(0)) if "oy" in boxes.columns else F.lit(0)}
    return boxes.select(*(((F.col(c) * factor + at[c[0]]).alias(c)) if c in ("x1", "y1", "x2", "y2") else F.col(c) for c in boxes.columns))


def faces(df: DataFrame, out: str, n: int, conf: float, size: int, w: int, h: int, landmarks: bool = True, max_iou: float = 0.3, most: int = 300) -> DataFrame:
    """Faces (score, x1, y1, x2, y2, eyes: left and right point, or null) of anchor-major outputs over a letterboxed
    frame. Duplicates go in the model's own space, before boxes and eyes are mapped to the frame; eyes count where
    the model is at least half sure of both."""
    t = F.col(out)
    at = lambda k, c: F.get(t, F.lit(k * n) + c).cast("double")

    def one(c: Column) -> Column:
        cx, cy, bw, bh = (at(k, c) for k in range(4))
        if landmarks:
            sure = (at(7, c) >= 0.5) & (at(10, c) >= 0.5)
            eyes = F.when(sure, F.struct(at(5, c).alias("lx"), at(6, c).alias("ly"), at(8, c).alias("rx"), at(9, c).alias("ry")))
        else:
            eyes = F.lit(None).cast("struct<lx:double,ly:double,rx:double,ry:double>")
        return F.struct(c.alias("det_id"), at(4, c).alias("score"), (cx - bw * 0.5).alias("x1"), (cy - bh * 0.5).alias("y1"), (cx + bw * 0.5).alias("x2"), (cy + bh * 0.5).alias("y2"), eyes.alias("eyes"))

    found = F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: at(4, c) >= conf), one)
    ranked = F.array_sort(F.transform(found, lambda b: F.struct((-b["score"]).alias("_s"), *(b[c].alias(c) for c in ("det_id", "score", "x1", "y1", "x2", "y2", "eyes")))))
    rows = df.withColumn("_f", F.explode(greedy(ranked, max_iou, most)))
    p = G.letterbox(F.lit(w), F.lit(h), size)
    box = G.unletterbox(tuple(F.col("_f." + c) for c in ("x1", "y1", "x2", "y2")), p["scale"], p["pad_x"], p["pad_y"], w, h, F.lit(False))
    eye = lambda c, pad, last: G.clamp((F.col("_f.eyes." + c) - pad) / p["scale"], 0.0, float(last))
    eyes = F.when(F.col("_f.eyes").isNotNull(), F.struct(eye("lx", p["pad_x"], w).alias("lx"), eye("ly", p["pad_y"], h).alias("ly"), eye("rx", p["pad_x"], w).alias("rx"), eye("ry", p["pad_y"], h).alias("ry")))
    return rows.select(*(c for c in df.columns if c != out), F.col("_f.det_id").alias("det_id"), F.col("_f.score").alias("score"), *(b.alias(c) for c, b in zip(("x1", "y1", "x2", "y2"), box)), eyes.alias("eyes"))


def unletterboxed(mask: np.ndarray, w: int, h: int, flip: bool = False) -> np.ndarray:
    """A square mask of a letterboxed frame at frame size, by nearest pixels; mirrored back if it was found on a mirrored frame."""
    size = len(mask)
    scale = np.float32(min(size / w, size / h))
    new_w, new_h = (max(1, int(np.floor(n * float(scale) + 0.5))) for n in (w, h))
    ys = np.minimum((np.arange(h, dtype=np.float32) * scale).astype(int), new_h - 1) + (size - new_h) // 2
    xs = np.minimum((np.arange(w, dtype=np.float32) * scale).astype(int), new_w - 1) + (size - new_w) // 2
    out = (mask[np.ix_(ys, xs)] == 1).astype(np.uint8)
    return out[:, ::-1] if flip else out
