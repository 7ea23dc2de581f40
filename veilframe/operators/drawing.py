"""Marks on frames for review, feathered hiding, and polygons as masks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.runs import Masks
from .frames import nv12_to_rgba

# Colours of tracks by number, and what a tint makes of a pixel's channels (times, of, plus).
PALETTE = ((255, 76, 76), (76, 175, 255), (255, 165, 0), (156, 39, 176), (0, 230, 118), (255, 105, 180), (121, 85, 72), (240, 240, 60))
TINT = ((3, 4, 60), (1, 1, 90), (3, 4, 20))


def tinted(rgba: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """RGBA [h, w, 4] with the set pixels of a mask tinted green."""
    out = rgba.copy()
    on = mask != 0
    for k, (times, of, plus) in enumerate(TINT):
        out[on, k] = np.minimum(rgba[on, k].astype(np.int64) * times // of + plus, 255)
    return out


def bordered(rgba: np.ndarray, box: tuple[float, float, float, float], color: tuple[int, int, int], thick: int) -> np.ndarray:
    """RGBA with a box's border of so many pixels inwards, drawn in place; its last row and column are the box's own."""
    h, w = rgba.shape[:2]
    x1, y1 = (int(max(v, 0)) for v in box[:2])
    x2, y2 = min(int(max(box[2], 0)), w - 1), min(int(max(box[3], 0)), h - 1)
    if x2 >= x1 and y2 >= y1:
        part = rgba[y1 : y2 + 1, x1 : x2 + 1]
        edge = np.ones(part.shape[:2], bool)
        edge[thick : max(part.shape[0] - thick, thick), thick : max(part.shape[1] - thick, thick)] = False
        part[edge] = (*color, 255)
    return rgba


def annotated(frames: DataFrame, thick: int = 3) -> DataFrame:
    """frames (w, h, nv12, spans, boxes: array of struct track_id, x1, y1, x2, y2, ...) with rgba: the mask as a tint, and
    each box bordered in its track's colour, in order of the array. Null where the bytes don't fit the sides."""
    names = frames.columns
    at = {n: i for i, n in enumerate(names)}
    keep = [n for n in names if n != "rgba"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 16) for b in batches for i in range(0, b.num_rows, 16)):
            w, h = (np.nan_to_num(b.column(at[n]).to_numpy(zero_copy_only=False)).astype(np.int64) for n in ("w", "h"))
            m = Masks.read(b.column(at["spans"]), w, h)
            made = []
            for i, (raw, boxes) in enumerate(zip(b.column(at["nv12"]).to_pylist(), b.column(at["boxes"]).to_pylist())):
                if raw is None or not w[i] or len(raw) != w[i] * h[i] * 3 // 2:
                    made.append(None)
                    continue
                rgba = np.frombuffer(nv12_to_rgba(raw, int(w[i]), int(h[i])), np.uint8).reshape(int(h[i]), int(w[i]), 4)
                rgba = tinted(rgba, m.plane(i))
                for x in boxes or []:
                    bordered(rgba, (x["x1"], x["y1"], x["x2"], x["y2"]), PALETTE[x["track_id"] % len(PALETTE)], thick)
                made.append(rgba.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in keep), pa.array(made, pa.binary())], names=[*keep, "rgba"])

    return frames.mapInArrow(run, T.StructType([*(frames.schema[n] for n in keep), T.StructField("rgba", T.BinaryType())]))


def gauss(k: int) -> np.ndarray:
    """Weights of k places (odd), their deviation by the usual rule from k."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    x = np.arange(k) - (k - 1) / 2
    g = np.exp(-(x * x) / (2 * sigma * sigma))
    return g / g.sum()


def soft(plane: np.ndarray, k: int) -> np.ndarray:
    """A plane [h, w, ...] under a Gaussian of k x k places, one axis after the other; nothing lies outside the frame."""
    g, r = gauss(k), k // 2
    for axis in (1, 0):
        n = plane.shape[axis]
        wide = np.pad(plane.astype(np.float64), [(r, r) if a == axis else (0, 0) for a in range(plane.ndim)])
        plane = sum(g[i] * wide.take(np.arange(i, i + n), axis) for i in range(k))
    return plane


def feathered(picture: np.ndarray, mask: np.ndarray, style: str = "blur", strength: int = 35, feather: int = 0, color: float = 0.0) -> np.ndarray:
    """A picture [h, w] or [h, w, channels] with the set pixels of a mask hidden and, with feather, edges that fade over
    about so many pixels; as numbers that are not rounded. Only the mask's surroundings are worked on."""
    if style not in ("blur", "solid"):
        raise ValueError(f"no style {style!r}")
    out = picture.astype(np.float64)
    y, x = np.nonzero(mask)
    if not len(y):
        return out
    k, f = max(3, int(strength) | 1), max(3, 2 * feather + 1) if feather > 0 else 1
    reach = f // 2
    part = tuple(slice(max(int(v.min()) - reach, 0), min(int(v.max()) + reach + 1, n)) for v, n in zip((y, x), mask.shape))
    wide = tuple(slice(max(s.start - k // 2 - reach, 0), min(s.stop + k // 2 + reach, n)) for s, n in zip(part, mask.shape))
    inner = tuple(slice(s.start - v.start, s.stop - v.start) for s, v in zip(part, wide))
    alpha = soft(mask[wide] != 0, f)[inner] if feather > 0 else (mask[part] != 0).astype(np.float64)
    if picture.ndim == 3:
        alpha = alpha[..., None]
    over = soft(picture[wide], k)[inner] if style == "blur" else color
    out[part] = out[part] * (1 - alpha) + over * alpha
    return out


def feathered_bytes(picture: np.ndarray, mask: np.ndarray, **options) -> np.ndarray:
    """The same as bytes, cut off."""
    return np.clip(feathered(picture, mask, **options), 0, 255).astype(np.uint8)


def polygon(points: np.ndarray, w: int, h: int) -> Masks:
    """A polygon's mask (one) from its corners [n, 2] in order, by rows: between the crossings of a row and its edges,
    taken in pairs from the left, ends included. An edge holds its upper end and not its lower one."""
    none = np.zeros(0, np.int64)
    empty = Masks(np.array([w]), np.array([h]), none, none, none)
    if len(points) < 3:
        return empty
    a, b = np.asarray(points, float), np.roll(np.asarray(points, float), -1, axis=0)
    top, low = np.maximum(np.ceil(np.minimum(a[:, 1], b[:, 1])), 0).astype(int), np.minimum(np.ceil(np.maximum(a[:, 1], b[:, 1])), h).astype(int)
    n = np.maximum(low - top, 0)
    edge = np.repeat(np.arange(len(a)), n)
    y = np.repeat(top - (np.cumsum(n) - n), n) + np.arange(n.sum())
    x = a[edge, 0] + (y - a[edge, 1]) * (b[edge, 0] - a[edge, 0]) / (b[edge, 1] - a[edge, 1])
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    first, last = x[::2], x[1::2]
    return empty._of_rows(np.zeros(len(first), np.int64), y[::2], np.ceil(first).astype(np.int64), np.floor(last).astype(np.int64) + 1)


def polygons(rows: DataFrame, w: int, h: int) -> DataFrame:
    """rows (points: array of arrays x, y, ...) with w, h and spans."""
    names = [c for c in rows.columns if c not in ("w", "h", "spans")]
    at = [rows.columns.index(c) for c in names]
    points = rows.columns.index("points")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            made = Masks.joined([polygon(np.array(p or [], float).reshape(-1, 2), w, h) for p in b.column(points).to_pylist()])
            side = lambda v: pa.array([v] * b.num_rows, pa.int32())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in at), side(w), side(h), made.write()], names=[*names, "w", "h", "spans"])

    kinds = T.StructType([*(rows.schema[c] for c in names), T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType()), T.StructField("spans", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, kinds)
