"""Whole frames as rows: NV12 bytes and a mask, worked on by numpy kernels over Arrow batches, without a shuffle.

A frame is (w, h, nv12 binary of w * h * 3 / 2 bytes, mask binary of w * h bytes, 0 or 1); w and h are even. A
batch is taken apart row by row, so a task holds one frame's planes at a time besides the batch itself. Frames
that are null, of a wrong size or without a masked pixel come back as they are. Other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.groups import pieces

#: Limited-range black, and chroma without colour.
BLACK_Y, NEUTRAL_UV = 16, 128
#: Bounds of a blur's radius, and the least side of a mosaic cell.
RADIUS, LEAST_CELL = (1, 64), 2


def planes(nv12: bytes, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Writable luma [h, w] and chroma [h / 2, w / 2, 2]."""
    a = np.frombuffer(nv12, np.uint8).copy()
    return a[: w * h].reshape(h, w), a[w * h :].reshape(h // 2, w // 2, 2)


def padded_box(mask: np.ndarray, pad: int) -> tuple[int, int, int, int] | None:
    """(x1, y1, x2, y2) around the masked pixels, pad wider and cut to the frame."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(ys):
        return None
    h, w = mask.shape
    return max(xs[0] - pad, 0), max(ys[0] - pad, 0), min(xs[-1] + 1 + pad, w), min(ys[-1] + 1 + pad, h)


def any_of_four(mask: np.ndarray) -> np.ndarray:
    """Chroma pixels of which any luma pixel is masked."""
    return mask[0::2, 0::2] | mask[1::2, 0::2] | mask[0::2, 1::2] | mask[1::2, 1::2]


def _half(box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    x1, y1, x2, y2 = box
    return x1 // 2, y1 // 2, (x2 + 1) // 2, (y2 + 1) // 2


def solid(y: np.ndarray, uv: np.ndarray, mask: np.ndarray) -> None:
    y[mask != 0] = BLACK_Y
    uv[any_of_four(mask) != 0] = NEUTRAL_UV


def block_means(plane: np.ndarray, box: tuple[int, int, int, int], cell: int) -> np.ndarray:
    """Whole-number means of cell x cell blocks from the box's corner, spread over the box."""
    x1, y1, x2, y2 = box
    part = plane[y1:y2, x1:x2].astype(np.uint32)
    rows, cols = np.arange(0, y2 - y1, cell), np.arange(0, x2 - x1, cell)
    total = np.add.reduceat(np.add.reduceat(part, rows, axis=0), cols, axis=1)
    high, wide = np.diff([*rows, y2 - y1]), np.diff([*cols, x2 - x1])
    n = (high[:, None] * wide).astype(np.uint32)
    mean = (total // (n[..., None] if part.ndim == 3 else n)).astype(np.uint8)
    return np.repeat(np.repeat(mean, high, axis=0), wide, axis=1)


def mosaic(y: np.ndarray, uv: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int], cell: int) -> None:
    for plane, hit, b, side in ((y, mask, box, cell), (uv, any_of_four(mask), _half(box), max(cell // 2, 1))):
        x1, y1, x2, y2 = b
        at = hit[y1:y2, x1:x2] != 0
        plane[y1:y2, x1:x2][at] = block_means(plane, b, side)[at]


def box_means(plane: np.ndarray, box: tuple[int, int, int, int], r: int) -> np.ndarray:
    """Whole-number means of windows 2 r + 1 along rows, then columns. Samples left of the box are the plane's own;
    those past its right, upper and lower edges repeat the edge."""
    x1, y1, x2, y2 = box
    win = 2 * r + 1

    def slide(a: np.ndarray) -> np.ndarray:
        total = np.cumsum(a, axis=1, dtype=np.uint32)
        return np.concatenate([total[:, win - 1 : win], total[:, win:] - total[:, :-win]], axis=1) // win

    rows = slide(plane[y1:y2][:, np.clip(np.arange(x1 - r, x2 + r), 0, x2 - 1)])
    height = y2 - y1
    return slide(rows[np.clip(np.arange(-r, height + r), 0, height - 1)].T).T.astype(np.uint8)


def blur(y: np.ndarray, uv: np.ndarray, mask: np.ndarray, box: tuple[int, int, int, int], radius: int, as_bytes: bool = False) -> None:
    """Masked pixels take box means. as_bytes treats the chroma plane as one of single bytes, at chroma places, as
    some encoders' filters do; else U and V are blurred apart."""
    x1, y1, x2, y2 = box
    at = mask[y1:y2, x1:x2] != 0
    y[y1:y2, x1:x2][at] = box_means(y, box, radius)[at]
    half, r = _half(box), (radius + 1) // 2
    x1, y1, x2, y2 = half
    at = mask[::2, ::2][y1:y2, x1:x2] != 0
    for p in [uv.reshape(len(uv), -1)] if as_bytes else [uv[..., 0], uv[..., 1]]:
        p[y1:y2, x1:x2][at] = box_means(p, half, r)[at]


def hide(nv12: bytes, mask: bytes, w: int, h: int, style: str, size: int = 0, as_bytes: bool = False) -> bytes:
    """One frame with its masked pixels hidden: style 'mosaic' (size: cell), 'blur' (size: radius) or 'solid'."""
    m = np.frombuffer(mask, np.uint8).reshape(h, w)
    pad = {"mosaic": size, "blur": size * 3, "solid": 0}[style]
    box = padded_box(m, pad)
    if box is None:
        return nv12
    y, uv = planes(nv12, w, h)
    if style == "solid":
        solid(y, uv, m)
    elif style == "mosaic":
        mosaic(y, uv, m, box, max(size, LEAST_CELL))
    else:
        blur(y, uv, m, box, min(max(size, RADIUS[0]), RADIUS[1]), as_bytes)
    return y.base.tobytes()


def each(frames: DataFrame, change, out: str = "nv12") -> DataFrame:
    """frames with column out (binary) made by change(nv12, mask, w, h), a function of one frame: bytes or None."""
    names = frames.columns
    keep = [n for n in names if n != out]

    def run(batches):
        for b in pieces(batches):
            col = {n: b.column(i) for i, n in enumerate(names)}
            new = []
            for i in range(b.num_rows):
                nv12, w, h = (col[n][i].as_py() for n in ("nv12", "w", "h"))
                mask = col["mask"][i].as_py() if "mask" in col else None
                fits = nv12 is not None and w and h and len(nv12) == w * h * 3 // 2 and (mask is None or len(mask) == w * h)
                new.append(change(nv12, mask, w, h) if fits else nv12 if out == "nv12" else None)
            yield pa.RecordBatch.from_arrays([*(col[n] for n in keep), pa.array(new, pa.binary())], names=[*keep, out])

    schema = frames.select(*keep).schema.add(out, "binary")
    return frames.mapInArrow(run, schema)


def apply(frames: DataFrame, style: str, size: int = 0, as_bytes: bool = False) -> DataFrame:
    """frames (w, h, nv12, mask, ...) with nv12 hidden by the style, whose pad it takes: the cell of a mosaic, three
    radii of a blur, nothing for solid."""
    if style not in ("mosaic", "blur", "solid"):
        raise ValueError(f"no style {style!r}")
    return each(frames, lambda nv12, mask, w, h: hide(nv12, mask, w, h, style, size, as_bytes) if mask is not None else nv12)


def nv12_to_rgba(nv12: bytes, w: int, h: int, out_w: int | None = None, out_h: int | None = None) -> bytes:
    """Full-range RGBA of limited-range NV12; the nearest source pixel of each, where another size is asked for."""
    y, uv = planes(nv12, w, h)
    rows = np.arange(out_h or h) * h // (out_h or h)
    cols = np.arange(out_w or w) * w // (out_w or w)
    c = (y[np.ix_(rows, cols)].astype(np.float64) - 16) * 1.164
    d, e = (uv[np.ix_(rows // 2, cols // 2)][..., k].astype(np.float64) - 128 for k in (0, 1))
    out = np.full((len(rows), len(cols), 4), 255, np.uint8)
    for k, x in enumerate((c + e * 1.596, c - d * 0.392 - e * 0.813, c + d * 2.017)):
        out[..., k] = np.clip(np.floor(x + 0.5), 0, 255)
    return out.tobytes()


def rgb_to_nv12(rgb: np.ndarray) -> bytes:
    """Limited-range NV12 of full-range RGB [h, w, 3]: luma of every pixel, chroma of each 2 x 2 block's mean colour."""
    r, g, b = (rgb[..., k].astype(np.float64) for k in range(3))
    y = np.floor(16.0 + (r * 65.481 + g * 128.553 + b * 24.966) / 255.0 + 0.5)
    four = lambda p: (p[0::2, 0::2] + p[1::2, 0::2] + p[0::2, 1::2] + p[1::2, 1::2]) / 4
    r, g, b = four(r), four(g), four(b)
    u = np.floor(128.0 + (r * -37.797 + g * -74.203 + b * 112.0) / 255.0 + 0.5)
    v = np.floor(128.0 + (r * 112.0 + g * -93.786 + b * -18.214) / 255.0 + 0.5)
    return np.clip(y, 0, 255).astype(np.uint8).tobytes() + np.clip(np.stack([u, v], axis=-1), 0, 255).astype(np.uint8).tobytes()


def to_rgba(frames: DataFrame, out_w: int | None = None, out_h: int | None = None) -> DataFrame:
    """frames with a column rgba."""
    return each(frames, lambda nv12, mask, w, h: nv12_to_rgba(nv12, w, h, out_w, out_h), "rgba")
