"""Camera motion between frames by phase correlation of small luma planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDE, LEAST_ENERGY, LEAST_PEAK = 128, 1e-3, 6.0


def small(luma: np.ndarray) -> np.ndarray:
    """A luma plane at SIDE x SIDE by nearest pixels."""
    h, w = luma.shape
    return luma[np.arange(SIDE) * h // SIDE][:, np.arange(SIDE) * w // SIDE]


def plane(luma: np.ndarray) -> np.ndarray:
    """A small plane less its mean, under a Hann window."""
    x = small(luma).astype(np.float64)
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIDE) / (SIDE - 1))
    return (x - x.mean()) * np.outer(win, win)


def shift_between(before: np.ndarray, now: np.ndarray, size_of: tuple[int, int] | None = None) -> tuple[float, float]:
    """(dx, dy) in pixels that carries the frame before onto this one; (0, 0) where the peak is not clear. Planes may
    be small ones of frames of size_of (h, w)."""
    h, w = size_of or now.shape
    cross = np.fft.fft2(plane(now)) * np.conj(np.fft.fft2(plane(before)))
    size = np.abs(cross)
    if size.sum() < LEAST_ENERGY * SIDE * SIDE:
        return 0.0, 0.0
    corr = np.abs(np.fft.ifft2(np.where(size > 1e-12, cross / np.maximum(size, 1e-12), 0)))
    flat = corr.ravel()
    at = len(flat) - 1 - int(np.argmax(flat[::-1]))
    if flat[at] / max(np.partition(flat, len(flat) // 2)[len(flat) // 2], 1e-9) < LEAST_PEAK:
        return 0.0, 0.0
    y, x = divmod(at, SIDE)

    def refined(line: np.ndarray, i: int) -> float:
        l, c, r = line[i - 1], line[i], line[(i + 1) % SIDE]
        bend = l - 2 * c + r
        part = float(np.clip(0.5 * (l - r) / bend, -0.5, 0.5)) if abs(bend) > 1e-9 else 0.0
        return (i - SIDE if i > SIDE // 2 else i) + part

    return refined(corr[y], x) * w / SIDE, refined(corr[:, x], y) * h / SIDE


def motions(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, dx, dy) of frames (video_id, frame_idx, w, h, luma binary) against the frame before. Frames
    become small planes of 16 KB where they are read; only these are shuffled and sorted."""

    def shrink(batches):
        for pdf in batches:
            made = [None if x is None else small(np.frombuffer(x, np.uint8).reshape(h, w)).tobytes() for x, w, h in zip(pdf["luma"], pdf["w"], pdf["h"])]
            yield pdf[["video_id", "frame_idx", "w", "h"]].assign(small=made)

    order = Window.partitionBy("video_id").orderBy("frame_idx")
    planes = frames.select("video_id", "frame_idx", "w", "h", "luma").mapInPandas(shrink, "video_id long, frame_idx long, w int, h int, small binary")
    both = planes.withColumn("before", F.lag("small").over(order))

    def run(batches):
        for pdf in batches:
            as_plane = lambda x: np.frombuffer(x, np.uint8).reshape(SIDE, SIDE)
            moved = [(0.0, 0.0) if a is None or b is None else shift_between(as_plane(b), as_plane(a), (h, w)) for a, b, w, h in zip(pdf["small"], pdf["before"], pdf["w"], pdf["h"])]
            yield pd.DataFrame({"video_id": pdf["video_id"], "frame_idx": pdf["frame_idx"], "dx": [m[0] for m in moved], "dy": [m[1] for m in moved]})

    return both.mapInPandas(run, "video_id long, frame_idx long, dx double, dy double")
