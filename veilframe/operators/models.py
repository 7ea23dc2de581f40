"""Models as hooks: made once in a worker, run over batches of frames, and over the regions and prompts of a frame
beside it, so that frames don't travel for them.

A Hook says how to make a model and what tells it apart; a worker keeps the last one made. Frames come to a model as
lists of at most `batch`; where it raises one of the hook's `too_large` errors, the batch is halved, for good, and tried
again; a single frame that fails is an error of the job. Results don't depend on the batches.

Defined results: a frame whose bytes don't fit its sides has no results; null boxes are no regions; regions under
`least` pixels a side are passed over; a frame without prompts is not encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import overlaps
from ..functions.runs import Masks
from ..functions.shared import beside
from .tensors import LEAST_CROP, LEAST_TILE, cropped, halved

KEYS = ("video_id", "frame_idx")
#: A found box: score, x1, y1, x2, y2, and the distance of the eyes or None.
Found = tuple[float, float, float, float, float, float | None]
#: Overlaps above which one of two boxes goes: of a cascade's passes, of tiles and scales.
CASCADE_IOU, TILE_IOU = 0.6, 0.4


@dataclass(frozen=True)
class Frame:
    nv12: bytes
    w: int
    h: int


@dataclass(frozen=True)
class Hook:
    """make() gives a model; name and settings tell models apart. Errors that a smaller batch may mend: too_large."""

    name: str
    make: Callable[[], Any]
    settings: tuple = ()
    batch: int = 8
    too_large: tuple[type[BaseException], ...] = field(default=(MemoryError,))

    @property
    def key(self) -> tuple:
        return (self.name, self.settings)


_kept: list = [None, None]


def model_of(hook: Hook) -> Any:
    """The worker's model of this hook; another one takes its place."""
    if _kept[0] != hook.key:
        _kept[:] = [None, None]  # the one before goes first
        _kept[:] = [hook.key, hook.make()]
    return _kept[1]


class Runner:
    """A model over lists of items, in batches that shrink where they must."""

    def __init__(self, hook: Hook, call: Callable[[Any, list], list]):
        self.model, self.call, self.batch, self.too_large = model_of(hook), call, hook.batch, hook.too_large

    def all(self, items: list) -> list:
        """A result for each item."""
        out: list = []
        while len(out) < len(items):
            part = items[len(out) : len(out) + self.batch]
            try:
                got = self.call(self.model, part)
            except self.too_large:
                if len(part) == 1:
                    raise
                self.batch = len(part) // 2
                continue
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} items")
            out += got
        return out


def _frames(b: pa.RecordBatch, at: int) -> list[Frame | None]:
    """Columns w, h, nv12 from `at` on; None where the bytes don't fit the sides."""
    rows = zip(*(b.column(at + k).to_pylist() for k in range(3)))
    return [Frame(x, w, h) if x is not None and w and h and len(x) == w * h * 3 // 2 else None for w, h, x in rows]


def _few(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


BOXES = "video_id long, frame_idx long, det_id long, score double, x1 double, y1 double, x2 double, y2 double, eye_dist double"


def _boxes(b: pa.RecordBatch, found: list[list[Found]]) -> pa.RecordBatch:
    """Rows of BOXES; det_id is a box's number in its frame."""
    n = np.array([len(f) for f in found])
    who = pa.array(np.repeat(np.arange(len(found)), n))
    flat = [x for f in found for x in f]
    cols = list(zip(*flat)) or [()] * 6
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(1).take(who), pa.array(number, pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], names=[c.split()[0] for c in BOXES.split(", ")])


def best_apart(found: list[Found], max_iou: float) -> list[Found]:
    """Boxes in falling order of scores (the earlier of equals first), less those that overlap a kept one by more."""
    if not found:
        return []
    rows = np.array([x[:5] for x in found], float)
    order = np.argsort(-rows[:, 0], kind="stable")
    near = overlaps(rows[order, 1:], rows[order, 1:])
    kept: list[int] = []
    for i in range(len(order)):
        if not kept or near[i, kept].max() <= max_iou:
            kept.append(i)
    return [found[order[i]] for i in kept]


def _moved(found: list[Found], x: float, y: float, times: float = 1.0) -> list[Found]:
    return [(s, a * times + x, b * times + y, c * times + x, d * times + y, None if e is None else e * times) for s, a, b, c, d, e in found]


def detect(frames: DataFrame, hook: Hook) -> DataFrame:
    """BOXES of frames (video_id, frame_idx, w, h, nv12): model.detect(list of Frame) gives a list of Found for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner = None
        for b in _few(batches, hook.batch):
            runner = runner or Runner(hook, lambda m, x: m.detect(x))
            got = _frames(b, 2)
            real = [f for f in got if f is not None]
            results = iter(runner.all(real))
            yield _boxes(b, [list(next(results)) if f is not None else [] for f in got])

    return frames.select(*KEYS, "w", "h", "nv12").mapInArrow(run, BOXES)


def _regions(frames: DataFrame, hook: Hook, regions_of: Callable[[Frame, list], list[tuple[Frame, float, float, float]]], max_iou: float, *more: str) -> DataFrame:
    """BOXES out of several regions (frame, x, y, scale) of each frame, which are made, looked at and merged where the
    frame is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner = None
        for b in _few(batches, 4):
            runner = runner or Runner(hook, lambda m, x: m.detect(x))
            got = _frames(b, 2)
            given = b.column(5).to_pylist() if more else [None] * b.num_rows
            parts = [regions_of(f, g or []) if f is not None else [] for f, g in zip(got, given)]
            results = iter(runner.all([p[0] for x in parts for p in x]))
            yield _boxes(b, [best_apart([y for p in x for y in _moved(list(next(results)), *p[1:])], max_iou) for x in parts])

    return frames.select(*KEYS, "w", "h", "nv12", *more).mapInArrow(run, BOXES)


def _part(f: Frame, x1: float, y1: float, x2: float, y2: float, least: int) -> list[tuple[Frame, float, float, float]]:
    """A region as a frame of its own, with even sides and its place; none where it is too small."""
    x, y = int(min(max(x1, 0), max(f.w - 2, 0))) // 2 * 2, int(min(max(y1, 0), max(f.h - 2, 0)))
    cw = (int(min(np.ceil(max(x2, 0)), f.w)) - x) // 2 * 2
    ch = (int(min(np.ceil(max(y2, 0)), f.h)) - y) // 2 * 2
    if cw < least or ch < least:
        return []
    return [(Frame(cropped(f.nv12, f.w, f.h, x, y, cw, ch), cw, ch), float(x), float(y), 1.0)]


def cascade(frames: DataFrame, people: DataFrame, hook: Hook, least: int = LEAST_CROP, max_iou: float = CASCADE_IOU) -> DataFrame:
    """Faces (BOXES) of whole frames and of the heads of people (video_id, frame_idx, box) in them, merged."""
    box = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    whole = people.where(F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull())
    heads = whole.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.array(*box))).alias("people"))

    def regions(f: Frame, people_: list) -> list[tuple[Frame, float, float, float]]:
        out = [(f, 0.0, 0.0, 1.0)]
        for x1, y1, x2, y2 in people_:
            bw, bh = x2 - x1, y2 - y1
            side = lambda v, most: min(max(v, 0.0), float(most))
            out += _part(f, side(x1 + bw * 0.08, f.w), side(y1 - bh * 0.05, f.h), side(x2 - bw * 0.08, f.w), side(y1 + bh * 0.3, f.h), least)
        return out

    return _regions(beside(frames, heads, KEYS), hook, regions, max_iou, "people")


def tiled(frames: DataFrame, hook: Hook, tile: int = 1280, overlap: int = 320, half: bool = True, least: int = LEAST_TILE, max_iou: float = TILE_IOU) -> DataFrame:
    """Faces (BOXES) of overlapping tiles of each frame at its own scale and of the whole frame at half scale, merged."""
    step = tile - overlap

    def starts(n: int) -> range:
        return range(0, max(0, -(-(n - tile) // step)) * step + 1, step)

    def regions(f: Frame, _: list) -> list[tuple[Frame, float, float, float]]:
        out = [p for y in starts(f.h) for x in starts(f.w) for p in _part(f, x, y, min(x + tile, f.w), min(y + tile, f.h), least)]
        if half:
            raw, w, h = halved(f.nv12, f.w, f.h)
            if w >= least and h >= least:
                out.append((Frame(raw, w, h), 0.0, 0.0, 2.0))
        return out

    return _regions(frames, hook, regions, max_iou)


REFINED = "video_id long, frame_idx long, prompt_id long, quality double, w int, h int, spans array<int>"


def refine(frames: DataFrame, prompts: DataFrame, hook: Hook) -> DataFrame:
    """REFINED masks of prompts (video_id, frame_idx, prompt_id, x1, y1, x2, y2): model.encode(list of Frame) gives an
    embedding a frame, kept for all its prompts; model.prompt(embedding, boxes [n, 4]) a list of (quality, plane [h, w])."""
    asked = prompts.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(F.col("prompt_id").cast("long").alias("i"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))))).alias("asked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner = None
        for b in _few(batches, hook.batch):
            runner = runner or Runner(hook, lambda m, x: m.encode(x))
            given = b.column(5).to_pylist()
            got = [f if g else None for f, g in zip(_frames(b, 2), given)]
            codes = iter(runner.all([f for f in got if f is not None]))
            who, ids, quality, planes_ = [], [], [], []
            for i, f in enumerate(got):
                if f is None:
                    continue
                answers = runner.model.prompt(next(codes), np.array([[p[c] for c in ("x1", "y1", "x2", "y2")] for p in given[i]]))
                for p, (q, plane) in zip(given[i], answers, strict=True):
                    who.append(i)
                    ids.append(p["i"])
                    quality.append(float(q))
                    planes_.append(plane)
            m = Masks.planes(planes_)
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(ids, pa.int64()), pa.array(quality, pa.float64()), pa.array(m.w.astype(np.int32)), pa.array(m.h.astype(np.int32)), m.write()], names=[c.split()[0] for c in REFINED.split(", ")])

    return beside(frames, asked, KEYS).select(*KEYS, "w", "h", "nv12", "asked").mapInArrow(run, REFINED)
