"""Hooks with made models: loads, shrinking batches, cascades, tiles and prompts."""

import os
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.functions.runs import Masks
from veilframe.operators import models
from veilframe.operators.models import Frame, Hook


def luma(f):
    return np.frombuffer(f.nv12, np.uint8)[: f.w * f.h].reshape(f.h, f.w)


class Squares:
    """Finds squares of one brightness and side: whole ones alone, by their corners."""

    def __init__(self, folder, most, side=24):
        self.most, self.side = most, side
        if folder:
            open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def detect(self, frames):
        if len(frames) > self.most:
            raise MemoryError
        out = []
        for f in frames:
            on = luma(f) == 235
            pad = np.pad(on, 1)
            corner = on & ~pad[:-2, 1:-1] & ~pad[1:-1, :-2]
            found = []
            for y, x in zip(*np.nonzero(corner)):
                for side in (self.side, self.side // 2):
                    if on[y : y + side, x : x + side].sum() == side * side and not pad[y + 1 : y + side + 1, x + side + 1 : x + side + 2].any() and not pad[y + side + 1 : y + side + 2, x + 1 : x + side + 1].any() and x + side <= f.w and y + side <= f.h:
                        found.append((0.9 - 0.001 * (f.w % 7), float(x), float(y), float(x + side), float(y + side), None))
            out.append(found)
        return out

    def encode(self, frames):
        if len(frames) > self.most:
            raise MemoryError
        return [luma(f) for f in frames]

    def prompt(self, code, boxes):
        out = []
        for x1, y1, x2, y2 in boxes.astype(int):
            plane = np.zeros_like(code)
            plane[y1:y2, x1:x2] = code[y1:y2, x1:x2] == 235
            out.append((plane.mean() * code.size / max((x2 - x1) * (y2 - y1), 1), plane))
        return out


def painted(w, h, squares, side=24):
    y = np.full((h, w), 16, np.uint8)
    for x, at in squares:
        y[at : at + side, x : x + side] = 235
    return y.tobytes() + bytes([128]) * (w * h // 2)


def videos(spark, w=128, h=96, n=30):
    rows = [(1, f, w, h, painted(w, h, [(f * 3, 10), (60, 40 + f)])) for f in range(n)]
    return spark.createDataFrame([*rows, (2, 0, w, h, b"short"), (2, 1, w, h, None)], "video_id long, frame_idx long, w int, h int, nv12 binary").repartition(4)


def test_batches_shrink_and_models_load_once(spark, tmp_path):
    v = videos(spark)
    want = None
    for most, batch in ((100, 8), (3, 8), (1, 5)):
        folder = str(tmp_path / f"{most}")
        os.mkdir(folder)
        hook = Hook("squares", lambda folder=folder, most=most: Squares(folder, most), (most, batch), batch)
        got = sorted(tuple(r) for r in models.detect(v, hook).collect())
        want = want or got
        assert got == want and len(got) == 60 and {r[0] for r in got} == {1}
        pids = [x.split("-")[0] for x in os.listdir(folder)]
        assert pids and len(pids) == len(set(pids))  # one load a worker
    with pytest.raises(Exception, match="MemoryError"):
        models.detect(v, Hook("none", lambda: Squares(None, 0))).collect()


def test_one_model_is_kept():
    made = []
    hook = lambda k: Hook("m", lambda: made.append(k) or object(), (k,))
    models._kept[:] = [None, None]
    a = models.model_of(hook(1))
    assert models.model_of(hook(1)) is a and models.model_of(hook(2)) is not a and models.model_of(hook(1)) is not a and made == [1, 2, 1]
    models._kept[:] = [None, None]
    runner = models.Runner(Hook("r", lambda: None, batch=8), lambda m, x: x)
    assert runner.all(list(range(20))) == list(range(20))
    with pytest.raises(ValueError):
        models.Runner(Hook("r", lambda: None), lambda m, x: x[1:]).all([1, 2])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_find_planted_faces_once(spark):
    """Faces on the edges of tiles, in the overlap of four, in corners, and whole ones that only half scale confirms."""
    w, h, tile, overlap = 640, 420, 256, 64
    places = [(0, 0), (192 - 10, 100), (250, 180), (192, 192), (616, 396), (400, 30), (500, 250)]
    f = spark.createDataFrame([(1, 0, w, h, painted(w, h, places)), (1, 1, w, h, painted(w, h, []))], "video_id long, frame_idx long, w int, h int, nv12 binary")
    found = models.tiled(f, Hook("squares", lambda: Squares(None, 99), ("t",)), tile, overlap)
    assert sorted((int(r.x1), int(r.y1), int(r.x2), int(r.y2)) for r in found.collect()) == sorted((x, y, x + 24, y + 24) for x, y in places)
    assert "Exchange" not in plan_of(found) and "Join" not in plan_of(found)
    starts = {x for x in range(0, max(0, -(-(w - tile) // (tile - overlap))) * (tile - overlap) + 1, tile - overlap)}
    assert max(starts) + tile >= w


def test_cascade_finds_small_faces_in_heads(spark):
    """A model that sees faces of 24 pixels in whole frames and of 12 in crops of at most 80 columns."""

    class Near(Squares):
        def detect(self, frames):
            return [[x for x in found if f.w <= 80 or x[3] - x[1] == 24] for f, found in zip(frames, super().detect(frames))]

    w, h = 256, 192
    y = np.full((h, w), 16, np.uint8)
    y[20:32, 40:52], y[100:124, 150:174], y[150:162, 220:232] = 235, 235, 235
    f = spark.createDataFrame([(1, 0, w, h, y.tobytes() + bytes([128]) * (w * h // 2)), (1, 1, w, h, y.tobytes() + bytes([128]) * (w * h // 2))], "video_id long, frame_idx long, w int, h int, nv12 binary")
    people = spark.createDataFrame([(1, 0, 20.0, 15.0, 90.0, 180.0), (1, 0, 140.0, 95.0, 200.0, 190.0), (1, 0, None, 1.0, 2.0, 3.0)], "video_id long, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    found = models.cascade(f, people, Hook("near", lambda: Near(None, 99)))
    rows = sorted((r.frame_idx, r.x1, r.y1, r.x2, r.y2) for r in found.collect())
    assert rows == [(0, 40.0, 20.0, 52.0, 32.0), (0, 150.0, 100.0, 174.0, 124.0), (1, 150.0, 100.0, 174.0, 124.0)]
    assert "SortMergeJoin" not in plan_of(found) and "Exchange hashpartitioning" not in plan_of(found)


def test_prompts_meet_their_frames_embedding(spark, tmp_path):
    v = videos(spark)
    prompts = spark.createDataFrame([(1, f, p, float(f * 3 - 2), 8.0, float(f * 3 + 26), 36.0) if p == 7 else (1, f, p, 0.0, 0.0, 4.0, 4.0) for f in range(5, 9) for p in (7, 9)] + [(2, 0, 1, 0.0, 0.0, 9.0, 9.0)], "video_id long, frame_idx long, prompt_id long, x1 double, y1 double, x2 double, y2 double")
    got = models.refine(v, prompts, Hook("s", lambda: Squares(None, 2), ("p",))).collect()
    assert {(r.frame_idx, r.prompt_id) for r in got} == {(f, p) for f in range(5, 9) for p in (7, 9)}
    for r in got:
        m = Masks.read(pa.array([r.spans], pa.list_(pa.int32())), [r.w], [r.h])
        if r.prompt_id == 7:
            assert m.box()[0].tolist() == [r.frame_idx * 3, 10, r.frame_idx * 3 + 24, 34] and r.quality > 0.5
        else:
            assert not r.spans and r.quality == 0
