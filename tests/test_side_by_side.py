"""Small pieces of work that are done many at a step: the same results, in few steps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilframe.functions.runs import Greys, Masks
from veilframe.operators import assemble
from veilframe.operators import track as track_ops


def plane_rows(videos: int, n_frames: int, tracks: int, w: int, h: int) -> tuple[pa.RecordBatch, dict]:
    """Rows as draw() reads them, of ragged masks seen on some frames, and (video, frame) -> tracks with their planes."""
    rng, rows, seen = np.random.default_rng(11), [], {}
    for v in range(videos):
        for f in range(n_frames):
            rows.append((v, f, assemble.FRAME, 0, None))
            for t in range(tracks):
                plane = (rng.random((h, w)) < 0.5).astype(np.uint8) if rng.random() < 0.7 else None
                seen[v, f, t] = plane
                spans = Masks.planes([plane]).write()[0].as_py() if plane is not None else None
                rows.append((v, f, assemble.PERSON, t, spans))
    cols = list(zip(*rows))
    zeros = [0.0] * len(rows), [0.0] * len(rows), [0] * len(rows), [0] * len(rows)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    names = "video_id frame_idx kind track_id shift_x shift_y grow shrink spans".split()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols[:4], *zeros, cols[4]], kinds)], names=names), seen


class Run:
    """In place of rows: what draw() does to batches."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_blends_of_many_tracks_are_a_fold_of_pixels_each(monkeypatch):
    w, h, videos, n_frames, tracks = 9, 7, 6, 8, 3
    rows, seen = plane_rows(videos, n_frames, tracks, w, h)
    steps, plain = [], Greys.blended
    monkeypatch.setattr(Greys, "blended", lambda *a: steps.append(1) or plain(*a))
    for weights in ((90, 166), (30, 220), (179, 77)):
        want = {}
        for v in range(videos):
            greys = {}
            for f in range(n_frames):
                for t in range(tracks):
                    if (plane := seen[v, f, t]) is not None:
                        now = plane.astype(int) * 255
                        greys[t] = now if t not in greys else (now * weights[0] + greys[t] * weights[1]) // 256
                want[v, f] = np.any([g >= 128 for g in greys.values()] + [np.zeros((h, w), bool)], axis=0)
        for size in (rows.num_rows, 10, 1):
            steps.clear()
            got = {}
            for b in assemble.draw(Run(), w, h, False, weights)(rows.slice(i, size) for i in range(0, rows.num_rows, size)):
                m = Masks.read(b.column(4), np.full(b.num_rows, w), np.full(b.num_rows, h))
                got.update({(v, f): m.plane(i) for i, (v, f) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))})
            assert got.keys() == want.keys()
            for k in want:
                assert (got[k] == want[k]).all(), (weights, size, k)
            if size == rows.num_rows:  # a step for each sight of a track, not for each of all tracks
                assert len(steps) <= 2 * n_frames


def test_pairs_of_few_boxes_are_found_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    of_a, of_b = np.sort(rng.integers(0, 40, 150)), np.sort(rng.integers(0, 40, 130))
    box = lambda n: np.concatenate([p := rng.uniform(0, 50, (n, 2)), p + rng.uniform(5, 40, (n, 2))], axis=1)
    a, b = box(150), box(130)
    few = {apart: track_ops.near_pairs(a, of_a, b, of_b, 40, apart) for apart in (False, True)}
    monkeypatch.setattr(track_ops, "FEW_PAIRS", 0)
    for apart, got in few.items():
        for x, y in zip(got, track_ops.near_pairs(a, of_a, b, of_b, 40, apart)):
            assert x.tolist() == y.tolist()
    assert len(few[False][0]) > 50


def test_fusion_of_many_small_frames(spark, monkeypatch):
    """Frames side by side give the same clusters as one by one."""
    from veilframe.operators import suppress

    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        p = rng.uniform(0, 12, 2)
        rows.append((int(rng.integers(0, 90)), i, int(rng.integers(0, 3)), float(rng.choice([0.0, 0.3, 0.5, 0.9])), *map(float, (*p, *(p + rng.uniform(20, 30, 2))))))
    d = spark.createDataFrame(rows, "frame_idx long, det_id long, src int, score double, x1 double, y1 double, x2 double, y2 double")
    fuse = lambda: sorted(tuple(r) for r in suppress.fuse(d, "frame_idx", [0.7, 1.0, 1.3]).collect())
    few = fuse()
    monkeypatch.setattr(suppress, "FEW_PAIRS", 0)
    assert few == fuse() and 90 < len(few) < 350 and {r[3] for r in few} == {1, 2, 3}


def test_instances_of_many_videos(monkeypatch):
    """Videos side by side, cut into batches anywhere, give the same instances as each one alone."""
    from veilframe.operators.archive import Memory, instances

    rng = np.random.default_rng(2)
    frames = []  # (video, boxes, looks)
    for v in range(30):
        for _ in range(int(rng.integers(1, 14))):
            n = int(rng.integers(0, 4))
            p = rng.uniform(0, 30, (n, 2))
            frames.append((v, np.concatenate([p, p + rng.uniform(10, 20, (n, 2))], axis=1), [rng.normal(size=int(rng.integers(2, 4))) if rng.random() < 0.6 else None for _ in range(n)]))
    want, now = [], None
    for v, boxes, looks in frames:
        if v != now:
            now, alone = v, Memory()
        want.append(alone.step(boxes, looks).tolist())
    calls, plain = [], Memory.step
    monkeypatch.setattr(Memory, "step", lambda *a: calls.append(1) or plain(*a))
    for size in (len(frames), 7, 1):
        got, now, memory = [], None, Memory()
        calls.clear()
        for a in range(0, len(frames), size):
            some = frames[a : a + size]
            # a frame without observations has a row that is none
            real = np.concatenate([np.full(max(len(f[1]), 1), len(f[1]) > 0) for f in some])
            xy = np.concatenate([f[1] if len(f[1]) else np.zeros((1, 4)) for f in some])
            looks = [x for f in some for x in (f[2] or [None])]
            edges = np.cumsum([0, *(max(len(f[1]), 1) for f in some)])
            video = np.array([f[0] for f in some])
            starts = np.flatnonzero(np.append(True, video[1:] != video[:-1]))
            ids, memory = instances(memory if now == video[0] else Memory(), starts, edges, real, xy, lambda at: [looks[i] for i in at.tolist()])  # noqa: B023
            now = video[-1]
            got += [ids[x:z][real[x:z]].tolist() for x, z in zip(edges[:-1], edges[1:])]
        assert got == want
        if size == len(frames):
            assert len(calls) <= 13
    assert max(max(w, default=0) for w in want) > 5


def test_instances_travel_with_their_masks(spark):
    """The masks of instances are not stored and joined with their numbers: these come with them."""
    from veilframe import registry
    from veilframe.operators import archive, masks

    plan = registry.QUERIES["archive_figures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("Exchange")]
    assert "Join" not in after and after.count("MapInArrow") == 2
    # refs of frames that are not named go, and what a frame refers to is real
    f = spark.createDataFrame([(1, 0), (1, 2), (2, 0)], "video_id long, frame_idx long")
    at = [(1, 0, 0, 5, 0.9), (1, 1, 0, 6, 0.9), (1, 2, 0, 7, 0.8), (2, 0, 1, 1, 0.7), (2, 5, 0, 1, 0.7), (1, None, 0, 1, 0.7), (1, 2, 0, None, 0.7)]
    r = spark.createDataFrame([(*x, 0.0, 0.0, 9.0, 9.0, None, f"{x[0]}{x[1]}") for x in at], "video_id long, frame_idx long, kind int, ref_id long, score double, x1 double, y1 double, x2 double, y2 double, emb array<double>, mark string")
    got = sorted((x.video_id, x.frame_idx, x.kind, x.ref_id, x.instance_id, x.mark) for x in archive.remember(f, r, ("mark",)).collect())
    assert got == [(1, 0, 0, 5, 0, "10"), (1, 2, 0, 7, 0, "12"), (2, 0, 1, 1, 0, "20")]
    box = spark.createDataFrame([(-2, 1, 5, 3, 8, 4), (0, 0, 8, 2, 8, 4), (3, 2, 3, 4, 8, 4), (2, 3, 9, 9, 8, 4), (None, 0, 1, 1, 8, 4)], "a int, b int, c int, d int, w int, h int")
    assert [x[0] for x in box.select(masks.rectangle(*(F.col(c) for c in "abcdwh"))).collect()] == [[8, 13, 16, 21], [0, 8, 8, 16], [], [26, 32], [0, 1]]
