"""Small vectors with known results."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.functions import geometry as G
from veilframe.functions.runs import Masks
from veilframe.operators import assemble, frames, gating, masks, motion, suppress, temporal
from veilframe.operators.track import Filters, Tracker


def boxes(spark, rows, frame=0):
    """rows of (x, y, side, score)."""
    return spark.createDataFrame([(frame, i, 0, s, float(x), float(y), float(x + d), float(y + d)) for i, (x, y, d, s) in enumerate(rows)], "frame_idx long, det_id long, src int, score double, x1 double, y1 double, x2 double, y2 double")


def test_suppression_keeps_apart(spark):
    b = boxes(spark, [(0, 0, 100, 0.9), (10, 0, 100, 0.8), (200, 0, 100, 0.7)])
    assert sorted(r.x1 for r in suppress.suppress(b, "frame_idx", 0.45).collect()) == [0, 200]
    folded = b.groupBy("frame_idx").agg(suppress.by_score().alias("b")).select(F.explode(suppress.greedy(F.col("b"), 0.45)).alias("k"))
    assert sorted(r.k.x1 for r in folded.collect()) == [0, 200]


def test_suppression_cap(spark):
    b = boxes(spark, [(300 * i, 0, 100, 0.9 - i / 100) for i in range(8)])
    assert suppress.suppress(b, "frame_idx", 0.45, 5).count() == 5


def test_fusion(spark):
    b = boxes(spark, [(0, 0, 100, 0.9)]).union(boxes(spark, [(5, 0, 100, 0.8)]).withColumn("src", F.lit(1)).withColumn("det_id", F.col("det_id") + 9))
    r = suppress.fuse(b, "frame_idx", [1.0, 1.0]).collect()
    assert len(r) == 1 and r[0].votes == 2 and abs(r[0].score - 0.85) < 1e-9 and r[0].x1 == 2.5 and r[0].best_score == 0.9
    alone = suppress.fuse(boxes(spark, [(0, 0, 100, 0.9)]), "frame_idx", [1.0, 1.0]).first()
    assert abs(alone.score - 0.45) < 1e-9 and alone.votes == 1
    same = suppress.fuse(boxes(spark, [(0, 0, 100, 0.9), (2, 0, 100, 0.8)]), "frame_idx", [1.0]).collect()
    assert len(same) == 1 and same[0].votes == 1
    assert suppress.fuse(b.where("false"), "frame_idx", [1.0]).count() == 0


def test_gate(spark):
    person = spark.createDataFrame([(0, 1, 80.0, 80.0, 400.0, 600.0)], "frame_idx long, det_id long, x1 double, y1 double, x2 double, y2 double")
    f = boxes(spark, [(200, 200, 50, 0.30), (700, 100, 50, 0.55), (800, 100, 50, 0.75)])
    assert sorted(r.det_id for r in gating.gate(f, person, 0.6).collect()) == [0, 2]
    assert [r.score for r in gating.gate(boxes(spark, [(0, 0, 9, 0.4), (0, 0, 9, 0.7)]), person.where("false"), 0.6).collect()] == [0.7]


@pytest.mark.parametrize(("w", "h", "size", "want"), [(1920, 1080, 640, (640, 360, 0, 140)), (1920, 1080, 1280, (1280, 720, 0, 280))])
def test_letterbox(spark, w, h, size, want):
    p = G.letterbox(F.lit(w), F.lit(h), size)
    assert tuple(spark.range(1).select(p["new_w"], p["new_h"], p["pad_x"], p["pad_y"]).first()) == want


def test_boxes_and_spans(spark):
    one = spark.createDataFrame([(90.0, 30.0, 150.0, 150.0)], "x1 double, y1 double, x2 double, y2 double")
    b = G.unletterbox(G.box(), F.lit(1.0), 0, 0, 640, 480, F.lit(True))
    assert tuple(one.select(*b).first()) == (489, 30, 549, 150)
    head = spark.createDataFrame([(100.0, 0.0, 300.0, 1080.0)], one.schema).select(*G.head_region(G.box(), 1920, 1080)).first()
    assert [round(x) for x in head] == [116, 0, 284, 324]
    crop = spark.createDataFrame([(2.3, 2.9, 6.7, 6.2)], one.schema).select(*G.crop_span(G.box(), 8, 8)).first()
    assert tuple(crop) == (2, 2, 4, 5)
    assert tuple(spark.createDataFrame([(-50.0, -50.0, 999.0, 999.0)], one.schema).select(*G.crop_span(G.box(), 16, 16)).first()) == (0, 0, 16, 16)
    x1, y1, x2, y2 = spark.createDataFrame([(100.0, 100.0, 200.0, 200.0)], one.schema).select(*G.rect_span(G.box(), 0.05, 640, 480)).first()
    assert (x2 - x1) * (y2 - y1) == 12100


def test_cosine(spark):
    got = [spark.range(1).select(G.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(a), F.lit(b)))).first()[0] for a, b in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, 0.0))]
    assert got == [1, 0, -1, 0]


def test_face_margin(spark):
    got = [spark.range(1).select(G.face_margin(F.lit(100.0), F.lit(d).cast("double"), 12)).first()[0] for d in (35.0, 5.1, None)]
    assert got == [12, 29, 12]


def test_tracker_holds_and_lets_go():
    t = Tracker(max_lost=2)
    box = lambda x: (x, 0.0, x + 100.0, 100.0)
    seen = [len(t.step([(0.9, box(0.0))])), len(t.step([(0.9, box(10.0))]))] + [len(t.step([])) for _ in range(3)]
    assert seen == [1, 1, 1, 1, 0]


def test_tracker_rescue_and_spawn():
    t = Tracker()
    t.step([(0.9, (0.0, 0.0, 100.0, 100.0))])
    assert [(x.id, x.lost) for x in t.step([(0.21, (4.0, 1.0, 104.0, 101.0))])] == [(0, 0)]
    assert Tracker().step([(0.15, (0.0, 0.0, 9.0, 9.0))]) == []
    assert [x.lost for x in t.step([(0.2, (70.0, 0.0, 170.0, 100.0))])] == [1]
    assert len(t.step([(0.9, (900.0, 0.0, 1000.0, 100.0))])) == 2


def test_tracker_fade():
    t = Tracker(max_lost=8)
    t.step([(0.9, (0.0, 0.0, 100.0, 100.0))])
    assert [t.step([])[0].fade for _ in range(8)] == [0, 0, 0, 0, 0.25, 0.5, 0.75, 1] and t.step([]) == []


def test_camera_motion():
    a, b = (0.0, 0.0, 100.0, 100.0), (80.0, 0.0, 180.0, 100.0)
    still, moved = Tracker(), Tracker()
    still.step([(0.9, a)]), moved.step([(0.9, a)])
    assert len(still.step([(0.9, b)])) == 2 and [x.id for x in moved.step([(0.9, b)], (80.0, 0.0))] == [0]


def test_gap_speed():
    f = Filters.across_gap(np.array([[0.0, 0.0, 100.0, 100.0]]), np.array([[40.0, 0.0, 140.0, 100.0]]), np.array([3]))
    assert abs(f.at[0, 0, 1] - 40 / 3) < 0.5


def test_kalman(spark):
    o = spark.createDataFrame([(1, i, 5.0 * i, True) for i in range(1, 7)], "k long, seq long, z double, hit boolean")
    v = temporal.in_order(o, "k", "seq", "z", "hit").select(temporal.kalman(F.col("o")).alias("s")).first().s.v
    assert abs(v - 5) < 0.5


def mask(spark, x1, y1, x2, y2, frame=0, w=32, h=32):
    return spark.createDataFrame([(frame, w, h)], "frame_idx long, w int, h int").withColumn("spans", masks.rectangle(*map(F.lit, (x1, y1, x2, y2)), w, h))


def test_erode_dilate_shift(spark):
    m = mask(spark, 8, 8, 24, 24)
    b = lambda d: tuple(masks.bounds(d, 0).select("bx1", "by1", "bx2", "by2").first())
    px = lambda d: masks.numbers(d, empty=True).first().n_px
    assert b(masks.erode(m, 4)) == (12, 12, 20, 20) and px(masks.erode(m, 20)) == 0 and px(masks.erode(m, 0)) == 256
    assert b(masks.shift(m, F.lit(6), F.lit(3))) == (14, 11, 30, 27)
    grown = masks.erode(masks.dilate(m, 2), 2)
    assert px(masks.difference(m, grown)) == 0 and masks.bounds(masks.erode(m, 20), 0).count() == 0
    assert masks.bounds(m, 10).select("bx1", "by1", "bx2", "by2").first() == (0, 0, 32, 32)


def test_run_algebra_is_that_of_planes():
    """Random planes of several sizes in one batch: every operation on runs gives what it gives on planes."""
    rng = np.random.default_rng(0)
    for _ in range(150):
        p = [(rng.random(rng.integers(1, 12, 2)) < rng.random()).astype(np.uint8) for _ in range(rng.integers(1, 5))]
        q = [(rng.random(x.shape) < rng.random()).astype(np.uint8) for x in p]
        m, o, n = Masks.planes(p), Masks.planes(q), len(p)
        dx, dy, r = rng.integers(-6, 7, n), rng.integers(-6, 7, n), rng.integers(0, 8, n)
        for got, want in (
            (m, p), (m.union(o), [a | b for a, b in zip(p, q)]), (m.minus(o), [a & (1 - b) for a, b in zip(p, q)]), (m.both(o), [a & b for a, b in zip(p, q)]), (m.rest(), [1 - a for a in p]),
            (m.moved(dx, dy), [assemble.moved(a, int(x), int(y)) for a, x, y in zip(p, dx, dy)]), (m.grown(r), [assemble.grown(a, int(k)) for a, k in zip(p, r)]), (m.shrunk(r), [assemble.shrunk(a, int(k)) for a, k in zip(p, r)]),
            (Masks.read(m.write(), m.w, m.h), p), (Masks.from_files(m.files(), m.w, m.h)[0], p), (Masks.joined([m, o]).take(np.arange(n, 2 * n)), q),
        ):
            assert all((got.plane(i) == want[i]).all() for i in range(n))
        assert m.area().tolist() == [a.sum() for a in p]
        for i, a in enumerate(p):
            if a.any():
                x, y, crop = m.crop(i)
                assert (Masks.of_crop(x, y, crop, a.shape[1], a.shape[0]).plane(0) == a).all() and crop.any(axis=0)[[0, -1]].all()


def test_large_frames_as_runs(spark):
    """1080p frames: unions, growth, edits and files cost what their runs do."""
    w, h = 1920, 1080
    y, x = np.mgrid[0:h, 0:w]
    disc = ((((x - 900) / 200.0) ** 2 + ((y - 500) / 400.0) ** 2) < 1).astype(np.uint8)
    spans = Masks.planes([disc]).write().to_pylist()[0]
    m = spark.createDataFrame([(f, w, h, spans) for f in range(40)], "frame_idx long, w int, h int, spans array<int>")
    box = m.select("frame_idx", F.col("frame_idx").alias("seq"), F.when(F.col("frame_idx") % 2 == 0, "add").otherwise("erase").alias("op"), "w", "h", masks.rectangle(F.lit(850), F.lit(50), F.lit(1000), F.lit(600), w, h).alias("spans"))
    square = np.zeros_like(disc)
    square[50:600, 850:1000] = 1
    edited = {r.frame_idx: r.n_px for r in masks.numbers(masks.replay(m, box)).collect()}
    assert len(edited) == 40 and edited[0] == (disc | square).sum() and edited[1] == (disc & (1 - square)).sum()
    files = masks.to_files(masks.dilate(m, 24))
    back = masks.from_files(files).where("whole")
    assert back.count() == 40 and masks.numbers(back).first().n_px == assemble.grown(disc, 24).sum()
    assert files.agg(F.max(F.length("data"))).first()[0] < 20_000


def test_runs_round_trip(spark):
    m = mask(spark, 3, 2, 17, 9, w=64, h=32)
    assert m.select(F.aggregate(masks.run_lengths(F.col("spans"), F.col("w"), F.col("h")), F.lit(0), lambda s, r: s + r["len"]).alias("n")).first().n == 64 * 32
    good = masks.to_files(m)
    read = lambda d: masks.from_files(d).first()
    assert read(good).whole and read(good).spans == m.first().spans
    for spoiled in ("substring(data, 1, length(data) - 1)", "substring(data, 1, 2)", "cast(null as binary)", "concat(substring(data, 1, 8), X'02', substring(data, 10))"):
        assert not read(good.withColumn("data", F.expr(spoiled))).whole and read(good.withColumn("data", F.expr(spoiled))).spans == []
    assert not read(good.withColumn("h", F.lit(33))).whole


def test_replay(spark):
    a, b = mask(spark, 0, 1, 8, 2).withColumns({"seq": F.lit(1), "op": F.lit("add")}), mask(spark, 0, 1, 2, 2).withColumns({"seq": F.lit(2), "op": F.lit("erase")})
    other = mask(spark, 0, 0, 3, 3, w=16, h=16).withColumns({"seq": F.lit(3), "op": F.lit("add")})
    out = {r.frame_idx: r.spans for r in masks.replay(mask(spark, 0, 0, 1, 1, frame=5), a.unionByName(b).unionByName(other)).collect()}
    assert out == {0: [34, 40], 5: [0, 1]}
    turned = masks.replay(mask(spark, 0, 0, 1, 1, frame=5), a.withColumn("seq", F.lit(9)).unionByName(b)).where("frame_idx = 0").first()
    assert turned.spans == [32, 40]


def test_smoothing_carries_over_empty_frames(spark):
    frames_ = spark.createDataFrame([(f,) for f in (0, 1, 2, 4)], "frame_idx long")
    m = mask(spark, 4, 4, 6, 6).unionByName(mask(spark, 9, 9, 10, 10, frame=2))
    got = {r.frame_idx: r.n_px for r in masks.numbers(masks.smoothed(m, frames_)).collect()}
    assert got == {0: 4, 1: 16, 2: 1}  # frame 1 has the mask of frame 0 alone; frame 3 is none


@pytest.mark.parametrize("weights", [(179, 77), (90, 166), (30, 220)])
def test_blends_are_a_fold_of_pixels(spark, weights):
    """Assembled masks of a walking figure with a ragged mask, seen on some frames, against a plain fold a pixel."""
    w, h, n = 40, 30, 14
    rng = np.random.default_rng(5)
    own = {f: (rng.random((h, w)) < 0.5).astype(np.uint8) for f in range(n) if f % 4 != 3}
    for m in own.values():
        m[:6], m[24:], m[:, :8], m[:, 30:] = 0, 0, 0, 0
    box = (8.0, 6.0, 30.0, 24.0)
    p = spark.createDataFrame([(1, f, 3, 0.9, *box, bytearray(m.tobytes())) for f, m in own.items()], "video_id long, frame_idx long, det_id long, score double, x1 double, y1 double, x2 double, y2 double, mask binary")
    fr = spark.createDataFrame([(1, f) for f in range(n)], "video_id long, frame_idx long")
    none = p.drop("mask").withColumn("eye_dist", F.lit(None).cast("double")).where("false")
    made = assemble.assemble(fr, p, none, w, h, smooth=False, blend=weights)
    got = {r.frame_idx: Masks.read(pa.array([r.spans], pa.list_(pa.int32())), [w], [h]).plane(0) for r in made.collect()}
    grey = None
    for f in range(n):
        if f in own:
            now = own[f].astype(int) * 255
            grey = now if grey is None else (now * weights[0] + grey * weights[1]) // 256
        assert (got[f] == (grey >= 128)).all(), f


def plain_hide(nv12, mask, w, h, style, size):
    """Pixel by pixel: what hide() does to whole planes."""
    y = np.frombuffer(nv12, np.uint8)[: w * h].reshape(h, w).astype(int)
    uv = np.frombuffer(nv12, np.uint8)[w * h :].reshape(h // 2, w // 2, 2).astype(int)
    four = np.array([[mask[2 * b : 2 * b + 2, 2 * a : 2 * a + 2].any() for a in range(w // 2)] for b in range(h // 2)])
    pad = {"mosaic": size, "blur": 3 * size, "solid": 0}[style]
    ys, xs = np.nonzero(mask)
    box = (max(xs.min() - pad, 0), max(ys.min() - pad, 0), min(xs.max() + 1 + pad, w), min(ys.max() + 1 + pad, h))
    half = (box[0] // 2, box[1] // 2, (box[2] + 1) // 2, (box[3] + 1) // 2)
    out = []
    for plane, hit, (x1, y1, x2, y2), k in ((y, mask > 0, box, 1), (uv[..., 0], four, half, 2), (uv[..., 1], four, half, 2)):
        new = plane.copy()
        if style == "solid":
            new[hit] = 16 if k == 1 else 128
        elif style == "mosaic":
            c = size if k == 1 else max(size // 2, 1)
            for b in range(y1, y2, c):
                for a in range(x1, x2, c):
                    mean = plane[b : min(b + c, y2), a : min(a + c, x2)].sum() // plane[b : min(b + c, y2), a : min(a + c, x2)].size
                    for v in range(b, min(b + c, y2)):
                        for u in range(a, min(a + c, x2)):
                            if hit[v, u]:
                                new[v, u] = mean
        else:
            r = size if k == 1 else (size + 1) // 2
            hit = mask[::k, ::k] > 0
            row = {(v, u): sum(plane[v, min(max(u + d, 0), x2 - 1)] for d in range(-r, r + 1)) // (2 * r + 1) for v in range(y1, y2) for u in range(x1, x2)}
            for v, u in row:
                if hit[v, u]:
                    new[v, u] = sum(row[min(max(v + d, y1), y2 - 1), u] for d in range(-r, r + 1)) // (2 * r + 1)
        out.append(new)
    return out[0].astype(np.uint8).tobytes() + np.stack(out[1:], axis=-1).astype(np.uint8).tobytes()


@pytest.mark.parametrize(("style", "size"), [("solid", 0), ("mosaic", 5), ("mosaic", 2), ("blur", 1), ("blur", 4)])
def test_hidden_frames(spark, style, size):
    rng = np.random.default_rng(7)
    w, h = 36, 22
    frames_ = []
    for k, (x, y, a, b) in enumerate([(3, 2, 9, 8), (30, 15, 6, 7), (0, 0, 36, 22), (17, 9, 1, 1)]):
        mask = np.zeros((h, w), np.uint8)
        mask[y : y + b, x : x + a] = 1
        frames_.append((k, w, h, rng.integers(0, 256, w * h * 3 // 2).astype(np.uint8).tobytes(), mask))
    rows_ = [(k, w, h, n, m.tobytes()) for k, w, h, n, m in frames_] + [(8, w, h, frames_[0][3], bytes(w * h)), (9, w, h, None, None), (10, w, h, b"short", bytes(w * h))]
    t = spark.createDataFrame(rows_, "frame_idx long, w int, h int, nv12 binary, mask binary")
    got = {r.frame_idx: r.nv12 and bytes(r.nv12) for r in frames.apply(t, style, size).collect()}
    for k, _, _, n, m in frames_:
        assert got[k] == plain_hide(n, m, w, h, style, size)
    assert got[8] == frames_[0][3] and got[9] is None and got[10] == b"short"


def test_colours():
    rgb = np.zeros((2, 4, 3), np.uint8)
    rgb[:, 2:] = 255
    raw = frames.rgb_to_nv12(rgb)
    assert list(raw[:8]) == [16, 16, 235, 235] * 2 and list(raw[8:]) == [128] * 4
    back = np.frombuffer(frames.nv12_to_rgba(raw, 4, 2), np.uint8).reshape(2, 4, 4)
    assert back[0, 0].tolist() == [0, 0, 0, 255] and back[1, 3].tolist() == [255, 255, 255, 255]
    assert len(frames.nv12_to_rgba(raw, 4, 2, 8, 6)) == 8 * 6 * 4


def test_assembled_masks(spark):
    """A figure that walks, unseen on every second frame, with a face; another that stands at the edge and leaves."""
    w, h = 80, 60
    people = [(1, f, 10, 0.9, 10.0 + 2 * f, 20.0, 30.0 + 2 * f, 50.0) for f in range(0, 8, 2)] + [(1, 0, 11, 0.9, 60.0, 0.0, 79.0, 15.0)]
    p = spark.createDataFrame(people, "video_id long, frame_idx long, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    face = spark.createDataFrame([(1, f, 5, 0.9, 16.0 + 2 * f, 22.0, 22.0 + 2 * f, 29.0, None) for f in range(0, 8, 2)] + [(1, 2, 6, 0.3, 2.0, 2.0, 8.0, 8.0, None)], p.schema.add("eye_dist", "double"))
    fr = spark.createDataFrame([(v, f) for v in (1, 2) for f in range(8)], "video_id long, frame_idx long")
    plane = lambda r: Masks.read(pa.array([r.spans], pa.list_(pa.int32())), [w], [h]).plane(0)
    got = {(r.video_id, r.frame_idx): plane(r) for r in assemble.assemble(fr, p, face, w, h, every=2, face_expand=0, smooth=False).collect()}
    assert len(got) == 16 and not any(got[2, f].any() for f in range(8))
    for f in range(0, 8, 2):
        want = np.zeros((h, w), np.uint8)
        want[20:50, 10 + 2 * f : 30 + 2 * f] = 1
        if f <= 2:  # held at the edge for three frames at most
            want[0:15, 60:79] = 1
        assert (got[1, f][:, :60] == want[:, :60]).all() and (got[1, f][:15, 60:] == want[:15, 60:]).all(), f
    held = got[1, 1]  # the figure of frame 0, grown by six pixels
    assert held[14:56, 4:36].all() and not held[57:, :].any() and held[:21, 54:].all()
    plain = assemble.assemble(fr, p, face, w, h, every=2, face_expand=0, smooth=True).where("video_id = 1 AND frame_idx = 2").first()
    assert (plane(plain) == (got[1, 2] | assemble.grown(got[1, 1], 1))).all()
    # with masks of its own a person is drawn by them
    own = np.zeros((h, w), np.uint8)
    own[25, 15] = 1
    drawn = assemble.assemble(fr, p.where("frame_idx = 0 AND det_id = 10").withColumn("mask", F.lit(bytearray(own.tobytes()))), face.where("false"), w, h, smooth=False).where("video_id = 1 AND frame_idx = 0").first()
    assert (plane(drawn) == own).all()


def test_hidden_video(spark):
    w, h = 64, 48
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, w * h * 3 // 2).astype(np.uint8).tobytes()
    v = spark.createDataFrame([(1, f, w, h, raw) for f in range(3)], "video_id long, frame_idx long, w int, h int, nv12 binary")
    detect = lambda fr: fr.select("video_id", "frame_idx", F.lit(1).cast("long").alias("det_id"), F.lit(0.9).alias("score"), *(F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), (10.0, 10.0, 20.0, 30.0))))
    none = lambda fr: detect(fr).withColumn("eye_dist", F.lit(None).cast("double")).where("false")
    got = assemble.hide_video(v, w, h, detect, none, "solid", follow_camera=True, smooth=False).orderBy("frame_idx").collect()
    y = np.frombuffer(got[1].nv12, np.uint8)[: w * h].reshape(h, w)
    was = np.frombuffer(raw, np.uint8)[: w * h].reshape(h, w)
    assert (y[10:30, 10:20] == 16).all() and (y[31:] == was[31:]).all() and len(got) == 3
    marked = assemble.hide_video(v, w, h, detect, none, compose=lambda x: x.select("frame_idx", F.length("mask").alias("n"))).collect()
    assert {r.n for r in marked} == {w * h}


def test_suppression_over_batches(spark):
    rng = np.random.default_rng(2)
    rows_ = [(f, f * 100 + k, float(s), float(x), float(y), float(x + a), float(y + b)) for f in range(40) for k, (s, x, y, a, b) in enumerate(zip(rng.random(30).round(2), rng.integers(0, 40, 30), rng.integers(0, 40, 30), rng.integers(5, 30, 30), rng.integers(5, 30, 30)))]
    t = spark.createDataFrame(rows_, "frame_idx long, det_id long, score double, x1 double, y1 double, x2 double, y2 double")
    folded = t.groupBy("frame_idx").agg(suppress.greedy(suppress.by_score(), 0.4, 9).alias("k")).select("frame_idx", F.explode("k.det_id").alias("det_id"))
    key = lambda d: sorted((r.frame_idx, r.det_id) for r in d.collect())
    assert key(suppress.suppress(t, "frame_idx", 0.4, 9)) == key(folded)


def test_phase_correlation():
    y, x = np.mgrid[0:128, 0:128]
    rng = np.random.default_rng(3)
    base = rng.integers(0, 255, (160, 160)).astype(np.uint8)
    a, b = base[16:144, 16:144], base[13:141, 10:138]
    dx, dy = motion.shift_between(a, b)
    assert abs(dx - 6) < 0.6 and abs(dy - 3) < 0.6
    assert motion.shift_between(np.full((128, 128), 9, np.uint8), np.full((128, 128), 9, np.uint8)) == (0.0, 0.0)


def test_stream_equals_batch(spark):
    from veilframe.operators.track import track
    from veilframe.streaming.tracks import stream_once

    d = pd.DataFrame([(v, f, v * 10, 0.9, 5.0 * f + v, 0.0, 5.0 * f + v + 100, 100.0) for v in range(3) for f in range(16) if (v + f) % 4], columns="video_id frame_idx det_id score x1 y1 x2 y2".split())
    dets = spark.createDataFrame(d)
    frames = spark.createDataFrame([(v, f) for v in range(3) for f in range(16)], "video_id long, frame_idx long")
    key = lambda df: sorted(tuple(r) for r in df.select("video_id", "frame_idx", "track_id", "lost").collect())
    assert key(track(dets, frames)) == key(stream_once(dets, frames))


def test_tracks_of_all_boxes(spark):
    """Each frame with boxes is a video, all of whose sure first detections begin a track, in batch and stream."""
    from veilframe import registry
    from veilframe.sources.fixtures import view

    from .conftest import SF

    boxes = view(spark, SF, "boxes").where("score >= 0.1")
    want = {r.frame_idx: r.n for r in boxes.groupBy("frame_idx").agg(F.count_if((F.col("det_id") % 5 != 0) & (F.col("score") >= 0.35)).alias("n")).collect()}
    batch, stream = (registry.QUERIES[n](spark, SF).select("video_id", "frame_idx", "track_id", "lost").collect() for n in ("track_batch", "track_stream"))
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream))
    began = Counter(r.video_id for r in batch if r.frame_idx == 0)
    assert began == Counter({v: n for v, n in want.items() if n}) and len(began) > 40


def test_motion_of_all_parts(spark):
    from veilframe import registry

    from .conftest import SF

    got = {(r.video_id, r.frame_idx): (r.dx, r.dy) for r in registry.QUERIES["gmc_shift"](spark, SF).collect()}
    keys = [r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    assert sorted(got) == sorted((k % 8, k // 8) for k in keys)
    assert all(round(dx) == 3 * (v % 3) and round(dy) == 2 * (v % 2) for (v, f), (dx, dy) in got.items() if f)


def test_sinks_and_lists(spark, tmp_path):
    from veilframe.sources import store

    rows_ = spark.createDataFrame([("a, b", 12.345678, 1.0, 0.5, 33.33333, 0.1)], "label string, fps double, mean_persons double, mean_faces double, mask_cov_pct double, held_pct double")
    store.write_sweep(rows_, str(tmp_path / "sweep"))
    lines = next((tmp_path / "sweep" / "csv").glob("*.csv")).read_text().splitlines()
    assert lines == ["label,fps,mean_persons,mean_faces,mask_cov_pct,held_pct", '"a, b",12.35,1.000,0.500,33.333,0.10']
    assert spark.read.json(str(tmp_path / "sweep" / "json")).first().fps == 12.345678

    def fails(_):
        raise store.SinkFailed("busy")

    took = []
    assert store.write_first(rows_, [("one", fails), ("two", took.append), ("three", fails)]) == "two" and took == [rows_]
    with pytest.raises(store.SinkFailed):
        store.write_first(rows_, [("one", fails)])
    with pytest.raises(ZeroDivisionError):  # not the sink's fault
        store.write_first(rows_, [("one", lambda _: 1 / 0), ("two", took.append)])
    (tmp_path / "models.json").write_text('{"models": [{"name": "n", "file": "n.bin", "sha256": "aa", "bytes": 5},\n {"name": "m", "file": "m.bin", "bytes": 7}]}')
    models = store.read_models(spark, str(tmp_path / "models.json"))
    found = spark.createDataFrame([("n.bin", 5), ("m.bin", 6)], "file string, bytes long")
    assert tuple(store.readiness(models, found).first()) == (2, 1, 12, 5)
    jobs = spark.createDataFrame([("a", "pending"), ("b", "done")], "name string, state string")
    store.save_pending(jobs, str(tmp_path / "queue"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "queue")).collect()] == [("a",)]


def test_mask_store(spark, tmp_path):
    from veilframe.sources import store

    path, edits = str(tmp_path / "m"), str(tmp_path / "e")
    assert store.analyzed_frames(spark, path) == 0 and store.stored_edits(spark, edits).count() == 0
    m = masks.to_files(mask(spark, 1, 1, 2, 2, w=2, h=2).unionByName(mask(spark, 0, 0, 1, 1, frame=20_000, w=2, h=2)))
    store.save_masks(m, path, 1)
    frames_ = spark.createDataFrame([(0,), (1,), (20_000,)], "frame_idx long")
    assert sorted((r.frame_idx, r.state) for r in store.load_masks(frames_, path, 2, 2).collect()) == [(0, "ok"), (1, "missing"), (20_000, "ok")]
    assert store.analyzed_frames(spark, path) == 20_001
    edit = lambda seq, frame, op: mask(spark, 0, 0, 1, 2, frame=frame, w=2, h=2).withColumns({"seq": F.lit(seq), "op": F.lit(op)})
    store.append_edits(edit(1, 0, "add").unionByName(edit(2, 0, "erase")).unionByName(edit(3, 5, "add")), edits)
    store.clear_frame(spark, edits, 0, 2)
    assert [r.seq for r in store.stored_edits(spark, edits).collect()] == [3]
    store.append_edits(edit(4, 0, "add"), edits)
    replayed = {r.frame_idx: r.spans for r in masks.replay(store.load_masks(frames_, path, 2, 2).where("state = 'ok'"), store.stored_edits(spark, edits)).collect()}
    assert replayed == {0: [0, 1, 2, 4], 5: [0, 1, 2, 3], 20_000: [0, 1]}
    store.compact(spark, path, edits, str(tmp_path / "new"))
    assert sorted(r.seq for r in store.stored_edits(spark, str(tmp_path / "new" / "edits")).collect()) == [3, 4] and store.stored_masks(spark, str(tmp_path / "new" / "masks")).count() == 2


def test_tensors(spark):
    from veilframe.operators import tensors

    rng = np.random.default_rng(5)
    w, h = 12, 8
    raw = rng.integers(16, 236, w * h).astype(np.uint8).tobytes() + rng.integers(90, 160, w * h // 2).astype(np.uint8).tobytes()
    y, uv = np.frombuffer(raw, np.uint8)[: w * h].reshape(h, w).astype(float), np.frombuffer(raw, np.uint8)[w * h :].reshape(h // 2, w // 2, 2).astype(float)

    def pixel(sx, sy):
        x0, y0 = max(int(np.floor(sx)), 0), max(int(np.floor(sy)), 0)
        fx, fy = min(max(sx - x0, 0), 1), min(max(sy - y0, 0), 1)
        g = lambda a, b: y[min(b, h - 1), min(a, w - 1)]
        v = g(x0, y0) * (1 - fx) * (1 - fy) + g(x0 + 1, y0) * fx * (1 - fy) + g(x0, y0 + 1) * (1 - fx) * fy + g(x0 + 1, y0 + 1) * fx * fy
        u, z = uv[min(int((sy + 0.5) / 2), h // 2 - 1), min(int((sx + 0.5) / 2), w // 2 - 1)] - 128
        c = (v - 16) * 1.1644
        return np.clip([c + 1.596 * z, c - 0.3917 * u - 0.813 * z, c + 2.0172 * u], 0, 255)

    frame = spark.createDataFrame([(1, w, h, raw), (2, w, h, None)], "frame_idx long, w int, h int, nv12 binary")
    got = {r.frame_idx: r.tensor for r in tensors.to_tensors(frame, tensors.Spec("letterbox", 6, scale=255.0)).collect()}
    assert got[2] is None
    t = np.array(got[1]).reshape(3, 6, 6)
    assert np.allclose(t[:, 0], 114 / 255) and np.allclose(t[:, 5], 114 / 255)
    for oy in range(4):
        for ox in range(6):
            assert np.allclose(t[:, oy + 1, ox] * 255, pixel((ox + 0.5) * 2 - 0.5, (oy + 0.5) * 2 - 0.5), atol=0.01)
    flipped = tensors.tensor(raw, w, h, tensors.Spec("same", mean=tensors.FACE_MEAN, bgr=True), True)
    assert flipped.shape == (3, 8, 12) and np.allclose(flipped[:, 3, 2][::-1] + tensors.FACE_MEAN, pixel(w - 1.0 - 2, 3), atol=0.01)
    assert tensors.tensor(raw, w, h, tensors.SPECS["looks"]).shape == (3, 256, 128) and tensors.tensor(raw, w, h, tensors.SPECS["phrases"]).shape == (3, 533, 800)
    rois = spark.createDataFrame([(1, 7, 1.0, 1.0, 9.5, 7.0), (1, 8, 0.0, 0.0, 3.0, 3.0)], "frame_idx long, det_id long, x1 double, y1 double, x2 double, y2 double")
    c = tensors.crops(frame, rois, ["frame_idx"], w, h, least=4).collect()
    assert [(r.det_id, r.ox, r.oy, r.w, r.h) for r in c] == [(7, 0, 1, 10, 6)]
    assert (np.frombuffer(c[0].nv12, np.uint8)[:60].reshape(6, 10) == y[1:7, 0:10]).all() and len(c[0].nv12) == 90
    t = tensors.tiles(spark.createDataFrame([(1, 200, 100)], "frame_idx long, w int, h int"), 96, 32, 64)
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in t.collect()) == [(0, 0, 96, 96), (64, 0, 160, 96), (128, 0, 200, 96)]
    back = tensors.back_to_frame(spark.createDataFrame([(5, 6, 1.0, 2.0, 3.0, 4.0)], "ox int, oy int, x1 double, y1 double, x2 double, y2 double"), 2.0).first()
    assert (back.x1, back.y1, back.x2, back.y2) == (7.0, 10.0, 11.0, 14.0)


def test_faces_with_eyes(spark):
    from veilframe.operators import tensors

    n = 3
    a = np.zeros((20, n))
    a[:5] = [[50, 52, 20], [60, 60, 60], [20, 20, 10], [20, 20, 10], [0.9, 0.8, 0.7]]
    a[5:11] = [[45, 0, 0], [55, 0, 0], [0.6, 0, 0.9], [55, 0, 0], [55, 0, 0], [0.7, 0, 0.2]]
    df = spark.createDataFrame([(1, a.ravel().tolist())], "frame_idx long, o array<double>")
    got = tensors.faces(df, "o", n, 0.5, 100, 200, 100).orderBy("det_id").collect()
    assert [r.det_id for r in got] == [0, 2]  # the second overlaps the first
    assert (got[0].x1, got[0].y1, got[0].x2, got[0].y2) == (80.0, 50.0, 120.0, 90.0) and (got[0].eyes.lx, got[0].eyes.ly, got[0].eyes.rx) == (90.0, 60.0, 110.0)
    assert got[1].eyes is None
    m = np.zeros((10, 10), np.uint8)
    m[3:5, 0:5] = 1
    out = tensors.unletterboxed(m, 20, 10)
    assert out.sum() == out[2:6].sum() == 4 * 10 and out[:, 10:].sum() == 0 and tensors.unletterboxed(m, 20, 10, True)[:, :10].sum() == 0


def test_memory_of_instances():
    from veilframe.operators.archive import Memory

    m = Memory()
    box = lambda *x: np.array(x, float).reshape(-1, 4)
    red, blue = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert m.step(box(0, 0, 10, 10, 50, 0, 60, 10), [red, blue]).tolist() == [0, 1]
    # looks win over place: both moved past each other's boxes
    assert m.step(box(4, 0, 14, 10), [red]).tolist() == [0]
    assert m.step(box(52, 0, 62, 10, 6, 0, 16, 10), [blue, None]).tolist() == [1, 0]
    assert m.step(box(500, 500, 510, 510), [None]).tolist() == [2]
    for _ in range(8):
        m.step(box(), [])
    assert m.ids.tolist() == [2] and m.step(box(52, 0, 62, 10), [blue]).tolist() == [3]


def test_archive_analysis(spark):
    from veilframe.operators import archive

    fr = spark.createDataFrame([(1, f) for f in range(4)], "video_id long, frame_idx long")
    rows_ = [(f, f * 10 + s, s, 0.8, 10.0 + 3 * f + s, 10.0, 50.0 + 3 * f + s, 90.0, 0.9) for f in range(4) if f != 2 for s in (0, 1)] + [(0, 5, 0, 0.05, 200.0, 10.0, 220.0, 50.0, 0.9)]
    b = spark.createDataFrame(rows_, "frame_idx long, det_id long, src int, score double, x1 double, y1 double, x2 double, y2 double, fill double")
    q = spark.createDataFrame([(0, 0, 0.9, 0.8), (1, 0, 0.2, 0.8), (3, 0, 0.2, 0.8)], "frame_idx long, cluster int, quality double, fill double")
    faces_ = spark.createDataFrame([(f, 100 + k, 0.9, x, 15.0, x + 12, 30.0, None) for k, (f, x) in enumerate(((0, 20.0), (0, 300.0), (1, 302.0)))], "frame_idx long, det_id long, score double, x1 double, y1 double, x2 double, y2 double, eye_dist double")
    looks = spark.createDataFrame([], "frame_idx long, cluster int, emb array<double>")
    got = archive.analyze(fr, b, q, faces_, looks).collect()
    assert sorted((r.kind, r.frame_idx, r.instance_id) for r in got) == [(0, 0, 0), (0, 1, 0), (0, 3, 0), (1, 0, 0), (1, 1, 0)]
    fused = suppress.confirmed(suppress.fuse(b, "frame_idx", [1.0, 1.0]), 0.25)
    kinds = {r.frame_idx: (r.source, round(r.score, 6)) for r in archive.with_masks(fused, q, b.where("src = 0 AND frame_idx <> 3")).collect()}
    assert kinds == {0: ("refined", 0.8), 1: ("matched", 0.72), 3: ("rect", 0.72)}


def test_sides_of_joins_are_not_sent_whole(spark):
    """Rows that are made from a row are more than a table's size tells: no side of these joins may be broadcast."""
    from veilframe import registry

    for name in ("mask_host_overlap", "archive_figures", "assemble_figures", "track_known"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, name


def test_many_edits_of_a_frame(spark):
    """More edits of one frame than a batch holds, each over a part of the one before: the same as one after another."""
    import numpy as np

    from veilframe.operators import masks

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(3000):
        f, lo = int(rng.integers(0, 2)), int(rng.integers(0, 60))
        hi, add, size = lo + int(rng.integers(0, 12)), bool(rng.integers(0, 2)), 8 if i % 7 or i < 20 else 9
        rows.append((f, i, "add" if add else "erase", 8, size, [lo, hi]))
        if size == 8:
            on = want.setdefault(f, np.zeros(80, bool))
            on[lo : min(hi, 64)] = add
    edits = spark.createDataFrame(rows, "frame_idx long, seq long, op string, w int, h int, spans array<int>")
    none = edits.select("frame_idx", "w", "h", "spans").where("false")
    got = {r.frame_idx: r.spans for r in masks.replay(none, edits).collect()}
    for f, on in want.items():
        turn = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
        assert got[f] == turn.tolist()


def test_fusion_of_crowded_boxes(spark):
    """Clusters that grow to three sources: as a plain walk over boxes and clusters gives them."""
    import numpy as np

    from veilframe.functions.groups import overlaps
    from veilframe.operators import suppress

    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 30, (300, 2))
    rows = [(int(i % 4), i, int(i % 3), float(rng.uniform(0, 1)), *map(float, (*p, *(p + rng.uniform(25, 35, 2))))) for i, p in enumerate(xy)]
    weights, want = [2.0, 1.0, 0.7], []
    for f in range(4):
        clusters = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[1])):
            b, w = np.array(r[4:]), weights[r[2]]
            at = next((c for c in clusters if overlaps((c["sum"] / c["w"])[None], b[None])[0, 0] >= 0.55), None)
            if at is None:
                clusters.append({"sum": w * b, "w": w, "mass": w * r[3], "srcs": {r[2]}})
            elif r[2] not in at["srcs"]:
                at["sum"], at["w"], at["mass"] = at["sum"] + w * b, at["w"] + w, at["mass"] + w * r[3]
                at["srcs"].add(r[2])
        want += [(f, i, round(c["mass"] / 3.7, 9), len(c["srcs"]), round(c["sum"][0] / c["w"], 9)) for i, c in enumerate(clusters)]
    boxes = spark.createDataFrame(rows, "frame_idx long, det_id long, src int, score double, x1 double, y1 double, x2 double, y2 double")
    got = [(r.frame_idx, r.cluster, round(r.score, 9), r.votes, round(r.x1, 9)) for r in suppress.fuse(boxes, "frame_idx", weights).collect()]
    assert sorted(got) == sorted(want) and max(r[3] for r in got) == 3


def test_links_are_made_in_tasks(spark):
    from veilframe.operators import link

    one, two, half = [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]
    box = (0.0, 0.0, 10.0, 10.0)
    refs = spark.createDataFrame([(1, 1, *box, one), (1, 2, *box, half), (2, 3, *box, None), (2, 4, 50.0, 0.0, 60.0, 10.0, one), (3, 5, *box, one)], "frame_idx long, ref_id long, x1 double, y1 double, x2 double, y2 double, emb array<float>")
    memory = spark.createDataFrame([(1, 10, *box, one, 0), (1, 11, *box, two, 8), (1, 12, *box, one, 9), (2, 13, *box, two, 0), (2, 14, 90.0, 0.0, 99.0, 10.0, [1.0, 0.0, 0.0], 0)], "frame_idx long, inst_id long, x1 double, y1 double, x2 double, y2 double, emb array<float>, missed int")
    got = link.link(refs, memory)
    # the best pair takes both of its sides; unlike vectors are told apart by place alone, those missed too often don't count
    assert [(*r[:3], round(r[3], 4)) for r in sorted(got.collect())] == [(1, 1, 10, 1.0), (1, 2, 11, round(0.6 + 0.4 / 2**0.5, 4)), (2, 3, 13, 0.6)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_masks_drawn_in_any_batches(spark):
    from veilframe.operators import assemble

    rows = []
    for v in range(3):
        for f in range(9):
            rows.append((v, f, assemble.FRAME, 0, 0.0, 0.0, 0, 0, None))
            for t in range(4):
                at = 200 * t + 10 * v + f
                # seen at every third frame and held, moved, between
                rows.append((v, f, assemble.PERSON, t, float(f % 3), 0.0, 0, 0, [at, at + 5] if (f + t) % 3 == 0 else None))
    d = spark.createDataFrame(rows, "video_id long, frame_idx long, kind int, track_id long, shift_x double, shift_y double, grow long, shrink long, spans array<int>")
    d = d.repartition(1).sortWithinPartitions("video_id", "frame_idx", "kind", "track_id")
    draw = lambda: [tuple(r) for r in assemble.draw(d, 64, 32, False).orderBy("video_id", "frame_idx").collect()]
    whole, key = draw(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 4)
        assert draw() == whole
    finally:
        spark.conf.set(key, before)
    assert len(whole) == 27 and whole[0][4] == [0, 5, 600, 605] and whole[1][4] == [1, 6, 402, 407, 601, 606]
