"""Jobs that stop midway end with the same tables; stores report what they are not of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe import jobs
from veilframe.operators import masks
from veilframe.sources import store

W, H = 48, 32


def video(spark):
    rng = np.random.default_rng(1)
    rows = [(v, f, W, H, rng.integers(20, 230, W * H * 3 // 2).astype(np.uint8).tobytes()) for v in range(3) for f in range(7)]
    return spark.createDataFrame(rows, "video_id long, frame_idx long, w int, h int, nv12 binary")


def people(frames):
    x = (F.col("frame_idx") * 2 + 4).cast("double")
    return frames.select("video_id", "frame_idx", F.lit(1).cast("long").alias("det_id"), F.lit(0.9).alias("score"), x.alias("x1"), F.lit(5.0).alias("y1"), (x + 12).alias("x2"), F.lit(25.0).alias("y2"))


def nobody(frames):
    return people(frames).withColumn("eye_dist", F.lit(None).cast("double")).where("false")


def table(job):
    return sorted((r.video_id, r.frame_idx, tuple(r.spans)) for r in job.masks().collect())


def test_a_job_stopped_midway_ends_with_the_same_table(spark, tmp_path):
    v = video(spark)
    whole = jobs.Job(spark, str(tmp_path / "whole"), W, H, segment=3, wave=100, options={"every": 2})
    assert whole.analyze(v, people, nobody) == 9 and len(table(whole)) == 21
    job = jobs.Job(spark, str(tmp_path / "cut"), W, H, segment=3, wave=2, options={"every": 2})
    calls = []

    def stops(frames):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return people(frames)

    with pytest.raises(KeyboardInterrupt):
        job.analyze(v, stops, nobody)
    assert job.done().count() == 4
    # a wave that wrote masks but was lost before its units were noted
    job.masks().limit(3).withColumn("spans", F.array(F.lit(0), F.lit(1))).withColumn("wave", F.lit("lost")).write.mode("append").parquet(f"{job.folder}/masks")
    told = []
    assert job.analyze(v, people, nobody, lambda n, of: told.append((n, of))) == 5
    assert table(job) == table(whole) and told[-1] == (9, 9)
    assert job.analyze(v, stops, nobody) == 0 and len(calls) == 3  # nothing is left to do
    with pytest.raises(store.MetaMismatch, match="48 x 32, not 64 x 32"):
        jobs.Job(spark, job.folder, 64, H).analyze(v, people, nobody)


def test_render_with_edits(spark, tmp_path):
    v = video(spark)
    job = jobs.Job(spark, str(tmp_path / "j"), W, H, options={"smooth": False})
    job.process(v, people, nobody, "solid").count()
    side = lambda x1, y1, x2, y2, seq, op: spark.createDataFrame([(0, 2, seq, op, W, H)], "video_id long, frame_idx long, seq long, op string, w int, h int").withColumn("spans", masks.rectangle(*map(F.lit, (x1, y1, x2, y2)), W, H))
    job.edit(side(0, 0, W, H, 1, "erase").unionByName(side(30, 0, 40, 4, 2, "add")))
    was = {(r.video_id, r.frame_idx): np.frombuffer(r.nv12, np.uint8)[: W * H].reshape(H, W) for r in v.collect()}
    got = {(r.video_id, r.frame_idx): np.frombuffer(r.nv12, np.uint8)[: W * H].reshape(H, W) for r in job.render(v, "solid").collect()}
    assert len(got) == 21 and (got[1, 2][5:25, 8:20] == 16).all() and (got[1, 2][26:] == was[1, 2][26:]).all()
    assert (got[0, 2][:4, 30:40] == 16).all() and (got[0, 2][5:25, 8:20] == was[0, 2][5:25, 8:20]).all()


def test_sweep(spark, tmp_path):
    got = {r.label: r for r in jobs.sweep(spark, str(tmp_path / "s"), video(spark), people, nobody, W, H, {"every": [1, 3], "smooth": [False]}).collect()}
    assert set(got) == {"every=1,smooth=False", "every=3,smooth=False"} and all(r.frames == 21 and r.masked == 21 for r in got.values())
    assert got["every=3,smooth=False"].mask_cov_pct > got["every=1,smooth=False"].mask_cov_pct


def test_instances(spark, tmp_path):
    path, meta = str(tmp_path / "i"), str(tmp_path / "m")
    f = spark.createDataFrame([(0,), (1,), (20_000,)], "frame_idx long")
    rows = spark.createDataFrame([(0, 7, 0, 0.9, 0.0, 0.0, 2.0, 1.0, [0, 2]), (0, 3, 1, 0.8, 0.0, 0.0, 4.0, 1.0, [0, 4])], "frame_idx long, instance_id long, kind int, score double, x1 double, y1 double, x2 double, y2 double, spans array<int>")
    assert store.check_meta(spark, meta, 4, 2) is None
    store.save_instances(f.where("frame_idx < 2"), rows.withColumn("score", F.lit(0.1)), path, 1, 4, 2)
    store.save_instances(f.where("frame_idx = 0"), rows, path, 2, 4, 2)
    got = {r.frame_idx: r for r in store.load_instances(f, path, 4, 2).collect()}
    assert {k: r.state for k, r in got.items()} == {0: "ok", 1: "ok", 20_000: "missing"}
    assert [(x.instance_id, x.kind, x.score, x.spans) for x in got[0].instances] == [(3, 1, 0.8, [0, 4]), (7, 0, 0.9, [0, 2])] and got[1].instances == []
    assert {r.state for r in store.load_instances(f.where("frame_idx < 2"), path, 4, 3).collect()} == {"size"}
    image = {r.instance_id: r.spans for r in store.instance_image(store.load_instances(f, path, 4, 2), 4, 2).collect()}
    assert image == {7: [0, 2], 3: [2, 4]}
    store.save_meta(spark, meta, 1, 4, 2, 30.0, 100)
    store.save_meta(spark, meta, 2, 4, 2, 30.0, 120)
    assert store.check_meta(spark, meta, 4, 2, 120)["total_frames"] == 120
    with pytest.raises(store.MetaMismatch):
        store.check_meta(spark, meta, 4, 2, 100)
