"""Jobs over a folder: probe-sized steps by name (analyze, render, process, sweep) that may be stopped and taken up again.

A video is worked on in units of `segment` frames, each a small video of its own whose tracker begins cold, so that a
unit's masks don't depend on which were made before it. Units are done in waves; a wave's masks are appended to the
store first and its units are noted after, both by Spark's commit, so a job that ends midway has whole waves only and
goes on with the units that are not noted; what a lost wave may have written is passed over. When no
unit is left, analyze() does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assemble, frames, masks
from .sources import store
from .sources.store import _read

MASKS = "video_id long, frame_idx long, w int, h int, spans array<int>, wave string"
UNITS = "video_id long, unit long, wave string"


@dataclass
class Job:
    spark: SparkSession
    folder: str
    w: int
    h: int
    segment: int = 10_000
    wave: int = 256
    options: dict = field(default_factory=dict)

    def units(self, video: DataFrame) -> DataFrame:
        return video.select("video_id", F.floor(F.col("frame_idx") / self.segment).alias("unit")).distinct()

    def done(self) -> DataFrame:
        return _read(self.spark, f"{self.folder}/units", UNITS)

    def pending(self, video: DataFrame) -> DataFrame:
        return self.units(video).join(self.done().select("video_id", "unit"), ["video_id", "unit"], "left_anti")

    def analyze(self, video: DataFrame, detect: Callable[[DataFrame], DataFrame], find_faces: Callable[[DataFrame], DataFrame], tell: Callable[[int, int], None] | None = None) -> int:
        """Masks of all frames of video (video_id, frame_idx, w, h, nv12) that have none yet; how many units it did.
        Hooks take frames and give boxes as assemble() reads them; tell hears units done and of how many."""
        store.check_meta(self.spark, f"{self.folder}/meta", self.w, self.h)
        store.save_meta(self.spark, f"{self.folder}/meta", 0, self.w, self.h, 0.0, 0)
        total, did = self.units(video).count(), 0
        while True:
            now = uuid.uuid4().hex  # what a lost wave has left is never taken for this one's
            some = self.pending(video).orderBy("video_id", "unit").limit(self.wave)
            units = [(int(v), int(u)) for v, u in some.collect()]  # a wave: a bounded number of rows
            if not units:
                return did
            # a unit is a video of its own while its masks are made
            number = self.spark.createDataFrame([(v, u, i) for i, (v, u) in enumerate(units)], "video_id long, unit long, _n long")
            part = video.withColumn("unit", F.floor(F.col("frame_idx") / self.segment)).join(F.broadcast(number), ["video_id", "unit"])
            own = part.select(F.col("_n").alias("video_id"), *(c for c in video.columns if c != "video_id"))
            every = self.options.get("every", 1)
            sampled = own.where(F.col("frame_idx") % every == 0)
            made = assemble.assemble(own.select("video_id", "frame_idx"), detect(sampled), find_faces(sampled), self.w, self.h, **self.options)
            back = number.select(F.col("_n"), F.col("video_id").alias("_v"))
            rows = made.join(F.broadcast(back), F.col("video_id") == F.col("_n")).select(F.col("_v").alias("video_id"), "frame_idx", "w", "h", "spans", F.lit(now).alias("wave"))
            rows.write.mode("append").parquet(f"{self.folder}/masks")
            number.select("video_id", "unit", F.lit(now).alias("wave")).coalesce(1).write.mode("append").parquet(f"{self.folder}/units")
            did += len(units)
            if tell:
                tell(self.done().count(), total)

    def masks(self) -> DataFrame:
        """(video_id, frame_idx, w, h, spans) of all noted units, each frame once: of the wave that noted its unit."""
        m = _read(self.spark, f"{self.folder}/masks", MASKS).withColumn("unit", F.floor(F.col("frame_idx") / self.segment))
        return m.join(self.done(), ["video_id", "unit", "wave"], "left_semi").select("video_id", "frame_idx", "w", "h", "spans")

    def edit(self, edits: DataFrame) -> None:
        """Append edits (video_id, frame_idx, seq, op, w, h, spans) for render()."""
        edits.select("video_id", "frame_idx", F.col("seq").cast("long").alias("seq"), "op", "w", "h", "spans").write.mode("append").parquet(f"{self.folder}/edits")

    def render(self, video: DataFrame, style: str = "mosaic", size: int = 24) -> DataFrame:
        """video with what its masks and edits cover hidden; frames without either pass as they are."""
        edits = _read(self.spark, f"{self.folder}/edits", "video_id long, frame_idx long, seq long, op string, w int, h int, spans array<int>")
        keys = ("video_id", "frame_idx")
        covers = masks.replay(self.masks(), edits, keys)
        both = masks.with_planes(assemble.beside(video, covers.select(*keys, "spans"), keys))
        return frames.apply(both, style, size)

    def process(self, video: DataFrame, detect: Callable, find_faces: Callable, style: str = "mosaic", size: int = 24) -> DataFrame:
        self.analyze(video, detect, find_faces)
        return self.render(video, style, size)


def sweep(spark: SparkSession, folder: str, video: DataFrame, detect: Callable, find_faces: Callable, w: int, h: int, grid: dict[str, list]) -> DataFrame:
    """label, frames, masked (frames with a mask), mask_cov_pct for each combination of options in grid, each a job in a
    folder of its own that goes on where it stopped."""
    out = None
    for values in product(*grid.values()):
        chosen = dict(zip(grid, values))
        label = ",".join(f"{k}={v}" for k, v in chosen.items())
        job = Job(spark, f"{folder}/{label}", w, h, options=chosen)
        job.analyze(video, detect, find_faces)
        n = masks.area(F.col("spans"))
        row = job.masks().agg(F.count(F.lit(1)).alias("frames"), F.count_if(n > 0).alias("masked"), F.round(F.avg(n * 100.0 / (F.col("w") * F.col("h"))), 6).alias("mask_cov_pct")).select(F.lit(label).alias("label"), "*")
        out = row if out is None else out.unionByName(row)
    return out
