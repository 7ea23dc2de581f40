"""Careful analysis of stored videos: boxes of two detectors fused, masks refined or fallen back on, faces given to
their persons, and instances that keep their numbers over time by overlap and looks.

The remembered instances of a video are its state: walked frame after frame, with a batch of rows held at a time.
Persons and faces without a person are remembered apart. Defined results: a frame without observations ages what is
remembered; a null embedding counts as no likeness; ties go to the earlier observation, then the older instance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.groups import matrix, paired, ranges, whole_groups
from ..functions.runs import Masks
from ..functions.shared import shuffled, spread, stored
from . import gating, masks, suppress
from .link import APPEARANCE, LEAST, MOST_MISSED

_BOX = ("x1", "y1", "x2", "y2")
PERSON, FACE = 0, 1
#: Least quality of a refined mask, least overlap with a detector's own box, and least share of a box that its mask fills.
REFINED, MATCHED, FILLED, HOSTED = 0.5, 0.55, 0.3, 0.1
#: How far beyond a person's box, in shares of it, the centre of its face may lie.
HOST_MARGIN = 0.08
#: What a score is worth where no refined mask stands behind it.
FALLEN_BACK = 0.9


class Memory:
    """Instances seen before, of n videos side by side: last box and looks, and for how many frames they were missing; of:
    each one's video, ascending."""

    def __init__(self, n: int = 1):
        self.next_id = np.zeros(n, np.int64)
        self.ids, self.missed, self.of = (np.zeros(0, np.int64) for _ in range(3))
        self.boxes, self.looks = np.zeros((0, 4)), np.zeros(0, object)

    def step(self, boxes: np.ndarray, looks: list[np.ndarray | None], of: np.ndarray | None = None) -> np.ndarray:
        """The instance of each observation; new ones where none is like it. of: each one's video, ascending."""
        of = np.zeros(len(boxes), np.int64) if of is None else of
        looked = np.empty(len(boxes), object)
        looked[:] = looks
        first = np.searchsorted(self.of, of)
        n = np.searchsorted(self.of, of, "right") - first
        rows, cols = np.repeat(np.arange(len(boxes)), n), ranges(first, n)
        near = paired(boxes[rows], self.boxes[cols]) * (1 - APPEARANCE)
        known = lambda x: np.array([v is not None for v in x], bool)
        for p in np.flatnonzero(known(looked)[rows] & known(self.looks)[cols]).tolist():
            a, b = looked[rows[p]], self.looks[cols[p]]
            if len(a) == len(b):
                size = np.sqrt((a @ a) * (b @ b))
                near[p] += APPEARANCE * max(float(a @ b / size) if size > 0 else 0.0, 0.0)
        own = np.full(len(boxes), -1)
        over = np.flatnonzero(near > LEAST)
        over = over[np.argsort(-near[over], kind="stable")]
        taken: set[int] = set()
        for i, j in zip(rows[over].tolist(), cols[over].tolist()):
            if own[i] < 0 and j not in taken:
                own[i] = j
                taken.add(j)
        hit = np.flatnonzero(own >= 0)
        self.missed += 1
        self.missed[own[hit]] = 0
        self.boxes[own[hit]] = boxes[hit]
        shown = hit[known(looked[hit])]
        self.looks[own[shown]] = looked[shown]
        new = np.flatnonzero(own < 0)
        count = np.bincount(of[new], minlength=len(self.next_id))
        ids = np.empty(len(boxes), np.int64)
        ids[hit], ids[new] = self.ids[own[hit]], ranges(self.next_id, count)
        self.next_id = self.next_id + count
        keep = self.missed <= MOST_MISSED
        if len(new) or not keep.all():
            order = np.argsort(np.concatenate([self.of[keep], of[new]]), kind="stable")
            join = lambda old, more: np.concatenate([old[keep], more])[order]
            self.ids, self.missed, self.of = join(self.ids, ids[new]), join(self.missed, np.zeros(len(new), np.int64)), join(self.of, of[new])
            self.boxes, self.looks = join(self.boxes, boxes[new]), join(self.looks, looked[new])
        return ids

    def between(self, a: int, z: int) -> Memory:
        """That of videos a to z alone."""
        m, on = Memory(), slice(*np.searchsorted(self.of, [a, z]).tolist())
        m.next_id, m.of = self.next_id[a:z].copy(), self.of[on] - a
        m.ids, m.missed, m.boxes, m.looks = (x[on].copy() for x in (self.ids, self.missed, self.boxes, self.looks))
        return m


def instances(memory: Memory, starts: np.ndarray, edges: np.ndarray, real: np.ndarray, xy: np.ndarray, looks: Callable[[np.ndarray], list]) -> tuple[np.ndarray, Memory]:
    """The instance of each row that is real, and the last video's memory. Frame f has the rows edges[f] to edges[f + 1],
    video v begins with frame starts[v]; memory is the first one's. The first frames of all videos are walked side by
    side, then the second ones, and so on; looks gives those of some rows."""
    length = np.diff(np.append(starts, len(edges) - 1))
    longest = np.argsort(-length, kind="stable")  # those at their end leave from behind
    slot = np.empty(len(starts), np.int64)
    slot[longest] = np.arange(len(starts))
    video = np.repeat(np.arange(len(starts)), length)
    rows = np.flatnonzero(real)
    frame = np.searchsorted(edges, rows, "right") - 1
    turn, of = (np.arange(len(edges) - 1) - starts[video])[frame], slot[video[frame]]
    order = np.lexsort((rows, of, turn))
    rows, turn, of = rows[order], turn[order], of[order]
    all_, last, ids = Memory(len(starts)), slot[-1], np.empty(len(real), np.int64)
    all_.next_id[slot[0]], all_.of = memory.next_id[0], np.full(len(memory.ids), slot[0])
    all_.ids, all_.missed, all_.boxes, all_.looks = memory.ids, memory.missed, memory.boxes, memory.looks
    cuts = np.searchsorted(turn, np.arange(int(length.max()) + 1)).tolist()
    active = np.searchsorted(-length[longest], -np.arange(int(length.max())), "left").tolist()
    for a, z, n in zip(cuts[:-1], cuts[1:], active):
        if n < len(all_.next_id):
            if n <= last < len(all_.next_id):
                memory = all_.between(last, last + 1)
            all_ = all_.between(0, n)
        ids[rows[a:z]] = all_.step(xy[rows[a:z]], looks(rows[a:z]), of[a:z])
    return ids, all_.between(last, last + 1) if last < len(all_.next_id) else memory


def remember(frames: DataFrame, refs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """refs (video_id, frame_idx, kind, ref_id, score, box, emb: array of double or null) with their columns `also` and
    instance_id, a number within its video and kind. frames names every (video_id, frame_idx); refs of others go."""
    cols = ("video_id", "frame_idx", "kind", "ref_id", "score", *_BOX)
    known = refs.where(" AND ".join(f"{c} IS NOT NULL" for c in cols[:4])).select(*cols, "emb", *also)
    none = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in (*cols[3:], "emb", *also)]
    # a frame has a row of its own for each kind, so that what it refers to travels once
    rows = frames.select("video_id", "frame_idx", F.explode(F.array(F.lit(PERSON), F.lit(FACE))).alias("kind"), *none).unionByName(known)

    def run(batches):
        now, memory = None, Memory()
        for b, edges in whole_groups(batches, "video_id", "kind", "frame_idx"):
            real = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            named = np.logical_or.reduceat(~real, edges[:-1])
            if not named.all():
                n = np.diff(edges)
                b = b.take(pa.array(np.flatnonzero(np.repeat(named, n))))
                if not b.num_rows:
                    continue
                real, edges = b.column(3).is_valid().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n[named]))
            video, kind = (b.column(i).to_numpy()[edges[:-1]] for i in (0, 2))
            starts = np.flatnonzero(np.concatenate([[True], (video[1:] != video[:-1]) | (kind[1:] != kind[:-1])]))
            emb = b.column(len(cols))
            looks = lambda at: [None if e is None else np.array(e, float) for e in emb.take(pa.array(at)).to_pylist()] if emb.null_count < len(emb) else [None] * len(at)  # noqa: B023, E731
            ids, memory = instances(memory if now == (video[0], kind[0]) else Memory(), starts, edges, real, matrix(b, *_BOX), looks)
            now = video[-1], kind[-1]
            at = np.flatnonzero(real)
            kept = b.select([*cols, *also]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ids[at])], names=[*cols, *also, "instance_id"])

    kind_of = lambda c: rows.schema[c].dataType.simpleString()
    schema = ", ".join(f"{c} {kind_of(c)}" for c in (*cols, *also)) + ", instance_id long"
    return spread(rows, "video_id", "kind").sortWithinPartitions("video_id", "kind", "frame_idx", F.desc("score"), "ref_id").mapInArrow(run, schema)


def with_masks(fused: DataFrame, refined: DataFrame, own: DataFrame) -> DataFrame:
    """fused (frame_idx, cluster, score, box) with where its mask comes from: 'refined' (frame_idx, cluster, quality,
    fill) where that is good enough, else 'matched', the best own box (frame_idx, det_id, score, box, fill) over it, else
    'rect'; fill is the share of the box that its mask covers. Scores without a refined mask count a little less."""
    f = fused.join(shuffled(refined.select("frame_idx", "cluster", "quality", F.col("fill").alias("r_fill"))), ["frame_idx", "cluster"], "left")
    o = own.select("frame_idx", F.col("det_id").alias("o_det_id"), F.col("score").alias("o_score"), "fill", *(F.col(c).alias("o_" + c) for c in _BOX))
    pairs = fused.join(shuffled(o), "frame_idx").where(G.iou(G.box("o_"), G.box()) > MATCHED)
    best = pairs.groupBy("frame_idx", "cluster").agg(F.max(F.struct("o_score", "o_det_id", "fill")).alias("m"))
    f = f.join(shuffled(best), ["frame_idx", "cluster"], "left")
    good, match = F.coalesce(F.col("quality") >= REFINED, F.lit(False)), F.coalesce(F.col("m.fill") > FILLED, F.lit(False))
    source = F.when(good, "refined").when(match, "matched").otherwise("rect")
    score = F.when(good, F.col("score")).otherwise(F.col("score") * FALLEN_BACK)
    return f.select("frame_idx", "cluster", *_BOX, score.alias("score"), source.alias("source"), F.when(source == "refined", F.col("r_fill")).when(source == "matched", F.col("m.fill")).otherwise(1.0).alias("fill"), F.when(source == "matched", F.col("m.o_det_id")).alias("matched_id"))


#: Margin of a filled box, and steps in pixels at which a box is looked at for how much of it a mask covers.
RECT_MARGIN, LOOKED_AT = 0.05, 4
INSTANCES = ("video_id", "frame_idx", "kind", "ref_id", "score", *_BOX, "source", "w", "h", "spans")


def covered(rows: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """rows (box, w, h, spans) with the share of a box's pixels, looked at in steps, that its mask covers; tidy: with runs
    in order, apart and within the frame."""
    names = list(rows.columns)
    at = [names.index(c) for c in (*_BOX, "w", "h", "spans")]

    def run(batches):
        for b in batches:
            x1, y1, x2, y2 = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at[:4])
            w, h = (np.nan_to_num(b.column(i).to_numpy(zero_copy_only=False)).astype(np.int64) for i in at[4:6])
            m = Masks.read(b.column(at[6]), w, h)
            a, c = np.maximum(x1, 0).astype(np.int64), np.maximum(y1, 0).astype(np.int64)
            b_, d = np.maximum(np.minimum(np.ceil(x2), w), a + 1).astype(np.int64), np.maximum(np.minimum(np.ceil(y2), h), c + 1).astype(np.int64)
            of, y, lo, hi = m.rows()
            # of a row that is looked at, the places a, a + LOOKED_AT, ... that lie in a run within the box
            on = (y >= c[of]) & (y < d[of]) & ((y - c[of]) % LOOKED_AT == 0)
            of, lo, hi = of[on], np.maximum(lo[on], a[of[on]]), np.minimum(hi[on], b_[of[on]])
            steps = lambda v: -(-(v - a[of]) // LOOKED_AT)  # noqa: B023, E731
            hit = np.bincount(of, np.maximum(steps(hi) - steps(lo), 0), len(w))
            total = -(-(b_ - a) // LOOKED_AT) * -(-(d - c) // LOOKED_AT)
            kept = [m.write() if tidy and i == at[6] else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hit / np.maximum(total, 1))], names=[*names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def analyze_videos(frames: DataFrame, boxes: DataFrame, faces: DataFrame, refine: Callable[[DataFrame], DataFrame], looks: Callable[[DataFrame], DataFrame] | None, w: int, h: int, conf: float = 0.25, face_expand: int = 12) -> DataFrame:
    """Instances of every frame with their masks: INSTANCES and instance_id, a number within its video and kind.

    frames: video_id, frame_idx; boxes of two detectors: those, det_id, src (0, 1), score, box, spans (a mask, of src 0);
    faces: video_id, frame_idx, det_id, score, box, eye_dist. refine takes prompts (video_id, frame_idx, prompt_id, box)
    and gives REFINED rows (models.refine over the frames); looks takes instances and gives video_id, frame_idx, kind,
    ref_id, emb, or is None.

    A fused box has its refined mask, else that of the best own box over it, else itself with a margin, filled. A face
    whose host's mask covers enough of the host's box is joined into that mask; any other is an instance of its own, its
    box a prompt too. Persons and faces are asked for in one pass of refine each. Frame numbers may repeat from video to
    video; what stands on frames that `frames` does not name goes."""
    frame, own_key = ("video_id", "frame_idx"), F.struct("video_id", "frame_idx").alias("frame_idx")
    keys = (*frame, "det_id")
    side = {"w": F.lit(w), "h": F.lit(h)}
    there = lambda df: df.where("video_id IS NOT NULL AND frame_idx IS NOT NULL")
    found = there(boxes)
    fused = stored(suppress.confirmed(suppress.fuse(found, frame, [1.0, 1.0]), conf).withColumn("cluster", F.col("cluster").cast("long")), "fused")
    refined = refine(fused.select(*frame, F.col("cluster").alias("prompt_id"), *_BOX)).where(F.col("quality") >= REFINED)
    refined = refined.select(*frame, F.col("prompt_id").alias("cluster"), F.col("spans").alias("r_spans"))
    own = found.where("src = 0").select(*frame, F.col("det_id").alias("o_det_id"), F.col("score").alias("o_score"), F.col("spans").alias("o_spans"), *(F.col(c).alias("o_" + c) for c in _BOX))
    over = fused.join(shuffled(own), list(frame)).where(G.iou(G.box("o_"), G.box()) > MATCHED)
    best = over.groupBy(*frame, "cluster").agg(F.max(F.struct("o_score", "o_det_id", "o_spans")).alias("m"))
    people = fused.join(shuffled(refined), [*frame, "cluster"], "left").join(shuffled(best), [*frame, "cluster"], "left")
    people = covered(people.select(*frame, "cluster", "score", *_BOX, "r_spans", F.col("m.o_spans").alias("spans")).withColumns(side), "fill")
    source = F.when(F.col("r_spans").isNotNull(), "refined").when(F.col("fill") > FILLED, "matched").otherwise("rect")
    rect = masks.rectangle(*G.rect_span(G.box(), RECT_MARGIN, w, h), w, h)
    people = people.withColumn("source", source).select(*frame, F.col("cluster").alias("det_id"), F.when(source == "refined", F.col("score")).otherwise(F.col("score") * FALLEN_BACK).alias("score"), *_BOX, "source", "w", "h", F.when(source == "refined", F.col("r_spans")).when(source == "matched", F.col("spans")).otherwise(rect).alias("spans"))
    people = stored(covered(people, "fill", tidy=True), "people")
    # faces: to their hosts' masks, or alone
    by_frame = lambda df: df.select(own_key, "det_id", "score", *_BOX)
    shown = there(faces).withColumn("frame_idx", own_key).drop("video_id")
    shown = gating.gate(gating.plausible(shown, by_frame(people)), by_frame(people), 0.75)
    hosted = gating.hosts(shown, by_frame(people.where(F.col("fill") > HOSTED)), HOST_MARGIN)
    hosted = stored(hosted.withColumns({"video_id": F.col("frame_idx.video_id"), "frame_idx": F.col("frame_idx.frame_idx")}), "faces")
    ex = G.face_margin(F.col("x2") - F.col("x1"), F.col("eye_dist"), face_expand)
    wide = masks.rectangle(*G.face_span(G.box(), ex, face_expand, w, h), w, h)
    whose = hosted.where("host IS NOT NULL").select(*frame, F.col("host.p_det_id").alias("det_id"), wide.alias("spans")).withColumns(side)
    # masks of hosts alone are made anew
    whole = masks.union(people.join(shuffled(whose.select(*keys).distinct()), list(keys), "left_semi"), whose, keys=keys).select(*keys, F.col("spans").alias("_whole"))
    people = people.join(shuffled(whole), list(keys), "left").withColumn("spans", F.coalesce("_whole", "spans")).drop("_whole", "fill").withColumn("kind", F.lit(PERSON))
    alone = hosted.where("host IS NULL").drop("host")
    better = refine(alone.select(*frame, F.col("det_id").alias("prompt_id"), *_BOX)).where(F.col("quality") >= REFINED).select(*frame, F.col("prompt_id").alias("det_id"), F.col("spans").alias("r_spans"))
    alone = alone.join(shuffled(better), list(keys), "left").select(*keys, "score", *_BOX, F.when(F.col("r_spans").isNotNull(), "refined").otherwise("rect").alias("source"), F.coalesce("r_spans", wide).alias("spans"), F.lit(FACE).alias("kind")).withColumns(side)
    every = people.unionByName(alone).withColumnRenamed("det_id", "ref_id").select(*INSTANCES)
    if looks:
        every, at = stored(every, "instances"), ["video_id", "frame_idx", "kind", "ref_id"]
        seen = every.join(shuffled(looks(every).select(*at, "emb")), at, "left")
    else:
        seen = every.withColumn("emb", F.lit(None).cast("array<double>"))
    return remember(frames, seen, ("source", "w", "h", "spans")).select(*INSTANCES, "instance_id")


def analyze(frames: DataFrame, boxes: DataFrame, refined: DataFrame, faces: DataFrame, looks: DataFrame, conf: float = 0.25) -> DataFrame:
    """Instances of every frame: video_id, frame_idx, kind, ref_id, score, box, instance_id.

    frames: video_id, frame_idx (unique over videos); boxes: frame_idx, det_id, src (0, 1), score, box, fill; refined
    and looks (emb) by frame_idx and cluster of the fused boxes; faces: frame_idx, det_id, score, box, eye_dist."""
    fused = suppress.confirmed(suppress.fuse(boxes, "frame_idx", [1.0, 1.0]), conf)
    persons = with_masks(fused, refined, boxes.where("src = 0"))
    people = persons.select("frame_idx", F.col("cluster").cast("long").alias("det_id"), "score", *_BOX)
    solid = persons.where(F.col("fill") > HOSTED).select("frame_idx", F.col("cluster").cast("long").alias("det_id"), "score", *_BOX)
    alone = gating.hosts(gating.gate(gating.plausible(faces, people), people, 0.75), solid, 0.08).where("host IS NULL")
    ref = people.join(shuffled(looks.select("frame_idx", F.col("cluster").cast("long").alias("det_id"), "emb")), ["frame_idx", "det_id"], "left").withColumn("kind", F.lit(PERSON))
    ref = ref.unionByName(alone.select("frame_idx", "det_id", "score", *_BOX, F.lit(None).cast("array<double>").alias("emb"), F.lit(FACE).alias("kind")))
    ref = frames.join(shuffled(ref), "frame_idx").withColumnRenamed("det_id", "ref_id")
    return remember(frames, ref)
