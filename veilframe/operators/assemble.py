"""The mask of every frame of a video, from detections to pixels: sampling, camera motion, tracking, holds and fades,
faces that follow their persons, and smoothing in time; and a whole pass over frames with detectors as hooks.

Boxes stay relational rows to the end; only the last step draws, frame after frame of a video. Masks are runs (masks.py)
from the first step to the last: a mask travels once, with the detection that brought it, and is the state of its track
from then on, blended over the frames that saw the track. Defined results: a frame without persons or faces has an empty
mask, and so has every frame of a video without detections; rows of frames that `frames` does not name are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.groups import matrix, whole_groups
from ..functions.runs import Greys, Masks
from ..functions.shared import beside, shuffled, spread
from . import frames as frame_ops
from . import gating, masks, motion
from .temporal import BLEND_NEW, BLEND_OLD, GREY_SET, follows
from .track import Tracker, track

_BOX = ("x1", "y1", "x2", "y2")
#: Frames after which a held track at the frame's edge is let go.
EDGE_LOST = 3


def grown(mask: np.ndarray, r: int) -> np.ndarray:
    """Pixels with a set pixel within r rows and columns."""
    if r <= 0:
        return mask
    for axis in (0, 1):
        n = mask.shape[axis]
        total = np.concatenate([np.zeros_like(mask.take([0], axis), np.int32), np.cumsum(mask, axis=axis, dtype=np.int32)], axis=axis)
        at = np.arange(n)
        mask = (total.take(np.minimum(at + r + 1, n), axis) - total.take(np.maximum(at - r, 0), axis) > 0).astype(np.uint8)
    return mask


def shrunk(mask: np.ndarray, r: int) -> np.ndarray:
    """Pixels whose neighbours within r rows and columns are all set; none lie outside the frame."""
    return 1 - grown(1 - mask, r) if r > 0 else mask


def moved(mask: np.ndarray, dx: int, dy: int) -> np.ndarray:
    h, w = mask.shape
    out = np.zeros_like(mask)
    if abs(dx) < w and abs(dy) < h:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def person_tracks(frames: DataFrame, persons: DataFrame, every: int, w: int, h: int, moves: DataFrame | None = None, **options) -> DataFrame:
    """Tracks of every frame from the persons of sampled ones, with how far a held mask is moved, grown and shrunk:
    video_id, frame_idx, track_id, score, box as last seen, shift_x, shift_y, grow, shrink, det_id, seen_at."""
    t = track(persons.where(F.col("frame_idx") % every == 0), frames, moves, **options)
    t = t.where(~((F.col("lost") > EDGE_LOST) & G.near_edge(G.box(), w, h)))
    held = F.col("frame_idx") % every != 0
    grow = F.when(held, G.hold_pixels(F.col("speed_x"), F.col("speed_y"), F.col("lost"))).otherwise(0).cast("long")
    shrink = G.fade_pixels(F.col("fade"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return t.select("video_id", "frame_idx", "track_id", "score", *_BOX, "shift_x", "shift_y", grow.alias("grow"), shrink.alias("shrink"), "det_id", "seen_at")


def following_faces(frames: DataFrame, faces: DataFrame, tracks: DataFrame, every: int, alone: float = 0.6) -> DataFrame:
    """Faces of every frame (frame_idx: struct of video and frame): of a sampled frame its own; of others those of the
    last sampled one, moved with the first person that holds them; less implausible ones and, below `alone`, those
    outside every person."""
    key = F.struct("video_id", "frame_idx")
    people = tracks.select(key.alias("frame_idx"), F.col("track_id").alias("det_id"), "score", "shift_x", "shift_y", *((F.col(c) + F.col("shift_" + c[0])).alias(c) for c in _BOX))
    at = frames.select("video_id", key.alias("key"), (F.col("frame_idx") - F.col("frame_idx") % every).alias("frame_idx"), (F.col("frame_idx") % every != 0).alias("held"))
    here = at.join(shuffled(faces), ["video_id", "frame_idx"]).select(F.col("key").alias("frame_idx"), "held", "det_id", "score", *_BOX, "eye_dist")
    hosted = gating.hosts(here, people, 0.0, "left", "shift_x", "shift_y")
    by = lambda c: F.when(F.col("held"), F.coalesce(F.col("host.p_shift_" + c[0]), F.lit(0.0))).otherwise(0.0)
    now = hosted.select("frame_idx", "det_id", "score", *((F.col(c) + by(c)).alias(c) for c in _BOX), "eye_dist")
    boxes = people.select("frame_idx", "det_id", "score", *_BOX)
    return gating.gate(gating.plausible(now, boxes), boxes, alone)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nearest whole numbers, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x).astype(np.int64)


PERSON, FACE, FRAME = 0, 1, -1


class Shown:
    """The masks of tracks as they stand at each of their rows, of rows sorted by video and frame: the blend of the masks
    of the sights up to that row. What a batch leaves is held for the tracks of its last video, of those seen not too long
    ago: their number, the frame they were last seen at, and their greys or, where the last mask alone decides, that."""

    def __init__(self, new: int, old: int, keep: int):
        self.new, self.old, self.keep, self.follows = new, old, keep, follows(new, old)
        none = np.zeros(0, np.int64)
        self.video, self.ids, self.seen = None, none, none
        self.held = Greys.of(Masks(*(none,) * 5))

    def step(self, video: np.ndarray, track: np.ndarray, at: np.ndarray, given: Masks, has: np.ndarray, now: int) -> tuple[np.ndarray, Masks]:
        """Which of the rows of tracks have a mask, in ascending order, and these masks. at: a row's frame, counted over all batches, which
        `now` ends; has: whether a sight brings a mask, of `given`."""
        n = len(video)
        order = np.lexsort((track, video))  # a track's rows stay in order
        video, track, sight = video[order], track[order], has[order]
        first = np.flatnonzero(np.concatenate([[True], (video[1:] != video[:-1]) | (track[1:] != track[:-1])])) if n else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        so_far = np.cumsum(sight)
        so_far -= (so_far[first] - sight[first])[of]  # sights of the track up to a row
        count = np.bincount(of, sight, len(first)).astype(np.int64)
        # a track's place among those held, or -1
        going = np.flatnonzero(video[first] == self.video) if self.video is not None else np.zeros(0, np.int64)
        before = np.full(len(first), -1)
        if len(going) and len(self.ids):
            place = np.minimum(np.searchsorted(self.ids, track[first][going]), len(self.ids) - 1)
            before[going] = np.where(self.ids[place] == track[first][going], place, -1)
        some = np.flatnonzero((so_far > 0) | (before[of] >= 0))
        last_at = np.full(len(first), -1)
        rows = np.flatnonzero(sight)
        np.maximum.at(last_at, of[rows], at[order][rows])
        stays = video[first] == video[-1] if n else np.zeros(0, bool)
        if self.follows:
            pool = Masks.joined([self.held.runs, given])
            latest = np.maximum.accumulate(np.where(sight, np.arange(n), -1))
            put = np.where(so_far > 0, len(self.ids) + order[latest], before[of])
            final = put[np.append(first[1:], n) - 1] if n else put
            greys = Greys.of(pool)
        else:
            # tracks with more sights come first; sights of all tracks are blended side by side, one of each after another
            rank = np.empty(len(first), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(first))
            turns = rows[np.lexsort((rank[of[rows]], so_far[rows]))]
            cuts = np.searchsorted(so_far[turns], np.arange(1, int(count.max(initial=0)) + 2)).tolist()
            sets, start, ends, ended = [self.held.above(GREY_SET)], [0, len(self.ids)], [], []
            for a, z in zip(cuts[:-1], cuts[1:]):
                who, masks_now = of[turns[a:z]], given.take(order[turns[a:z]])
                if not ends:  # the first sight: of a new track, or on what is held
                    old = np.flatnonzero(before[who] >= 0)
                    new = np.flatnonzero(before[who] < 0)
                    both = Greys.joined([self.held.take(before[who[old]]).blended(masks_now.take(old), self.new, self.old), Greys.of(masks_now.take(new))])
                    back = np.empty(len(who), np.int64)
                    back[np.concatenate([old, new])] = np.arange(len(who))
                    grey = both.take(back)
                else:
                    grey = grey.take(np.arange(z - a)).blended(masks_now, self.new, self.old)
                sets.append(grey.above(GREY_SET))
                start.append(start[-1] + z - a)
                done = np.flatnonzero((count[who] == len(sets) - 1) & stays[who])
                ends.append(grey.take(done))
                ended.append(who[done])
            pool = Masks.joined(sets)
            put = np.where(so_far > 0, np.array(start)[so_far] + rank[of], before[of])
            greys = Greys.joined([self.held, *ends])
            final = before.copy()
            got = np.concatenate([np.zeros(0, np.int64), *ended])
            final[got] = len(self.ids) + np.arange(len(got))
        back = np.argsort(order[some])
        shown = order[some][back], pool.take(put[some][back])
        # what is held from now on
        if n and (self.video is None or video[-1] != self.video):
            self.video, old = video[-1], np.zeros(0, np.int64)
        else:
            old = np.setdiff1d(np.arange(len(self.ids)), before[before >= 0])  # without a row here
        mine = np.flatnonzero(stays & (final >= 0))
        ids = np.concatenate([self.ids[old], track[first][mine]])
        seen = np.concatenate([self.seen[old], np.maximum(last_at[mine], np.where(before[mine] >= 0, np.append(self.seen, 0)[before[mine]], -1))])
        at_ = np.concatenate([old, final[mine]])
        keep = np.flatnonzero(now - seen <= self.keep + 1)
        keep = keep[np.argsort(ids[keep])]
        self.ids, self.seen, self.held = ids[keep], seen[keep], greys.take(at_[keep])
        return shown


def draw(rows: DataFrame, w: int, h: int, smooth: bool, blend: tuple[int, int] = (BLEND_NEW, BLEND_OLD), keep: int = 12) -> DataFrame:
    """(video_id, frame_idx, w, h, spans) of rows sorted by video, frame and kind: FRAME, a frame that there is; PERSON,
    a track, with spans where the frame saw it; FACE, spans as they are. Tracks may come back for `keep` frames.

    A track's state is its blended mask; where the weights let the last mask alone decide, that mask. All masks of a
    batch of frames are blended side by side, and moved, grown, shrunk and joined in one step."""
    new, old = blend

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown, clock, before = Shown(new, old, keep), 0, None
        for b, edges in whole_groups(batches, "video_id", "frame_idx"):
            ids, kind, track_id = (b.column(i).to_numpy() for i in (0, 2, 3))
            n = matrix(b, "shift_x", "shift_y", "grow", "shrink")
            n_rows = b.num_rows
            given = Masks.read(b.column(8), np.full(n_rows, w), np.full(n_rows, h))
            has = b.column(8).is_valid().to_numpy(zero_copy_only=False)
            at_frame = clock + np.searchsorted(edges, np.arange(n_rows), "right") - 1
            clock += len(edges) - 1
            people, faces = np.flatnonzero(kind == PERSON), np.flatnonzero(kind == FACE)
            some, drawn = shown.step(ids[people], track_id[people], at_frame[people], given.take(people), has[people], clock)
            people = people[some]
            move = _rounded(n[people, :2])
            drawn = drawn.moved(move[:, 0], move[:, 1])
            drawn = drawn.grown(n[people, 2].astype(np.int64)).shrunk(n[people, 3].astype(np.int64))
            frames_at = np.arange(len(edges) - 1)
            whose = np.searchsorted(edges, np.concatenate([edges[:-1], people, faces]), "right") - 1
            every = Masks.joined([Masks(np.full(len(frames_at), w), np.full(len(frames_at), h), *(np.zeros(0, np.int64),) * 3), drawn, given.take(faces)])
            order = np.argsort(whose, kind="stable")
            raw = every.take(order).grouped(np.searchsorted(whose[order], np.arange(len(frames_at) + 1)))
            out = raw
            first = edges[:-1]
            if smooth:
                key = ids[first]
                last = Masks(np.array([w]), np.array([h]), *(np.zeros(0, np.int64),) * 3) if before is None or before[0] != key[0] else before[1]
                carried = Masks.joined([last, raw]).take(frames_at)  # of each frame, the one before it
                same = np.concatenate([[True], key[1:] == key[:-1]])
                out = raw.union(carried.only(same[carried.of]).grown(np.ones(len(frames_at), np.int64)))
                before = (key[-1], raw.take(frames_at[-1:]))
            side = lambda v: pa.array(np.full(len(frames_at), v, np.int32))
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), side(w), side(h), out.write()], names=["video_id", "frame_idx", "w", "h", "spans"])

    return rows.mapInArrow(run, "video_id long, frame_idx long, w int, h int, spans array<int>")


def assemble(frames: DataFrame, persons: DataFrame, faces: DataFrame, w: int, h: int, every: int = 1, moves: DataFrame | None = None, face_expand: int = 12, smooth: bool = True, blend: tuple[int, int] = (BLEND_NEW, BLEND_OLD), **options) -> DataFrame:
    """(video_id, frame_idx, w, h, spans) of every frame.

    frames: video_id, frame_idx; persons: those, det_id, score, box and, where there is one, spans, or mask (w * h
    bytes); else the box is filled; faces: video_id, frame_idx, det_id, score, box, eye_dist (null: unknown); moves: the
    camera's motion. Detections count on every `every`th frame alone. blend: weights, of 256, of a track's new mask and
    of its masks before."""
    if "mask" in persons.columns:
        persons = masks.from_planes(persons, w, h)
    tracks = person_tracks(frames, persons, every, w, h, moves, **options)
    shown = following_faces(frames, faces, tracks, every)
    box = masks.rectangle(*G.rect_span(G.box(), 0.0, w, h), w, h)
    own = F.coalesce("_spans", box) if "spans" in persons.columns else box
    fresh = F.col("seen_at") == F.col("frame_idx")
    if "spans" in persons.columns:
        # a mask meets its track once, on the frame that saw it
        brought = persons.select("video_id", "frame_idx", "det_id", F.col("spans").alias("_spans"))
        tracks = tracks.withColumn("det_id", F.when(fresh, F.col("det_id"))).join(shuffled(brought), ["video_id", "frame_idx", "det_id"], "left")
    people = tracks.select("video_id", "frame_idx", F.lit(PERSON).alias("kind"), "track_id", "shift_x", "shift_y", "grow", "shrink", F.when(fresh, own).alias("spans"))
    none = lambda kind: (F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("track_id"), F.lit(0.0).alias("shift_x"), F.lit(0.0).alias("shift_y"), F.lit(0).cast("long").alias("grow"), F.lit(0).cast("long").alias("shrink"))
    ex = G.face_margin(F.col("x2") - F.col("x1"), F.col("eye_dist"), face_expand)
    spans = shown.select(F.col("frame_idx.video_id").alias("video_id"), F.col("frame_idx.frame_idx").alias("frame_idx"), *_BOX, ex.alias("ex"))
    rows = people.unionByName(spans.select("video_id", "frame_idx", *none(FACE), masks.rectangle(*G.face_span(G.box(), F.col("ex"), face_expand, w, h), w, h).alias("spans")))
    rows = rows.unionByName(frames.select("video_id", "frame_idx", *none(FRAME), F.lit(None).cast("array<int>").alias("spans")))
    return draw(spread(rows, "video_id").sortWithinPartitions("video_id", "frame_idx", "kind", "track_id"), w, h, smooth, blend, options.get("max_lost", Tracker.max_lost))


def hide_video(video: DataFrame, w: int, h: int, detect: Callable[[DataFrame], DataFrame], find_faces: Callable[[DataFrame], DataFrame], style: str = "mosaic", size: int = 24, compose: Callable[[DataFrame], DataFrame] | None = None, follow_camera: bool = False, **options) -> DataFrame:
    """video (video_id, frame_idx, w, h, nv12) with persons and faces hidden; its masks are stored once in the shared folder.

    Hooks: detect and find_faces take sampled frames and give boxes as assemble() reads them; compose, if given,
    takes frames with their mask instead of the style."""
    every = options.get("every", 1)
    sampled = video.where(F.col("frame_idx") % every == 0)
    moves = None
    if follow_camera:
        moves = motion.motions(video.select("video_id", "frame_idx", "w", "h", F.expr("substring(nv12, 1, w * h)").alias("luma")))
    made = assemble(video.select("video_id", "frame_idx"), detect(sampled), find_faces(sampled), w, h, moves=moves, **options)
    both = masks.with_planes(beside(video, made.select("video_id", "frame_idx", "spans"), ("video_id", "frame_idx")))
    return compose(both) if compose else frame_ops.apply(both, style, size)
