"""Greedy duplicate suppression and fusion of boxes, a frame at a time in score order.

A frame holds a few hundred boxes at most (detectors cap them), so a group is bounded by the frame;
frames spread over the cluster by their key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..functions.groups import matrix, overlaps, paired, ranges, whole_groups
from ..functions.shared import spread

_BOX = ("x1", "y1", "x2", "y2")
#: Pairs of boxes a frame up to which the frames of a batch are fused side by side.
FEW_PAIRS = 256


def by_score(*fields: str) -> Column:
    """A frame's boxes as structs, best score first and then by det_id."""
    return F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "det_id", "score", *_BOX, *fields))), lambda b: F.struct(*(b[n].alias(n) for n in ("det_id", "score", *_BOX, *fields))))


def greedy(boxes: Column, max_iou: float, most: int | None = None) -> Column:
    """Boxes, best first, that overlap none already kept by more than max_iou; at most `most`."""

    def step(kept: Column, b: Column) -> Column:
        free = F.forall(kept, lambda k: iou(box(struct=k), box(struct=b)) <= max_iou)
        if most is not None:
            free = (F.size(kept) < most) & free
        return F.when(free, F.concat(kept, F.array(b))).otherwise(kept)

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)


def _sorted(boxes: DataFrame, keys: tuple[str, ...], *fields: str) -> DataFrame:
    """Rows by keys, best score first, a key's rows in one partition: what the steps over whole groups read."""
    rows = boxes.select(*keys, "det_id", *fields, "score", *_BOX)
    return spread(rows, *keys).sortWithinPartitions(*keys, F.desc("score"), "det_id")


def suppress(boxes: DataFrame, key: str, max_iou: float, most: int | None = 300) -> DataFrame:
    """The boxes of each key that survive: (key, det_id, score, x1, y1, x2, y2).

    The same rule as greedy(), over Arrow batches of many frames: one matrix of overlaps a frame
    instead of an interpreted fold over pairs."""

    def keep(batches):
        for b, edges in whole_groups(batches, key):
            xy, kept = matrix(b, *_BOX), []
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                over = overlaps(xy[a:z], xy[a:z]) > max_iou
                free, n = np.ones(z - a, bool), 0
                for i in range(z - a):
                    if free[i]:
                        kept.append(a + i)
                        n += 1
                        if n == most:
                            break
                        free &= ~over[i]
            yield b.take(pa.array(kept, pa.int64()))

    rows = _sorted(boxes, (key,))
    return rows.mapInArrow(keep, rows.schema)


def fuse(boxes: DataFrame, key: str | tuple[str, ...], weights: list[float], min_iou: float = 0.55) -> DataFrame:
    """Weighted fusion of boxes of several sources (column src: 0, 1, ...).

    In score order a box joins the first cluster whose mean box it overlaps by min_iou; a second box of
    a source in a cluster is dropped. A cluster's box is the weighted mean of its members, its score the
    weighted sum over the weight of all sources. (key or keys, cluster, score, votes, best_score, best_src, box)"""
    keys = (key,) if isinstance(key, str) else key
    total = float(sum(weights))

    share = np.array(weights, float)

    def cluster(xy: np.ndarray, score: np.ndarray, src: np.ndarray) -> tuple:
        n = len(xy)
        weight, own = share[src], share[src][:, None] * xy
        # a cluster of one box is that box: its overlaps with all others are found at once, those of larger ones as they grow
        alone = own / weight[:, None]
        near: dict[int, list[int]] = {}
        for i, j in np.argwhere(np.tril(overlaps(alone, xy).T >= min_iou, -1)).tolist():
            near.setdefault(i, []).append(j)
        sums, mean, mass, best, best_src = own.copy(), alone.copy(), weight * score, np.where(score > 0, score, 0.0), np.where(score > 0, src, 0).astype(np.int32)
        number, heads, grown, members = np.full(n, -1), [], [], {}
        for i in range(n):
            # boxes that begin a cluster are those of heads; of the ones that still stand alone the first near one counts
            hits = [j for j in near.get(i, ()) if number[j] >= 0 and j not in members]
            if grown:
                some = np.flatnonzero(overlaps(mean[grown], xy[i][None])[:, 0] >= min_iou)
                hits += [grown[k] for k in some.tolist()]
            if not hits:
                number[i] = len(heads)
                heads.append(i)
                continue
            at, k = min(hits), int(src[i])
            seen = members.get(at) or {int(src[at])}
            if k in seen:
                continue
            if at not in members:
                grown.append(at)
            members[at] = seen | {k}
            sums[at] += own[i]
            weight[at] += share[k]
            mass[at] += share[k] * score[i]
            mean[at] = sums[at] / weight[at]
            if score[i] >= best[at] and score[i] > 0:
                best[at], best_src[at] = score[i], k
        h = np.array(heads, np.int64)
        return np.arange(len(h), dtype=np.int32), mass[h] / total, np.array([len(members.get(x, (0,))) for x in heads], np.int32), best[h], best_src[h], *mean[h].T

    def side_by_side(xy: np.ndarray, score: np.ndarray, src: np.ndarray, edges: np.ndarray) -> tuple:
        """The same for the frames between edges: the first boxes of all, then the second ones, and so on. Clusters stand at their first box's row."""
        n = np.diff(edges)
        weight, own = share[src], share[src][:, None] * xy
        sums, mean, mass, best, best_src = own.copy(), own / weight[:, None], weight * score, np.where(score > 0, score, 0.0), np.where(score > 0, src, 0).astype(np.int32)
        head, seen = np.zeros(len(xy), bool), np.zeros((len(xy), len(share)), bool)
        for t in range(int(n.max(initial=0))):
            rows = edges[:-1][n > t] + t
            j = ranges(rows - t, np.full(len(rows), t))
            i = np.repeat(rows, t)
            on = np.flatnonzero(head[j])
            on = on[paired(mean[j[on]], xy[i[on]]) >= min_iou]
            i, first = np.unique(i[on], return_index=True)  # the first cluster that is near
            at, k = j[on[first]], src[i]
            begins = np.setdiff1d(rows, i, assume_unique=True)
            head[begins], seen[begins, src[begins]] = True, True
            new = ~seen[at, k]
            i, at, k = i[new], at[new], k[new]
            seen[at, k] = True
            sums[at] += own[i]
            weight[at] += share[k]
            mass[at] += share[k] * score[i]
            mean[at] = sums[at] / weight[at][:, None]
            better = (score[i] >= best[at]) & (score[i] > 0)
            best[at[better]], best_src[at[better]] = score[i[better]], k[better]
        h = np.flatnonzero(head)
        count = np.diff(np.searchsorted(h, edges))
        return h, ranges(np.zeros(len(count), np.int64), count).astype(np.int32), mass[h] / total, seen[h].sum(axis=1).astype(np.int32), best[h], best_src[h], *mean[h].T

    def run(batches):
        for b, edges in whole_groups(batches, *keys):
            xy, score, src = matrix(b, *_BOX), matrix(b, "score")[:, 0], matrix(b, "src")[:, 0].astype(int)
            if (np.diff(edges) ** 2).sum() <= FEW_PAIRS * (len(edges) - 1):
                h, *found = side_by_side(xy, score, src, edges)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(h)) for c in range(len(keys))), *map(pa.array, found)], names=names)
                continue
            found = [cluster(xy[a:z], score[a:z], src[a:z]) for a, z in zip(edges[:-1], edges[1:])]
            first = np.repeat(edges[:-1], [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(first)) for c in range(len(keys))), *(pa.array(np.concatenate(c)) for c in zip(*found))], names=names)

    rows = _sorted(boxes, keys, "src")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, cluster int, score double, votes int, best_score double, best_src int, x1 double, y1 double, x2 double, y2 double"
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def confirmed(fused: DataFrame, conf: float) -> DataFrame:
    """Fused boxes that two sources saw, or that score well enough for one."""
    return fused.where((F.col("votes") >= 2) | (F.col("score") >= 0.10) | (F.col("best_score") >= 0.6 * conf))
