"""Linking observations to remembered instances by overlap and appearance, one to one, best pairs first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import matrix, whole_groups
from ..functions.shared import spread

APPEARANCE, LEAST, MOST_MISSED = 0.4, 0.30, 8
#: Pairs whose vectors are held at a time.
PAIRS = 1 << 15


def _vectors(emb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; -1 for those that are null or hold a null."""
    emb = emb.cast(pa.list_(pa.float64()))
    n = emb.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat, of = emb.flatten(), np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    length = n.copy()
    length[~emb.is_valid().to_numpy(zero_copy_only=False)] = -1
    length[of[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, length


def scores(boxes: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Overlap and likeness of pairs of rows; vectors that can't be compared are not alike."""
    out = np.empty(len(i))
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    side = lambda x: np.maximum(x[:, 2] - x[:, 0], 0.0) * np.maximum(x[:, 3] - x[:, 1], 0.0)
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], k[at : at + PAIRS]
        a, b = boxes[x], boxes[y]
        both = np.maximum(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0.0) * np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0.0)
        union, n = side(a) + side(b) - both, norm[x] * norm[y]
        known = (lengths[x] == lengths[y]) & (lengths[x] >= 0) & ~(n <= 0)
        alike = np.clip((vectors[x] * vectors[y]).sum(axis=1) / np.where(known, n, 1.0), -1.0, 1.0)
        out[at : at + PAIRS] = np.where(union > 0, both / np.where(union > 0, union, 1.0), 0.0) * (1 - APPEARANCE) + np.where(known, np.maximum(alike, 0.0), 0.0) * APPEARANCE
    return out


def link(refs: DataFrame, memory: DataFrame) -> DataFrame:
    """(frame_idx, ref_id, inst_id, score) of one-to-one links. refs: frame_idx, ref_id, box, emb; memory: the same with
    inst_id and missed. Pairs are made in the tasks, some whole frames at a time, and a frame's pairs over the bound are
    gone through from the best on, each once."""
    rows = lambda df, is_ref, name: spread(df.where("frame_idx IS NOT NULL").select("frame_idx", F.lit(is_ref).alias("is_ref"), F.col(name).alias("id"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("emb").cast("array<double>").alias("emb")), "frame_idx")
    both = rows(refs, True, "ref_id").unionByName(rows(memory.where(F.col("missed") <= MOST_MISSED), False, "inst_id"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b, edges in whole_groups(batches, "frame_idx"):
            is_ref = b.column(1).to_numpy(zero_copy_only=False)
            boxes = matrix(b, "x1", "y1", "x2", "y2")
            vectors, lengths = _vectors(b.column(7))
            ids = b.column(2).to_pylist()
            frames = np.append(edges[edges < b.num_rows], b.num_rows).tolist()
            i, k = [], []
            for a, z in zip(frames[:-1], frames[1:]):
                own, other = a + np.flatnonzero(is_ref[a:z]), a + np.flatnonzero(~is_ref[a:z])
                i.append(np.repeat(own, len(other)))
                k.append(np.tile(other, len(own)))
            i, k = np.concatenate(i), np.concatenate(k)
            s = scores(boxes, vectors, lengths, i, k)
            over = np.flatnonzero((s > LEAST) | np.isnan(s))
            i, k, s = i[over], k[over], s[over]
            frame = np.searchsorted(frames, i, "right")
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            best = np.lexsort((rank[k], rank[i], -s, frame))
            taken, kept = set(), []
            for at, f, x, y in zip(best.tolist(), frame[best].tolist(), i[best].tolist(), k[best].tolist()):
                one, two = (f, True, ids[x]), (f, False, ids[y])
                if one not in taken and two not in taken:
                    taken |= {one, two}
                    kept.append(at)
            i, k = pa.array(i[kept], pa.int64()), pa.array(k[kept], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(2).take(i), b.column(2).take(k), pa.array(s[kept], pa.float64())], names=["frame_idx", "ref_id", "inst_id", "score"])

    kind = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = f"frame_idx {kind['frame_idx']}, ref_id {kind['id']}, inst_id {kind['id']}, score double"
    return spread(both, "frame_idx").sortWithinPartitions("frame_idx").mapInArrow(run, schema)
