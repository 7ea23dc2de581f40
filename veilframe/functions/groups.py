"""Whole groups out of Arrow batches that are sorted by a key: many groups a step, none held longer than it is needed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, edges): rows of whole groups in a row, group i from edges[i] to edges[i + 1].

    The last group of a batch waits for the next one. Keys are numbers without nulls."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if rest is not None:
            b = joined(rest, b)
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            x = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change |= x[1:] != x[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1])
        rest = b.slice(int(edges[-1]))
        if len(edges) > 1:
            yield b.slice(0, int(edges[-1])), edges
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows: what is made of a batch of pictures is held for a piece of it alone."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def joined(first: pa.RecordBatch, second: pa.RecordBatch) -> pa.RecordBatch:
    """Two batches as one, which may hold over 2 GiB of bytes in a column."""
    table = pa.Table.from_batches([first, second.cast(first.schema)]).combine_chunks()
    if len(found := table.to_batches()) > 1:  # offsets of 32 bits don't reach that far
        table = table.cast(pa.schema([f.with_type(_WIDE.get(f.type, f.type)) for f in table.schema])).combine_chunks()
        found = table.to_batches()
    if len(found) != 1:
        raise MemoryError("rows of one group can't stand in one batch")
    return found[0]


_WIDE = {pa.binary(): pa.large_binary(), pa.string(): pa.large_string()}


def matrix(b: pa.RecordBatch, *names: str) -> np.ndarray:
    """Columns of numbers side by side [rows, names]; nulls are NaN."""
    return np.stack([b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of box rows a [..., n, 4] with b [m, 4]: [n, m]; 0 where neither has an area."""
    w = np.maximum(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0)
    h = np.maximum(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0)
    side = lambda r: np.maximum(r[:, 2] - r[:, 0], 0) * np.maximum(r[:, 3] - r[:, 1], 0)
    union = side(a)[:, None] + side(b)[None] - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of box rows a [n, 4] with b [n, 4], one by one; 0 where neither has an area."""
    w = np.maximum(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0)
    h = np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0)
    side = lambda r: np.maximum(r[:, 2] - r[:, 0], 0) * np.maximum(r[:, 3] - r[:, 1], 0)
    union = side(a) + side(b) - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., n[i] of them, for one i after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
