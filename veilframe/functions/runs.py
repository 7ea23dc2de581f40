"""Masks as sorted runs of set pixels, many masks a step, in numpy.

A run is a half-open range lo..hi of places y * w + x. All masks of a batch stand behind one another on one line with a
gap between them, so that an operation is one sort or sweep over the runs of all of them, and costs what the runs are,
not the pixels. Work along columns sets rows apart by one more place, so that runs don't join across them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in any order, joined where they meet or touch, in order; empty ones go."""
    real = hi > lo
    if not real.all():
        lo, hi = lo[real], hi[real]
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > top[:-1]]))
    return lo[first], top[np.append(first[1:], len(lo)) - 1]


def swept(a: tuple, b: tuple, rule: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ranges where rule(inside a, inside b) holds; it must not hold outside both."""
    at = np.concatenate([a[0], a[1], b[0], b[1]])
    n, m = len(a[0]), len(b[0])
    step = np.zeros((2, len(at)), np.int32)
    step[0, :n], step[0, n : 2 * n] = 1, -1
    step[1, 2 * n : 2 * n + m], step[1, 2 * n + m :] = 1, -1
    order = np.argsort(at, kind="stable")
    at, depth = at[order], np.cumsum(step[:, order], axis=1)
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
    at, inside = at[last], rule(depth[0, last] > 0, depth[1, last] > 0)
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    return at[turn[::2]], at[turn[1::2]]


class Masks:
    """n masks: sizes w, h [n], and runs lo, hi of mask `of` [runs], in order."""

    def __init__(self, w: np.ndarray, h: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.w, self.h, self.of, self.lo, self.hi = w, h, of, lo, hi

    @classmethod
    def read(cls, bounds: pa.ListArray, w: np.ndarray, h: np.ndarray) -> Masks:
        """From arrays lo, hi, lo, hi, ... in any order, clipped to the frame; null: an empty mask."""
        flat = bounds.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = pc.fill_null(pc.list_value_length(bounds), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        w, h = np.asarray(w, np.int64), np.asarray(h, np.int64)
        of = np.repeat(np.arange(len(n)), n)
        size = (w * h)[of]
        return cls(w, h, of, np.clip(flat[::2], 0, size), np.clip(flat[1::2], 0, size)).clean()

    def write(self) -> pa.ListArray:
        out = np.empty(2 * len(self.lo), np.int32)
        out[::2], out[1::2] = self.lo, self.hi
        ends = np.concatenate([[0], np.cumsum(2 * np.bincount(self.of, minlength=len(self.w)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))

    @classmethod
    def planes(cls, planes: list[np.ndarray]) -> Masks:
        """From planes [h, w] of zeros and others."""
        w, h = np.array([p.shape[1] for p in planes], np.int64), np.array([p.shape[0] for p in planes], np.int64)
        of, lo, hi = [], [], []
        for i, p in enumerate(planes):
            turn = np.flatnonzero(np.diff(np.concatenate([[0], (p.ravel() != 0).view(np.int8), [0]])))
            lo.append(turn[::2])
            hi.append(turn[1::2])
            of.append(np.full(len(turn) // 2, i))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(w, h, join(of), join(lo), join(hi))

    def plane(self, i: int) -> np.ndarray:
        """Mask i as a plane [h, w] of 0 and 1."""
        a, z = np.searchsorted(self.of, [i, i + 1])
        turn = np.zeros(int(self.w[i] * self.h[i]) + 1, np.int8)
        turn[self.lo[a:z]] += 1
        turn[self.hi[a:z]] -= 1
        return np.cumsum(turn[:-1], dtype=np.int8).view(np.uint8).reshape(int(self.h[i]), int(self.w[i]))

    def crop(self, i: int) -> tuple[int, int, np.ndarray]:
        """(x, y, plane) of the smallest rectangle that holds mask i."""
        one = self.take(np.array([i]))
        x1, y1, x2, y2 = one.box()[0].tolist()
        _, y, a, z = one.rows()
        turn = np.zeros((y2 - y1, x2 - x1 + 1), np.int8)
        np.add.at(turn, (y - y1, a - x1), 1)
        np.add.at(turn, (y - y1, z - x1), -1)
        return x1, y1, np.cumsum(turn[:, :-1], axis=1, dtype=np.int8).view(np.uint8)

    @classmethod
    def of_crop(cls, x: int, y: int, plane: np.ndarray, w: int, h: int) -> Masks:
        """One mask from a plane at x, y in a frame."""
        small = cls.planes([plane])
        of, row, a, z = small.rows()
        return cls(np.array([w]), np.array([h]), of, np.zeros(0), np.zeros(0))._of_rows(of, row + y, a + x, z + x)

    # one line for all masks

    def _base(self) -> np.ndarray:
        size = self.w * self.h + 1
        return np.cumsum(size) - size

    def _line(self) -> tuple[np.ndarray, np.ndarray]:
        base = self._base()[self.of]
        return self.lo + base, self.hi + base

    def _off_line(self, lo: np.ndarray, hi: np.ndarray) -> Masks:
        base = self._base()
        of = np.searchsorted(base, lo, "right") - 1
        return Masks(self.w, self.h, of, lo - base[of], hi - base[of])

    def clean(self) -> Masks:
        return self._off_line(*merged(*self._line()))

    def _runs_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of masks of these numbers, in this order, and how many each has."""
        n = np.bincount(self.of, minlength=len(self.w))
        first = np.cumsum(n) - n
        k = n[rows]
        return np.repeat(first[rows] - (np.cumsum(k) - k), k) + np.arange(k.sum()), k

    def take(self, rows: np.ndarray) -> Masks:
        """Masks of these numbers, in this order."""
        at, k = self._runs_of(rows)
        return Masks(self.w[rows], self.h[rows], np.repeat(np.arange(len(rows)), k), self.lo[at], self.hi[at])

    def only(self, runs: np.ndarray) -> Masks:
        """The same masks with these runs of theirs alone."""
        return Masks(self.w, self.h, self.of[runs], self.lo[runs], self.hi[runs])

    @classmethod
    def joined(cls, parts: list[Masks]) -> Masks:
        """Masks of several lots, one lot after the other."""
        n = np.cumsum([0, *(len(p.w) for p in parts)])
        pick = lambda f: np.concatenate([f(p) for p in parts]) if parts else np.zeros(0, np.int64)
        return cls(pick(lambda p: p.w), pick(lambda p: p.h), np.concatenate([p.of + k for p, k in zip(parts, n)]) if parts else np.zeros(0, np.int64), pick(lambda p: p.lo), pick(lambda p: p.hi))

    def grouped(self, edges: np.ndarray) -> Masks:
        """The union of masks edges[i] to edges[i + 1], for each i; sizes are those of the first."""
        to = np.searchsorted(edges, np.arange(len(self.w)), "right") - 1
        return Masks(self.w[edges[:-1]], self.h[edges[:-1]], to[self.of], self.lo, self.hi).clean()

    def _swept(self, other: Masks, rule) -> Masks:
        return self._off_line(*swept(self._line(), Masks(self.w, self.h, other.of, other.lo, other.hi)._line(), rule))

    def union(self, other: Masks) -> Masks:
        return self._swept(other, np.logical_or)

    def minus(self, other: Masks) -> Masks:
        return self._swept(other, lambda a, b: a & ~b)

    def both(self, other: Masks) -> Masks:
        return self._swept(other, np.logical_and)

    def rest(self) -> Masks:
        """What is not set."""
        n = np.arange(len(self.w))
        return Masks(self.w, self.h, n, np.zeros(len(n), np.int64), self.w * self.h).minus(self)

    # rows

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(mask, y, x1, x2): runs cut at the ends of rows."""
        w = self.w[self.of]
        y1, y2 = self.lo // w, (self.hi - 1) // w
        n = y2 - y1 + 1
        of, wide = np.repeat(self.of, n), np.repeat(w, n)
        y = np.repeat(y1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x1 = np.maximum(np.repeat(self.lo, n) - y * wide, 0)
        return of, y, x1, np.minimum(np.repeat(self.hi, n) - y * wide, wide)

    def _of_rows(self, of, y, x1, x2) -> Masks:
        """From pieces of rows in any order, those outside cut off."""
        x1, x2 = np.maximum(x1, 0), np.minimum(x2, self.w[of])
        real = (x2 > x1) & (y >= 0) & (y < self.h[of])
        of, y, x1, x2 = of[real], y[real], x1[real], x2[real]
        return Masks(self.w, self.h, of, y * self.w[of] + x1, y * self.w[of] + x2).clean()

    def moved(self, dx: np.ndarray, dy: np.ndarray) -> Masks:
        """Mask i moved by dx[i], dy[i]; what leaves the frame is lost."""
        if not (dx.any() or dy.any()):
            return self
        of, y, x1, x2 = self.rows()
        return self._of_rows(of, y + dy[of], x1 + dx[of], x2 + dx[of])

    def grown(self, r: np.ndarray) -> Masks:
        """Pixels of mask i with a set pixel within r[i] rows and columns. Rows go up and down by a step that triples."""
        if not (r > 0).any():
            return self
        r = np.maximum(r, 0)
        of, y, x1, x2 = self.rows()
        x1, x2 = np.maximum(x1 - r[of], 0), np.minimum(x2 + r[of], self.w[of])
        pitch = self.w + 1
        size = pitch * (self.h + 2 * r) + 1  # with room for rows above and below the frame
        base = np.cumsum(size) - size
        at = base[of] + (y + r[of]) * pitch[of]
        lo, hi = merged(at + x1, at + x2)
        done = np.zeros(len(self.w), np.int64)
        while (step := np.minimum(2 * done + 1, r - done)).max(initial=0) > 0:
            of = np.searchsorted(base, lo, "right") - 1
            on = step[of] > 0
            move = (step * pitch)[of][on]
            lo, hi = merged(np.concatenate([lo, lo[on] - move, lo[on] + move]), np.concatenate([hi, hi[on] - move, hi[on] + move]))
            done += step
        of = np.searchsorted(base, lo, "right") - 1
        y, x = np.divmod(lo - base[of], pitch[of])
        return self._of_rows(of, y - r[of], x, x + hi - lo)

    def shrunk(self, r: np.ndarray) -> Masks:
        """Pixels of mask i whose neighbours within r[i] rows and columns are all set; none lie outside the frame."""
        return self.rest().grown(r).rest() if (r > 0).any() else self

    # numbers

    def area(self) -> np.ndarray:
        return np.bincount(self.of, self.hi - self.lo, len(self.w)).astype(np.int64)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of x and of y over set pixels."""
        of, y, x1, x2 = self.rows()
        n = len(self.w)
        return np.bincount(of, (x1 + x2 - 1) * (x2 - x1) // 2, n).astype(np.int64), np.bincount(of, y * (x2 - x1), n).astype(np.int64)

    def box(self) -> np.ndarray:
        """[n, 4]: half-open box of the set pixels; zeros for an empty mask."""
        of, y, x1, x2 = self.rows()
        out = np.zeros((len(self.w), 4), np.int64)
        if len(of):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            who = of[first]
            for k, (f, v) in enumerate(((np.minimum, x1), (np.minimum, y), (np.maximum, x2), (np.maximum, y + 1))):
                out[who, k] = f.reduceat(v, first)
        return out

    # the file form: a count of runs, then each run's length (32 bits, little-endian) and value (8 bits)

    _RUN = np.dtype([("len", "<u4"), ("val", "u1")])

    def files(self) -> list[bytes]:
        """Each mask in its file form: runs of set and unset pixels in turn, none empty."""
        out, ends = [], np.searchsorted(self.of, np.arange(len(self.w) + 1))
        for i, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            at = np.empty(2 * (z - a) + 2, np.int64)
            at[0], at[-1] = 0, self.w[i] * self.h[i]
            at[1:-1:2], at[2:-1:2] = self.lo[a:z], self.hi[a:z]
            size = np.diff(at)
            rows = np.zeros(len(size), self._RUN)
            rows["len"], rows["val"] = size, np.arange(len(size)) % 2
            rows = rows[size > 0]
            out.append(np.uint32(len(rows)).tobytes() + rows.tobytes())
        return out

    @classmethod
    def from_files(cls, data: list[bytes | None], w: np.ndarray, h: np.ndarray) -> tuple[Masks, np.ndarray]:
        """Masks and whether each file is whole: its length fits its count, values are 0 or 1, lengths cover the frame.
        What is not whole is an empty mask."""
        w, h = np.asarray(w, np.int64), np.asarray(h, np.int64)
        good = np.zeros(len(data), bool)
        of, lo, hi = [], [], []
        for i, x in enumerate(data):
            if x is None or len(x) < 4 or (len(x) - 4) % 5 or int.from_bytes(x[:4], "little") != (len(x) - 4) // 5:
                continue
            rows = np.frombuffer(x, cls._RUN, offset=4)
            end = np.cumsum(rows["len"], dtype=np.int64)
            if (rows["val"] > 1).any() or (end[-1] if len(end) else 0) != w[i] * h[i]:
                continue
            good[i] = True
            on = rows["val"] == 1
            of.append(np.full(on.sum(), i))
            lo.append((end - rows["len"])[on])
            hi.append(end[on])
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(w, h, join(of), join(lo), join(hi)).clean(), good


class Greys:
    """n grey masks of 0 to 255: runs of masks [n], each of one value [runs] above zero, in order; runs may touch."""

    def __init__(self, runs: Masks, value: np.ndarray):
        self.runs, self.value = runs, value

    @classmethod
    def of(cls, masks: Masks) -> Greys:
        """What is set is 255."""
        return cls(masks, np.full(len(masks.lo), 255))

    def take(self, rows: np.ndarray) -> Greys:
        return Greys(self.runs.take(rows), self.value[self.runs._runs_of(rows)[0]])

    @classmethod
    def joined(cls, parts: list[Greys]) -> Greys:
        return cls(Masks.joined([p.runs for p in parts]), np.concatenate([p.value for p in parts]))

    def blended(self, now: Masks, new: int, old: int) -> Greys:
        """(255 * new where now sets + grey * old) // 256, for masks of the same sizes."""
        was = self.runs
        (a, b), (c, d) = was._line(), Masks(was.w, was.h, now.of, now.lo, now.hi)._line()
        at = np.concatenate([a, b, c, d])
        step = np.zeros((2, len(at)), np.int64)
        step[0, : len(a)], step[0, len(a) : 2 * len(a)] = self.value, -self.value
        step[1, 2 * len(a) : 2 * len(a) + len(c)], step[1, 2 * len(a) + len(c) :] = 1, -1
        order = np.argsort(at, kind="stable")
        at, (grey, inside) = at[order], np.cumsum(step[:, order], axis=1)
        last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
        at, value = at[last], ((inside[last] > 0) * (255 * new) + grey[last] * old) >> 8 & 255
        turn = np.flatnonzero(np.diff(value, prepend=0))  # the last value is zero
        at, value = at[turn], value[turn]
        on = np.flatnonzero(value > 0)
        return Greys(was._off_line(at[on], at[on + 1]), value[on])

    def above(self, least: int) -> Masks:
        """Masks of what is `least` or more."""
        return self.runs.only(self.value >= least).clean()
