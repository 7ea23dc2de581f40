"""A bidirectional gated recurrent network with attention pooling over words, in numpy.

A word's input is the sum of its own embedding (hashed) and the mean embedding of its character n-grams (hashed), so an
unseen word is read by its letters. Both directions run over a window of words; attention weighs the states of all its
places into one vector, and a linear head makes a logit of it. Arrays are laid out [place, unit, window].
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import hash_words, mix

WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, ATTENTION = 1 << 14, 1 << 14, 12, 8, 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 32, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word's own embedding, rows of all words' n-grams end to end, n-grams of each word). Words are UTF-8
    with a mark before and after; every word has an n-gram at least."""
    n = len(words)
    words = words.cast(pa.large_string())
    own = (hash_words(words) % np.uint64(WORD_ROWS)).astype(np.int64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
    size = np.diff(at)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    first = np.cumsum(size + 2) - (size + 2)
    marked = np.full(int((size + 2).sum()) + max(GRAMS), 2, np.uint64)
    marked[first + size + 1] = 3
    inside = np.arange(len(raw)) + np.repeat(first + 1 - (at[:-1] - at[0]), size)
    marked[inside] = raw
    made = [np.maximum(size + 2 - g + 1, 1 if g == GRAMS[0] else 0) for g in GRAMS]
    total = sum(made)
    behind = np.cumsum(total) - total
    rows = np.empty(int(total.sum()), np.int64)
    h = np.zeros(len(marked), np.uint64)
    for k in range(GRAMS[0] - 1):
        h[: len(h) - k] = h[: len(h) - k] * np.uint64(257) + marked[k:]
    for g, m in zip(GRAMS, made):  # the hash at a place grows by one byte from length to length
        h[: len(h) - g + 1] = h[: len(h) - g + 1] * np.uint64(257) + marked[g - 1 :]
        before = np.cumsum(m) - m
        k = np.arange(m.sum())
        start = np.repeat(first - before, m) + k
        rows[np.repeat(behind - before, m) + k] = mix(h[start] * _ODD + np.uint64(g)) % np.uint64(CHAR_ROWS)
        behind = behind + m
    return own, rows, total


def windows(lengths: np.ndarray, width: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all overlapping windows over texts of these many words; a text has one at least,
    and its last words are in one, so every word is read."""
    n = np.maximum(1, -(-(lengths - width) // stride) + 1)
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = k * stride
    return doc, start, np.minimum(width, lengths[doc] - start)


class BiGRU:
    FIELDS = ("word", "char", "X", "bx", "Uf", "Ub", "A", "a", "v", "w", "b")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.w = arrays

    @classmethod
    def start(cls, seed: int = 7, dtype=np.float32) -> BiGRU:
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(dtype)
        D, H, K = DIM, HIDDEN, ATTENTION
        return cls({"word": f(WORD_ROWS, D, k=0.1), "char": f(CHAR_ROWS, D, k=0.3), "X": f(6 * H, D, k=D**-0.5), "bx": np.zeros((6 * H, 1), dtype), "Uf": f(3 * H, H, k=H**-0.5), "Ub": f(3 * H, H, k=H**-0.5), "A": f(K, 2 * H, k=(2 * H) ** -0.5), "a": np.zeros((K, 1), dtype), "v": f(K, k=K**-0.5), "w": f(2 * H, k=(2 * H) ** -0.5), "b": np.zeros(1, dtype)})

    def pack(self) -> bytes:
        return b"".join(self.w[k].astype(np.float32).tobytes() for k in self.FIELDS)

    @classmethod
    def unpack(cls, raw: bytes) -> BiGRU:
        like, at, out = cls.start().w, 0, {}
        for k in cls.FIELDS:
            out[k] = np.frombuffer(raw, np.float32, like[k].size, at).reshape(like[k].shape).copy()
            at += 4 * like[k].size
        return cls(out)

    def inputs(self, own: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Input vectors [words, DIM] of distinct words."""
        x = self.w["word"][own]
        if len(own):
            x = x + np.add.reduceat(self.w["char"][grams], np.cumsum(counts) - counts, axis=0) / counts[:, None].astype(x.dtype)
        return x

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates of both directions [words + 1, 6 HIDDEN]; the last row is no word."""
        g = x @ self.w["X"].T + self.w["bx"].T
        return np.concatenate([g, np.zeros((1, g.shape[1]), g.dtype)])

    def _direction(self, g: np.ndarray, real: np.ndarray | None, U: np.ndarray, backward: bool, keep: bool):
        """States [T, H, n] of one direction over gates [T, 3H, n], and what the way back needs."""
        T, _, n = g.shape
        H = HIDDEN
        out = np.empty((T, H, n), g.dtype)
        saved = [np.empty((T, k, n), g.dtype) for k in (H, 2 * H, H, H)] if keep else None
        h = np.zeros((H, n), g.dtype)
        for t in range(T - 1, -1, -1) if backward else range(T):
            a = U @ h
            zr = g[t, : 2 * H] + a[: 2 * H]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = np.tanh(g[t, 2 * H :] + zr[H:] * a[2 * H :])
            new = c + zr[:H] * (h - c)
            if real is not None:
                new = np.where(real[t], new, h)
            if keep:
                saved[0][t], saved[1][t], saved[2][t], saved[3][t] = h, zr, c, a[2 * H :]
            out[t] = h = new
        return out, saved

    def forward(self, gates: np.ndarray, places: np.ndarray, real: np.ndarray | None, keep: bool = False):
        """Logits [n] of windows: places [T, n] are rows of gates, real [T, n] says where a word is (None: everywhere)."""
        w, H = self.w, HIDDEN
        g = np.ascontiguousarray(gates[places].transpose(0, 2, 1))
        f, sf = self._direction(g[:, : 3 * H], real, w["Uf"], False, keep)
        b, sb = self._direction(g[:, 3 * H :], real, w["Ub"], True, keep)
        s = np.concatenate([f, b], axis=1)
        e = np.tanh(np.matmul(w["A"], s) + w["a"])
        score = np.tensordot(w["v"], e, (0, 1))
        if real is not None:
            score = np.where(real, score, -1e9)
        p = np.exp(score - score.max(axis=0))
        if real is not None:
            p = p * real
        p /= np.maximum(p.sum(axis=0), 1e-9)
        c = np.einsum("tn,tkn->kn", p, s)
        z = w["w"] @ c + w["b"][0]
        return (z, (g, sf, sb, s, e, p, c)) if keep else z

    def gradients(self, own, grams, counts, code: np.ndarray, real: np.ndarray, dz_of) -> tuple[np.ndarray, dict]:
        """Logits of windows over distinct words, and gradients of a loss whose derivative by the logits is dz_of(z)."""
        w, H = self.w, HIDDEN
        x = self.inputs(own, grams, counts)
        z, (g, sf, sb, s, e, p, c) = self.forward(self.gates(x), code, real, True)
        dz = dz_of(z).astype(z.dtype)
        grad = {"w": c @ dz, "b": np.array([dz.sum()])}
        dc = w["w"][:, None] * dz
        ds = p[:, None] * dc[None]
        dp = np.einsum("tkn,kn->tn", s, dc)
        dscore = p * (dp - (p * dp).sum(axis=0))
        grad["v"] = np.einsum("tn,tkn->k", dscore, e)
        de = w["v"][None, :, None] * dscore[:, None] * (1 - e * e)
        grad["A"] = np.einsum("tkn,tjn->kj", de, s)
        grad["a"] = de.sum(axis=(0, 2))[:, None]
        ds += np.matmul(w["A"].T, de)
        dg = np.empty_like(g)
        for rows, U, name, saved, backward in ((slice(0, H), "Uf", "f", sf, False), (slice(H, 2 * H), "Ub", "b", sb, True)):
            hin, zr, cand, an = saved
            T = len(hin)
            dU, dh = np.zeros_like(w[U]), np.zeros_like(hin[0])
            out = dg[:, : 3 * H] if name == "f" else dg[:, 3 * H :]
            for t in range(T) if backward else range(T - 1, -1, -1):
                dh = dh + ds[t, rows]
                live = np.where(real[t], dh, 0)
                zt, rt = zr[t, :H], zr[t, H:]
                dcand = live * (1 - zt) * (1 - cand[t] ** 2)
                da = np.concatenate([live * (hin[t] - cand[t]) * zt * (1 - zt), dcand * an[t] * rt * (1 - rt), dcand * rt])
                out[t, : 2 * H], out[t, 2 * H :] = da[: 2 * H], dcand
                dU += da @ hin[t].T
                dh = (dh - live) + live * zt + w[U].T @ da
            grad[U] = dU
        flat = dg.transpose(0, 2, 1)[real]
        codes = code[real]
        order = np.argsort(codes, kind="stable")
        who, first = np.unique(codes[order], return_index=True)
        dgate = np.add.reduceat(flat[order], first, axis=0) if len(who) else np.zeros((0, 6 * H), g.dtype)
        grad["X"], grad["bx"] = dgate.T @ x[who], dgate.sum(axis=0)[:, None]
        dx = np.zeros_like(x)
        dx[who] = dgate @ w["X"]
        grad["word"], grad["char"] = (own, dx), (grams, np.repeat(dx / np.maximum(counts, 1)[:, None].astype(dx.dtype), counts, axis=0))
        return z, grad


class Adagrad:
    def __init__(self, model: BiGRU, rate: float = 0.1):
        self.model, self.rate = model, rate
        self.squares = {k: np.full_like(x, 1e-6) for k, x in model.w.items()}

    def step(self, grad: dict) -> None:
        for k, g in grad.items():
            w, s = self.model.w[k], self.squares[k]
            if k in ("word", "char"):
                rows, g = g
                order = np.argsort(rows, kind="stable")
                rows, first = np.unique(rows[order], return_index=True)
                if not len(rows):
                    continue
                g = np.add.reduceat(g[order], first, axis=0)
                s[rows] += g * g
                w[rows] -= self.rate * g / np.sqrt(s[rows])
            else:
                s += g * g
                w -= (self.rate * g / np.sqrt(s)).astype(w.dtype)
