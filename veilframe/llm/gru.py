"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output softmax,
and state carried from window to window, so a document of any length gets its whole log-likelihood.

Targets are (class, word in class). Head classes hold frequent words each and have a softmax of their own over
the hidden state; of other classes the probability of a word within its class is left to the caller, who knows
the counts. Arrays are laid out [lane, unit], a block for each gate, so that rows of the input table are taken as
they are; biases are the last row of their weights. Logits are laid out [word, token].
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, WINDOW, LANES = 16, 16, 1024
#: Lanes of a text that is only scored, few enough for a step to stay in a core's cache, and tokens that one call of the output layer then takes.
SCORED_LANES, SCORED = 512, 16_384
#: Tokens of a document that are learned from in one stretch, with the state carried; the next stretch begins anew.
STRETCH = 1_024
_FIELDS = ("E", "U", "Wc", "Ww")


class Weights:
    """E [inputs, 3 H]: the gates' input; U [H + 1, 3 H]: recurrence; Wc [H + 1, classes]; Ww [heads, H + 1, words]."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    @classmethod
    def start(cls, n_inputs: int, class_counts: np.ndarray, word_counts: np.ndarray, hidden: int = HIDDEN, seed: int = 11) -> Weights:
        """Random, but for the output biases, which begin at the training frequencies."""
        rng = np.random.default_rng(seed)
        h, c, heads = hidden, len(class_counts), len(word_counts)
        f = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        U, Wc, Ww = f(h + 1, 3 * h, k=h**-0.5), f(h + 1, c, k=0.05), f(heads, h + 1, word_counts.shape[1], k=0.05)
        U[h] = 0
        Wc[h] = np.log((class_counts + 1) / (class_counts + 1).sum())
        Ww[:, h] = np.where(word_counts > 0, np.log(np.maximum(word_counts, 1) / np.maximum(word_counts.sum(axis=1, keepdims=True), 1)), -1e4)
        return cls({"E": f(n_inputs, 3 * h, k=0.3), "U": U, "Wc": Wc, "Ww": Ww})

    def pack(self) -> np.ndarray:
        return np.concatenate([self.a[k].ravel() for k in _FIELDS])

    def unpack(self, flat: np.ndarray) -> Weights:
        out, at = {}, 0
        for k in _FIELDS:
            n = self.a[k].size
            out[k] = flat[at : at + n].reshape(self.a[k].shape).astype(np.float32)
            at += n
        return Weights(out)


class Lanes:
    """Stretches of tokens dealt to lanes, longest first to the emptiest; lanes in falling order of their lengths."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray, n_lanes: int):
        n = max(1, min(n_lanes, len(lengths)))
        heap = [(0, i) for i in range(n)]
        dealt: list[list[int]] = [[] for _ in range(n)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            load, i = heapq.heappop(heap)
            dealt[i].append(d)
            heapq.heappush(heap, (load + int(lengths[d]), i))
        dealt = sorted((x for x in dealt if x), key=lambda x: int(lengths[x].sum()), reverse=True)
        order = np.array([d for x in dealt for d in x], np.int64)
        size = lengths[order]
        self.sizes = np.array([int(lengths[x].sum()) for x in dealt], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        #: Positions of tokens, lane by lane.
        self.tokens = (np.repeat(starts[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())).astype(np.int32)

    def window(self, at: int, steps: int) -> np.ndarray:
        """Positions [steps, live lanes] from step `at` on, -1 past a lane's end."""
        n = int((self.sizes > at).sum())
        t = at + np.arange(min(steps, int(self.sizes[0]) - at))[:, None]
        real = t < self.sizes[:n]
        return np.where(real, self.tokens[np.where(real, self.first[:n] + t, 0)], -1)


def stretches(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of documents laid end to end, each cut into pieces of at most `most` tokens."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    pieces = -(-lengths // most)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + k * most
    return start, np.minimum(most, np.repeat(first + lengths, pieces) - start)


class GRU:
    def __init__(self, weights: Weights, start_id: int):
        self.w, self.start_id = weights.a, start_id
        self.hidden = self.w["U"].shape[0] - 1
        self.grad2 = None

    def _run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """Steps x [T, n] from h [n, H]; lanes where fresh begin with no state. States after each step [T, n, H],
        and what backward needs."""
        H, (T, n) = self.hidden, x.shape
        # both sigmoids want the negative of their sums
        sign = np.array([-1, -1, 1], self.w["U"].dtype)[:, None, None]
        U = self.w["U"].reshape(H + 1, 3, H).transpose(1, 0, 2) * sign
        bias = np.repeat(U[:, H:], n, axis=1)
        U = np.ascontiguousarray(U[:, :H])
        gates = self.w["E"].reshape(-1, H).take(x[:, None] * np.int64(3) + np.arange(3)[:, None], axis=0)
        out = np.empty((T, n, H), U.dtype)
        saved = tuple(np.empty(s, U.dtype) for s in ((T, n, H), (T, 2, n, H), (T, n, H), (T, n, H))) if keep else None
        a, tmp = np.empty((3, n, H), U.dtype), np.empty((n, H), U.dtype)
        any_fresh = fresh.any(axis=1).tolist()
        for t in range(T):
            if any_fresh[t]:
                h = h.copy()
                h[fresh[t]] = 0
            np.matmul(h, U, out=a)
            a += bias
            g = gates[t]
            zr = saved[1][t] if keep else a[:2]
            np.subtract(a[:2], g[:2], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = saved[2][t] if keep else g[2]
            np.multiply(zr[1], a[2], out=tmp)
            np.add(g[2], tmp, out=c)
            np.tanh(c, out=c)
            np.subtract(h, c, out=tmp)
            tmp *= zr[0]
            np.add(c, tmp, out=out[t])
            if keep:
                saved[0][t], saved[3][t] = h, a[2]
            h = out[t]
        return out, h, saved

    def _far(self) -> tuple[bool, list[bool]]:
        """Whether logits of the classes, and of each head's words, might leave the range of exp."""

        def far(W):
            bias = W[..., -1, :].max(axis=-1)
            return (bias + np.abs(W[..., :-1, :]).sum(axis=-2).max(axis=-1) > 60) | (bias < -60)

        return bool(far(self.w["Wc"])), far(self.w["Ww"]).tolist()

    def _outputs(self, hs: np.ndarray, cls: np.ndarray, idx: np.ndarray, grads: dict | None, far: tuple[bool, list[bool]]):
        """log-probabilities (natural) of targets, in order of their classes, given hidden rows [m, H + 1]; with grads,
        also d loss / d hs."""
        w, H, m = self.w, self.hidden, len(cls)
        Wc, Ww = w["Wc"], w["Ww"]
        p = Wc.T @ hs.T
        if far[0]:
            p -= p.max(axis=0)
        at = np.arange(m)
        target = cls * np.int64(m) + at
        logp = p.ravel().take(target)
        np.exp(p, out=p)
        s = np.ones(len(p), p.dtype) @ p
        logp -= np.log(s)
        dh = None
        if grads is not None:
            p *= 1 / s
            p.ravel()[target] -= 1
            grads["Wc"] = (p @ hs).T
            dh = p.T @ Wc[:H].T
            grads["Ww"] = np.zeros_like(Ww)
        heads, _, words = Ww.shape
        bounds = np.searchsorted(cls, np.arange(heads + 1))
        size, short = np.diff(bounds), int(bounds[-1])
        # a head's logits [words, its tokens] are one block of flat
        flat, sums, one = np.empty(short * words, hs.dtype), np.empty(short, hs.dtype), np.ones(words, hs.dtype)
        target = np.repeat(bounds[:-1] * (words - 1), size) + at[:short] + idx[:short] * np.repeat(size, size)
        blocks = [(k, a, b, flat[a * words : b * words].reshape(words, b - a)) for k, a, b in zip(range(heads), bounds[:-1].tolist(), bounds[1:].tolist()) if a < b]
        for k, a, b, q in blocks:
            np.matmul(Ww[k].T, hs[a:b].T, out=q)
            if far[1][k]:
                q -= q.max(axis=0)
        own = flat.take(target)
        np.exp(flat, out=flat)
        for _, a, b, q in blocks:
            np.matmul(one, q, out=sums[a:b])
        logp[:short] += own - np.log(sums)
        if grads is not None:
            back, inverse = np.empty((short, H), hs.dtype), 1 / sums
            for _, a, b, q in blocks:
                q *= inverse[a:b]
            flat[target] -= 1
            for k, a, b, q in blocks:
                grads["Ww"][k] = (q @ hs[a:b]).T
                np.matmul(q.T, Ww[k][:H].T, out=back[a:b])
            dh[:short] += back
        return logp, dh

    def _by_class(self, p: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in p, and positions, of a window's tokens in order of their classes."""
        at = np.flatnonzero(p >= 0)
        where = p.ravel()[at]
        kinds = cls[where]
        order = np.argsort(kinds.astype(np.int16) if self.w["Wc"].shape[1] < 30_000 else kinds, kind="stable")
        return at[order], where[order]

    def score(self, inputs: np.ndarray, cls: np.ndarray, idx: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log-probability at each position of documents laid end to end."""
        out = np.zeros(len(inputs))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        dealt = Lanes(starts, lengths, SCORED_LANES)
        h = self._nothing(len(dealt.sizes))
        far = self._far()
        at = 0
        while at < dealt.sizes[0]:
            n = int((dealt.sizes > at).sum())
            steps = max(WINDOW, SCORED // n)
            p = dealt.window(at, steps)
            x = np.where(p >= 0, inputs[p], 0)
            hs, h, _ = self._run(x, x == self.start_id, h[:n], False)
            place, where = self._by_class(p, cls)
            out[where] = self._outputs(self._rows(hs, place), cls[where], idx[where], None, far)[0]
            at += steps
        return out

    def _nothing(self, n: int) -> np.ndarray:
        return np.zeros((n, self.hidden), self.w["U"].dtype)

    @staticmethod
    def _rows(hs: np.ndarray, place: np.ndarray) -> np.ndarray:
        """States [T, n, H] at these places as rows [m, H + 1], the last of which is 1."""
        H = hs.shape[-1]
        out = np.ones((len(place), H + 1), hs.dtype)
        out[:, :H] = hs.reshape(-1, H).take(place, axis=0)
        return out

    def train(self, inputs: np.ndarray, cls: np.ndarray, idx: np.ndarray, lengths: np.ndarray, rate: float) -> float:
        """One pass of truncated backpropagation over every token, Adagrad steps; the mean loss a token."""
        if self.grad2 is None:
            self.grad2 = {k: np.full_like(v, 1e-3) for k, v in self.w.items()}
        starts, sizes = stretches(lengths, STRETCH)
        begin = np.zeros(len(inputs), bool)
        begin[starts] = True
        # fewer lanes for little text, so that there are steps enough
        dealt = Lanes(starts, sizes, max(16, min(LANES, len(inputs) // 1500)))
        h = self._nothing(len(dealt.sizes))
        loss = 0.0
        for at in range(0, int(dealt.sizes[0]), WINDOW):
            p = dealt.window(at, WINDOW)
            n = p.shape[1]
            real = p >= 0
            x = np.where(real, inputs[p], 0)
            fresh = real & begin[p]
            hs, h, saved = self._run(x, fresh, h[:n], True)
            place, where = self._by_class(p, cls)
            grads: dict[str, np.ndarray] = {}
            logp, dh = self._outputs(self._rows(hs, place), cls[where], idx[where], grads, self._far())
            loss -= float(logp.sum())
            d_out = np.zeros((p.size, self.hidden), hs.dtype)
            d_out[place] = dh
            self._backward(d_out.reshape(hs.shape), saved, fresh, grads)
            self._step(grads, x, real, 1 / len(where), rate)
        return loss / max(1, len(inputs))

    def _backward(self, d_out, saved, fresh, grads) -> None:
        H, U = self.hidden, self.w["U"]
        hin, zr, c, an = saved
        T, n = fresh.shape
        z, r = zr[:, 0], zr[:, 1]
        by_c, by_z, by_r, tmp = c * c, hin - c, an * r, 1 - z
        np.subtract(1, by_c, out=by_c)
        by_c *= tmp
        tmp *= z
        by_z *= tmp
        by_r *= np.subtract(1, r, out=tmp)
        # d loss / d of the sums that U gives, and of the candidate's input
        d_a, d_c = np.empty((T, 3, n, H), U.dtype), np.empty((T, n, H), U.dtype)
        dh, tmp = np.zeros((n, H), U.dtype), np.empty((3, n, H), U.dtype)
        UT = np.ascontiguousarray(U[:H].reshape(H, 3, H).transpose(1, 2, 0))
        any_fresh = fresh.any(axis=1).tolist()
        for t in range(T - 1, -1, -1):
            dh += d_out[t]
            d = d_a[t]
            np.multiply(dh, by_c[t], out=d_c[t])
            np.multiply(dh, by_z[t], out=d[0])
            np.multiply(d_c[t], by_r[t], out=d[1])
            np.multiply(d_c[t], r[t], out=d[2])
            dh *= z[t]
            np.matmul(d, UT, out=tmp)
            for part in tmp:
                dh += part
            if any_fresh[t]:
                dh[fresh[t]] = 0
        d_gates = np.empty((T, n, 3, H), U.dtype)
        d_gates[:] = d_a.transpose(0, 2, 1, 3)
        rows = np.ones((T * n, H + 1), U.dtype)
        rows[:, :H] = hin.reshape(-1, H)
        grads["U"] = (d_gates.reshape(-1, 3 * H).T @ rows).T
        d_gates[:, :, 2] = d_c
        grads["E"] = d_gates.reshape(T, n, 3 * H).transpose(0, 2, 1)

    def _step(self, grads, x, real, scale: float, rate: float) -> None:
        for k in ("U", "Wc", "Ww"):
            g = grads[k] * np.float32(scale)
            g2 = self.grad2[k]
            g2 += g * g
            g *= np.float32(rate)
            g /= np.sqrt(g2)
            self.w[k] -= g
        at = np.flatnonzero(real)
        used = x.ravel()[at]
        order = np.argsort(used.astype(np.uint16) if len(self.w["E"]) <= 1 << 16 else used, kind="stable")
        used = used[order]
        start = np.flatnonzero(np.diff(used, prepend=-1))
        ids = used[start]
        g = grads["E"].transpose(0, 2, 1).reshape(x.size, -1).take(at[order], axis=0)
        if g.shape[1] % 2 == 0:  # two sums at a time
            g = g.view(np.result_type(g, np.complex64))
        g = np.add.reduceat(g, start, axis=0).view(self.w["E"].dtype)
        g *= np.float32(scale)
        g2 = self.grad2["E"].take(ids, axis=0)
        g2 += g * g
        self.grad2["E"][ids] = g2
        g *= np.float32(rate)
        g /= np.sqrt(g2, out=g2)
        self.w["E"][ids] = self.w["E"].take(ids, axis=0) - g
