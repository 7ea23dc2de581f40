"""Words [^\\x20\\x09-\\x0D]+ of whole texts with A-Z lower-cased, split by Arrow kernels: no Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are split at a time; a longer text is split alone, whole.
BATCH_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def by_bytes(batches, text_at: int, limit: int = BATCH_BYTES, rows: int = 4096):
    """Record batches cut or kept so that each holds about limit bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) // limit) * len(size) + np.arange(len(size)) // rows
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for i, j in zip(first, [*first[1:], len(size)]):
            yield b.slice(i, j - i)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, and the number of words of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row[real], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(real))
    return flat, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def laid_out(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words end to end, where each word starts there, and its size."""
    n = len(words)
    wide = pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at[:-1] - at[0], np.diff(at)


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its bytes eight at a time, mixed in one after another; the length begins it."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    raw, start, size = laid_out(words)
    # eight bytes from every place on, as one number; the last ones are followed by zeros
    eight = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed) * _ODD + _ODD)
    on = np.arange(n)
    k = 0
    while len(on := on[size[on] > k]):
        part = eight[start[on] + k] & _LOW[np.minimum(size[on] - k, 8)]
        out[on] = mix((out[on] ^ part) * _ODD + np.uint64(k + 1))
        k += 8
    return mix(out)


def hash_shingles(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles (the whole sequence where a text has fewer words, none without words),
    end to end, and their number for each text. h: hashes of the words of texts of these counts."""
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = int(made.sum())
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    start = np.repeat(first - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(total)
    size = np.repeat(np.minimum(counts, n), made)
    x = h[start].copy() if total else np.zeros(0, np.uint64)
    short = (counts < n).any()
    for k in range(1, n):
        if short:
            on = size > k
            x[on] = mix(x[on]) + h[start[on] + k]
        else:
            x = mix(x) + h[start + k]
    return mix(x + size.astype(np.uint64) * _ODD), made


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text."""
    words, counts = split_words(texts)
    x, made = hash_shingles(hash_words(words), counts, n)
    ends = np.cumsum(made)
    starts = ends - made
    for a, b in zip(starts.tolist(), ends.tolist()):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    if len(x):
        new[1:] = x[1:] != x[:-1]
        new[starts[made > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    x = x[new]
    return [x[kept[a] : kept[b]] for a, b in zip(starts.tolist(), ends.tolist())]
