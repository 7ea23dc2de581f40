"""A Bloom filter of 64-bit keys, filled on the executors; false positives only cost its user a later check."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import default_parallelism

HASHES = 4
#: Bits a key; bits_for() gives fewer only at MAX_BITS.
FILTER_BITS = 12
SEGMENT_BITS, MAX_BITS = 1 << 17, 1 << 28


def bits_for(n: int) -> int:
    return min(MAX_BITS, max(SEGMENT_BITS, 1 << int(FILTER_BITS * n).bit_length()))


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = keys.astype(np.uint64)
        b = a ^ (a >> np.uint64(33))
        b = (b * np.uint64(0xFF51AFD7ED558CCD)) ^ (b >> np.uint64(29))
        b = (b * np.uint64(0xC4CEB9FE1A85EC53)) | np.uint64(1)
        k = np.arange(1, HASHES + 1, dtype=np.uint64)
        x = a[:, None] + k * b[:, None]
        return ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(bits)


def put(words: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(words, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def holds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def bloom_of(keys: DataFrame, bits: int) -> bytes:
    """The filter of the one long column of keys (no nulls): bits / 8 bytes, at most 32 MB."""

    def fill(batches):
        words = np.zeros(bits // 8, np.uint8)
        for b in batches:
            if b.num_rows:
                put(words, positions(b.column(0).to_numpy().view(np.uint64), bits))
        step = SEGMENT_BITS // 8
        for i in range(0, len(words), step):
            if words[i : i + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([zlib.compress(words[i : i + step].tobytes(), 1)], pa.binary())], names=["at", "words"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(SEGMENT_BITS // 8, np.uint8)
        for z in pdf["words"]:
            words |= np.frombuffer(zlib.decompress(z), np.uint8)
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "words": [zlib.compress(words.tobytes(), 1)]})

    out = bytearray(bits // 8)
    filled = keys.coalesce(default_parallelism(keys.sparkSession)).mapInArrow(fill, "at long, words binary")
    for at, z in filled.groupBy("at").applyInPandas(merge, "at long, words binary").collect():
        out[at : at + SEGMENT_BITS // 8] = zlib.decompress(z)
    return bytes(out)
