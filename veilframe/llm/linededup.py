"""Removal of lines that many documents share, with two Bloom filters.

The hashes of each document's long lines are stored once. A first pass over them fills, per task, a filter of
lines seen once and one of lines seen again; the tasks' filters merge bitwise (again = again | once & once'), so
no repeated line can be missing from the merged "again" filter. Only lines that this filter suspects are
shuffled, as 128-bit hashes, to be counted exactly and to choose the document that keeps the line. Where one
filter of MAX_BITS would fill up, lines are dealt by a range of their hashes to as many filters as are needed,
one after the other, so suspects stay few however large the corpus is.

Defined results: a null or empty text is one empty line; a null doc_id counts as no document and keeps
its lines; rows repeated under one doc_id count as one document and are all rewritten alike; an empty
table gives an empty result; lines are split at \\n alone, and every line of a text is looked at.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BITS, SEGMENT_BITS, holds, put
from .common import cut, default_parallelism, drop_cut, slices

SPACE = " \t\n\r\x0b\x0c"
HASHES = 4
#: Filter bits for each stored line.
BITS_A_LINE = 12


def line_key(line: str, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None for a line too short to count."""
    key = line.strip(SPACE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions (n, HASHES) of 128-bit hashes given as (n, 2) unsigned 64-bit."""
    k = np.arange(1, HASHES + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (hashes[:, :1] + k * (hashes[:, 1:] | np.uint64(1))) % np.uint64(bits)


def line_hashes(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, keys): the distinct hashes of each document's long lines, end to end."""

    def run(batches):
        for b in slices(batches):
            keys = [b"".join({k for k in (line_key(x, min_chars) for x in (t or "").split("\n")) if k}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(k) // 16 for k in keys], pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "n", "keys"])

    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return some.mapInArrow(run, "doc_id long, n int, keys binary").where("n > 0")


def _of_part(b: pa.RecordBatch, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes (n, 2) of a batch's lines whose hash is in this range."""
    pairs = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8").reshape(-1, 2)
    row = np.repeat(np.arange(b.num_rows), b.column(1).to_numpy())
    if parts > 1:
        mine = pairs[:, 1] // np.uint64(-(-(1 << 64) // parts)) == part
        pairs, row = pairs[mine], row[mine]
    return row, pairs


def repeat_filter(hashes: DataFrame, bits: int, part: int = 0, parts: int = 1) -> bytes:
    """The merged filter of line hashes of one range that more than one document may hold."""

    def fill(batches):
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in slices(batches, 1024):
            pairs = _of_part(b, part, parts)[1]
            if len(pairs):
                pairs, n = np.unique(pairs, axis=0, return_counts=True)
                at = _bits(pairs, bits)
                put(again, at[(n > 1) | holds(once, at)])
                put(once, at)
        step = SEGMENT_BITS // 8
        rows = [(i, zlib.compress(o, 1), zlib.compress(again[i : i + step].tobytes(), 1)) for i in range(0, len(once), step) if (o := once[i : i + step].tobytes()).strip(b"\0")]
        for i in range(0, len(rows), 64):
            some = rows[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.binary()), pa.array([r[2] for r in some], pa.binary())], names=["at", "once", "again"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once = again = np.zeros(SEGMENT_BITS // 8, np.uint8)
        for o, a in zip(pdf["once"], pdf["again"]):
            o, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, a))
            again = again | a | (once & o)
            once = once | o
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "again": [zlib.compress(again.tobytes(), 1)]})

    tasks = default_parallelism(hashes.sparkSession)  # a filter for each core, however many input splits there are
    filled = hashes.coalesce(tasks).mapInArrow(fill, "at long, once binary, again binary")
    out = bytearray(bits // 8)
    for at, z in filled.groupBy("at").applyInPandas(merge, "at long, again binary").collect():  # MAX_BITS / 8 bytes at most
        out[at : at + SEGMENT_BITS // 8] = zlib.decompress(z)
    return bytes(out)


def filters_for(lines: int, most: int = MAX_BITS) -> tuple[int, int]:
    """(bits of a filter, number of filters) for so many lines."""
    want = max(SEGMENT_BITS, BITS_A_LINE * lines)
    parts = -(-want // most)
    return min(most, 1 << (-(-want // parts) - 1).bit_length()), parts


def repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, keys): for each document that loses lines, the hashes of the lines it loses."""
    spark = docs.sparkSession
    hashes = cut(line_hashes(docs, min_chars, id_col, text_col), "lines")
    bits, parts = filters_for(int(hashes.agg(F.sum("n")).first()[0] or 0), most_bits)
    found = []
    for part in range(parts):
        again = spark.sparkContext.broadcast(repeat_filter(hashes, bits, part, parts))  # MAX_BITS / 8 bytes at most

        def suspects(batches, again=again, part=part):
            words = np.frombuffer(again.value, np.uint8)
            for b in slices(batches, 1024):
                row, pairs = _of_part(b, part, parts)
                if len(row):
                    hit = holds(words, _bits(pairs, bits))
                    row, pairs = row[hit], np.ascontiguousarray(pairs[hit])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.Array.from_buffers(pa.binary(16), len(row), [None, pa.py_buffer(pairs)]).cast(pa.binary())], names=["doc_id", "key"])

        found.append(cut(hashes.mapInArrow(suspects, "doc_id long, key binary"), "suspects"))
        again.unpersist()
    drop_cut(hashes)
    seen = reduce(DataFrame.union, found).distinct()
    kept_by = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    lost = seen.join(kept_by, "key").where("doc_id <> keeper")  # one row of kept_by a key: a hot key's partition is split
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_BITS) -> DataFrame:
    """docs with text rewritten, and n_lines (before) and n_dropped beside its columns (replacing such names).

    A line whose key has at least min_chars code points and stands in at least min_docs documents stays
    only in the largest id that holds it."""
    docs = docs.drop("n_lines", "n_dropped", "_lost_by", "_lost")
    lost = repeated_lines(docs, min_docs, min_chars, id_col, text_col, most_bits).withColumnRenamed("doc_id", "_lost_by").withColumnRenamed("keys", "_lost")
    joined = docs.join(lost, F.col(f"`{id_col}`") == F.col("_lost_by"), "left").drop("_lost_by")
    schema = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]).schema.add("n_lines", "long").add("n_dropped", "long")
    names = docs.columns

    def rewrite(batches):
        for b in slices(batches):
            gone = b.column(b.num_columns - 1).to_pylist()
            texts, n_lines, n_dropped = [], [], []
            for t, keys in zip(b.column(names.index(text_col)).to_pylist(), gone):
                lines = (t or "").split("\n")
                drop = set(keys or ())
                kept = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = [pa.array(texts, pa.string()) if c == text_col else b.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(rewrite, schema)
