"""Spelling variants: words one edit apart, found by Aho-Corasick automata of word halves, and grouped under their forms.

A word is cut into two halves. One inserted, deleted or replaced code point leaves one half of it whole, at the start
or at the end of the other word. The vocabulary is dealt by length, and by hash where a length has many words, to
shards of about SHARD_WORDS words and SHARD_BYTES bytes; a shard's automaton holds both halves of each of its words, the
first behind a mark for the start of a word and the second before one for its end, so a hit is at the right offset. Each
shard is broadcast alone (its size is bounded by its number and bytes of words) and all words of compatible lengths run
through it. Hits with a length that differs by more than one are passed over, and the rest of the word is verified:
against each member of a small group of equal halves, through an index of deletions and gaps in a large one (work then
follows the word, not the group). A word's both halves are in one shard, so a pair is found in one shard only, and a
task hands on one row for each word that has neighbours, not the pairs.

Counting is done by Arrow kernels; crc32(id + word) comes from crc32(word) by linear algebra over all places at once.

Defined results: a null or empty text has no words; a null id counts as an empty string before the colon; repeated
rows count again; of forms with equal n the smallest in code-point order is taken; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, ids_and_text
from .words import by_bytes, split_words

SHARD_WORDS, SHARD_BYTES = 50_000, 4 << 20
#: Members of a group that are compared one by one; a larger one gets an index.
SMALL = 12
#: Distinct words that a task gathers before it passes them on.
GATHERED = 400_000
START, STOP, GAP = "\x02", "\x03", "\x00"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0xC3] = 0xC3


def letters_only(texts: pa.Array) -> pa.Array:
    """Texts with A-Z lower-cased and every byte of what is not in [A-Za-z\\u00C0-\\u00FF] a blank. In UTF-8 the
    letters from \\u00C0 to \\u00FF are those that begin with C3."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    out = _LETTER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    out[second] = raw[second]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).copy()), pa.py_buffer(out))


def _crc_shifts(longest: int) -> np.ndarray:
    """[length, 4, 256]: what a crc32 turns into before `length` more bytes, byte by byte of the crc."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(longest):
        out[k + 1] = (out[k] >> 8) ^ table[out[k] & 255]
    return out


TABLED = 48
_SHIFTS = _crc_shifts(TABLED).reshape(-1)


def crc_of_both(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32(a + b) from crc32(a), crc32(b) and the bytes of b, which are TABLED at most."""
    at = length.astype(np.int64) * 1024
    out = second.astype(np.uint32)
    for k in range(4):
        out = out ^ _SHIFTS[at + 256 * k + ((first >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def noted_words(docs: DataFrame, every: int = 97, shortest: int = 5) -> DataFrame:
    """(word, n) over all documents (doc_id, text): runs of letters, where one in `every` (by crc32 of id and run) has
    lost a code point, of at least `shortest` code points."""

    def of_batch(b: pa.RecordBatch) -> pa.Table:
        flat, counts = split_words(letters_only(b.column(1)))
        coded = flat.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        text = words.to_pylist()
        raw = [w.encode() for w in text]
        points, size = pc.utf8_length(words).to_numpy().astype(np.int64), np.array([len(w) for w in raw], np.int64)
        own = np.array([zlib.crc32(w) for w in raw], np.uint32)
        ids = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column(0).to_pylist()], np.uint32)
        doc = np.repeat(ids, counts)
        h = crc_of_both(doc, own[code], np.minimum(size, TABLED)[code])
        for i in np.flatnonzero(size[code] > TABLED).tolist():
            h[i] = zlib.crc32(raw[code[i]], int(doc[i]))
        hit = h % np.uint32(every) == 0
        n = np.bincount(code[~hit], minlength=len(text))
        keep = (points >= shortest) & (n > 0)
        lost: dict[str, int] = defaultdict(int)
        long_enough = hit & (points[code] > shortest)
        for c, p in zip(code[long_enough].tolist(), (h[long_enough] % points[code[long_enough]]).tolist()):
            w = text[c]
            lost[w[:p] + w[p + 1 :]] += 1
        kept = words.filter(pa.array(keep)).cast(pa.string())
        return pa.table({"word": pa.concat_arrays([kept, pa.array(list(lost), pa.string())]), "n": np.concatenate([n[keep], np.array(list(lost.values()), np.int64)])})

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for b in by_bytes(batches, 1):
            parts.append(of_batch(b))
            rows += len(parts[-1])
            if rows > GATHERED:
                whole = summed(parts)
                parts, rows = [whole], len(whole)
                if rows > GATHERED // 2:
                    yield from whole.to_batches(max_chunksize=100_000)
                    parts, rows = [], 0
        if parts:
            yield from summed(parts).to_batches(max_chunksize=100_000)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Group:
    """Words of one length with an equal half; the other half is `rest`."""

    def __init__(self):
        self.words: list[int] = []
        self.rests: list[str] = []
        self.index: dict[str, list[int]] | None = None

    def _indexed(self) -> dict[str, list[int]]:
        # whole rests, rests without a code point and rests with a gap differ by length or gap
        index: dict[str, list[int]] = defaultdict(list)
        for w, r in zip(self.words, self.rests):
            index[r].append(w)
            for i in range(len(r)):
                index[r[:i] + GAP + r[i + 1 :]].append(w)
            for short in {r[:i] + r[i + 1 :] for i in range(len(r))}:
                index[short].append(w)
        return index

    def near(self, rest: str, longer: int) -> Iterable[int]:
        """Members whose rest is one edit from `rest`, which has `longer` (-1, 0 or 1) more code points than theirs."""
        if len(self.words) <= SMALL:
            return [w for w, r in zip(self.words, self.rests) if one_edit(r, rest)]
        if self.index is None:
            self.index = self._indexed()
        if longer < 0:
            return self.index.get(rest, ())
        keys = [rest[:i] + (GAP if longer == 0 else "") + rest[i + 1 :] for i in range(len(rest))]
        same = self.index.get(rest, ()) if longer == 0 else ()
        return [w for k in keys for w in self.index.get(k, ()) if w not in same]


class Shard:
    """An automaton of both halves of every word."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = words, counts
        groups: dict[str, dict[int, Group]] = defaultdict(dict)
        for i, w in enumerate(words):
            a = len(w) // 2
            for segment, rest in ((START + w[:a], w[a:]), (w[a:] + STOP, w[:a])):
                g = groups[segment].get(len(w))
                if g is None:
                    g = groups[segment][len(w)] = Group()
                g.words.append(i)
                g.rests.append(rest)
        self.machine = ahocorasick.Automaton()
        for segment, by_length in groups.items():
            self.machine.add_word(segment, (segment, by_length))
        if groups:
            self.machine.make_automaton()

    def near(self, word: str) -> set[int]:
        """Numbers of the shard's words that are one edit from this word."""
        found: set[int] = set()
        n = len(word)
        for end, (segment, by_length) in self.machine.iter(START + word + STOP):
            size = len(segment) - 1
            rest = word[size:] if segment[0] == START else word[: n - size]
            for length in (n - 1, n, n + 1):
                if (g := by_length.get(length)) is not None:
                    found.update(g.near(rest, n - length))
        return found


_held: list = [None, None]


def _shard_of(shared) -> Shard:
    """A worker's automaton of the shard that it works on; it keeps one."""
    if _held[0] != shared._jid if hasattr(shared, "_jid") else _held[0] is not shared:
        words, counts = shared.value
        _held[:] = [shared._jid if hasattr(shared, "_jid") else shared, Shard(words.to_pylist(), counts)]
    return _held[1]


def shards_of(lengths: list[tuple[int, int, int]], most_words: int, most_bytes: int) -> list[tuple[int, int, int, int]]:
    """(shortest, longest, part, parts) of shards, from (length, words, bytes) in order: lengths in a row that together
    stay within both bounds, and parts by hash of a length that alone does not."""
    out: list[tuple[int, int, int, int]] = []
    first = last = None
    weight = 0.0
    for size, words, bytes_ in lengths:
        own = max(words / most_words, bytes_ / most_bytes)
        if first is not None and weight + own > 1:
            out.append((first, last, 0, 1))
            first, weight = None, 0.0
        if own > 1:
            parts = math.ceil(own)
            out += [(size, size, k, parts) for k in range(parts)]
            continue
        first, last, weight = size if first is None else first, size, weight + own
    if first is not None:
        out.append((first, last, 0, 1))
    return out


def neighbours(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near ones in vocabulary (word, n, size), a stored table in
    order of size, the words' code points: how many, and the one of largest n, smallest word first."""
    spark = vocabulary.sparkSession
    lengths = vocabulary.groupBy("size").agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).orderBy("size").collect()  # a row for each length
    parts = None
    for low, high, k, n in shards_of([tuple(map(int, r)) for r in lengths], shard_words, shard_bytes) or [(0, 0, 0, 1)]:
        mine = vocabulary.where(F.col("size").between(low, high) & (F.pmod(F.xxhash64("word"), F.lit(n)) == k)).toArrow()  # a shard: bounded words and bytes
        shared = spark.sparkContext.broadcast((mine.column("word").combine_chunks(), mine.column("n").to_numpy()))

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shard = None
            for b in batches:
                shard = shard or _shard_of(shared)
                out = []
                for w in b.column(0).to_pylist():
                    if near := shard.near(w):
                        n, best = min((-int(shard.counts[i]), shard.words[i]) for i in near)
                        out.append((w, len(near), best, -n))
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "best", "best_n"])

        # words of other lengths than these are near none of the shard's
        met = vocabulary.where(F.col("size").between(low - 1, high + 1)).select("word")
        found = cut(met.mapInArrow(scan, "word string, n_near long, best string, best_n long"), "near")
        shared.destroy()
        parts = found if parts is None else parts.unionByName(found)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): the last word that forms lead to. A form has twice the occurrences
    of its word, so paths end, and each round doubles the steps that a row has gone."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = cut(now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        more = not after.where("moved").isEmpty()
        now = after.select("word", "root")
        if not more:
            return now


def spelling_variants(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with `least` occurrences."""
    noted = noted_words(ids_and_text(docs, id_col, text_col), every, shortest).where(F.col("n") >= least).withColumn("size", F.char_length("word"))
    # in order of lengths, so that a shard's words and those that meet it are read without the others
    noted = cut(noted, "noted")
    vocabulary = cut(noted.repartitionByRange("size", F.xxhash64("word")).sortWithinPartitions("size"), "vocabulary")
    drop_cut(noted)
    near = neighbours(vocabulary, shard_words)
    more = F.col("best_n") >= ratio * F.col("n")
    rows = cut(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(more, F.col("best")).alias("form"), F.when(more, F.col("best_n")).alias("form_n")), "forms")
    drop_cut(vocabulary)
    led = roots(rows.where("form IS NOT NULL"))
    return rows.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
