"""Best-fit packing of tokenized documents into sequences of bounded length.

Only the counts per length decide a packing, so the plan is made on the length histogram (at most
`capacity` rows however large the corpus): best-fit decreasing builds bins as patterns of lengths with a
multiplicity, then swap-based local search exchanges or moves documents between underfull patterns so
that squared fill rises until bins empty; it ends where no step is left. The pieces get their places by rank within their length, which
Spark computes over salted buckets.

Defined results: a null or empty text is one piece holding the end token alone; repeated rows are packed
as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ids_and_text, slices

#: Pieces of one length that are ranked together, about; a length has as many salt buckets as it needs.
BUCKET_ROWS = 1_000
#: Pre-tokens whose ids a Python worker remembers.
CACHE_ENTRIES = 700_000


class WordTokenizer:
    """ids of a word-level BPE tokenizer, with the ids of each pre-token remembered.

    Texts whose characters all lie in U+0000-U+017F (less U+0130) are split here as the tokenizer's own
    normalizer and pre-tokenizer do: nothing in that range changes under NFC. Any other text, and one that
    holds a special token, goes through the tokenizer itself."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        spec = json.loads(source)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.whole = Tokenizer.from_str(source)
        self.fast = _is_lower_word_bpe(spec)
        self.bpe = BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model.get("end_of_word_suffix") or "")
        specials = [re.escape(a["content"]) for a in spec.get("added_tokens", [])]
        self.slow = re.compile("|".join(["[^\x00-ſ]", "İ", *specials])).search
        letters, digits, space = "a-zªµºß-öø-ÿĀ-ſA-ZÀ-ÖØ-Þ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
        self.split = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[^{letters}{digits}{space}]+").findall
        self.byte_chars = str.maketrans({i: c for i, c in _byte_chars().items() if i != 32})
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHE_ENTRIES:
            self.known.clear()
        tokenize = self.bpe.tokenize
        shown = " ".join(words).encode().decode("latin-1").translate(self.byte_chars).split(" ")
        for w, s in zip(words, shown):
            self.known[w] = np.array([t.id for t in tokenize(s)], dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        split: list[list[str] | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if self.fast and not self.slow(t):
                split[i] = self.split(t.lower())
            else:
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        todo = [i for i, w in enumerate(split) if w is not None]
        missing = list(set().union(*(split[i] for i in todo)).difference(self.known))
        if missing:
            kept = len(self.known)
            self.learn(missing)
            if len(self.known) < kept + len(missing):  # cleared: learn the rest of these texts again
                self.learn(list(set().union(*(split[i] for i in todo)).difference(self.known)))
        get = self.known.__getitem__
        for i in todo:
            out[i] = b"".join(map(get, split[i]))
        return out


def _is_lower_word_bpe(spec: dict) -> bool:
    """Whether the tokenizer normalizes and splits as WordTokenizer.split expects."""
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = [n.get("type") for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return kinds == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == pattern and not spec.get("post_processor")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as bytes.

    A document is its ids then end_id; only one longer than capacity is cut, into pieces of capacity."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary file, of fixed size
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))
    schema = pa.schema(fields)

    def run(batches):
        tok = WordTokenizer(source.value)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), tok.ids([t or "" for t in b.column(1).to_pylist()])):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows))[: len(fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=schema)

    types = {"ids": "binary", "piece": "int"}
    ddl = ", ".join(f"{n} {types.get(n, 'long')}" for n, _ in fields)
    return ids_and_text(docs, id_col, text_col).mapInArrow(run, ddl)


Pattern = tuple[tuple[int, int], ...]


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a length histogram: (pattern of (length, copies), multiplicity) per kind of bin."""
    left = {n: c for n, c in hist.items() if c > 0}
    order = sorted(left)
    bins: list[tuple[Pattern, int]] = []
    while order:
        room, pattern = capacity, []
        at = len(order) - 1
        while at >= 0:
            size = order[at]
            copies = min(room // size, left[size])
            if copies:
                pattern.append((size, copies))
                room -= size * copies
            at = min(at, bisect_right(order, room)) - 1
        times = min(left[s] // k for s, k in pattern)
        bins.append((tuple(pattern), times))
        for s, k in pattern:
            left[s] -= k * times
            if not left[s]:
                del left[s]
                order.remove(s)
    return bins


class _Kinds:
    """Kinds of underfull bins, numbered as they come up: lengths and copies, fill, how many bins there are, and
    what a bin can give back for what it takes (nothing, one document or two), end to end for all kinds."""

    def __init__(self):
        self.pattern: list[Pattern] = []
        self.number: dict[Pattern, int] = {}
        self.n = 0
        self.fill = np.zeros(64, np.int64)
        self.bins = np.zeros(64, np.int64)
        self.first = [0]  # of each kind's options
        self.m = 0
        self.owner, self.size, self.one, self.two = (np.zeros(256, np.int64) for _ in range(4))

    def add(self, pattern: Pattern, times: int) -> None:
        """times more bins of this pattern; a kind that had run out is numbered anew, so that all look at it again."""
        k = self.number.get(pattern)
        if k is not None and self.bins[k]:
            self.bins[k] += times
            return
        k = self.number[pattern] = self.n
        if k == len(self.fill):
            self.fill, self.bins = (np.concatenate([x, np.zeros_like(x)]) for x in (self.fill, self.bins))
        self.pattern.append(pattern)
        self.fill[k], self.bins[k] = sum(s * c for s, c in pattern), times
        rows = [(0, 0, 0), *gives(pattern)]
        while self.m + len(rows) > len(self.size):
            self.owner, self.size, self.one, self.two = (np.concatenate([x, np.zeros_like(x)]) for x in (self.owner, self.size, self.one, self.two))
        at = slice(self.m, self.m + len(rows))
        a = np.array(rows, np.int64)
        self.owner[at], self.size[at], self.one[at], self.two[at] = k, a[:, 0], a[:, 1], a[:, 2]
        self.m += len(rows)
        self.first.append(self.m)
        self.n += 1


    def compact(self) -> np.ndarray:
        """Forget kinds of which no bin is left; how many of the kept ones came before each old number."""
        live = self.bins[: self.n] > 0
        before = np.concatenate([[0], np.cumsum(live)])
        rows = live[self.owner[: self.m]]
        for name in ("owner", "size", "one", "two"):
            kept = getattr(self, name)[: self.m][rows]
            setattr(self, name, np.concatenate([kept, np.zeros(max(256, len(kept)), np.int64)]))
        self.m = int(rows.sum())
        self.owner[: self.m] = before[self.owner[: self.m]]
        self.pattern = [p for p, on in zip(self.pattern, live.tolist()) if on]
        self.number = {p: k for k, p in enumerate(self.pattern)}
        self.n = len(self.pattern)
        self.fill, self.bins = (np.concatenate([x[: len(live)][live], np.zeros(max(64, self.n), np.int64)]) for x in (self.fill, self.bins))
        self.first = np.searchsorted(self.owner[: self.m], np.arange(self.n + 1)).tolist()
        return before


def gives(pattern: Pattern) -> list[tuple[int, int, int]]:
    """(size, one, two) of the single documents and of the pairs that a bin can give; two is 0 for a single one."""
    out = [(s, s, 0) for s, _ in pattern]
    for i, (s, c) in enumerate(pattern):
        if c > 1:
            out.append((2 * s, s, s))
        out += [(s + t, s, t) for t, _ in pattern[i + 1 :]]
    return out


def _best_step(kinds: _Kinds, a: int, since: int, capacity: int) -> tuple[int, tuple[int, int], tuple[int, int]] | None:
    """The step from kind a to a kind numbered since or later that raises squared fill most: (kind, what a gives,
    what it gets): one document for none, one or two, or two for none or one."""
    lo = kinds.first[since]
    owner = kinds.owner[lo : kinds.m]
    back, pair = kinds.size[lo : kinds.m], kinds.two[lo : kinds.m] > 0
    fill = kinds.fill[owner]
    ready = kinds.bins[owner] > (owner == a)
    least = np.maximum(kinds.fill[a] - fill, 0)
    most = np.where(ready, capacity - fill, -1)
    lead = fill - kinds.fill[a]
    best, found = 0, None
    for size, x, z in gives(kinds.pattern[a]):
        moved = size - back
        gain = np.where((moved > least) & (moved <= most), moved * (moved + lead), 0)
        if z:
            gain[pair] = 0
        at = int(gain.argmax())
        if gain[at] > best:
            best, found = int(gain[at]), (int(owner[at]), (x, z), (int(kinds.one[lo + at]), int(kinds.two[lo + at])))
    return found


def local_search(bins: list[tuple[Pattern, int]], capacity: int) -> list[tuple[Pattern, int]]:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills.

    Any underfull bin may give to any other, the emptiest first; of a kind of bin with a multiplicity as many take
    the step as both kinds have. A kind that found no step is looked at again against every kind that comes up
    later. Ends when the bins are as few as their tokens allow, or when no pair of bins has a step left."""
    full: list[tuple[Pattern, int]] = []
    kinds = _Kinds()
    for p, m in bins:
        if sum(s * c for s, c in p) == capacity:
            full.append((p, m))
        else:
            kinds.add(tuple(sorted(p)), m)
    n_bins = int(kinds.bins.sum())
    total = int((kinds.fill * kinds.bins).sum())
    least = -(-total // capacity)
    seen: list[int] = []
    heap: list[tuple[int, int]] = []

    def enlist() -> None:
        for k in range(len(seen), kinds.n):
            seen.append(0)
            heapq.heappush(heap, (int(kinds.fill[k]), k))

    enlist()
    idle: list[tuple[int, int]] = []
    dead = 0
    while n_bins > least:
        if not heap:
            again = [x for x in idle if kinds.bins[x[1]] and seen[x[1]] < kinds.n]
            if not again:
                break
            idle = [x for x in idle if kinds.bins[x[1]] and seen[x[1]] == kinds.n]
            heap = again
            heapq.heapify(heap)
        a = heap[0][1]
        step = _best_step(kinds, a, seen[a], capacity) if kinds.bins[a] and seen[a] < kinds.n else None
        if not step:
            if kinds.bins[a]:
                seen[a] = kinds.n
                idle.append(heap[0])
            heapq.heappop(heap)
            continue
        b, out, back = step
        times = int(kinds.bins[a] // 2 if a == b else min(kinds.bins[a], kinds.bins[b]))
        new_a, new_b = (Counter(dict(kinds.pattern[k])) for k in (a, b))
        for x, src, dst in [*((x, new_a, new_b) for x in out if x), *((y, new_b, new_a) for y in back if y)]:
            src[x] -= 1
            dst[x] += 1
        kinds.bins[a] -= times
        kinds.bins[b] -= times
        n_bins -= 2 * times
        for new in (+new_a, +new_b):
            if not new:
                continue
            p, fill = tuple(sorted(new.items())), sum(s * c for s, c in new.items())
            if fill == capacity:
                full.append((p, times))
                total -= capacity * times
                least = -(-total // capacity)
            else:
                kinds.add(p, times)
                n_bins += times
        enlist()
        dead += int(not kinds.bins[a]) + int(a != b and not kinds.bins[b])
        if dead > 64 and 2 * dead > kinds.n:
            live = kinds.bins[: kinds.n] > 0
            before = kinds.compact()
            seen = [int(before[x]) for x, on in zip(seen, live.tolist()) if on]
            heap, idle = ([(f, int(before[k])) for f, k in rows if live[k]] for rows in (heap, idle))
            heapq.heapify(heap)
            dead = 0
    return [*full, *((kinds.pattern[k], int(kinds.bins[k])) for k in range(kinds.n) if kinds.bins[k])]


def plan_bins(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    return local_search(best_fit(hist, capacity), capacity)


def slots(bins: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first rank, copies a bin, first sequence and offset there."""
    rows, first, used = [], 0, Counter()
    for pattern, times in bins:
        offset = 0
        for size, copies in pattern:
            rows.append((size, used[size], copies, first, offset))
            used[size] += copies * times
            offset += size * copies
        first += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {k: a[:, i] for i, k in enumerate(("size", "rank", "copies", "first", "offset"))}


def pack(pieces: DataFrame, capacity: int = 4096, key_cols: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces (with a column length between 1 and capacity) with sequence_id and offset.

    pieces is read twice, so it should be a stored table. key_cols order rows of one length."""
    spark = pieces.sparkSession
    hist = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    layout = spark.sparkContext.broadcast(slots(plan_bins(hist, capacity)))  # bounded by the lengths, not the rows
    buckets = F.lit([hist.get(n, 0) // BUCKET_ROWS + 1 for n in range(capacity + 1)])
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*key_cols), F.get(buckets, F.col("length").cast("int"))).cast("long"))
    counts = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*key_cols)).cast("long"))
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_row") - 1).drop("_bucket", "_row", "_base")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches):
        lay = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("_rank")).to_numpy()
            start, stop = np.searchsorted(lay["size"], size, "left"), np.searchsorted(lay["size"], size, "right")
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                m = size == s
                i, j = start[m][0], stop[m][0]
                at[m] = i + np.searchsorted(lay["rank"][i:j], rank[m], "right") - 1
            k = rank - lay["rank"][at]
            seq, off = lay["first"][at] + k // lay["copies"][at], lay["offset"][at] + (k % lay["copies"][at]) * size
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ranked.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    pieces = cut(token_pieces(docs, tokenizer_json, capacity, end_id, with_ids, id_col, text_col), "pieces")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return pack(pieces, capacity).select(*cols)
