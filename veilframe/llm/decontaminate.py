"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every passage of every document is a query. Weights are divided by an item's score against itself, so
one threshold holds for all items. Passages are windows of two segments, a segment being as long as the
longest of all items, so each place where an item can stand lies whole in a window. Upper bounds of all (window,
block of items) pairs come from the block maxima, for some windows at a time; windows with a block that can reach the threshold go
through the document-at-a-time WAND loop, which skips by block maxima and returns every item at or above
the threshold. A hit is confirmed on the words: shares of the question's and of the answer's word
n-grams that stand in the window.

Defined results: a null or empty text matches nothing, nor does a null or wordless item; repeated
documents give repeated rows; no items or no documents give no rows; other columns are ignored. The index
is broadcast in parts of at most INDEX_BYTES of item text, one pass over the documents for each part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, slices

INDEX_BYTES = 32 << 20
K1, B = 1.2, 0.75
BLOCK = 4
#: Cells, of windows by blocks or by their terms' postings, that bounds are computed for at a time.
CELLS = 2_000_000
_TABLE = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased words; every ASCII character but letters and digits parts them."""
    return text.lower().encode().translate(_TABLE).split() if text else []


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words: the answer is the last sentence, or the last quarter of a single one."""
    parts = [w for w in map(terms_of, re.split(r"(?<=[.!?])\s+|\n", text)) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    words = parts[0] if parts else []
    at = len(words) - max(1, len(words) // 4) if words else 0
    return words[:at], words[at:]


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class BlockMaxIndex:
    """Postings of items by term, in blocks of BLOCK items with the largest weight in each."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_len: float):
        items = sorted(i for i in items if terms_of(i[1]))
        self.ids = [i for i, _ in items]
        self.words = [terms_of(t) for _, t in items]
        self.parts = [split_item(t) for _, t in items]
        self.longest = max(map(len, self.words), default=0)
        self.term: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for k, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / mean_len)
            own = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in Counter(words).items()}
            whole = sum(own.values())
            for w, x in own.items():
                t = self.term.setdefault(w, len(self.term))
                if t == len(postings):
                    postings.append([])
                postings[t].append((k, x / whole))
        self.postings = postings
        blocks: list[list[tuple[int, float]]] = []
        for p in postings:
            most: dict[int, float] = {}
            for k, x in p:
                most[k // BLOCK] = max(most.get(k // BLOCK, 0.0), x)
            blocks.append(sorted(most.items()))
        self.blocks = [dict(b) for b in blocks]
        self.top = [max(b.values()) for b in self.blocks]
        self.n_blocks = -(-len(items) // BLOCK)
        self.first = np.cumsum([0, *map(len, blocks)]).astype(np.int64)
        self.block_of = np.array([k for b in blocks for k, _ in b], np.int64)
        self.block_max = np.array([x for b in blocks for _, x in b], np.float64)

    def hopeful(self, window: np.ndarray, term: np.ndarray, n_windows: int, threshold: float) -> list[int]:
        """Windows with a block whose upper bound reaches the threshold; (window, term) rows are distinct and in order."""
        size = self.first[term + 1] - self.first[term]
        row_of = np.searchsorted(window, np.arange(n_windows + 1))
        cost = np.diff(np.concatenate([[0], np.cumsum(size)])[row_of]) + self.n_blocks
        found: list[int] = []
        at, spent = 0, np.cumsum(cost)
        while at < n_windows:
            stop = max(at + 1, int(np.searchsorted(spent, CELLS + (spent[at - 1] if at else 0), "right")))
            rows = slice(row_of[at], row_of[stop])
            n, own = size[rows], self.first[term[rows]]
            places = np.repeat(own - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            cell = np.repeat(window[rows] - at, n) * self.n_blocks + self.block_of[places]
            bound = np.bincount(cell, self.block_max[places], (stop - at) * self.n_blocks).reshape(stop - at, self.n_blocks)
            found += (at + np.flatnonzero((bound >= threshold - 1e-9).any(axis=1))).tolist()
            at = stop
        return found

    def search(self, texts: list[list[bytes]], step: int, threshold: float, min_question: float, min_answer: float, n: int) -> list[tuple]:
        """(text number, item id, first word, score, question overlap, answer overlap) of all windows of 2 * step words."""
        rows: list[tuple] = []
        counts = [-(-len(w) // step) for w in texts]
        at = np.cumsum([0, *counts])
        n_segments = int(at[-1])
        if not n_segments or not self.ids:
            return rows
        get = self.term.get
        total = sum(map(len, texts))
        term = np.fromiter((get(x, -1) for w in texts for x in w), np.int64, total)
        segment = np.concatenate([np.arange(len(w)) // step + s for w, s in zip(texts, at[:-1])])
        keep = term >= 0
        n_terms = len(self.term)
        segment, term = segment[keep], term[keep]
        opening = np.zeros(n_segments, bool)
        opening[[s for s, c in zip(at[:-1].tolist(), counts) if c]] = True
        # a window is a segment and the next one of its document; each term counts once in it
        after = ~opening[segment]
        pairs = np.unique(np.concatenate([segment * n_terms + term, (segment[after] - 1) * n_terms + term[after]]))
        for s in self.hopeful(pairs // n_terms, pairs % n_terms, n_segments, threshold):
            k = int(np.searchsorted(at, s, "right")) - 1
            first = (s - int(at[k])) * step
            window = texts[k][first : first + 2 * step]
            for item, score in self.wand({t for t in map(get, window) if t is not None}, threshold):
                q, a = self.overlap(item, window, n)
                if q >= min_question and a >= min_answer:
                    rows.append((k, self.ids[item], first, min(1.0, score), q, a))
        return rows

    def wand(self, query: set[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score is at least the threshold, by block-max WAND."""
        slack = threshold - 1e-9
        lists = [[self.postings[t][0][0], 0, t] for t in query]
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[x[2]].get(block, 0.0) for x in lists[: pivot + 1]) < slack:
                # no item up to the block's end or the next list's item can reach the threshold
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
                goal = max(goal, item + 1)
            elif lists[0][0] == item:
                score = sum(self.postings[x[2]][x[1]][1] for x in lists[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for x in lists[: pivot + 1]:
                p = self.postings[x[2]]
                while x[1] < len(p) and p[x[1]][0] < goal:
                    x[1] += 1
                x[0] = p[x[1]][0] if x[1] < len(p) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found

    def overlap(self, item: int, window: list[bytes], n: int) -> tuple[float, float]:
        """Shares of the question's and of the answer's n-grams that stand in the window."""
        shares = []
        for part in self.parts[item]:
            want = grams(part, n)
            have = grams(window, min(n, len(part))) if want else set()
            shares.append(len(want & have) / len(want) if want else 1.0)
        return shares[0], shares[1]


def build_index(items: DataFrame, part: int, parts: int, df: DataFrame, n_items: int, mean_len: float) -> BlockMaxIndex:
    mine = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part) if parts > 1 else items
    rows = [(r[0], r[1]) for r in mine.collect()]  # about INDEX_BYTES of text
    used = {w for _, t in rows for w in terms_of(t)}
    counts = {bytes(r[0]): r[1] for r in (df.join(mine.mapInArrow(_terms, "item long, term binary").select("term").distinct(), "term", "left_semi") if parts > 1 else df).collect()}
    return BlockMaxIndex(rows, {w: counts[w] for w in used}, n_items, mean_len)


def _terms(batches):
    for b in slices(batches):
        pairs = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(terms_of(t))]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["item", "term"])


def _lengths(batches):
    for b in slices(batches):
        n = [len(terms_of(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x in n if x], pa.int64())], names=["n"])


def _indexes(items: DataFrame, item_id_col: str, item_text_col: str):
    """(index as a broadcast, words a segment) for each part of the items."""
    spark = items.sparkSession
    test = ids_and_text(items, item_id_col, item_text_col).where("text IS NOT NULL AND doc_id IS NOT NULL")
    size = test.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_items, mean_len, longest = test.mapInArrow(_lengths, "n long").agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    if not n_items:
        return
    df = test.mapInArrow(_terms, "item long, term binary").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = -(-size // INDEX_BYTES)
    for part in range(parts):
        yield spark.sparkContext.broadcast(build_index(test, part, parts, df, n_items, mean_len)), int(longest)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, min_question: float = 0.5, min_answer: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, score, question_overlap, answer_overlap): a row for each document and
    item with a window at or above all three thresholds, from the best such window."""
    some = ids_and_text(docs, id_col, text_col)
    out_schema = "doc_id long, item_id long, start_word long, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], out_schema)
    for shared, step in _indexes(items, item_id_col, item_text_col):

        def search(batches, shared=shared, step=step):
            for b in slices(batches, 128):
                ids, texts = b.column(0).to_pylist(), [terms_of(t) for t in b.column(1).to_pylist()]
                best: dict[tuple[int, int], tuple] = {}
                for r in shared.value.search(texts, step, threshold, min_question, min_answer, n):
                    if (r[0], r[1]) not in best or r[3:] > best[r[0], r[1]][3:]:
                        best[r[0], r[1]] = r
                cols = list(zip(*((ids[r[0]], *r[1:]) for r in best.values()))) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in out_schema.split(", ")])

        found = found.unionByName(some.mapInArrow(search, out_schema))
    return found


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = 0.5, min_question: float = 0.5, min_answer: float = 0.5, n: int = 3, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item: each row goes by its own text, whatever its id."""
    for shared, step in _indexes(items, item_id_col, item_text_col):
        at = docs.columns.index(text_col)

        def search(batches, shared=shared, step=step, at=at):
            for b in slices(batches, 128):
                texts = [terms_of(None if t is None else str(t)) for t in b.column(at).to_pylist()]
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in shared.value.search(texts, step, threshold, min_question, min_answer, n)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(search, docs.schema)
    return docs
