"""Prefix trie of conversations: every shared opening of turns as a node, by an LCP-aware mergesort and an open-path stack.

A turn is its (role, text) as 128 bits of SHA-256, so a conversation is a key of 16 bytes a turn, and texts travel no
further than their first task. Equal conversations become one key with a count before anything is sorted, so a
conversation that very many share is one row. Distinct keys are dealt by ranges to tasks of about RANGE_BYTES; Spark's
shuffle files are the external storage between the two steps. A task sorts each slice of what it gets into a run that
carries the number of turns each key shares with the one before it (LCP), and merges its runs with a loser tree: the
contender that shares more turns with the last winner wins without a look at its turns, and equal contenders are
compared from the turns on that both share with it.

The merged stream keeps the open path from the root as a stack: a key that shares l turns with the one before closes
all nodes below depth l. Nodes on a task's first or last path may go on in a neighbouring task; they are passed on, in
order, as parts (two paths a task), and one more stack over all tasks' parts, fed in order by Spark's sort, closes
them. That table grows with the number of tasks and the depth of paths, not with the rows.

Identifiers of ends are hashed in numeric order, in blocks of BLOCK ids that are joined first.

Defined results: null roles and texts are empty strings; turns are ordered with null first, equal turns of one
conversation by their digests, and repeated rows stay as turns of their own; rows without conv_id are ignored; a
conversation whose rebuilt form has no turn ends at the root; an empty table has no node; other columns are ignored.
A task holds the digests (not the texts) of a whole conversation: 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, default_parallelism, drop_cut

#: Bytes of a turn's digest; bytes of keys that a task merges; rows of a run; ids that are joined into one block (a power of two's exponent).
TURN, RANGE_BYTES, RUN_ROWS, BLOCK = 16, 16 << 20, 2048, 12
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def common_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two keys share, given that they share `at`."""
    n = min(len(a), len(b))
    i, step = at * TURN, TURN
    while i < n:  # longer and longer steps, then shorter ones
        if a[i : min(i + step, n)] == b[i : min(i + step, n)]:
            i += step
            step *= 2
        elif step == TURN:
            return i // TURN
        else:
            step = max(TURN, step // 2 // TURN * TURN)
    return n // TURN


class Run:
    """Sorted keys, each with the number of turns it shares with the one before it."""

    def __init__(self, keys: list[bytes]):
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        self.keys = [keys[i] for i in self.order]
        self.lcp = [0, *map(common_turns, self.keys, self.keys[1:])]


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, turns shared with the key before) over all runs in order of keys, by a loser tree.

    lcp[i] is what the head of run i shares with the last winner that it met; heads on a winner's way up have all
    lost to that winner, so their numbers compare."""
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    head: list[bytes | None] = [r.keys[0] if r.keys else None for r in runs] + [None] * (k - len(runs))
    lcp = [0] * k

    def meet(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        shared = common_turns(x, y, lcp[a])
        if x[shared * TURN : shared * TURN + TURN] <= y[shared * TURN : shared * TURN + TURN]:
            lcp[b] = shared
            return a, b
        lcp[a] = shared
        return b, a

    losers = [0] * k
    winners = list(range(k))
    size = k
    while size > 1:  # the first tournament, level by level
        size //= 2
        played = [meet(winners[2 * i], winners[2 * i + 1]) for i in range(size)]
        losers[size : 2 * size] = [b for _, b in played]
        winners = [a for a, _ in played]
    best = winners[0] if winners else 0
    while head[best] is not None:
        yield best, at[best], lcp[best]
        at[best] += 1
        run = runs[best]
        more = at[best] < len(run.keys)
        head[best], lcp[best] = (run.keys[at[best]], run.lcp[at[best]]) if more else (None, 0)
        i = (best + k) // 2
        while i:
            best, losers[i] = meet(best, losers[i])
            i //= 2


def node_ids(key: bytes) -> list[bytes]:
    """A name of 128 bits for each node on a key's path, the root first."""
    h = hashlib.blake2b(digest_size=16)
    out = [h.digest()]
    for i in range(0, len(key), TURN):
        h.update(key[i : i + TURN])
        out.append(h.copy().digest())
    return out


class Trie:
    """Nodes of sorted keys as columns; `open` is the path from the root to the last key."""

    def __init__(self):
        self.depth, self.parent, self.words, self.n, self.least = [], [], [], [], []
        self.children, self.leaves, self.saved, self.sha, self.shared = [], [], [], [], []
        self.open: list[int] = []

    def _push(self, words: int, shared: bool) -> None:
        self.depth.append(len(self.open))
        self.parent.append(self.open[-1] if self.open else -1)
        self.words.append(words)
        self.sha.append(None)
        self.least.append(None)
        self.shared.append(shared)
        for c in (self.n, self.children, self.leaves, self.saved):
            c.append(0)
        self.open.append(len(self.n) - 1)

    def _pop(self) -> None:
        i = self.open.pop()
        up = self.parent[i]
        if up < 0:
            return
        self.n[up] += self.n[i]
        self.least[up] = self.least[i] if self.least[up] is None else min(self.least[up], self.least[i])
        if self.shared[i]:  # its neighbours' parts are not known here
            return
        self.leaves[i] = self.leaves[i] or 1
        self.saved[i] += (self.n[i] - 1) * self.words[i]
        self.children[up] += 1
        self.leaves[up] += self.leaves[i]
        self.saved[up] += self.saved[i]

    def add(self, shared_turns: int, words: np.ndarray, n: int, least: int, sha: str) -> None:
        """The next key: words of each of its turns, its conversations, the smallest of them, the hash of all."""
        first = not self.n
        if first:
            self._push(0, True)
        while len(self.open) > shared_turns + 1:
            self._pop()
        for w in words[len(self.open) - 1 :].tolist():
            self._push(w, first)
        i = self.open[-1]
        self.n[i] += n
        self.least[i] = least if self.least[i] is None else min(self.least[i], least)
        self.sha[i] = sha

    def close(self) -> list[int]:
        """Ends the stream: the nodes on the last path, the root first."""
        last = list(self.open)
        for i in last:
            self.shared[i] = True
        while self.open:
            self._pop()
        return last


NODES = "conv_id long, depth long, parent_conv_id long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part int, place int, id binary, words long"


def trie_of_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of distinct keys (key, words, n, conv_id, sha); those with an id are parts of nodes."""
    runs: list[Run] = []
    rows: list[tuple] = []
    for b in batches:
        for i in range(0, b.num_rows, RUN_ROWS):
            s = b.slice(i, RUN_ROWS)
            run = Run(s.column(0).to_pylist())
            order = pa.array(run.order, pa.int64())
            runs.append(run)
            rows.append(tuple(s.column(k).take(order) for k in range(1, 5)))
    if not runs:
        return
    trie = Trie()
    first = last = None
    for r, i, shared in merged(runs):
        words, n, least, sha = rows[r]
        trie.add(shared, np.frombuffer(words[i].as_py(), np.int32), n[i].as_py(), least[i].as_py(), sha[i].as_py())
        last = runs[r].keys[i]
        first = last if first is None else first
    end = trie.close()
    left = list(range(len(first) // TURN + 1))  # the first path was pushed first
    names: dict[int, bytes] = dict(zip(left, node_ids(first)))
    names.update(zip(end, node_ids(last)))
    on_left = set(left)
    in_order = [*left, *(i for i in end if i not in on_left)]
    place = {i: k for k, i in enumerate(in_order)}
    part = TaskContext.get().partitionId()
    total = len(trie.n)
    for at in range(0, total, 50_000):
        some = range(at, min(at + 50_000, total))
        inner = [i not in names for i in some]
        up = [trie.parent[i] for i in some]
        col = lambda x, kind=pa.int64(): pa.array([x[i] for i in some], kind)
        yield pa.RecordBatch.from_arrays(
            [
                col(trie.least), col(trie.depth), pa.array([trie.least[u] if u >= 0 and u not in names else None for u in up], pa.int64()),
                pa.array([names.get(u) for u in up], pa.binary()), col(trie.n), col(trie.children), col(trie.leaves), col(trie.saved),
                pa.array([(trie.sha[i] or EMPTY_SHA) if own else trie.sha[i] for i, own in zip(some, inner)], pa.string()),
                pa.array([part] * len(inner), pa.int32()), pa.array([place.get(i) for i in some], pa.int32()), pa.array([names.get(i) for i in some], pa.binary()), col(trie.words),
            ],
            names=[x.split()[0] for x in NODES.split(", ")],
        )


def joined_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes out of their parts in order of tasks and places: parts of one node follow one another along the open path."""
    path: list[dict] = []
    done: list[dict] = []

    def pop():
        x = path.pop()
        x["n_leaves"] = x["n_leaves"] or 1
        x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
        x["ends_sha256"] = x["ends_sha256"] or EMPTY_SHA
        if path:
            up = path[-1]
            up["n_children"] += 1
            up["n_leaves"] += x["n_leaves"]
            up["saved_tokens"] += x["saved_tokens"]
        done.append(x)

    def out():
        cols = {k: [x[k] for x in done] for k in ("conv_id", "depth", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "id")}
        done.clear()
        return pa.RecordBatch.from_pydict({**cols}, schema=pa.schema([(k, pa.binary() if k in ("up", "id") else pa.string() if k == "ends_sha256" else pa.int64()) for k in cols]))

    for b in batches:
        for x in b.to_pylist():
            d = x["depth"]
            if d < len(path) and path[d]["id"] == x["id"]:  # what is open below it may go on too
                own = path[d]
                for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    own[k] += x[k]
                own["conv_id"] = min(own["conv_id"], x["conv_id"])
                own["ends_sha256"] = own["ends_sha256"] or x["ends_sha256"]
            else:
                while len(path) > d:
                    pop()
                path.append(x)
        if len(done) > 10_000:
            yield out()
    while path:
        pop()
    if done:
        yield out()


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, d, w): each turn's digest and words; its text goes no further."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    role, said = text(role_col), text(text_col)
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, said)
    return conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * TURN)).alias("d"), F.regexp_count(said, F.lit(WORD)).cast("int").alias("w")
    )


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, t): a conversation's turns in order."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "w"))).alias("t"))


def with_shared_heads(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, t): each conversation c anew: the first h turns of conversation c - c % every, then its own after its
    first h; h = crc32(c as text) % heads."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    own = convs.select("conv_id", "t", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("_base"))
    base = convs.select(F.col("conv_id").alias("_base"), F.slice("t", 1, heads).alias("_head"))
    none = F.slice("t", 1, 0)
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    return own.join(base, "_base", "left").select("conv_id", F.concat(F.slice(F.coalesce("_head", none), F.lit(1), F.col("h")), rest).alias("t"))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, seq, key, words) of (conv_id, digests, words): arrays as bytes."""
    for b in batches:
        for s in (b.slice(i, RUN_ROWS) for i in range(0, b.num_rows, RUN_ROWS)):
            digests, words = s.column(1), s.column(2)
            size = np.concatenate([[0], np.cumsum(digests.value_lengths().to_numpy(zero_copy_only=False))])
            raw, w = b"".join(digests.flatten().to_pylist()), words.flatten().to_numpy().astype(np.int32)
            keys = [raw[x * TURN : y * TURN] for x, y in zip(size[:-1].tolist(), size[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [s.column(0), pa.array([hashlib.blake2b(k, digest_size=16).digest() for k in keys], pa.binary()), pa.array(keys, pa.binary()), pa.array([w[x:y].tobytes() for x, y in zip(size[:-1], size[1:])], pa.binary())],
                names=["conv_id", "seq", "key", "words"],
            )


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, sha) of blocks of joined ids, sorted by seq and block."""
    now, h = None, hashlib.sha256()
    for b in batches:
        seqs, shas = [], []
        for seq, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if seq == now:
                h.update(b",")
            else:
                if now is not None:
                    seqs.append(now)
                    shas.append(h.hexdigest())
                now, h = seq, hashlib.sha256()
            h.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), pa.array(shas, pa.string())], names=["seq", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["seq", "sha"])


def trie_nodes(convs: DataFrame, range_bytes: int = RANGE_BYTES, ranges: int | None = None) -> DataFrame:
    """The nodes of conversations (conv_id, t): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    keyed = cut(convs.select("conv_id", F.transform("t", lambda x: x.d).alias("d"), F.transform("t", lambda x: x.w).alias("w")).mapInArrow(_packed, "conv_id long, seq binary, key binary, words binary"), "keys")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = keyed.groupBy("seq", F.shiftright("conv_id", BLOCK).alias("block")).agg(ids.alias("ids"))
    ends = blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "ids").mapInArrow(_ends, "seq binary, sha string")
    one = keyed.groupBy("seq").agg(F.any_value("key").alias("key"), F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    rows = cut(one.join(ends, "seq").select("key", "words", "n", "conv_id", "sha"), "rows")
    drop_cut(keyed)
    size = rows.agg(F.sum(F.octet_length("key") + F.octet_length("words"))).first()[0] or 0
    parts = ranges or max(2 * default_parallelism(spark), -(-size // range_bytes))
    nodes = cut(rows.repartitionByRange(parts, "key").mapInArrow(trie_of_range, NODES), "nodes")
    drop_cut(rows)
    spine = nodes.where("id IS NOT NULL").select("part", "place", "conv_id", "depth", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "id", "words")
    closed = cut(spine.coalesce(1).sortWithinPartitions("part", "place").mapInArrow(joined_parts, "conv_id long, depth long, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id binary"), "closed")
    names = closed.select(F.col("id").alias("up"), F.col("conv_id").alias("_up_conv"))
    if closed.count() <= 1 << 18:  # two paths a task; beyond that a join that Spark splits where a parent has very many children
        names = F.broadcast(names)
    last = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where("id IS NULL")
    waiting = inner.where("up IS NOT NULL").select("conv_id", "depth", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").unionByName(closed.drop("id"))
    return inner.where("up IS NULL").select(*last).unionByName(waiting.join(names, "up", "left").withColumnRenamed("_up_conv", "parent_conv_id").select(*last))


def conversation_trie(conversations: DataFrame, every: int | None = None, heads: int = 4, ranges: int | None = None) -> DataFrame:
    """The prefix trie of a table (conv_id, turn, role, text); with `every`, of conversations with shared heads."""
    convs = sequences(turn_rows(conversations))
    if every:
        convs = with_shared_heads(cut(convs, "convs"), every, heads)
    return trie_nodes(convs, ranges=ranges)
