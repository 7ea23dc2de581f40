"""Size-aware heavy-light join of word n-gram sets by Jaccard similarity, and its components.

Sets are the nodes, so copies of a text are one node from the start. Two light sets (fewer than
`boundary` shingles) that must share c shingles share a c-subset, so each light set enumerates its
subsets of the sizes its partners need, and a group under one subset key is linked by a star. A pair
with a heavy set shares one of the prefix shingles that inverted lists hold, rarest shingles first; the
boundary is where enumerating costs less than scanning. Inverted lists are never expanded into all pairs
up front, but for short ones: each list's most connected member is verified against the others, and only members that still
lie in different components are paired, round by round, until no untested pair is left between
components. So no link that decides a component is lost, while a group of n near copies costs about n
verifications. A pair goes on from a list only if enough of both sets stands behind the shared shingle, and
its sets travel only if their parity signatures allow it; neither test loses a link. Where near copies don't link with their list's centre, their differences to it stand for
them: pairs that must link by these differences are linked without meeting, and others only meet if they
share one.

Rarity comes from counts of hashed shingles over all documents (2**SKETCH_BITS counters, a fixed size).
It orders prefixes only: any counts give the same result.

Defined results: null or empty texts and texts without words have an empty set and are their own
component; fewer words than n make one shingle; repeated rows are linked as copies; rows without an id
get the component of their set, and sets that only such rows hold are not linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import FILTER_BITS, bits_for, bloom_of, holds, positions
from .common import arrow_batches, cut, drop_cut, free_shuffles, ids_and_text, slices
from .components import components
from .words import by_bytes, shingle_sets

SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 15
#: Tasks whose counts are added up in one group.
MERGED = 64
#: Members of one star that a task joins with what is known of their centre; larger stars are salted, at most MOST_SALTED of them.
STAR_ROWS, MOST_SALTED = 20_000, 1_000
#: Largest set size that subset enumeration is considered for.
LIGHT_MOST = 40
#: Differences are kept for pairs up to this many times as far apart as linked ones may be.
NEAR = 4
#: Members from which on a star draws others of its lists to it.
LARGE = 16
#: Members up to which a list's pairs are all looked at in the first round.
SHORT = 8
#: Untested pairs between components, for each set, above which another round of stars comes before all of them are tested.
DENSE = 2
#: Share of the open pairs that a round of stars must close to be followed by another one.
CLOSED = 0.1


def need(s: int, t: int, num: int, den: int) -> int:
    """Shingles that sets of s and t must share: den * shared >= num * (s + t - shared)."""
    return -(-num * (s + t) // (num + den))


def partners(s: int, num: int, den: int) -> range:
    """Sizes that a set of s can link with."""
    return range(-(-num * s // den), den * s // num + 1)


def probe_prefix(s: int, num: int, den: int) -> int:
    return s + (num * s) // -den + 1


def index_prefix(s: int, num: int, den: int) -> int:
    """Enough when the partner is no smaller."""
    return s - need(s, s, num, den) + 1


def subsets(s: int, boundary: int, num: int, den: int) -> list[tuple[int, int]]:
    """(partner size, subset size) for which a light set of s enumerates subsets."""
    return [(t, c) for t in partners(s, num, den) if 0 < t < boundary and (c := need(s, t, num, den)) <= min(s, t)]


def choose_boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The size below which enumerating subsets makes fewer rows than prefixes in inverted lists."""
    best, cost = 1, None
    for b in range(1, LIGHT_MOST + 1):
        light = sum(n * sum(math.comb(s, c) for _, c in subsets(s, b, num, den)) for s, n in sizes.items() if s < b)
        lists = sum(n * probe_prefix(s, num, den) for s, n in sizes.items() if den * s >= num * b)
        if cost is None or light + lists < cost:
            best, cost = b, light + lists
    return best


def _sid(s: np.ndarray, seed: int) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=seed)], np.uint64).view(np.int64)[0])


def _first_pass(docs: DataFrame, n: int, seed: int, spread: int) -> DataFrame:
    """A row for each document (doc_id, n_shingles, sid, key, and the set's signature where a task first meets it)
    and, at each task's end, its shingle counts."""

    def run(batches):
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint8), set()
        for b in by_bytes(batches, 1):
            sets = shingle_sets(b.column(1), n)
            sids = [_sid(s, seed) if len(s) else None for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            new = {i: s for i, s in zip(sids, sets) if i is not None and i not in seen}
            seen.update(new)
            if new:
                at, more = np.unique((np.concatenate(list(new.values())) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.uint32), return_counts=True)
                counts[at] = np.minimum(counts[at] + more, 255)  # a task's count of a hot shingle ends at 255; their sum still stands out
            sigs = [signature(new.pop(i), spread) if i in new else None for i in sids]
            k = len(sets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        blocks = [(i, zlib.compress(counts[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK].tobytes(), 1)) for i in range(len(counts) // SKETCH_BLOCK)]
        k = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array([i for i, _ in blocks], pa.int32()), pa.array([z for _, z in blocks], pa.binary())], names=names)

    names = ["doc_id", "n_shingles", "sid", "key", "sig", "block", "counts"]
    return docs.mapInArrow(run, "doc_id long, n_shingles long, sid long, key binary, sig binary, block int, counts binary").withColumn("task", F.spark_partition_id())


def _sketch(rows: DataFrame) -> np.ndarray:
    """Sums of the tasks' counts, those of MERGED tasks in one group at a time, so that no group grows with their number."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH_BLOCK, np.uint32)
        for z in pdf["counts"]:
            x = zlib.decompress(z)
            total += np.frombuffer(x, np.uint8 if len(x) == SKETCH_BLOCK else np.uint32)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "task": [pdf["task"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    part = rows.where("block IS NOT NULL").select("block", "task", "counts")
    last = part.agg(F.max("task")).first()[0] or 0
    while last >= MERGED:
        part = part.withColumn("task", F.floor(F.col("task") / MERGED).cast("int")).groupBy("block", "task").applyInPandas(add, "block int, task int, counts binary")
        last //= MERGED
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for block, _, z in part.groupBy("block").applyInPandas(add, "block int, task int, counts binary").collect():  # 16 MB
        out[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(zlib.decompress(z), np.uint32)
    return out


def _postings(docs: DataFrame, n: int, seed: int, sketch, boundary: int, num: int, den: int) -> DataFrame:
    """(h, sid, size, role, at): role 1 is a prefix shingle and its place in the set's order, rarest first;
    2 and 3 are a light set's subset keys, as the smaller and as the larger side (2 with equal sizes)."""

    def run(batches):
        seen, counts = set(), sketch.value
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for b in by_bytes(batches, 1):
            hs, sids, sizes, roles, places = [], [], [], [], []

            def add(h, sid, size, role, at):
                hs.append(h)
                sids.append(np.full(len(h), sid, np.int64))
                sizes.append(np.full(len(h), size, np.int32))
                roles.append(np.full(len(h), role, np.int8))
                places.append(at)

            for s in shingle_sets(b.column(1), n):
                if not len(s) or (sid := _sid(s, seed)) in seen:
                    continue
                seen.add(sid)
                size = len(s)
                if size < boundary:
                    for t, c in subsets(size, boundary, num, den):
                        lo, hi, role = min(size, t), max(size, t), 3 if size > t else 2
                        keys = [xxhash.xxh3_64_intdigest(s[list(x)].tobytes(), seed=(c * 1000 + lo) * 1000 + hi) for x in itertools.combinations(range(size), c)]
                        add(np.array(keys, np.uint64), sid, size, role, np.zeros(len(keys), np.int32))
                if den * size >= num * boundary:
                    p = probe_prefix(size, num, den)
                    of = counts[s & mask]
                    # the p rarest, ties by hash: the same order for every set
                    near = np.flatnonzero(of <= np.partition(of, p - 1)[p - 1])
                    add(s[near[np.argsort(of[near], kind="stable")[:p]]], sid, size, 1, np.arange(p, dtype=np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(roles)), pa.array(np.concatenate(places))], names=["h", "sid", "size", "role", "at"])

    return docs.mapInArrow(run, "h long, sid long, size int, role byte, at int")


def signature(s: np.ndarray, spread: int = 0) -> bytes:
    """Parities of the counts of a set's hashes by their low bits. Two sets differ in at least as many hashes as
    their signatures, folded to one length, differ in bits. Longer for larger sets, a power of two of bits."""
    bits = 1 << max(6, int(len(s)).bit_length() + spread)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of hashes that one of two sets has alone, from their signatures."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):  # parities of a shorter signature are sums of those of a longer one
        small, large = (a, b) if len(a) < len(b) else (b, a)
        a, b = small, np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _sets_of(docs: DataFrame, n: int, seed: int, ids: DataFrame) -> DataFrame:
    """(sid, shingles) of the documents with these ids, which may be named more than once.

    They are picked where the texts are read, by a Bloom filter, or by a join where ids are too many for one. A false
    positive, or an id on two rows, gives a set twice and verifies its pairs twice; that changes nothing."""
    count = ids.agg(F.approx_count_distinct(ids.columns[0], 0.02)).first()[0]
    bits = bits_for(count)
    fits = bits >= FILTER_BITS * count
    if fits:
        wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(ids, bits))  # bits / 8, at most 32 MB
    else:
        docs = docs.join(ids.withColumnRenamed(ids.columns[0], "doc_id"), "doc_id", "left_semi").select("doc_id", "text")

    def run(batches):
        words = np.frombuffer(wanted.value, np.uint8) if fits else None

        def hits():
            for b in batches:
                b = b.filter(b.column(0).is_valid())
                if b.num_rows and fits:
                    b = b.filter(pa.array(holds(words, positions(b.column(0).to_numpy().view(np.uint64), bits))))
                if b.num_rows:
                    yield b

        for b in by_bytes(hits(), 1):
            sets = [s for s in shingle_sets(b.column(1), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_sid(s, seed) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "shingles"])

    return docs.mapInArrow(run, "sid long, shingles binary")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, seed: int, num: int, den: int, wide: int = NEAR) -> DataFrame:
    """(a, b, linked, a_size, size, diff) of pairs (a, a_size, b, size): whether their sets are similar enough and, for
    pairs not over `wide` times as far apart as linked ones may be, the shingles that only one of them has. Pairs whose
    signatures show that they are farther apart than that end there; only the sets of the others travel, hubs last."""

    def near(batches):
        for b in slices(batches, 4096):
            a_size, size = b.column(1).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
            most = wide * (den - num) * (a_size + size) // (den + num)
            keep = [least_apart(x, y) <= m for x, y, m in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), most.tolist())]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 2, 6, 7])

    known = nodes.where("rep IS NOT NULL")
    sig = lambda side: known.select(F.col("sid").alias(side), F.col("sig").alias("s" + side), F.col("rep").alias("r" + side))
    close = pairs.join(sig("b"), "b").join(sig("a"), "a").select("a", "a_size", "b", "size", "sa", "sb", "ra", "rb").mapInArrow(near, "a long, b long, ra long, rb long")
    close = cut(close, "close")
    sets = cut(_sets_of(docs, n, seed, close.select(F.col("ra").alias("rep")).union(close.select("rb"))), "shingles")

    def run(batches):
        last, x = None, None
        for b in slices(batches):
            linked, a_sizes, sizes, diffs = [], [], [], []
            for a, sa, sb in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if a != last:
                    last, x = a, np.frombuffer(sa, np.int64)
                y = np.frombuffer(sb, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                apart = len(x) + len(y) - 2 * both
                linked.append(den * both >= num * (len(x) + len(y) - both))
                a_sizes.append(len(x))
                sizes.append(len(y))
                diffs.append(np.setxor1d(x, y, assume_unique=True).tolist() if wide > 1 and (den + num) * apart <= wide * (den - num) * (len(x) + len(y)) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_()), pa.array(a_sizes, pa.int32()), pa.array(sizes, pa.int32()), pa.array(diffs, pa.list_(pa.int64()))], names=["a", "b", "linked", "a_size", "size", "diff"])

    of = lambda side: sets.select(F.col("sid").alias(side), F.col("shingles").alias("s" + side))
    found = close.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean, a_size int, size int, diff array<long>")
    found = cut(found, "found")
    drop_cut(close)
    drop_cut(sets)
    free_shuffles(docs.sparkSession)
    return found


def _weights(found: DataFrame) -> DataFrame:
    """(a, weight, a_size): members near each star's centre, and its size."""
    return found.where("diff IS NOT NULL").groupBy("a").agg(F.count(F.lit(1)).alias("weight"), F.max("a_size").alias("a_size"))


def _towards_large_stars(members: DataFrame, found: DataFrame) -> DataFrame:
    """(a, a_size, b, size): for each list, the centre of the largest star that any of its members is in, with every
    member that is in another or none."""
    weight = _weights(found).where(F.col("weight") >= LARGE)
    reach = found.where("diff IS NOT NULL").select("a", "b").join(weight, "a").select(F.col("b").alias("sid"), "weight", F.col("a").alias("hub"), F.col("a_size").alias("hub_size"))
    own = weight.select(F.col("a").alias("sid"), "weight", F.col("a").alias("hub"), F.col("a_size").alias("hub_size"))
    mine = reach.union(own).groupBy("sid").agg(F.max(F.struct("weight", "hub", "hub_size")).alias("mine"))
    rows = members.select("h", "sid", "size").join(mine, "sid", "left")
    top = rows.where("mine IS NOT NULL").groupBy("h").agg(F.max(F.struct("mine.weight", "mine.hub", "mine.hub_size")).alias("top"))
    rows = rows.join(top, "h").where(~F.col("top.hub").eqNullSafe(F.col("mine.hub")) & (F.col("top.hub") != F.col("sid")))
    return rows.select(F.col("top.hub").alias("a"), F.col("top.hub_size").alias("a_size"), F.col("sid").alias("b"), "size").dropDuplicates(["a", "b"])


def _salted(rows: DataFrame, about: DataFrame, most: int) -> DataFrame:
    """rows (hub, sid, members of a large star, else 0) joined with what is known of each star (hub, n, more): the
    rows of a star of more than `most` members go to several tasks."""
    spread = about.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / most)))).drop("n")
    return rows.withColumn("_salt", F.pmod(F.xxhash64("sid"), F.floor(F.col("members") / most) + 1)).join(spread, ["hub", "_salt"], "left").drop("_salt")


def _groups(found: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """What verified stars say about pairs of a star's own members, without meeting each pair.

    Members of a star are kept as differences to its centre, corrected by the differences that most
    members share. Of two members, |a ^ b| = |da| + |db| - 2 |da & db|: where the first two are small
    enough they link, and all such pairs hang together in a star around the member of the least
    (den + num) |d| - (den - num) size; any other pair can link only if it shares a difference, and
    edits of one copy are seldom those of another. Returns (links a b; lists h sid size of shared
    differences; the star that each sid belongs to: sid grp; parities of the differences: sid d; tables to delete once
    those are written)."""
    near = found.where("diff IS NOT NULL").drop("a_size").join(_weights(found), "a")
    # the largest star within reach, so that few pairs lie across stars
    mine = near.groupBy("b").agg(F.max(F.struct("weight", F.col("a").alias("hub"), "size", "diff")).alias("m")).select(F.col("b").alias("sid"), "m.hub", "m.size", "m.diff")
    centres = mine.select(F.col("hub").alias("sid")).distinct()
    # a centre belongs to its own star, with no difference
    sizes = found.where("linked OR diff IS NOT NULL").groupBy(F.col("a").alias("sid")).agg(F.max("a_size").alias("size"))
    mine = mine.join(centres, "sid", "left_anti").unionByName(centres.join(sizes, "sid").select("sid", F.col("sid").alias("hub"), "size", F.array().cast("array<long>").alias("diff")))
    mine = cut(mine, "stars")
    total = mine.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    most = max(STAR_ROWS, mine.count() // MOST_SALTED)
    often = mine.select("hub", F.explode("diff").alias("e")).groupBy("hub", "e").agg(F.count(F.lit(1)).alias("c")).where("c > 1").join(total, "hub").where("2 * c > n")
    # at most twice as many as a member's differences
    common = total.join(often.groupBy("hub").agg(F.collect_list("e").alias("u")), "hub", "left")
    large = F.broadcast(total.where(F.col("n") > most).select("hub", F.col("n").alias("members")))  # at most MOST_SALTED rows
    counted = mine.join(large, "hub", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))
    d = F.when(F.col("u").isNull(), F.col("diff")).otherwise(F.concat(F.array_except("diff", "u"), F.array_except("u", "diff")))
    rows = _salted(counted, common, most).select("hub", "sid", "size", "members", d.alias("d")).withColumn("f", F.size("d") * (den + num) - F.col("size") * (den - num))
    rows = cut(rows, "stars")
    least = cut(rows.groupBy("hub").agg(F.min(F.struct("f", "sid")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    known = _salted(rows, least, most)
    links = known.where((F.col("f") + F.col("m.f") <= 0) & (F.col("sid") != F.col("m.sid"))).select(F.col("m.sid").alias("a"), F.col("sid").alias("b"))
    # a pair must share (f + f') / (2 den + 2 num) differences, so it shares one of the rarest of each:
    # few of the member with the smaller f (its partner's is no smaller), some more of the other
    q = den + num
    each = known.select("hub", "sid", "size", "f", F.size("d").alias("n"), F.col("m.f").alias("f0"), F.explode("d").alias("e"))
    each = each.join(each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("c")), ["hub", "e"])
    each = each.withColumn("at", F.row_number().over(Window.partitionBy("sid").orderBy("c", "e")))
    one = F.lit(1).cast("long")
    probe = F.col("n") - F.greatest(F.ceil((F.col("f") + F.col("f0")) / (2 * q)), one) + 1
    index = F.col("n") - F.greatest(F.ceil(F.col("f") / q), one) + 1
    shared = each.where(F.col("at") <= F.greatest(probe, index)).select(F.xxhash64("hub", "e").alias("h"), "sid", "size", "f", F.when(F.col("at") <= index, SHARED_FIRST).otherwise(SHARED).cast("byte").alias("role"))
    return links, shared, mine.select("sid", F.col("hub").alias("grp")), rows.select("sid", parities(F.col("d")).alias("d")), [mine, rows, least]


#: Longs of the parities of a member's differences; a fixed size.
PARITY_WORDS = 8


def parities(d):
    """Array of PARITY_WORDS longs: for each bit the parity of the count of the hashes in d that fall on it."""
    one = F.lit(1).cast("long")
    word = lambda k: F.aggregate(F.filter(d, lambda e: F.shiftright(e, 6).bitwiseAND(F.lit(PARITY_WORDS - 1)) == k), F.lit(0).cast("long"), lambda x, e: x.bitwiseXOR(F.call_function("shiftleft", one, e.bitwiseAND(F.lit(63)).cast("int"))))
    return F.array(*(word(k) for k in range(PARITY_WORDS)))


#: Roles of a row in a list of shared differences: SHARED_FIRST also serves with a partner of larger f.
SHARED, SHARED_FIRST = 9, 10


def _can_link(x: str, y: str, num: int, den: int):
    return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)


def _may_pair(boundary: int, num: int, den: int):
    """Whether two rows of one key (size, role and size2, role2) name a pair that this key is to find."""
    lists = (F.col("role") < 2) & (F.col("role2") < 2) & (F.greatest("size", "size2") >= boundary) & _can_link("size", "size2", num, den)
    # sets share no shingle before the first one they share: from its places on there must be enough of both
    rest = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    lists = lists & (rest * (num + den) >= (F.col("size") + F.col("size2")) * num)
    subset = F.col("role").between(2, 3) & F.col("role2").between(2, 3) & ((F.col("size") == F.col("size2")) | (F.col("role") != F.col("role2")))
    shared = (F.col("role") >= SHARED) & (F.col("role2") >= SHARED) & _can_link("size", "size2", num, den) & (F.col("f") + F.col("f2") > 0)
    shared = shared & (((F.col("f") <= F.col("f2")) & (F.col("role") == SHARED_FIRST)) | ((F.col("f2") <= F.col("f")) & (F.col("role2") == SHARED_FIRST)))
    # of one star: a pair differs in at least as many shingles as the parities of its differences to the centre do
    bits = F.aggregate(F.zip_with("d", "d2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    shared = shared & (bits * (num + den) <= (F.col("size") + F.col("size2")) * (den - num))
    return (lists | subset | shared) & (F.col("grp") != F.col("grp2"))


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents link where
    den * |intersection| >= num * |union| of their n-word shingle sets, and component_id is the
    smallest doc_id reachable by links."""
    with arrow_batches(docs.sparkSession):
        return _linked(docs, n, num, den, id_col, text_col)


def _linked(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """jaccard_components(), whose stored tables are all made when it returns."""
    spark = docs.sparkSession
    some = ids_and_text(docs, id_col, text_col)
    spread = 0 if NEAR * 4 * (den - num) <= den + num else 2
    for seed in range(4):
        first = cut(_first_pass(some, n, seed, spread), "sets")
        nodes = first.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"), F.first("sig", ignorenulls=True).alias("sig"), (F.min("key") != F.max("key")).alias("two"))
        nodes = cut(nodes, "nodes")
        of_size = nodes.groupBy(F.when(F.col("size") <= 2 * LIGHT_MOST, F.col("size")).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.bool_or("two").alias("two")).collect()
        if not any(r.two for r in of_size):  # no two different sets share a 64-bit id
            break
        drop_cut(first)
        drop_cut(nodes)
    else:
        raise RuntimeError("64-bit set ids collide under every seed")
    sizes = {int(r.size): int(r.n) for r in of_size if r.size is not None}
    boundary = choose_boundary(sizes, num, den)
    sketch = spark.sparkContext.broadcast(_sketch(first))  # 16 MB
    rows = cut(_postings(some, n, seed, sketch, boundary, num, den), "postings")
    sketch.unpersist()
    # keys that two different sets have; a set's rows from several tasks say the same
    both = rows.groupBy("h").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("h")
    lists = rows.join(both, "h", "left_semi").dropDuplicates(["h", "sid", "role"])
    # they lie by h already: their number takes no exchange
    lists = cut(lists.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))), "lists")
    drop_cut(rows)
    degree = cut(lists.groupBy("sid").agg(F.sum("n").alias("degree")), "degree")
    n_open = degree.count()
    about = ("sid", "size", "role", "at", "degree", "grp", "f", "d")
    columns = ("h", *about)
    members = cut(lists.join(degree, "sid").select("h", "sid", "size", "role", "at", "degree", F.col("sid").alias("grp"), F.lit(0).cast("long").alias("f"), F.lit(None).cast("array<long>").alias("d"), "n"), "members")
    drop_cut(lists)
    del rows, both, lists
    free_shuffles(spark)
    may = _may_pair(boundary, num, den)
    label, tested, before, last = None, [], None, False
    while True:
        if last:  # the round before linked nothing: the lists are as they were
            pass
        elif label is None:
            rows = members.withColumn("comp", F.col("sid"))
        else:
            rows = members.join(label, F.col("sid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "sid")).drop("node", "component")
            apart = rows.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("h")
            rows = cut(rows.join(apart, "h", "left_semi"), "open")
        if label is not None and not last:
            # of all pairs of a list, those of one component or star don't count
            square = F.col("k").cast("double") * F.col("k")
            counts = rows.groupingSets([["h"], ["h", "comp"], ["h", "grp"], ["h", "comp", "grp"]], "h", "comp", "grp").agg(F.count(F.lit(1)).alias("k"), F.grouping_id().alias("by"))
            left = (counts.agg(F.sum(F.when(F.col("by").isin(1, 2), -square).otherwise(square))).first()[0] or 0) / 2
            if not left:
                drop_cut(rows)
                break
            # stars go on while they close pairs fast; what is open then is tested pair by pair
            last = left <= DENSE * n_open or (before is not None and left > (1 - CLOSED) * before)
            before = left

        def met(x: DataFrame) -> DataFrame:  # all pairs of each list
            other = x.select("h", *(F.col(c).alias(c + "2") for c in (*about, "comp")))
            return x.join(other, "h").where("comp < comp2").where(may)  # noqa: B023

        if last:
            pairs = met(rows)
        else:
            # each list's most connected member, and later also the most connected one outside that member's component
            hub = F.struct("degree", "sid", "size", "role", "at", "comp", "grp", "f", "d")
            long_ = rows.where(F.col("n") > SHORT) if label is None else rows
            best = long_.groupBy("h").agg(F.max(hub).alias("hub"))
            if label is None:
                hubs = best.select("h", F.col("hub").alias("x"))
            else:
                second = long_.join(best, "h").where(F.col("comp") != F.col("hub.comp")).groupBy("h").agg(F.max(hub).alias("x"))
                hubs = best.select("h", F.col("hub").alias("x")).unionByName(second)
            named = [*about, "comp", *(c + "2" for c in (*about, "comp"))]
            pairs = long_.join(hubs, "h").select(*about, "comp", *(F.col("x." + c).alias(c + "2") for c in (*about, "comp")))
            pairs = pairs.where("comp <> comp2").where(may)
            if label is None:
                pairs = pairs.union(met(rows.where(F.col("n") <= SHORT)).select(*named))
        first_is_hub = F.struct("degree", "sid") > F.struct(F.col("degree2").alias("degree"), F.col("sid2").alias("sid"))
        one, two = ("sid", "size"), ("sid2", "size2")
        pick = lambda here, there: F.when(first_is_hub, F.col(here)).otherwise(F.col(there))  # noqa: B023, E731
        pairs = pairs.select(pick("sid", "sid2").alias("a"), pick("size", "size2").alias("a_size"), pick("sid2", "sid").alias("b"), pick("size2", "size").alias("size")).dropDuplicates(["a", "b"])
        if tested:
            pairs = pairs.join(functools.reduce(DataFrame.union, [t.select("a", "b") for t in tested]), ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        tested.append(pairs)
        free_shuffles(spark)
        found = _verify(pairs, nodes, some, n, seed, num, den, NEAR if label is None else 1)
        more = [found.where("linked").select("a", "b")]
        spent = [found]
        if label is None:
            again = _towards_large_stars(members, found).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
            again = cut(again, "pairs")
            tested.append(again)
            other = _verify(again, nodes, some, n, seed, num, den)
            spent.append(other)
            found = found.union(other)
            more.append(other.where("linked").select("a", "b"))
            certain, shared, stars, apart_by, parts = _groups(found, num, den)
            more.append(certain)
            shared = cut(shared.join(degree, "sid").select("h", "sid", "size", "role", F.lit(0).alias("at"), "degree", F.col("sid").alias("grp"), F.col("f").cast("long").alias("f")), "shared")
            wide = shared.groupBy("h").count().where("count > 1").select("h")
            now = members.where(F.col("n") > SHORT).drop("grp").join(stars, "sid", "left").withColumn("grp", F.coalesce("grp", "sid")).select(*columns)
            now = cut(now.unionByName(shared.join(wide, "h", "left_semi").join(apart_by, "sid").select(*columns)), "members")
            drop_cut(members)
            drop_cut(shared)
            members = now
            spent += parts
        links = cut(functools.reduce(DataFrame.union, more), "links")
        # later links all lie between components: without any, labels and lists stay
        same = label is not None and links.isEmpty()
        if label is not None and (last or not same):
            spent.append(rows)
        for t in spent:
            drop_cut(t)
        if not same:
            old, label = label, components(links if label is None else links.union(label))
            if old is not None:
                drop_cut(old)
        drop_cut(links)
        del pairs, found, spent, more
        free_shuffles(spark)
        if last:
            break
        last = same
    for t in (members, degree, *tested):
        drop_cut(t)
    members_of = nodes.select("sid", "rep").join(label, F.col("sid") == F.col("node"), "left").select("sid", "rep", F.coalesce("component", "sid").alias("comp"))
    smallest = members_of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_set = members_of.join(smallest, "comp").select(F.col("sid").alias("_sid"), "component_id")
    rows = first.where("block IS NULL")
    return rows.join(by_set, F.col("sid") == F.col("_sid"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
