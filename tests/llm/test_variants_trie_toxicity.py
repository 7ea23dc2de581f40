"""Spelling variants, the conversation trie and toxicity against brute force, on odd rows and small parts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import bigru, prefixtrie, queries, spelling, toxicity

from ..conftest import SF

# spelling variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_variants(rows, every=97):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 3}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            gaps[w[:i] + "*" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in count:
                near[w].add(short)
                near[short].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(x, key=lambda o: (-count[o], o)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if count[b] >= 2 * count[w]}
    out = []
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, count[w], len(near.get(w, ())), count[form[w]] if w in form else None))
    return sorted(out, key=repr)


def variants(df, **k):
    return sorted((tuple(r) for r in spelling.spelling_variants(df, **k).collect()), key=repr)


def test_variants_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    assert got == brute_variants(docs.select("doc_id", "text").collect())


def test_variants_in_shards_and_large_groups(spark, monkeypatch):
    """Many words with an equal half, in groups beyond SMALL, over several automata, with chains of forms."""
    random.seed(4)
    words = ["".join(random.choice("abé") for _ in range(random.randint(4, 8))) for _ in range(700)] + ["house" + c for c in "abcdefghijklmnopqrstuvwxyz"] + ["houses", "hous", "housess"]
    rows = [(i, " ".join(random.choices(words, k=400, weights=[1 / (1 + k % 17) for k in range(len(words))]))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_variants(rows)
    assert variants(df) == want and sum(r[1] is not None for r in want) > 100 and any(r[2] != r[1] for r in want if r[1])
    assert variants(df, shard_words=60) == want
    monkeypatch.setattr(spelling, "SMALL", 0)
    assert variants(df) == want


def test_variants_odd(spark):
    long = "ab" * 4000
    rows = [(1, None), (2, ""), (None, "MÄDCHEN Mädchen mÄdchen"), (3, f"Colour colour {long}"), (3, f"Colour colour {long}"), (3, f"Colour colour {long}"), (4, "color COLOR color 12ab_colorĀcolor \U0001f600color"), (5, "÷×÷×÷× ÷×÷×÷× ÷×÷×÷×")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    got = variants(df)
    assert got == brute_variants(rows) and {"mÄdchen", "mädchen", "÷×÷×÷×", "color", "colour"} & {r[0] for r in got}
    assert any(r[0] == long for r in got) or zlib.crc32(f"3:{long}".encode()) % 97 == 0
    assert variants(df.where("false")) == []


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
@settings(max_examples=300, deadline=None)
def test_one_edit(a, b):
    want = a != b and (any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
    assert spelling.one_edit(a, b) == want
    if len(a) >= 4 and len(b) >= 4:  # one half stands whole at the start or the end
        assert (0 in spelling.Shard([a], np.array([1])).near(b)) == want


@given(st.lists(st.tuples(st.binary(max_size=9), st.binary(max_size=spelling.TABLED)), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_crc_of_both(pairs):
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    got = spelling.crc_of_both(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# conversation trie


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute_trie(rows, every=None):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    if every:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - c % every, [])[: h[c]] + t[h[c] :] for c, t in turns.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    saved, leaves, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in children[k])
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        ends = ",".join(str(c) for c in sorted(members[k]) if len(turns[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def nodes(df, **k):
    return sorted((tuple(r) for r in prefixtrie.conversation_trie(df, **k).collect()), key=repr)


def test_trie_on_the_tables(spark):
    got = sorted((tuple(r) for r in queries.op12_conversation_trie(spark, SF).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)
    assert got == brute_trie(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect(), 20)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_trie_over_ranges(spark, ranges):
    """One opening that nearly all share, copies of one conversation, prefixes of others, over more tasks than paths."""
    random.seed(ranges)
    rows = []
    for c in range(160):
        n = random.randint(1, 6)
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello there" if t == 0 and c % 8 else f"w {random.randint(0, 2)}"))
    rows += [(c, t, "user", f"copy {t}") for c in range(5000, 5080) for t in range(4)] + [(9000, t, "user", f"copy {t}") for t in range(300)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), TURNS)
    assert nodes(df, ranges=ranges) == brute_trie(rows)
    assert nodes(df, ranges=ranges, every=20) == brute_trie(rows, 20)


def test_trie_odd(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first \x0b of all"), (2, 0, "", ""), (2, 0, "", ""), (None, 0, "user", "nobody's"), (-7, 1, "a:b", "c"), (-7, 2, "a", ":bc"), (20, 0, "user", "x " * 20000), (23, 3, "user", "x"), (1 << 40, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "0", 5) for r in rows], TURNS + ", seq string, n int")
    assert nodes(df) == brute_trie(rows)
    assert nodes(df.where("false"), every=20) == []
    assert nodes(df.where("conv_id = 23"), every=20) == brute_trie([r for r in rows if r[0] == 23], 20)


@given(st.lists(st.lists(st.sampled_from([b"a" * 16, b"b" * 16, b"a" * 15 + b"b"]), max_size=6).map(b"".join), max_size=40), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_loser_tree(keys, n):
    runs = [prefixtrie.Run(keys[i::n]) for i in range(n)]
    out = list(prefixtrie.merged(runs))
    merged = [runs[r].keys[i] for r, i, _ in out]
    assert merged == sorted(keys)
    assert [s for _, _, s in out] == [0, *(prefixtrie.common_turns(a, b) for a, b in zip(merged, merged[1:]))][: len(out)]


@given(st.binary(max_size=40), st.binary(max_size=12), st.binary(max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_turns(shared, a, b):
    key = lambda x: b"".join(bytes([c]) * 16 for c in x)
    x, y = shared + a, shared + b
    want = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert prefixtrie.common_turns(key(x), key(y)) == want and prefixtrie.common_turns(key(x), key(y), min(len(shared), want)) == want


# toxicity


def test_network_gradients():
    net = bigru.BiGRU.start(dtype=np.float64)
    own, grams, counts = bigru.features(pa.array(["ab", "hello", "wörld", "x", "aa"]))
    rng = np.random.default_rng(0)
    real = np.arange(6)[:, None] < np.array([6, 3, 1, 0])
    code, y = np.where(real, rng.integers(0, 5, (6, 4)), 5), np.array([1, 0, 1, 0.0])
    loss = lambda: float(np.log1p(np.exp(-(2 * y - 1) * net.forward(net.gates(net.inputs(own, grams, counts)), code, real))).sum())
    _, grad = net.gradients(own, grams, counts, code, real, lambda z: 1 / (1 + np.exp(-z)) - y)
    for k, w in net.w.items():
        full = np.zeros_like(w)
        if k in ("word", "char"):
            np.add.at(full, grad[k][0], grad[k][1])
            places = [(grad[k][0][0], 1), (grad[k][0][-1], 3)]
        else:
            full = grad[k].reshape(w.shape)
            places = [tuple(int(rng.integers(0, s)) for s in w.shape) for _ in range(4)]
        for at in places:
            was = w[at]
            w[at] = was + 1e-5
            up = loss()
            w[at] = was - 1e-5
            down = loss()
            w[at] = was
            assert abs((up - down) / 2e-5 - full[at]) < 1e-7


def test_windows_hold_every_word():
    lengths = np.array([0, 1, 32, 33, 48, 49, 1000])
    doc, start, size = bigru.windows(lengths)
    for d, n in enumerate(lengths):
        mine = doc == d
        assert {w for s, k in zip(start[mine], size[mine]) for w in range(s, s + k)} == set(range(n)) and mine.sum() >= 1
        assert (np.diff(start[mine]) < bigru.WINDOW).all()


def test_logits_do_not_depend_on_neighbours():
    """A text's windows score alike alone, among others, and through a plain pass place by place."""
    net = bigru.BiGRU.start(3)
    texts = ["alpha beta " * 40, "", None, "one", "gamma delta epsilon " * 11]
    whole = toxicity.Windows(pa.array(texts, pa.string()))
    z = whole.logits(net)
    assert np.isfinite(z).all()
    for i, t in enumerate(texts):
        alone = toxicity.Windows(pa.array([t], pa.string())).logits(net)
        assert np.allclose(alone, z[whole.doc == i], atol=1e-4)


def toxic_table(spark, n=420):
    """Texts of common words in which one of a few stems with changing ends marks the toxic ones."""
    random.seed(9)
    common = ["".join(random.choice("aeioulnrst") for _ in range(random.randint(3, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = random.choices(common, k=random.randint(20, 90))
        toxic = i % 3 == 0
        if toxic:
            for at in random.sample(range(len(words)), 3):
                words[at] = random.choice(["zgrumpf", "vexqu"]) + "".join(random.choice("aeiou") for _ in range(3))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxic_documents_are_caught(spark):
    docs, labels, truth = toxic_table(spark)
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    right = [r.predicted == truth[r.doc_id] for r in held]
    assert sum(right) >= 0.95 * len(right) and len(right) > 100
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", labels.toxic * 0 + 1).where("crc32(cast(doc_id as string)) % 3 = 1").unionByName(labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    again = toxicity.toxicity_scores(docs, other).collect()
    assert {(r.doc_id, round(r.score, 5)) for r in again} == {(r.doc_id, round(r.score, 5)) for r in got}


def test_toxicity_odd(spark):
    docs, labels, _ = toxic_table(spark, 60)
    odd = spark.createDataFrame([(None, "zgrumpfaaa"), (500, None), (500, ""), (501, " \n\t"), (502, "word " * 30000), (502, "word " * 30000)], "doc_id long, text string")
    some = docs.unionByName(odd).selectExpr("doc_id", "text", "1 AS score", "'x' AS predicted")
    noisy = labels.unionByName(spark.createDataFrame([(None, 1), (500, None), (1, None), (502, 0)], "doc_id long, toxic int"))
    got = toxicity.toxicity_scores(some, noisy, epochs=1).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert len({r.score for r in got if r.doc_id == 502}) == 1
    assert toxicity.toxicity_scores(some.where("false"), noisy, epochs=1).count() == 0
    assert toxicity.toxicity_scores(some, noisy.where("false")).count() == 66
    assert toxicity.toxicity_scores(some, noisy.where("toxic = 0")).count() == 66


def test_shards_by_length():
    lengths = [(5, 10, 50), (6, 30, 180), (7, 95, 665), (8, 250, 2000), (9, 1, 9), (10, 1, 10), (5000, 1, 5000)]
    got = spelling.shards_of(lengths, 100, 3000)
    assert got == [(5, 6, 0, 1), (7, 7, 0, 1), (8, 8, 0, 3), (8, 8, 1, 3), (8, 8, 2, 3), (9, 10, 0, 1), (5000, 5000, 0, 2), (5000, 5000, 1, 2)]
    assert spelling.shards_of([], 1, 1) == []
