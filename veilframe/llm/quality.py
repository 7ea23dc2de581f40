"""Quality classifier without hand labels: a label model over heuristic labellers, then a hashed linear scorer.

Labellers look at the whole text and vote good, bad or abstain. Expectation-maximisation over the counts
of vote patterns (3 ** labellers at most, whatever the corpus) estimates each labeller's accuracy and each
pattern's probability of being good. Those posteriors train a logistic model on hashed words, word shapes
and repeats; it fits on FIT_ROWS documents at most (the bound is a parameter), chosen by a hash of the id;
counts and scores cover all documents.

Defined results: a null, empty or wordless text is rejected, with score 0; null ids and repeated rows are scored
as any row; ties at the threshold are kept; an empty table gives an empty result; other columns pass
through classify() untouched, but for those with its own two names, which are replaced.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_and_text, slices

FIT_ROWS = 6_000
BITS = 16
BUCKETS = 1 << BITS
CACHE_ENTRIES = 300_000
N_EXTRA = 3

#: Frequent short function words of several languages.
STOPWORDS = frozenset("the of and to in a is it that for on was with as at by an be this are or from de la le les des et un une en que qui el los las y del der die das und den von zu mit im ist nicht".split())
LABELLERS = ("symbols", "capitals", "repeats", "variety", "bars", "stopwords", "sentences", "shout")


def votes(text: str, words: list[str]) -> tuple[int, ...]:
    """1 good, -1 bad, 0 abstain, in the order of LABELLERS."""
    n = len(words)
    if not n:
        return (0,) * len(LABELLERS)
    raw = text.encode()
    letters = len(raw.translate(None, _NOT_LETTERS))
    solid = len(text) - text.count(" ") - text.count("\n")
    odd = len(raw) - len(raw.translate(None, _ODD))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    same = sum(a == b for a, b in zip(words, words[1:]))
    kinds = len(set(words))
    stop = sum(1 for w in words if w.lower().strip(".,") in STOPWORDS)
    ends = sum(1 for w in words if w[-1] in ".!?")
    shout = sum(1 for w in words if w.endswith("!"))
    bars = sum(1 for w in words if w == "|")
    ask = lambda bad, good: -1 if bad else int(good)
    return (
        ask(odd > 0.04 * solid, odd < 0.01 * solid and letters > 0.8 * solid),
        ask(upper > 0.4 * n, upper < 0.15 * n),
        ask(n >= 10 and same > 0.2 * n, n >= 10 and same < 0.05 * n),
        ask(n >= 50 and kinds < 0.25 * n**0.85, n >= 50 and kinds > 0.45 * n**0.85),
        ask(bars > 0.1 * n, False),
        ask(n >= 60 and stop < 0.01 * n, n >= 10 and stop > 0.06 * n),
        ask(n >= 80 and ends < n / 200, n >= 10 and n / 60 < ends < n / 2),
        ask(shout > 0.3 * n, False),
    )


#: Bytes that begin no letter: ASCII but letters, and the later bytes of longer characters.
_NOT_LETTERS = bytes(c for c in range(192) if c >= 128 or not chr(c).isalpha())
_ODD = b"$#%&*|^~<>{}[]\\=@_+"


class LabelModel:
    """Class prior and P(vote | class) of each labeller, by expectation-maximisation over vote patterns."""

    def __init__(self, patterns: dict[tuple[int, ...], int], rounds: int = 100):
        keys = list(patterns)
        v = np.array(keys, np.int64).reshape(len(keys), -1) + 1
        c = np.array([patterns[k] for k in keys], np.float64)
        m = v.shape[1]
        balance = (v - 1).sum(axis=1)
        good = np.where(balance > 0, 0.9, np.where(balance < 0, 0.1, 0.5))
        for _ in range(rounds):
            weight = np.stack([c * (1 - good), c * good])
            self.prior = (weight.sum(axis=1) + 1) / (c.sum() + 2)
            self.p = np.full((2, m, 3), 0.0)
            for j in range(m):
                for y in (0, 1):
                    self.p[y, j] = np.bincount(v[:, j], weight[y], 3) + 1
            self.p /= self.p.sum(axis=2, keepdims=True)
            new = self._posterior(v)
            if np.abs(new - good).max(initial=0) < 1e-6:
                break
            good = new
        self.posterior = {k: float(x) for k, x in zip(keys, self._posterior(v))}

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + np.stack([sum(np.log(self.p[y, j, v[:, j]]) for j in range(v.shape[1])) for y in (0, 1)])
        logs -= logs.max(axis=0)
        e = np.exp(logs)
        return e[1] / e.sum(axis=0)

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among a labeller's votes."""
        right = self.prior[1] * self.p[1, :, 2] + self.prior[0] * self.p[0, :, 0]
        wrong = self.prior[1] * self.p[1, :, 0] + self.prior[0] * self.p[0, :, 2]
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist()))


def word_shape(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; other characters as they are."""
    out = []
    for c in word:
        s = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class Hasher:
    """Feature numbers of texts: two for each word (itself, its shape), remembered for each word."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def features(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        for w in set().union(*texts).difference(self.known):
            a = xxhash.xxh3_64_intdigest(w.lower().encode()) % BUCKETS
            b = xxhash.xxh3_64_intdigest(word_shape(w).encode(), seed=1) % BUCKETS
            self.known[w] = a << 32 | b
        out = []
        for words in texts:
            n = len(words)
            both = np.fromiter(map(self.known.__getitem__, words), np.int64, n)
            ids, counts = np.unique(np.concatenate([both >> 32, both & 0xFFFFFFFF]), return_counts=True)
            same = float((both[1:] == both[:-1]).sum()) / max(1, n)
            kinds = len(np.unique(both)) / max(1, n) ** 0.85
            extra = np.array([1.0, 4 * same, kinds])
            out.append((np.concatenate([ids, BUCKETS + np.arange(N_EXTRA)]).astype(np.int32), np.concatenate([counts / max(1, n), extra]).astype(np.float32)))
        return out


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 60, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels, full-batch Adagrad."""
    w, g2 = np.zeros(BUCKETS + N_EXTRA), np.full(BUCKETS + N_EXTRA, 1e-8)
    if not rows:
        return w
    size = np.array([len(r[0]) for r in rows])
    ids, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    row, y = np.repeat(np.arange(len(rows)), size), np.array([r[2] for r in rows])
    for _ in range(epochs):
        z = np.bincount(row, w[ids] * values, len(rows))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(ids, values * ((p - y) / len(rows))[row], len(w)) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def label_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, pattern): votes as a string of -, 0 and + for each document."""

    def run(batches):
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            words = [t.split() for t in texts]
            signs = ["".join("-0+"[v + 1] for v in votes(t, w)) for t, w in zip(texts, words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(signs, pa.string())], names=["doc_id", "n_words", "pattern"])

    return docs.mapInArrow(run, "doc_id long, n_words long, pattern string")


def share_bound(share: float) -> int:
    """The signed 64-bit number that this share of all such numbers does not exceed."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def train_quality(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[LabelModel, np.ndarray]:
    """The label model over all docs (doc_id, text) and the linear weights fitted on at most about fit_rows of them."""
    counts = label_documents(docs).where("n_words > 0").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** labellers rows at most
    patterns = {tuple("-0+".index(c) - 1 for c in p): int(n) for p, n in counts}
    model = LabelModel(patterns) if patterns else LabelModel({(0,) * len(LABELLERS): 1})
    total = sum(patterns.values())
    share = min(1.0, fit_rows / max(1, total))
    posterior = model.posterior

    def features(batches):
        hasher = Hasher()
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            words = [t.split() for t in texts]
            rows = [(i.tobytes(), v.tobytes(), posterior.get(votes(t, w), 0.5)) for t, w, (i, v) in zip(texts, words, hasher.features(words)) if w]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.float64())], names=["ids", "values", "y"])

    # a share of all 64-bit hashes; equal rows count once, so that a text repeated without end is one row here
    own = F.xxhash64("doc_id", F.xxhash64("text"))
    picked = docs.where(own <= F.lit(share_bound(share))).dropDuplicates(["doc_id", "text"])
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in picked.mapInArrow(features, "ids binary, values binary, y double").collect()]
    return model, fit_linear(rows)


def classify(docs: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with quality_score (the linear scorer's) and quality_keep."""
    _, w = train_quality(ids_and_text(docs, id_col, text_col), fit_rows)
    weights = docs.sparkSession.sparkContext.broadcast(w)  # 2 ** BITS numbers
    new = ("quality_score", "quality_keep")
    names = [c for c in docs.columns if c not in new]
    at = names.index(text_col)

    def run(batches):
        hasher = Hasher()
        w = weights.value
        for b in slices(batches):
            words = [(t or "").split() for t in b.column(at).to_pylist()]
            z = [float((w[i] * v).sum()) for i, v in hasher.features(words)]
            score = [float(1 / (1 + np.exp(-np.clip(s, -30, 30)))) if x else 0.0 for s, x in zip(z, words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64()), pa.array([bool(x) and s >= threshold for s, x in zip(score, words)])], names=[*names, *new])

    typed = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
    return typed.mapInArrow(run, T.StructType([*typed.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.BooleanType())]))
