"""Language-model scores of whole documents: add-one unigram base, and a gated recurrent model (gru.py).

Counts cover every training document. The HEAD most frequent words (a fixed number, so their table can
be broadcast) are scored where the text is read; each document's other words go, with their numbers, to a
join with the count table, so nothing about rare words is cut off. The recurrent model trains on every
training document once: in each round every task starts from the shared weights, goes over its documents
of the round, and the tasks' weights are averaged by tokens; a document's round goes by a hash of its id.

The softmax holds the 2 sqrt(V) most frequent of V distinct training words, in classes of about 1.35 times the
square root of their number: both grow with the corpus. Any other word belongs to a tail class by its shape and
by whether the head table has it, and its probability within that class is (count + 1) / (class tokens + class
words + 1), so unseen words have one too.

Defined results: a null or empty text is the end token alone; a document with a null id is neither learned
from nor held out; repeated rows are each learned from and scored; an empty table gives an empty result;
without training documents every count is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, ids_and_text
from .gru import GRU, Weights
from .words import by_bytes, laid_out, split_words

HEAD, HEAD_BYTES = 1 << 18, 64
ROUNDS, RATE = 2, 0.1
#: Bytes of text that a Python worker runs the model over at a time, and distinct words that it counts before it passes them on.
BATCH_BYTES, COUNTED = 6 << 20, 600_000
END = "\n"
SHAPES = 6
#: Tail classes: SHAPES of words that the head table has, then SHAPES of others.
TAILS = 2 * SHAPES
LOG10 = float(np.log(10))


#: By byte: 1 for those of other than ASCII characters, 2 for digits; last bytes of words that make kinds of their own.
_BYTES = np.where(np.arange(256) > 127, 1, np.isin(np.arange(256), list(b"0123456789")) * 2).astype(np.uint8)
_SIGN, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"!$#&*%|", b",."))


def shapes(words: pa.Array) -> np.ndarray:
    """The kind of each word by its characters."""
    out = np.zeros(len(words), np.int32)
    raw, start, size = laid_out(words) if len(words) else (np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 2)
    some = np.flatnonzero(size)
    if len(some):
        start, last = start[some], raw[start[some] + size[some] - 1]
        has = np.bitwise_or.reduceat(_BYTES[raw], start)
        kind = np.where(has & 1, 3 + _STOP[last], np.where(has & 2, 5, 1 + _STOP[last]))
        out[some] = np.where(_SIGN[last], 0, kind)
    return out


def shape(word: str) -> int:
    return int(shapes(pa.array([word], pa.string()))[0])


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def _train_filter(folds: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word string, c long) over documents' words and ends."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches):
        parts, size, ends = [], 0, 0
        for b in by_bytes(batches, 0):
            words, counts = split_words(b.column(0))
            ends += len(counts)
            seen = words.cast(pa.string()).value_counts()
            parts.append(pa.table({"word": seen.field(0), "n": seen.field(1).cast(pa.int64())}))
            size += len(seen)
            if size > COUNTED:
                whole = summed(parts)
                parts, size = [whole], len(whole)
                if size > COUNTED // 2:
                    yield from whole.to_batches(max_chunksize=100_000)
                    parts, size = [], 0
        parts.append(pa.table({"word": pa.array([END]), "n": pa.array([ends], pa.int64())}))
        yield from summed(parts).to_batches(max_chunksize=100_000)

    return docs.select("text").mapInArrow(run, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))


def shortlist(v: int, head: int) -> tuple[int, int]:
    """Words in the softmax and words a class, for v distinct training words of which the head table has `head`."""
    short = min(head, 2 * math.isqrt(max(v, 1)) + 1)
    return short, max(1, math.ceil(1.35 * math.sqrt(short)))


class Vocabulary:
    """What scoring needs to know of the head words; plain arrays by head number."""

    def __init__(self, head: list[tuple[str, int]], tail_tokens: np.ndarray, tail_words: np.ndarray, n: int, v: int):
        head = sorted(head, key=lambda x: (-x[1], x[0].encode()))
        self.words = pa.array([w for w, _ in head], pa.string())
        c = np.array([k for _, k in head], np.float64)
        self.n_short, self.per_class = shortlist(v, len(head))
        heads = max(1, -(-self.n_short // self.per_class))
        kinds = shapes(self.words).astype(np.int64)
        i = np.arange(len(head))
        short = i < self.n_short
        own = [np.bincount(kinds[~short], x, SHAPES) for x in (c[~short], np.ones(int((~short).sum())))]
        self.tail_tokens, self.tail_words = np.concatenate([own[0], tail_tokens]), np.concatenate([own[1], tail_words])
        # one more entry, at -1, that words outside the head take for the moment
        more = lambda x: np.concatenate([x, np.zeros(1, x.dtype)])
        self.inputs = more(np.where(short, i, self.n_short + kinds).astype(np.int32))
        self.cls = more(np.where(short, i // self.per_class, heads + kinds).astype(np.int32))
        self.idx = more(np.where(short, i % self.per_class, 0).astype(np.int32))
        self.within = more(np.where(short, 0.0, np.log10((c + 1) / self.tail_size()[kinds])))
        self.base = more(np.log10((c + 1) / (n + v + 1)))
        self.heads, self.start_id = heads, self.n_short + TAILS
        counts = np.zeros(heads * self.per_class)
        counts[: self.n_short] = c[: self.n_short]
        self.word_counts = counts.reshape(heads, self.per_class)
        self.class_counts = np.concatenate([self.word_counts.sum(axis=1), self.tail_tokens])

    def tail_size(self) -> np.ndarray:
        return self.tail_tokens + self.tail_words + 1

    def encode(self, texts: pa.Array) -> Encoded:
        return Encoded(self, texts)


class Encoded:
    """Documents end to end, each closed by END: head numbers (-1: not a head word), classes, places in class, inputs."""

    def __init__(self, voc: Vocabulary, texts: pa.Array):
        flat, counts = split_words(texts)
        heads = len(voc.words)
        # behind the head words, so that a head word's code is its number
        coded = pa.concat_arrays([voc.words, pa.array([END]), flat.cast(pa.string())]).dictionary_encode()
        self.distinct, code = coded.dictionary, coded.indices.to_numpy()
        self.kind = np.zeros(len(self.distinct), np.int32)
        self.kind[heads:] = SHAPES + shapes(self.distinct[heads:])
        self.lengths = counts + 1
        ends = np.cumsum(self.lengths) - 1
        self.code = np.full(int(self.lengths.sum()), code[heads], np.int32)
        inside = np.ones(len(self.code), bool)
        inside[ends] = False
        self.code[inside] = code[heads + 1 :]
        self.number = np.where(self.code < heads, self.code, -1)
        self.cls = np.concatenate([voc.cls[:-1], voc.heads + self.kind[heads:]])[self.code]
        self.idx = voc.idx[self.number]
        own = np.concatenate([voc.inputs[:-1], voc.n_short + self.kind[heads:]])[self.code]
        self.inputs = np.empty(len(own), np.int32)
        self.inputs[1:] = own[:-1]
        self.inputs[ends + 1 - self.lengths] = voc.start_id


def _averaged(parts: DataFrame, total: int) -> np.ndarray:
    """Token-weighted mean of the tasks' weights, block by block, in two steps."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float64) for x in pdf["w"]], axis=0)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "tokens": [pdf["tokens"].sum()], "w": [total.tobytes()]})

    half = parts.groupBy("block", "salt").applyInPandas(add, "block int, tokens double, w binary")
    out = np.zeros(total)
    for block, tokens, w in half.groupBy("block").applyInPandas(add, "block int, tokens double, w binary").collect():  # the model's size
        x = np.frombuffer(w, np.float64) / tokens
        out[block * 8192 : block * 8192 + len(x)] = x
    return out


def train(docs: DataFrame, shared, rounds: int = ROUNDS, rate: float = RATE) -> Weights:
    """The recurrent model, trained once on each of docs (doc_id, text): on a share of them by id in each round."""
    spark = docs.sparkSession
    voc: Vocabulary = shared.value
    weights = Weights.start(voc.start_id + 1, voc.class_counts, voc.word_counts)
    size = len(weights.pack())
    for k in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def fit(batches, now=now):
            v = shared.value
            model = GRU(now.value.unpack(now.value.pack().copy()), v.start_id)
            tokens = 0
            for b in by_bytes(batches, 0, BATCH_BYTES, 1 << 20):
                x = v.encode(b.column(0))
                model.train(x.inputs, x.cls, x.idx, x.lengths, rate)
                tokens += len(x.inputs)
            if tokens:
                flat = Weights(model.w).pack().astype(np.float64) * tokens
                blocks = [flat[i : i + 8192].tobytes() for i in range(0, size, 8192)]
                m = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), pa.array([float(tokens)] * m), pa.array(blocks, pa.binary())], names=["block", "tokens", "w"])

        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("text")
        fitted = part.mapInArrow(fit, "block int, tokens double, w binary").withColumn("salt", F.spark_partition_id() % 64)
        flat = _averaged(fitted, size)
        if flat.any():
            weights = weights.unpack(flat)
        now.unpersist()
    return weights


def lm_scores(docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; learned from
    those whose crc32(doc_id as text) mod folds is not fold."""
    spark = docs.sparkSession
    some = ids_and_text(docs, id_col, text_col)
    learn = some.where(_train_filter(folds, fold))
    counts = cut(word_counts(learn), "counts")
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    # the head: whole bins of counts from the top, at most HEAD words of at most HEAD_BYTES bytes
    can = F.octet_length("word") <= HEAD_BYTES
    bin_of = F.floor(F.log2("c") * 16).cast("int")
    bins = counts.where(can).groupBy(bin_of.alias("bin")).count().orderBy(F.desc("bin")).collect()  # a thousand rows at most
    least, taken = None, 0
    for b, k in bins:
        if taken + k > HEAD:
            break
        least, taken = b, taken + k
    is_head = can & (bin_of >= least) if least is not None else F.lit(False)
    head = [(w, int(c)) for w, c in counts.where(is_head).collect()]

    def tail_shapes(batches):
        tokens, words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for b in batches:
            if b.num_rows:
                kinds = shapes(b.column(0))
                tokens += np.bincount(kinds, b.column(1).to_numpy(), SHAPES).astype(np.int64)
                words += np.bincount(kinds, minlength=SHAPES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(tokens), pa.array(words)], names=["kind", "tokens", "words"])

    tail_tokens, tail_words = np.zeros(SHAPES), np.zeros(SHAPES)
    for kind, t, w in counts.where(~is_head).select("word", "c").mapInArrow(tail_shapes, "kind int, tokens long, words long").groupBy("kind").agg(F.sum("tokens"), F.sum("words")).collect():
        tail_tokens[kind], tail_words[kind] = t, w
    shared = spark.sparkContext.broadcast(Vocabulary(head, tail_tokens, tail_words, n, v))  # HEAD words
    model = spark.sparkContext.broadcast(train(learn, shared, rounds))

    def score(batches):
        voc = shared.value
        gru = GRU(model.value, voc.start_id)
        row_id = TaskContext.get().partitionId() << 33
        for b in by_bytes(batches, 1, BATCH_BYTES, 1 << 20):
            x = voc.encode(b.column(1))
            logp = gru.score(x.inputs, x.cls, x.idx, x.lengths) / LOG10
            k = b.num_rows
            doc = np.repeat(np.arange(k), x.lengths)
            known = x.number >= 0
            logp += voc.within[x.number]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row_id, row_id + k)), b.column(0), pa.array([held_out(i, folds, fold) for i in b.column(0).to_pylist()], pa.bool_()), pa.array(x.lengths),
                    pa.array(np.bincount(doc, known, k).astype(np.int64)), pa.array(np.bincount(doc, voc.base[x.number], k)), pa.array(np.bincount(doc, logp, k)),
                    pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()),
                ],
                names=names,
            )
            # each document's other words, with their numbers
            rows, times = np.unique(doc[~known] * len(x.distinct) + x.code[~known], return_counts=True)
            for at in range(0, len(rows), 100_000):
                who, code = np.divmod(rows[at : at + 100_000], len(x.distinct))
                m = len(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(who + row_id), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()),
                        x.distinct.take(pa.array(code)), pa.array(times[at : at + m].astype(np.int32)), pa.array(x.kind[code]),
                    ],
                    names=names,
                )
            row_id += k

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "logp", "word", "n", "kind"]
    # row numbers hold only because this table is written once
    scored = cut(some.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, logp double, word string, n int, kind int"), "scored")
    sizes = F.array(*(F.lit(float(x)) for x in shared.value.tail_size()))
    rare = scored.where("word IS NOT NULL").select("row", "word", "n", "kind")
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts.where(~is_head), "word", "left").select(
        "row", F.when(c > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("b"), (F.col("n") * F.log10((c + 1) / F.get(sizes, F.col("kind")))).alias("s")
    )
    terms = cut(rare.groupBy("row").agg(F.sum("known").alias("known"), F.sum("b").alias("b"), F.sum("s").alias("s")), "terms")
    drop_cut(counts)
    docs_ = scored.where("word IS NULL").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "logp")
    zero = F.lit(0)
    return docs_.join(terms, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("logp") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
