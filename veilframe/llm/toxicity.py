"""Toxicity of whole documents: a bidirectional gated recurrent network (bigru.py) over all overlapping windows.

A document's logit is the largest of its windows' logits, so one toxic passage in a long text counts. It is learned from
document labels alone: in each epoch the network reads every window of every fitted document and learns from those
that now stand highest, two of each document and one by chance. A logistic curve from the document's logit to a
probability is then fitted on documents that the network did not learn from, weighted back to the labels' own share.

The fit takes at most FIT_ROWS documents of either label, chosen by a hash of their ids from the labelled documents that
are not held out, and of these only texts of at most FIT_CHARS code points, whole; both bounds are parameters. Fitting
is one task's; all documents, of any length, are scored where they are read, without a shuffle.

Defined results: a null, empty or wordless text is one window without words and has the score of the empty context; a
null id is not held out and has no label; of several labels of an id the largest counts, null labels none; repeated rows
are each scored, and count once in the fit; without any labels the network stays as it starts; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bigru import WINDOW, Adagrad, BiGRU, features, windows
from .common import ids_and_text
from .words import by_bytes, split_words

#: Documents with label 0 and with label 1 that are fitted on at most, and their code points.
FIT_ROWS, FIT_CHARS = (3_000, 1_500), 60_000
EPOCHS, BATCH, RATE = 12, 128, 0.1
#: Windows that are run at a time, and bytes of text that a task encodes at a time.
LANES, BATCH_BYTES = 2_048, 6 << 20
#: One in so many fitted documents only serves the curve.
SPARED = 5


class Windows:
    """All windows of texts over their distinct words."""

    def __init__(self, texts: pa.Array):
        flat, counts = split_words(texts)
        coded = flat.dictionary_encode()
        self.own, self.grams, self.counts = features(coded.dictionary)
        none = len(self.own)
        self.code = np.concatenate([coded.indices.to_numpy().astype(np.int64), [none]])
        self.doc, start, self.length = windows(counts)
        self.first = start + (np.cumsum(counts) - counts)[self.doc]
        self.docs, self.none = len(counts), none

    def places(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of distinct words [T, n], where a word is) of these windows."""
        t = np.arange(WINDOW)[:, None]
        real = t < self.length[some]
        return np.where(real, self.code[np.where(real, self.first[some] + t, -1)], self.none), real

    def logits(self, model: BiGRU) -> np.ndarray:
        """The logit of every window."""
        gates = model.gates(model.inputs(self.own, self.grams, self.counts))
        out = np.empty(len(self.doc), np.float64)
        whole = self.length == WINDOW
        for some in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for i in range(0, len(some), LANES):
                part = some[i : i + LANES]
                code, real = self.places(part)
                out[part] = model.forward(gates, code, None if real.all() else real)
        return out


def highest(logits: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Each document's largest logit."""
    out = np.full(docs, -np.inf)
    np.maximum.at(out, doc, logits)
    return out


def fit(texts: list[str], labels: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 5) -> tuple[BiGRU, float, float]:
    """(network, slope, offset) from texts and their labels; share: of label 1 among all labelled documents."""
    model = BiGRU.start()
    if not len(labels) or labels.min() == labels.max():
        return model, 1.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    rng = np.random.default_rng(seed)
    x = Windows(pa.array(texts, pa.string()))
    spared = np.array([zlib.crc32(t.encode()) % SPARED == 0 for t in texts])
    learned = ~spared[x.doc]
    steps = Adagrad(model, RATE)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    rows = np.flatnonzero(learned)
    for epoch in range(epochs):
        z = x.logits(model)[rows] if epoch else rng.random(len(rows))
        chosen = []
        for key, most in ((-z, 2), (rng.random(len(rows)), 1)):
            order = rows[np.lexsort((key, x.doc[rows]))]
            d = x.doc[order]
            new = np.flatnonzero(np.diff(d, prepend=-1))
            place = np.arange(len(d)) - np.repeat(new, np.diff(np.append(new, len(d))))
            chosen.append(order[place < most])
        # a toxic document's window by chance says nothing of itself once there is a model
        by_chance = chosen[1] if epoch == 0 else chosen[1][labels[x.doc[chosen[1]]] == 0]
        some = rng.permutation(np.unique(np.concatenate([chosen[0], by_chance])))
        for i in range(0, len(some), BATCH):
            part = some[i : i + BATCH]
            code, real = x.places(part)
            used = np.unique(code[real]) if real.any() else np.zeros(0, np.int64)
            number = np.full(x.none + 1, len(used), np.int64)
            number[used] = np.arange(len(used))
            at = np.cumsum(x.counts) - x.counts
            counts = x.counts[used]
            grams = x.grams[np.repeat(at[used] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            y, k = labels[x.doc[part]], weight[x.doc[part]] / len(part)
            _, grad = model.gradients(x.own[used], grams, counts, number[code], real, lambda z: k * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y))  # noqa: B023
            steps.step(grad)
    top = highest(x.logits(model), x.doc, x.docs)
    on = spared if len(set(labels[spared].tolist())) == 2 else np.ones(len(labels), bool)
    prior = np.where(labels == 1, share / max(1, (labels[on] == 1).sum()), (1 - share) / max(1, (labels[on] == 0).sum())) * on
    return model, *curve(top, labels, prior)


def curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope (0.2 to 5) and offset of the logistic curve of least weighted loss, by damped Newton steps; a weak pull
    to slope 1 and offset 0 keeps separable data finite."""
    weight = weight / max(weight.sum(), 1e-12)
    p = np.array([1.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(p[0] * z + p[1], -30, 30)))
        d, h = weight * (q - y), weight * q * (1 - q)
        g = np.array([(d * z).sum() + 0.01 * (p[0] - 1), d.sum() + 0.001 * p[1]])
        H = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.001]])
        move = np.linalg.solve(H, g)
        p = p - np.clip(move, -0.5, 0.5)
        p[0] = min(5.0, max(0.2, p[0]))
        if np.abs(move).max() < 1e-6:
            break
    return float(p[0]), float(p[1])


def learnable(id_col, folds: int, fold: int):
    """Whether a document's label may be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds != fold, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, fit_rows: tuple[int, int] = FIT_ROWS, fit_chars: int = FIT_CHARS, epochs: int = EPOCHS) -> tuple[BiGRU, float, float]:
    """The fitted network and curve; docs (doc_id, text), labels (doc_id, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    n = {int(y): int(k) for y, k in known.groupBy("toxic").count().collect()}
    by_hash = F.xxhash64("doc_id", F.lit(3))
    few = [known.where(F.col("toxic") == y).orderBy(by_hash).limit(fit_rows[y]) for y in (0, 1)]
    chosen = [(int(i), int(y)) for part in few for i, y in part.collect()]  # two numbers for each fitted row
    if not chosen:
        return fit([], np.zeros(0), 0.5)
    spark = docs.sparkSession
    rows = docs.where(F.length("text") <= fit_chars).join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int")), "doc_id")
    rows = rows.dropDuplicates(["doc_id", "text"]).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sum(fit_rows)).select("text", "toxic")
    share = n.get(1, 0) / max(1, sum(n.values()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for b in batches:
            texts += [t or "" for t in b.column(0).to_pylist()]
            y += b.column(1).to_pylist()
        model, slope, offset = fit(texts, np.array(y, np.float64), share, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([model.pack()], pa.binary()), pa.array([slope]), pa.array([offset])], names=["model", "slope", "offset"])

    fitted = rows.repartition(1).mapInArrow(run, "model binary, slope double, offset double").first()
    if fitted is None:  # labels of no document here
        return fit([], np.zeros(0), share)
    raw, slope, offset = fitted
    return BiGRU.unpack(bytes(raw)), float(slope), float(offset)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", fit_rows: tuple[int, int] = FIT_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows and worst_word (the first word of the highest window) of every
    document; labels (doc_id, toxic) of ids whose crc32(id as text) mod folds is fold are not learned from."""
    some = ids_and_text(docs, id_col, text_col)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = docs.sparkSession.sparkContext.broadcast(train_toxicity(some, known, folds, fold, fit_rows, epochs=epochs))  # about 2 MB

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, slope, offset = model.value
        for b in by_bytes(batches, 1, BATCH_BYTES, 1 << 20):
            x = Windows(b.column(1))
            z = x.logits(net)
            order = np.lexsort((x.first, -z, x.doc))
            best = order[np.flatnonzero(np.diff(x.doc[order], prepend=-1))]
            p = 1 / (1 + np.exp(-np.clip(slope * z[best] + offset, -700, 700)))
            ids = b.column(0).to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids]
            begin = np.cumsum(np.bincount(x.doc, minlength=x.docs)) - np.bincount(x.doc, minlength=x.docs)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(np.bincount(x.doc, minlength=x.docs).astype(np.int64)), pa.array((x.first[best] - x.first[begin]).astype(np.int64))],
                names=["doc_id", "held_out", "score", "predicted", "n_windows", "worst_word"],
            )

    return some.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, n_windows long, worst_word long")
