"""A quality classifier of averaged subword embeddings.

A document is the mean of the learned vectors of its words, word pairs and
character n-grams, each hashed to a bucket, and a softmax layer over it gives
the classes (Joulin et al., "Bag of Tricks for Efficient Text Classification",
2016). Both are trained by stochastic gradient descent in numpy, on the driver,
on at most MAX_ROWS labelled documents; scoring covers all documents.

As the output layer is linear, scoring needs no vectors: every bucket's vector
times the output weights is one number a class, and a document's logits are
the means of its buckets' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .frames import column, pick, positional

U64 = X.U64
#: Labelled documents that are trained on at most, by the least hash of doc_id.
MAX_ROWS = 4000
BUCKETS, DIM, GRAM, EPOCHS, RATE, SEED = 1 << 17, 8, 4, 6, 0.4, 11
#: Classes: 0 good, 1 of low quality, 2 toxic.
CLASSES = 3
#: Share of the probability that a document needs for class 0 to be kept.
KEEP = 0.4
#: Probability of class 2 from which a document goes. A long one's toxic passage is averaged away, so that is far below a half; the README has what it costs.
TOXIC = 0.05


def buckets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds of each text) of the words, the pairs of words and the character n-grams of all texts."""
    low = np.take(X.LOWER, data)
    starts, ends, bounds = X.spans(np.take(X.NOT_SPACE, low), offsets)
    h = X.span_hash(X.prefix_hash(low), starts, ends)
    last = np.zeros(len(h), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    pairs = X.mix(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:])[~last[:-1]] if len(h) else h
    per_pair = np.maximum(np.diff(bounds) - 1, 0)
    shift = U64(64 - BUCKETS.bit_length() + 1)
    out = [((h >> shift).astype(np.int32), bounds), ((pairs >> shift).astype(np.int32), np.concatenate(([0], np.cumsum(per_pair))))]
    n = max(0, len(low) - GRAM + 1)
    code = low[:n].astype(np.uint32)
    for i in range(1, GRAM):
        code |= low[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    code *= np.uint32(0x9E3779B1)
    grams = (code >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
    # n-grams that reach into the next text belong to none
    inner = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    if n and inner.sum() < n:
        keep = np.arange(inner.sum()) + np.repeat(offsets[:-1] - (np.cumsum(inner) - inner), inner)
        grams = grams[keep]
    out.append((grams, np.concatenate(([0], np.cumsum(inner)))))
    return out


#: Each kind of feature has its own part of the table.
KINDS = 3


class Model:
    def __init__(self, table: np.ndarray, bias: np.ndarray):
        self.table, self.bias = table, bias  # (KINDS, CLASSES, BUCKETS), (CLASSES,)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        logits = np.tile(self.bias.astype(np.float64), (texts, 1))
        for kind, (b, bounds) in enumerate(buckets(data, offsets)):
            n = np.maximum(np.diff(bounds), 1)
            for c in range(CLASSES):
                logits[:, c] += X.segment_sum(np.take(self.table[kind, c], b), bounds) / n
        return softmax(logits)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, seed: int = SEED) -> Model:
    """Gradient descent over single documents, in a new seeded order each epoch, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((KINDS * BUCKETS, dim), dtype=np.float32) - 0.5) / dim
    weights, bias = np.zeros((CLASSES, dim), np.float32), np.zeros(CLASSES, np.float32)
    bags = []
    for t in texts:
        data, off = X.strings(pa.array([t]))
        ids, share = [], []
        for kind, (b, _) in enumerate(buckets(data, off)):
            u, n = np.unique(b, return_counts=True)
            ids.append(u + kind * BUCKETS)
            share.append(n / max(1, len(b)))
        bags.append((np.concatenate(ids), np.concatenate(share).astype(np.float32)))
    # classes are as rare as they are; the loss weighs them by the square root
    count = np.bincount(labels, minlength=CLASSES)
    cost = np.sqrt(count.max() / np.maximum(count, 1))
    step, total = 0, max(1, epochs * len(texts))
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ids, share = bags[i]
            now = rate * (1 - step / total)
            step += 1
            if not len(ids):
                continue
            v = vectors[ids]
            hidden = share @ v
            g = softmax(weights @ hidden + bias)
            g[labels[i]] -= 1
            g *= cost[labels[i]]
            back = g @ weights
            weights -= now * np.outer(g, hidden)
            bias -= now * 0.1 * g
            # rare features learn as fast as frequent ones
            vectors[ids] = v - (now * np.sqrt(share))[:, None] * back
    table = (vectors @ weights.T).reshape(KINDS, BUCKETS, CLASSES).transpose(0, 2, 1)
    return Model(np.ascontiguousarray(table, dtype=np.float32), bias)


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> list:
    """At most limit rows (doc_id, text, y), those of the least hash of doc_id; y: 2 toxic, else 1 of low quality, else 0.

    Labels with a null doc_id or quality don't count, nor do those without a
    document. Of repeated labels or documents the least by y and text counts.
    """
    y = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    marks = pick(labels, doc_id="bigint", quality="int", toxic="int").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(y).alias("y"))
    # a bounded number of ids, so broadcasting them is safe at any size
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    src = pick(docs, doc_id="bigint", text="string").where("text is not null")
    rows = src.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return sorted(rows.collect(), key=lambda r: r.doc_id)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = X.strings(b.column(1))
        p = [model.probabilities(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in X.pieces(offsets)]
        p = np.concatenate(p) if p else np.zeros((0, CLASSES))
        blank = X.counts(np.take(X.NOT_SPACE, data), offsets) == 0
        cols = [pa.array(np.ascontiguousarray(p[:, c]), mask=blank) for c in range(CLASSES)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "p_good", "p_low", "p_toxic"])


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """(doc_id, p_good, p_low, p_toxic double) for each row of docs.

    A text without a word (null, empty or blank) has null probabilities. A null
    or repeated doc_id is passed on. Without a labelled document all classes
    are as likely. A very long text is scored whole. An empty table gives an empty one.
    """
    rows = labelled(docs, labels, limit)
    model = train([r.text for r in rows], np.array([r.y for r in rows], dtype=np.int64)) if rows else Model(np.zeros((KINDS, CLASSES, BUCKETS), np.float32), np.zeros(CLASSES, np.float32))
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    pos, names = positional(docs)
    src = pos.select(F.col(column(names, "doc_id")).cast("bigint").alias("doc_id"), F.col(column(names, "text")).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _score(it, held.value), "doc_id bigint, p_good double, p_low double, p_toxic double")


def kept(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS, least: float = KEEP, toxic: float = TOXIC) -> DataFrame:
    """The rows of `classify` that are good with a probability of at least `least` and toxic with one below `toxic`; those without words go."""
    return classify(docs, labels, limit).where((F.col("p_good") >= least) & (F.col("p_toxic") < toxic))
