"""Quality classification by supervised subword embeddings.

A document is the average of learned vectors of its words, its word pairs and its character 3- and 5-grams (over
the whole text, spaces included), each hashed to one of ``BUCKETS`` rows; a softmax layer over the average gives
the class. Vectors and layer are trained together by stochastic gradient descent in numpy on the driver, on a
bounded sample (see ``labelled``). As only the difference of the two logits matters for two classes, a
task scores with one number per bucket: the bucket's vector times that difference of the layer's rows.

A document's gradient reaches each of its vectors with the share that the vector has in the average, which is
tiny, so vectors move at a rate of their own: the layer's, times ``SPREAD`` and the square root of the number of
the document's distinct features over that rate.

Defined results: a null or empty text has no features and gets the layer's bias alone; without labelled
rows of both classes every score is the class share (k + 1) / (n + 2); rows that repeat are scored each on its
own; an empty table gives no rows. Other columns are no inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .labelled import fitting_sample, held_out

BITS, DIM, EPOCHS, RATE, SPREAD = 17, 12, 8, 0.4, 24
BUCKETS = 1 << BITS
GRAMS = (3, 5)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows of the words, of the word pairs and of each size of character n-gram."""
    shift = np.uint64(64 - BITS)
    starts, ends, rows = tb.tokens(data, offsets, tb.word_table("space"))
    prefix = tb.prefix_hash(tb.BYTE_VALUES[data])
    words = tb.span_hash(prefix, starts, ends)
    out = [((words >> shift).astype(np.int32), rows)]
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    out.append(((tb.mix(words[pair] * np.uint64(3) + words[pair + 1]) >> shift).astype(np.int32), rows[pair]))
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # each character's first byte
    owner = np.searchsorted(offsets, first[:-1], "right") - 1
    for n in GRAMS:
        at = np.flatnonzero(owner[: max(len(owner) - n + 1, 0)] == owner[n - 1 :])
        out.append(((tb.mix(tb.span_hash(prefix, first[at], first[at + n])) >> shift).astype(np.int32), owner[at]))
    return out


def train(sample: list[tuple[str, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias, in logits of class 1."""
    texts, labels = [t for t, _ in sample], np.array([y for _, y in sample])
    n, k = len(labels), int(labels.sum()) if len(labels) else 0
    if k in (0, n):
        return np.zeros(BUCKETS, np.float32), float(np.log((k + 1) / (n - k + 1)))
    docs = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        buckets = np.concatenate([b for b, _ in features(raw, np.array([0, len(raw)]))])
        ids, count = np.unique(buckets, return_counts=True)
        docs.append((ids, (count / max(1, len(buckets))).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * n
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            rate = np.float32(RATE * (1 - step / steps))
            ids, share = docs[i]
            mean = share @ vectors[ids]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= rate * np.float32(0.1) * p
            vectors[ids] -= np.float32(SPREAD) * (rate * len(ids)) ** np.float32(0.5) * np.outer(share, back)
            step += 1
    weights = vectors @ (layer[1] - layer[0])
    return weights.astype(np.float32), float(bias[1] - bias[0])


def logits(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    for buckets, rows in features(data, offsets):
        total += np.bincount(rows, weights[buckets], minlength=n)
        count += np.bincount(rows, minlength=n)
    return total / np.maximum(count, 1) + bias


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = pickle.loads(model.value)
        for batch in tb.each(batches):
            data, offsets = tb.text_column(batch)
            parts = [logits(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], weights, bias) for lo, hi in tb.row_blocks(offsets)]
            z = np.clip(np.concatenate(parts) if parts else np.empty(0), -50, 50)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(1 / (1 + np.exp(-z)))], [*names, "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, the columns ``keep`` (text among them) as one struct ``row`` if any, and score (0 to 1)."""
    sample = fitting_sample(docs, labels, "quality")
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(pickle.dumps(train(sample)))
    text = F.struct(*keep).alias("row") if keep else F.col("text")
    own = docs.select("doc_id", held_out("doc_id").alias("held_out"), text)
    fields = [T.StructField(f.name, f.dataType) for f in own.schema.fields if f.name != "text"]
    return own.mapInArrow(_score(model), T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def good_documents(docs: DataFrame, labels: DataFrame, at_least: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept."""
    return score_quality(docs, labels, tuple(docs.columns)).where(F.col("score") >= at_least).select("row.*")
