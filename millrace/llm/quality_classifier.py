"""Quality scores by supervised subword embeddings.

Words, word bigrams and the character n-grams of words (with a blank on either side) hash into rows of one embedding table. A document is the
mean of its rows, and a softmax over two labels follows, all trained by plain stochastic gradient descent in numpy on a bounded
sample of labelled documents. As mean and softmax input are linear, a trained table folds into one number a row, so that scoring
is one pass over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._tables import received, sent

#: Rows and columns of the table, lengths of n-grams in bytes, labelled documents drawn of each label, characters of each, and passes over them.
ROWS_BITS = 16
DIM = 16
GRAMS = (2, 3, 4, 5)
SAMPLE = 1500
CHARS = 20_000
EPOCHS = 5
RATE = 0.4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all features, and the text row of each: words, word bigrams, and n-grams of bytes without a blank inside."""
    rows, owner = [], []
    starts, ends, at = T.word_bounds(data, offsets)
    shift = np.uint64(64 - ROWS_BITS)
    words, word_row = T.word_hashes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    rows.append(words >> shift)
    owner.append(word_row)
    # word bigrams; hashed by their difference, so that all doubled words are one feature
    pair = np.flatnonzero(word_row[1:] == word_row[:-1])
    rows.append(T.mix(words[pair] ^ words[pair + 1]) >> shift)
    owner.append(word_row[pair])
    blank = T.SPACE[data]
    clean = np.where(blank, np.uint8(32), data)
    values = T.BYTE_VALUES[1][clean]
    inside = np.concatenate([[0], np.cumsum(blank)])
    text_row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k in GRAMS:
        n = len(data) - k + 1
        if n <= 0:
            continue
        i = np.arange(n)
        good = np.flatnonzero((text_row[:n] == text_row[k - 1 :]) & (inside[i + k - 1] - inside[i + 1] == 0))
        rows.append(T.range_hashes(values, good, good + k, T.BASES[1]) >> shift)
        owner.append(text_row[good])
    return np.concatenate(rows).astype(np.int64), np.concatenate(owner)


class Model:
    """weight: the folded table, the difference of the two labels' inputs a row; bias: of the labels and of the sample's shares."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, owner = features(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(owner, weights=self.weight[rows], minlength=n)
        many = np.bincount(owner, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(many, 1) + self.bias, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, prior: float, seed: int = 5) -> Model:
    """By gradient descent over single documents; `prior`: log of the odds of label 1 among all over those in the sample."""
    rng = np.random.default_rng(seed)
    bags = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        rows, _ = features(raw, np.array([0, len(raw)]))
        ids, count = np.unique(rows, return_counts=True)
        bags.append((ids, (count / max(1, count.sum())).astype(np.float32)))
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << ROWS_BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    steps = EPOCHS * len(bags)
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = bags[i]
            hidden = share @ table[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ out
            out -= rate * p[:, None] * hidden
            bias -= rate * p
            # a mean spreads its gradient over all rows of the document; the sum of the squared shares would make steps of long ones vanish
            table[ids] -= rate * (share / share.max())[:, None] * back if len(ids) else 0
    return Model((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]) + prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """From about SAMPLE documents of each label, drawn by a hash of their ids; CHARS characters of each at most come to the driver."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    counts = {r[0]: r[1] for r in marked.groupBy("_label").count().collect()}
    if not counts:
        return Model(np.zeros(1 << ROWS_BITS), 0.0)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(9), F.col("_id")), 11).cast("double") / float(1 << 53)
    wanted = F.when(F.col("_label") == 1, F.lit(SAMPLE / counts.get(1, 1))).otherwise(F.lit(SAMPLE / counts.get(0, 1)))
    # about 2 * SAMPLE ids: a bounded side
    drawn = marked.filter(place < wanted)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.substring(F.col(text_col), 1, CHARS).alias("_text"))
    found = sorted(tuple(r) for r in own.join(F.broadcast(drawn), "_id").filter("_text is not null").toLocalIterator())
    if not found:
        return Model(np.zeros(1 << ROWS_BITS), 0.0)
    y = np.array([r[2] for r in found])
    in_sample = np.log((1 + (y == 1).sum()) / (1 + (y == 0).sum()))
    prior = np.log((1 + counts.get(1, 0)) / (1 + counts.get(0, 0))) - in_sample
    return fit([r[1] for r in found], y, float(prior))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = received(shared)
        for batch in batches:
            data, offsets = T.text_bytes(batch.column(1))
            parts = [model.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in T.steps(offsets, 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*parts, np.zeros(0)]))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of docs: how likely label 1 is.

    Null and empty texts have no feature and get the labels' shares. Null ids and repeated rows come back as they are. Other
    columns are ignored. An empty table gives an empty result; a model of no label scores everything 0.5."""
    shared = sent(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(shared), "doc_id long, score double")
