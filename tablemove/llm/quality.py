"""Quality classifier (operator 1): random-indexing word vectors, pooled, and a small network.

1. Random indexing over every document: words and word shapes (the sequence of
   character classes) fall by hash into a fixed number of rows; a row owns a
   sparse random index vector, and its word vector is the sum of the index
   vectors of all neighbours within ``REACH`` words anywhere in the corpus.
   The table has the same size for any corpus; tasks send partial sums.
2. A document is the mean of its words' and its shapes' vectors, the length of
   its mean index vectors (how much it repeats itself) and its log length.
3. A two-layer numpy network learns quality on at most ``LABELLED`` training
   rows (smallest hash of the id); its temperature is fitted on a fifth of them
   held apart, so scores are calibrated probabilities.

Training uses only rows whose crc32(id) modulo 5 is not 0; text is the only input
of a score.  Cases: a null or empty text has the zero vector and still a score;
labels that are null are dropped, of contradicting labels of an id the lowest
counts; without labels every score is 0.5, with one class only its smoothed
frequency; rows with equal ids are each scored; a null id counts as held out;
other columns are ignored; no rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SEPARATORS, Words, mix, prepare, text_bytes, text_chunks

WORD_ROWS, SHAPE_ROWS, DIM, REACH = 4096, 256, 32, 2
LABELLED = 20_000  # most labelled rows the network is trained on
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
THRESHOLD = 0.3
ROWS = WORD_ROWS + SHAPE_ROWS


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, four entries of +-1 per row; the same in every process."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((ROWS, DIM), dtype=np.float32)
    at = rng.random((ROWS, DIM)).argsort(axis=1)[:, :4]
    np.put_along_axis(out, at, rng.choice(np.float32([-1, 1]), size=(ROWS, 4)), axis=1)
    return out


#: Character classes of a shape: lower, upper, digit, beyond ASCII, and each punctuation byte for itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS_HASH = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11))


def token_rows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word and of its shape (runs of one class count once)."""
    word_rows = (words.hash % np.uint64(WORD_ROWS)).astype(np.int64)
    cls = _CLASS[words.data]
    new = np.ones(len(cls), dtype=bool)
    new[1:] = cls[1:] != cls[:-1]
    new[words.starts] = True
    new &= ~SEPARATORS[words.data]
    kept = np.cumsum(new)
    first = np.zeros(len(cls), dtype=np.int64)  # kept characters before each word
    if len(words):
        span = np.diff(np.append(words.starts, len(cls)))
        first[words.starts[0]:] = np.repeat(kept[words.starts], span)
    rank = kept - first
    value = np.where(new, mix(_CLASS_HASH[cls] + np.clip(rank, 0, 15).astype(np.uint64)), np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    shape = mix(total[words.ends] - total[words.starts])
    return word_rows, WORD_ROWS + (shape % np.uint64(SHAPE_ROWS)).astype(np.int64)


def _context_sums(batches):
    """One batch of table rows per task: sums of neighbours' index vectors."""
    index = index_vectors()
    sums = np.zeros((ROWS, DIM), dtype=np.float64)
    some = False
    for part in text_chunks(batches, "text"):
        words = Words(*text_bytes(part.column("text")))
        if not len(words):
            continue
        some = True
        rows = token_rows(words)
        own = index[rows[0]] + index[rows[1]]
        near = np.zeros_like(own)
        for d in range(1, REACH + 1):
            same = (words.doc[d:] == words.doc[:-d])[:, None]
            near[d:] += own[:-d] * same
            near[:-d] += own[d:] * same
        for r in rows:
            for k in range(DIM):
                sums[:, k] += np.bincount(r, weights=near[:, k], minlength=ROWS)
    if some:
        at = np.flatnonzero(np.abs(sums).any(axis=1))
        names = ["bucket", *(f"c{k}" for k in range(DIM))]
        yield pa.RecordBatch.from_arrays([pa.array(at)] + [pa.array(sums[at, k].astype(np.int64)) for k in range(DIM)], names=names)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of word vectors of a corpus, rows scaled to length 1; ROWS x DIM, whatever the corpus."""
    prepare(docs.sparkSession)
    ddl = "bucket long, " + ", ".join(f"c{k} long" for k in range(DIM))
    parts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(_context_sums, ddl)
    table = np.zeros((ROWS, DIM))
    for r in parts.groupBy("bucket").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(DIM))).collect():  # at most ROWS rows
        table[r[0]] = r[1:]
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(words: Words, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row per text: mean vectors of words and shapes, lengths of the mean index vectors, log length."""
    n_docs = len(words.offsets) - 1
    n = np.diff(words.first)
    out = np.zeros((n_docs, 2 * DIM + 3))
    full = np.flatnonzero(n)
    if len(full):
        at, share = words.first[full], n[full][:, None]
        for k, rows in enumerate(token_rows(words)):
            out[full, k * DIM:(k + 1) * DIM] = np.add.reduceat(table[rows], at, axis=0, dtype=np.float64) / share
            out[full, 2 * DIM + k] = np.linalg.norm(np.add.reduceat(index[rows], at, axis=0, dtype=np.float64) / share, axis=1)
    out[:, -1] = np.log1p(n)
    return out


class Network:
    """Two layers, tanh and sigmoid, trained with Adam; ``predict`` divides by a fitted temperature."""

    def __init__(self, constant: float = 0.5):
        self.constant: float | None = constant

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if len(set(y.tolist())) < 2:
            self.constant = (y.sum() + 1) / (len(y) + 2)
            return self
        rng = np.random.Generator(np.random.PCG64(11))
        order = rng.permutation(len(y))
        check, train = order[:len(y) // 5], order[len(y) // 5:]
        if len(set(y[train].tolist())) < 2 or len(check) < 10:
            check = train = order
        self.constant = None
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        p = self.params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        for epoch in range(EPOCHS):
            mixed = rng.permutation(train)
            for a in range(0, len(mixed), BATCH):
                i = mixed[a:a + BATCH]
                h = np.tanh(x[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [x[i].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        z, sign = self._logits(x[check]), 2 * y[check] - 1
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        self.temperature = float(grid[np.argmin([np.logaddexp(0, -sign * z / t).mean() for t in grid])])
        return self

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.params[0] + self.params[1]) @ self.params[2] + self.params[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def held_out(id_col: str) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _feature_rows(table: np.ndarray) -> Callable:
    def run(batches):
        index = index_vectors()
        for part in text_chunks(batches, "text"):
            x = features(Words(*text_bytes(part.column("text"))), table, index)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = LABELLED) -> Network:
    """Fit the network on labelled rows of the training folds, at most ``sample`` of them."""
    own = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL AND id IS NOT NULL")
           .where(~held_out("id")).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id")
    ddl = "id long, y double, x binary"
    got = (rows.select("id", "text", "y").mapInArrow(_feature_rows(table), ddl).dropDuplicates(["id", "x"])
           .orderBy(F.xxhash64("id"), "id", "x").limit(sample).collect())  # at most ``sample`` rows of 67 numbers
    if not got:
        return Network()
    return Network().fit(np.array([np.frombuffer(r["x"]) for r in got]), np.array([1.0 if r["y"] > 0 else 0.0 for r in got]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = LABELLED) -> DataFrame:
    """``docs``' columns plus ``quality_score``, learned from ``labels`` and all of ``docs``."""
    prepare(docs.sparkSession)
    table = word_vectors(docs, text_col)
    model = train(docs, labels, table, id_col, text_col, label_col, sample)

    def run(batches):
        index = index_vectors()
        for part in text_chunks(batches, text_col):
            score = model.predict(features(Words(*text_bytes(part.column(text_col))), table, index))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "quality_score"])

    keep = docs.drop("quality_score")
    return keep.mapInArrow(run, StructType([*keep.schema.fields, StructField("quality_score", DoubleType())]))
