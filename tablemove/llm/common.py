"""Helpers shared by the training-data operators: scratch tables, code shipping, vectorised word hashing."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tablemove.session import delete_path, scratch_path, table_path

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CHUNK_BYTES = 1 << 18  # text bytes hashed at a time; bounds the numpy working set
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MAX_U64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def prepare(spark: SparkSession, rows_per_batch: int = 512) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of whole texts small."""
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` below the shared checkpoint folder and read it back: (frame, path).

    Cuts the lineage with files that every executor can read, so a lost
    executor costs no recomputation of what lies before.  The write's shuffle
    files go when it ends, not at the driver's next garbage collection.
    """
    path, conf = scratch_path(df.sparkSession, "llm", tag), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        delete_path(spark, p)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words -----------------------------------------------------------------

#: Bytes that separate words: space and 0x09-0x0D.
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C17, 0xD1342543DE82EF93)  # odd, 3 modulo 4
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(base, -1, 2**64) if inverse else base
        p = np.full(max(n, CHUNK_BYTES + 1), np.uint64(b & (2**64 - 1)), dtype=np.uint64)
        p[0] = 1
        have = _POWERS[(base, inverse)] = np.cumprod(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a few texts: ``hash`` (uint64) per word, ``doc`` its text's index,
    ``starts``/``ends`` its byte span in ``data``; ``first[i]:first[i + 1]`` are text i's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int = 0):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~SEPARATORS[data]
        edge = np.zeros(n + 1, dtype=bool)  # a text starts here, or all texts end
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = self._hashes(seed)

    def _hashes(self, seed: int) -> np.ndarray:
        out = np.empty(len(self.starts), dtype=np.uint64)
        base, i = _BASE[seed], 0
        while i < len(out):  # runs of words of about CHUNK_BYTES
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + CHUNK_BYTES, side="right")))
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            total = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[seed][self.data[at:at + e[-1]]] * _powers(base, int(e[-1])), out=total[1:])
            out[i:j] = (total[e] - total[s]) * _powers(base, int(s[-1]) + 1, inverse=True)[s]
            out[i:j] += (e - s).astype(np.uint64) << np.uint64(56)
            i = j
        return mix(out)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the ``size`` words from each word on, whether they lie in one text)."""
        n = len(self.hash)
        out, whole = np.full(n, MAX_U64, dtype=np.uint64), np.zeros(n, dtype=bool)
        if n < size:
            return out, whole
        whole[:n - size + 1] = self.doc[:n - size + 1] == self.doc[size - 1:]
        base = _BASE[1 - seed]
        for a in range(0, n - size + 1, CHUNK_BYTES):
            b = min(n, a + CHUNK_BYTES + size - 1)
            total = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(mix(self.hash[a:b] ^ np.uint64(seed)) * _powers(base, b - a), out=total[1:])
            k = b - a - size + 1
            out[a:a + k] = mix((total[size:] - total[:-size]) * _powers(base, k, inverse=True))
        return out, whole


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string column; a null counts as empty."""
    arr = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return (LOWER[data] if lower else data), off - off[0]


def text_chunks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about CHUNK_BYTES of text each; a longer text comes alone."""
    for batch in batches:
        if not len(batch):
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < len(batch):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + CHUNK_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def as_int64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
