"""Target-distribution importance resampling (operator 12) with an Aho-Corasick dictionary.

Texts are compared with a target by hashed features: runs of consecutive words,
joined by one space, whose CRC-32 modulo ``buckets`` names a bucket.  A dictionary
of distinct words, each bounded by delimiters, is an Aho-Corasick automaton
whose payloads are the word's CRC and length.  One scan of a text emits the
payloads of its words in order; the CRC of a longer feature is composed from
those of adjacent words (shift the first by the second's length, then XOR), so
no word is hashed again and no feature is ever built.  The dictionary holds the
most frequent words of all texts, up to ``DICTIONARY_WORDS``; the scan shows which
words it misses, and their payloads are computed on the spot, so its size changes
no result.

Bucket counts of documents and target give each bucket its gain, a document's
weight is the sum of its features' gains, and Gumbel noise seeded by its id makes
the highest scores a draw without replacement.  Ranks come from a range sort and
counts per partition; no task sees all rows.

Words are maximal runs of ASCII letters and digits and all characters beyond
ASCII, only A-Z lower-cased.

Cases: a null or empty text, or one without words, has no features and weight 0;
the target's count for nothing.  A null id takes its noise from an empty name and
comes last among equal scores.  Rows with equal ids each have their own score and
place.  Other columns are ignored.  No rows: no rows; an empty target is allowed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, prepare, shuffle_partitions, text_chunks
from .lexical_rank import FOLD

BUCKETS = 10_000
DICTIONARY_WORDS = 1 << 16
WORD_BYTES = 64  # longer words stay out of the dictionary
KEPT_WORDS = 200_000  # distinct words a task counts before it hands them on
_POLYNOMIAL = 0xEDB88320  # CRC-32, reflected


# --- composing CRCs ---------------------------------------------------------

def _byte_step(register: np.ndarray) -> np.ndarray:
    """The CRC register after one zero byte (linear over bits)."""
    for _ in range(8):
        register = (register >> np.uint32(1)) ^ np.where(register & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    return register


def _apply(columns: np.ndarray, register: np.ndarray) -> np.ndarray:
    out = np.zeros_like(register)
    for bit in range(32):
        out ^= np.where((register >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


_SHIFTS: dict[int, np.ndarray] = {}


def _columns(length: int) -> np.ndarray:
    """Images of the 32 single bits under ``length`` zero bytes, by halving the length."""
    if length not in _SHIFTS:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        half = _columns(length // 2) if length > 1 else unit
        both = _apply(half, half)
        own = unit if length == 0 else _byte_step(both) if length % 2 else both
        if length > 4096:
            return own
        _SHIFTS[length] = own
    return _SHIFTS[length]


def compose(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings from those of their first parts, and those and the lengths of the rest."""
    out = np.empty_like(first)
    for n in np.unique(length).tolist():
        own = length == n
        out[own] = _apply(_columns(n), first[own])
    return out ^ second


# --- the dictionary ----------------------------------------------------------

class Dictionary:
    """Automaton of delimiter-bounded words with payloads (length, CRC)."""

    def __init__(self, words: list[bytes]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for w in words:
            self.automaton.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
        if words:
            self.automaton.make_automaton()

    def scan(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's index, CRC, length) of every word of the texts, in order."""
        joined = b" " + b" ".join([(t or b"").translate(FOLD) for t in texts]) + b" "
        data = np.frombuffer(joined, dtype=np.uint8)
        word = data != 32
        starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        lengths = np.flatnonzero(word[:-1] & ~word[1:]) + 1 - starts
        crc, missing = np.zeros(len(starts), dtype=np.uint32), np.ones(len(starts), dtype=bool)
        if len(self.automaton):
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(joined.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
            at = np.searchsorted(starts, hits[:, 0] - (hits[:, 1] >> 32))
            crc[at], missing[at] = (hits[:, 1] & 0xFFFFFFFF).astype(np.uint32), False
        for i in np.flatnonzero(missing).tolist():  # words beyond the dictionary
            crc[i] = zlib.crc32(joined[starts[i]:starts[i] + lengths[i]])
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        return np.searchsorted(ends, starts - 1, side="right"), crc, lengths

    def features(self, texts: list[bytes | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text's index, CRC) of the features of 1 to ``most`` words."""
        doc, crc, length = self.scan(texts)
        yield doc, crc
        space = np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32)
        spaced = compose(space, crc, length) if most > 1 else crc  # a space and the word
        run = crc
        for n in range(1, most):
            if len(run) < 2:
                return
            run = compose(run[:-1], spaced[n:], length[n:] + 1)
            whole = doc[:-n] == doc[n:]
            yield doc[:-n][whole], run[whole]


_DICTIONARIES: dict[tuple, Dictionary] = {}


def _dictionary(words: list[bytes]) -> Dictionary:
    """The worker's dictionary; it outlives the task."""
    key = (len(words), zlib.crc32(b" ".join(words)))
    if key not in _DICTIONARIES:
        _DICTIONARIES.clear()
        _DICTIONARIES[key] = Dictionary(words)
    return _DICTIONARIES[key]


def _words(batches) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def handed():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for b in text_chunks(batches, "text"):
        for text in b.column("text").cast(pa.binary()).to_pylist():
            counts.update((text or b"").translate(FOLD).split())
        if len(counts) > KEPT_WORDS:
            yield handed()
            counts.clear()
    yield handed()


def frequent_words(texts: DataFrame, most: int = DICTIONARY_WORDS) -> list[bytes]:
    """At most ``most`` words of up to WORD_BYTES bytes: all those that occur at least so often that no more than ``most`` do.

    A histogram of the counts' logarithms gives the bound, so only the words taken are sent to the driver."""
    found = texts.mapInArrow(_words, "word binary, n long").where(F.octet_length("word") <= WORD_BYTES)
    counted, path = materialize(found.groupBy("word").agg(F.sum("n").alias("n")), "resample-words")
    level = F.floor(F.log2("n") * 16)
    least, taken = None, 0
    for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # some hundred levels
        taken += r["words"]
        if taken > most:
            break
        least = r["level"]
    words = [] if least is None else sorted(bytes(r["word"]) for r in counted.where(level >= least).select("word").collect())
    drop_scratch(texts.sparkSession, path)
    return words


# --- counts, scores, ranks ----------------------------------------------------

def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return b.column("text").cast(pa.binary()).to_pylist()


def _count(words, most: int, buckets: int) -> Callable:
    def run(batches):
        total, own = np.zeros(buckets, dtype=np.int64), _dictionary(words.value)
        for b in text_chunks(batches, "text"):
            for _, crc in own.features(_texts(b), most):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, words, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket; a row per bucket comes back.  ``words`` is a broadcast dictionary."""
    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInArrow(_count(words, most, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the smoothed log-ratio of target to source, rounded down."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weigh(words, gain: np.ndarray, most: int) -> Callable:
    def run(batches):
        own = _dictionary(words.value)
        for b in text_chunks(batches, "text"):
            n_words, n_features, weight = (np.zeros(len(b), dtype=np.int64) for _ in range(3))
            for i, (doc, crc) in enumerate(own.features(_texts(b), most)):
                many = np.bincount(doc, minlength=len(b))
                n_words += many if i == 0 else 0
                n_features += many
                np.add.at(weight, doc, gain[crc % np.uint32(len(gain))])
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, (n_words, n_features, weight))], names=["id", "n_words", "n_features", "weight"])

    return run


def _numbered(batches) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the row's place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, dtype=np.int32)), pa.array(np.arange(at + 1, at + 1 + len(b)))],
                                         names=[*b.schema.names, "part", "place"])
        at += len(b)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             most_words: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """(id, n_features, weight, score, rank) per row of ``docs``; ``rank`` counts the drawn rows from 1, others have none.

    Of the rows with at least ``least_words`` words, ``percent`` percent (rounded down) are drawn."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = target.select(F.col(target_text_col).alias("text"))
    words = spark.sparkContext.broadcast(frequent_words(rows.select("text").unionByName(wanted)))  # at most DICTIONARY_WORDS short words
    gain = gains(bucket_counts(rows.select("text"), words, most_words, buckets), bucket_counts(wanted, words, most_words, buckets))
    noise = F.expr(f"CAST(conv(substring(sha2(concat('{seed}:', coalesce(CAST(id AS string), '')), 256), 1, 8), 16, 10) AS double)")
    weighed = rows.mapInArrow(_weigh(words, gain, most_words), "id long, n_words long, n_features long, weight long")
    scored, _ = materialize(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))), "resample-scores")

    in_draw = F.col("n_words") >= least_words
    keys = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    prepare(spark, 10_000)
    ordered = scored.where(in_draw).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    placed, placed_path = materialize(ordered.mapInArrow(_numbered, "id long, n_words long, n_features long, weight long, score long, part int, place long"), "resample-places")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    drawn = placed.count() * percent // 100
    rank = F.col("base") + F.col("place")
    ranked = placed.join(base, "part").select("id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where(~in_draw).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("id", id_col)
