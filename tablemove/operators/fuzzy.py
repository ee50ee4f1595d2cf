"""Fuzzy-match dedupe (E9): exact copies by content hash, near copies by
MinHash + LSH banding, connected inside their buckets.

Scale notes
* Shingles, MinHash values and a parity sketch come from one vectorised pass over
  the texts; what it writes is a few hundred bytes a text, and no text is
  shuffled before the survivors are picked.
* Exact copies collapse in an aggregate on ``sha2(text)`` over those rows.
* A bucket's members meet in blocks of ``BLOCK_SETS``.  The sketches reject pairs
  that cannot hold the threshold (never others), and a unit sends no more than a
  spanning forest of the pairs left.  These are checked exactly on their shingle
  sets and linked ones merged with the connected-components job.  In the first
  round each block meets the bucket's leader only, so large families are joined
  in linear time; then all blocks of a bucket whose members are not all
  connected meet, until no bucket holds an untried, unconnected pair.
* Shingle sets are made again from the texts of tried pairs only; a bitmap of
  fixed size picks their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.common import Words, as_int64, mix, prepare, text_bytes, text_chunks
from ..llm.ngram_join import BITMAP_BITS, BLOCK_SETS, _units, forest, near_matrix, parity_sketch
from .graph import _cut, connected_components

#: The shingle set of a text without words.
BLANK = np.ones(1, dtype=np.uint64)
#: Tells the places of words apart in a text that is shorter than one shingle.
WORD_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct word ``shingle``-gram hashes of lower-case texts; a text shorter than one shingle is one."""
    words = Words(*text_bytes(texts))
    grams, out = words.windows(shingle)[0], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= shingle:
            own = np.sort(grams[a:b - shingle + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(np.bitwise_xor.reduce(mix(words.hash[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * WORD_PLACE), keepdims=True))
        else:
            out.append(BLANK)
    return out


def _minima(sets: Sequence[np.ndarray], k: int, seed: int) -> np.ndarray:
    """(sets, k) MinHash values: the smallest of ``a * x + b`` modulo 2^32 over a set's hashes, for ``k`` odd a."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = (rng.integers(0, 2**32, size=(2, k), dtype=np.uint32) | np.array([[1], [0]], dtype=np.uint32))
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(x * a[i] + b[i], first) for i in range(k)], axis=1)


def _band_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands) keys; sets whose values of a band are equal share its key."""
    values = minima.reshape(len(minima), bands, -1).astype(np.uint64)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(minima), 1))
    for r in range(values.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
    return key


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.int64()))


def _arrow_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def signatures(docs: DataFrame, id_col: str, text_col: str, num_hashes: int, shingle: int,
               seed: int) -> DataFrame:
    """(id, signature array<long>, shingle set array<long>) from word ``shingle``-grams of the whole text.

    Texts shorter than one shingle use all their words as a single shingle.
    """
    prepare(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_t"):
            sets = _sets(part.column("_t"), shingle)
            yield pa.RecordBatch.from_arrays([part.column("_id"), _lists(_minima(sets, num_hashes, seed)), pa.array(map(as_int64, sets), pa.list_(pa.int64()))],
                                             names=[id_col, "_sig", "_set"])

    rows = docs.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_t"))
    return rows.mapInArrow(run, f"`{id_col}` {_arrow_type(docs, id_col)}, _sig array<long>, _set array<long>")


def _described(rows: DataFrame, bands: int, rows_per_band: int, shingle: int, seed: int, percent: int) -> DataFrame:
    """(_id, _h: content hash, n: shingles, sketch, keys: a bucket per band) of rows (_id, _t)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_t"):
            sets = _sets(part.column("_t"), shingle)
            keys = _band_keys(_minima(sets, bands * rows_per_band, seed), bands)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_h"), pa.array(map(len, sets), pa.int64()),
                                              pa.array([parity_sketch(x, percent) for x in sets], pa.binary()), _lists(as_int64(keys))],
                                             names=["_id", "_h", "n", "sketch", "keys"])

    hashed = rows.select("_id", F.unhex(F.sha2("_t", 256)).alias("_h"), F.lower("_t").alias("_t"))
    return hashed.mapInArrow(run, f"_id {_arrow_type(rows, '_id')}, _h binary, n long, sketch binary, keys array<long>")


def _kept_bits(bits: np.ndarray) -> Callable:
    packed = np.packbits(bits, bitorder="little")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = part.column("bit").to_numpy()
            yield part.filter(pa.array(((packed[at >> 3] >> (at & 7)) & 1).astype(bool))).select(["_id", "_t"])

    return run


def _sets_of(rows: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(fp, set) of the ``needed`` texts (fp, _id, _h), made from rows (_id, _t).

    Bits of the hashed ids come to the driver, at most ``BITMAP_BITS`` of them; false hits only cost time.
    """
    # Spark's bitmap buckets start at 1 for the value 1.
    bit = F.pmod(F.xxhash64("_id"), F.lit(BITMAP_BITS)) + 1
    marks = needed.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros(BITMAP_BITS + 32_768, dtype=bool)
    for r in marks.collect():
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        at = (r["k"] - 1) * 32_768
        bits[at:at + len(own)] = own
    found = rows.select("_id", "_t", (bit - 1).alias("bit")).mapInArrow(_kept_bits(bits), f"_id {_arrow_type(rows, '_id')}, _t string")
    found = found.select("_id", F.unhex(F.sha2("_t", 256)).alias("_h"), F.lower("_t").alias("_t")).join(needed, ["_id", "_h"]).dropDuplicates(["fp"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "_t"):
            yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array(map(as_int64, _sets(part.column("_t"), shingle)), pa.list_(pa.int64()))], names=["fp", "set"])

    return found.select("fp", "_t").mapInArrow(run, "fp long, set array<long>")


def _links(tries: DataFrame, rows: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The rows of ``tries`` whose sets hold the threshold."""
    needed = texts.join(tries.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi")
    sets = _cut(_sets_of(rows, _cut(needed.select("fp", "_id", "_h")), shingle))
    s1 = sets.select(F.col("fp").alias("a"), F.col("set").alias("s1"))
    s2 = sets.select(F.col("fp").alias("b"), F.col("set").alias("s2"))
    common = F.size(F.array_intersect("s1", "s2"))
    return _cut(tries.join(s1, "a").join(s2, "b").filter(common >= threshold * (F.size("s1") + F.size("s2") - common) - 1e-9).select(*tries.columns))


def _shared_buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, fp, node, n, sketch) of buckets with several texts, and their texts (fp, node, _id, _h, n, sketch).

    Texts of one id have one node.  Of buckets with the same members one is kept.
    """
    keys = reps.select("fp", F.explode(F.array_distinct("keys")).alias("key"))
    met = _cut(keys.join(keys.groupBy("key").agg(F.min("fp").alias("_lo"), F.max("fp").alias("_hi")).filter("_lo < _hi").select("key"), "key", "left_semi"))
    named = met.groupBy("key").agg(F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("fp", F.lit(1)).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("c"))
    met = met.join(named.groupBy("x", "s", "c").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    texts = _cut(reps.drop("keys").join(met.select("fp").distinct(), "fp", "left_semi"))
    texts = _cut(texts.join(texts.groupBy("_id").agg(F.min("fp").alias("node")), "_id"))
    return _cut(met.join(texts.select("fp", "node", "n", "sketch"), "fp")), texts


#: Columns of tried pairs.
TRIED = ["a", "b", "comp_a", "comp_b", "key"]


def _tries(percent: int) -> Callable:
    """Per unit the pairs to check (a, b, their components, key): a forest of those near by sketch, of different components and not failed before."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for t in _units(batches):
            if len(t) < 2:
                continue
            fp, comp, part = (t.column(c).to_numpy() for c in ("fp", "comp", "part"))
            open_ = comp[:, None] != comp[None, :]
            if t.column("i")[0].as_py() != t.column("j")[0].as_py():
                open_ &= part[:, None] != part[None, :]
            open_ &= near_matrix(t.column("n").to_numpy(), t.column("sketch").to_pylist(), percent)
            for x, others in enumerate(t.column("failed").to_pylist()):
                if others:
                    failed = np.isin(fp, others)
                    open_[x, failed] = open_[failed, x] = False
            if open_.any():
                pairs = np.array([(x, y) if fp[x] < fp[y] else (y, x) for x, y in forest(open_)])
                a, b = pairs[:, 0], pairs[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (fp[a], fp[b], comp[a], comp[b], np.full(len(a), t.column("key")[0].as_py()))], names=TRIED)

    return run


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` between components (comp_a, comp_b)."""
    joined = _cut(connected_components(links, "comp_a", "comp_b"))
    moved = comps.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    return _cut(moved.select("node", F.coalesce("_to", "component").alias("component")).unionByName(joined.join(comps, "node", "left_anti")))


def _linked_ids(rows: DataFrame, reps: DataFrame, threshold: float, percent: int, shingle: int) -> DataFrame:
    """(_id, component) of the ids with links; component is a number."""
    shared, texts = _shared_buckets(reps)
    unit = ["key", "i", "j"]
    columns = [*unit, "part", "fp", "comp", "n", "sketch", "failed"]
    comps = texts.select("node", F.col("node").alias("component")).limit(0)
    gone = texts.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    first = True
    while True:
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        failed = gone.select(both.alias("p")).groupBy(F.col("p.a").alias("fp")).agg(F.collect_list("p.b").alias("failed"))
        placed = shared.join(comps, "node", "left").join(failed, "fp", "left").withColumn("comp", F.coalesce("component", "node"))
        # written, so that the join below can split a bucket's rows over tasks
        torn = _cut(placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("parts"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
                                              F.min("fp").alias("_leader")).filter("_lo < _hi").select("key", "parts", "_leader"))
        live = placed.join(torn, "key").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
        every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        live = live.withColumn("other", F.explode(F.when(F.col("fp") == F.col("_leader"), every).otherwise(F.array("part")) if first else every))
        if first:  # the leader counts to the block it visits
            live = live.withColumn("part", F.col("other"))
        live = live.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).select(*columns)
        tried = _cut(live.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_tries(percent), ", ".join(f"{c} long" for c in TRIED)))
        if not first and tried.isEmpty():
            return texts.select("node", "_id").distinct().join(comps, "node").select("_id", "component")
        # a bucket all of whose blocks have met without an open pair has none later
        left = tried.select("key")
        shared = _cut(shared.join((left.unionByName(torn.filter("parts > 1").select("key")) if first else left).distinct(), "key", "left_semi"))
        tries = _cut(tried.drop("key").distinct())
        new = _links(tries, rows, texts, threshold, shingle)
        gone = _cut(gone.unionByName(tries.select("a", "b").join(new, ["a", "b"], "left_anti")))
        if not new.isEmpty():
            comps = _joined(comps, new)
        first = False


def fuzzy_dedupe(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8,
                 bands: int = 16, rows_per_band: int = 4, shingle: int = 5, seed: int = 7) -> DataFrame:
    """Rows of ``df`` that survive fuzzy dedupe: one row (smallest id) per
    group of exact or near copies.  Near = Jaccard of word ``shingle``-grams
    >= ``threshold``, checked on the shingle sets of every candidate pair; the
    ``bands * rows_per_band`` MinHash values only choose candidates (a pair at
    Jaccard 0.8 shares a band with probability > 0.999).  Exact copies always
    collapse; rows without a text all stay."""
    prepare(df.sparkSession)
    percent = int(100 * threshold + 1e-9)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.col("_t").isNotNull())
    # Exact copies: one representative per content hash (all texts of a hash
    # are equal, so any one of their descriptions is the group's), numbered as it is written.
    described = _described(rows, bands, rows_per_band, shingle, seed, percent)
    groups = described.groupBy("_h").agg(F.min("_id").alias("_id"), F.any_value(F.struct("n", "sketch", "keys")).alias("_d")).filter(F.col("_id").isNotNull())
    reps = _cut(groups.select(F.monotonically_increasing_id().alias("fp"), "_id", "_h", "_d.*"))
    linked = _linked_ids(rows, reps, threshold, percent, shingle)
    smallest = linked.groupBy("component").agg(F.min("_id").alias("_least"))
    dropped = linked.join(smallest, "component").filter(F.col("_id") != F.col("_least")).select("_id")
    # the ids of the representatives were written: the aggregation over the texts is not run a second time
    keep = reps.select("_id").join(dropped, "_id", "left_anti")
    survivors = df.join(keep.withColumnRenamed("_id", id_col), id_col, "left_semi").filter(F.col(text_col).isNotNull())
    return survivors.unionByName(df.filter(F.col(text_col).isNull()))
