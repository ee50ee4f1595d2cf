"""N-gram Jaccard join (operator 6): parity sketches, pigeonhole segments per size band, exact check.

Each distinct word shingle of a text flips one position of a very wide bit
sketch, so the Hamming distance of two sketches is at most the size of the
sets' symmetric difference.  Similar sets have sizes in the same or
neighbouring bands, and per pair of bands the symmetric difference is at most
t.  The wide sketch is cut into more than t segments: similar sets agree on one
of them at least (pigeonhole).  A segment travels as the XOR of its tokens'
64-bit hashes.  Segments without a token say little; they are left out unless a
set has so many that the pigeonhole argument would need them.  Such a set is
cut again with another hash, together with the others of its kind.

Candidates are pairs that share a segment key; of keys shared by the same sets one
is kept.  The sets of a key meet in units of at most two blocks of ``BLOCK_SETS``.  A
short parity sketch (the wide one folded) rejects pairs whose Hamming distance
exceeds what the threshold allows, and a unit sends no more than a spanning
forest of the pairs left between different components.  Those are verified
exactly on their texts; verified links join components, failed pairs are
remembered, and the next round tries what is still open.  The loop ends when
no pair that shares a key is both unconnected and untried, so no connection is
lost, and no round sends more pairs than key rows.  Equal sets are collapsed
before all this.

Cases: null or empty text and text without words: no shingles, linked with
nothing.  Fewer words than ``size``: the whole sequence is one shingle.  Of rows with
equal ids each has its own text's component.  A null id is returned with a null
component.  Other columns are ignored.  No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_int64, drop_scratch, materialize, mix, prepare, text_bytes, text_chunks
from .components import connected_components

BLOCK_SETS = 1024
RECUTS = 8  # hashes tried for sets whose segments are too often empty; with the last, empty ones count too
SEEN_SETS = 100_000  # sets a task remembers, not to send the keys of a copy again
BITMAP_BITS = 1 << 23  # filter of the ids whose texts are needed; false hits only cost time


def most_difference(x: int, y: int, percent: int) -> int:
    """Largest symmetric difference of sets of sizes x, y with 100 * |intersection| >= percent * |union|; -1 if none."""
    common = -(-percent * (x + y) // (100 + percent))
    return x + y - 2 * common if common <= min(x, y) else -1


@cache
def bands(percent: int, upto: int) -> tuple[int, ...]:
    """First sizes of the bands: sets similar enough lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return tuple(out + [max(out[-1] + 1, -(-100 * out[-1] // percent))])


@cache
def scheme(percent: int, j: int, upto: int) -> tuple[int, int]:
    """(most symmetric difference t, segments) for pairs of bands j and j + 1 and within band j."""
    starts = bands(percent, upto)
    x = starts[j + 1] - 1
    y = min(starts[j + 2] - 1, 100 * x // percent) if j + 2 < len(starts) else x
    t = max(most_difference(x, b, percent) for b in range(x, y + 1))
    k = t + 1
    for _ in range(3):  # room for the segments expected to be empty
        k = t + 1 + math.ceil(k * math.exp(-starts[j] / k))
    return t, k


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    grams = words.windows(size)[0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for i in range(a, b):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words.hash[i:i + 1])
            yield h
        else:
            yield np.zeros(0, dtype=np.uint64)


def fingerprint(own: np.ndarray) -> int:
    """64-bit name of a set; 0 only for the empty one."""
    if not len(own):
        return 0
    both = np.array([np.bitwise_xor.reduce(mix(own + np.uint64(3))), len(own)], dtype=np.uint64)
    return int(mix(mix(both[:1]) + both[1:]).view(np.int64)[0]) or 1


def parity_sketch(own: np.ndarray, percent: int) -> bytes:
    """Folded parity sketch: a power of two of bits, at least 16 per difference allowed."""
    bits = 1 << max(6, (16 * max(0, most_difference(len(own), len(own), percent))).bit_length())
    odd = np.bincount((mix(own ^ np.uint64(0x5BD1E995)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_matrix(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Boolean matrix: pairs whose sizes and sketches allow the threshold."""
    width = min(map(len, sketches))
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0) for x in sketches])
    distance = np.zeros((len(sizes), len(sizes)), dtype=np.int32)
    for word in folded.T:
        distance += np.bitwise_count(word[:, None] ^ word[None, :])
    total = sizes[:, None] + sizes[None, :]
    common = -(-percent * total // (100 + percent))
    return (common <= np.minimum(sizes[:, None], sizes[None, :])) & (distance <= total - 2 * common)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, new = [], np.ones(len(near), dtype=bool)
    while new.any():
        edge = np.array([int(np.argmax(new))])
        new[edge] = False
        while len(edge):
            reach = near[edge] & new
            hit = np.flatnonzero(reach.any(axis=0))
            out += zip(edge[np.argmax(reach[:, hit], axis=0)].tolist(), hit.tolist())
            new[hit] = False
            edge = hit
    return out


def segment_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: two sets within the threshold share at least one, unless they are equal."""
    n = len(own)
    upto = 1 << n.bit_length()
    starts = bands(percent, upto)
    band = int(np.searchsorted(starts, n, side="right")) - 1
    out = []
    for j in (band - 1, band):
        if j < 0:
            continue
        t, k = scheme(percent, j, upto)
        if t == 0:
            continue  # only equal sets, which are collapsed already
        for cut in range(RECUTS):
            token = mix(own ^ np.uint64((cut + 1) * 0x9E3779B97F4A7C15 % 2**64))
            at = (token % np.uint64(k)).astype(np.int64)
            order = np.argsort(at)
            at = at[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            value, where = np.bitwise_xor.reduceat(mix(token[order]), first), at[first]
            scarce = k - len(where) >= k - t  # as many empty segments as may be all that agree
            if scarce and cut == RECUTS - 1:
                empty = np.setdiff1d(np.arange(k), where)
                value, where = np.append(value, np.zeros(len(empty), np.uint64)), np.append(where, empty)
            out.append(mix(value ^ mix((where.astype(np.uint64) << np.uint64(24)) + np.uint64(j * RECUTS + cut))))
            if not scarce:
                break
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _sets(batches, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in text_chunks(batches, "text"):
        yield part, list(shingle_sets(Words(*text_bytes(part.column("text"), lower=True)), size))


def _describe(size: int, percent: int) -> Callable:
    """Per text its set's size, name and short sketch, and the segment keys of sets that the task meets first."""
    def run(batches):
        seen: set[int] = set()
        for part, sets in _sets(batches, size):
            fps, keys = [fingerprint(x) for x in sets], []
            for has_id, fp, own in zip(part.column("id").is_valid().to_pylist(), fps, sets):
                if not has_id or fp in seen or not len(own):
                    keys.append(None)
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(fp)
                keys.append(as_int64(segment_keys(own, percent)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps, pa.int64()),
                                              pa.array([parity_sketch(x, percent) for x in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["id", "text_hash", "n", "fp", "sketch", "keys"])

    return run


def _units(batches) -> Iterator[pa.Table]:
    """Whole units of a stream sorted by (key, i, j)."""
    left: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
        cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if len(t) > 1 else np.zeros(0, np.int64)
        for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            yield t.slice(x, y - x)
        left = t.slice(int(cuts[-1])) if len(cuts) else t
    if left is not None and len(left):
        yield left


def _tries(percent: int) -> Callable:
    """Per unit the pairs (a, b) to verify: a forest of those near by sketch, in different components and not failed before."""
    def run(batches):
        out: set[tuple[int, int]] = set()
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
                    gone = np.isin(fp, others)
                    open_[x, gone] = open_[gone, x] = False
            out.update((int(min(fp[x], fp[y])), int(max(fp[x], fp[y]))) for x, y in forest(open_))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return run


def _verify(size: int, percent: int) -> Callable:
    def run(batches):
        for b in batches:
            known: dict[int, np.ndarray] = {}
            for side in "ab":
                fps = b.column(side).to_pylist()
                new = [i for i, fp in enumerate(fps) if fp not in known and not known.setdefault(fp, np.zeros(0, np.uint64)).size]
                for at in range(0, len(new), 64):
                    some = new[at:at + 64]
                    texts = b.column(f"{side}_text").take(pa.array(some))
                    for i, own in zip(some, shingle_sets(Words(*text_bytes(texts, lower=True)), size)):
                        known[fps[i]] = own
            keep = []
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                common = len(np.intersect1d(known[x], known[y], assume_unique=True))
                keep.append(100 * common >= percent * (len(known[x]) + len(known[y]) - common))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


class _Texts:
    """Texts by set, one each, of the sets that any pair needs."""

    def __init__(self, rows: DataFrame, holders: DataFrame, needed: DataFrame, size: int):
        # Bits of the hashed ids of the needed sets' holders: at most BITMAP_BITS of them come to the driver.
        # Spark's bitmap buckets start at 1 for the value 1; the value 0 has a bucket of its own.
        bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS)) + 1
        ids = holders.join(needed, "fp", "left_semi").select(bit.alias("bit"))
        parts = (ids.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())
        bits = np.zeros(BITMAP_BITS + 32_768, dtype=bool)
        for r in parts:
            own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
            at = (r["k"] - 1) * 32_768
            bits[at:at + len(own)] = own
        packed = np.packbits(bits, bitorder="little")

        def run(batches):
            for part in batches:
                at = part.column("bit").to_numpy()
                part = part.filter(pa.array(((packed[at >> 3] >> (at & 7)) & 1).astype(bool)))
                for some, sets in _sets([part.select(["id", "text"])], size):
                    yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in sets], pa.int64()), some.column("id"), some.column("text")], names=["fp", "id", "text"])

        place = F.bitmap_bit_position(bit) + (F.bitmap_bucket_number(bit) - 1) * 32_768
        found = rows.where("id IS NOT NULL").select("id", "text", place.alias("bit")).mapInArrow(run, "fp long, id long, text string")
        self.rows = found.join(holders.withColumnRenamed("id", "holder"), "fp").where("id = holder").select("fp", "text")


def _verified(tries: DataFrame, rows: DataFrame, holders: DataFrame, size: int, percent: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) of ``tries`` that hold the threshold, written."""
    texts = _Texts(rows, holders, tries.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), size).rows
    side = lambda s: texts.select(F.col("fp").alias(s), F.col("text").alias(f"{s}_text"))
    return materialize(tries.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(size, percent), "a long, b long").distinct(), "ngram-links")


def _connect(spark: SparkSession, shared: DataFrame, sets: DataFrame, rows: DataFrame, holders: DataFrame, size: int, percent: int) -> DataFrame:
    """(id: set, component: set) of linked sets, from rows (key, fp, n, sketch)."""
    links = spark.createDataFrame([], "a long, b long")
    failed = spark.createDataFrame([], "fp long, failed array<long>")
    gone = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "id long, component long")
    unit = ["key", "i", "j"]
    while True:
        placed = shared.join(comps.withColumnRenamed("id", "fp"), "fp", "left").join(failed, "fp", "left").withColumn("comp", F.coalesce("component", "fp"))
        torn = placed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        live = (placed.join(torn.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
                .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "comp", "n", "sketch", "failed"))
        tries, tries_path = materialize(live.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_tries(percent), "a long, b long").distinct(), "ngram-tries")
        if tries.isEmpty():
            return comps
        new, _ = _verified(tries, rows, holders, size, percent)
        links = links.union(new)
        gone, _ = materialize(gone.union(tries.join(new, ["a", "b"], "left_anti")), "ngram-failed")
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        failed = gone.select(both.alias("p")).groupBy(F.col("p.a").alias("fp")).agg(F.collect_list("p.b").alias("failed"))
        drop_scratch(spark, tries_path)
        if not new.isEmpty():
            comps, _ = materialize(connected_components(links), "ngram-comps")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) per row: component_id is the smallest id reachable by links."""
    return jaccard_groups(docs, id_col, text_col, size, percent).select(id_col, "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, text_hash, group) per row: component_id is the smallest id reachable by
    links; text_hash is the text's xxhash64; group names the component even where one id has several texts
    (null for rows without shingles or id)."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    described, _ = materialize(hashed.mapInArrow(_describe(size, percent), "id long, text_hash long, n long, fp long, sketch binary, keys array<long>"), "ngram-sets")
    known = described.where("id IS NOT NULL AND n > 0")
    holders, _ = materialize(known.groupBy("fp").agg(F.min("id").alias("id")), "ngram-holders")
    sets = known.join(holders, ["fp", "id"], "left_semi").dropDuplicates(["fp"]).select("fp", "n", "sketch")

    keys = described.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "fp")
    common, common_path = materialize(keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("key"), "ngram-common")
    met, met_path = materialize(keys.join(common, "key").distinct(), "ngram-met")
    # Many keys bring the same sets together: one of them is enough.
    named = met.groupBy("key").agg(F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("fp", F.lit(1)).cast("decimal(38,0)")).alias("s"), F.count("*").alias("c"))
    once = named.groupBy("x", "s", "c").agg(F.min("key").alias("key")).select("key")
    shared, shared_path = materialize(met.join(once, "key").join(sets, "fp"), "ngram-shared")
    drop_scratch(spark, common_path, met_path)
    comps = _connect(spark, shared, sets, rows, holders, size, percent)
    drop_scratch(spark, shared_path)

   # Names of sets back to ids: the smallest holder of any set of the component.
    named = holders.join(comps.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    final, _ = materialize(named.join(least, "comp").select("fp", "component_id", F.col("comp").alias("group")), "ngram-final")
    out = described.join(final, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))).alias("component_id"),
                      "text_hash", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("group")).alias("group"))
