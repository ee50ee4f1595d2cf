"""Token-id output (operator 2): id arrays compressed one document at a time.

Layout below the output folder, all written by Spark tasks:

* ``dictionary``: the zstandard dictionary, trained once on a bounded sample of
  serialized id arrays and shared by all frames, with its SHA-256;
* ``blocks``: rows (shard, block, dictionary_sha256, payload, docs).  A payload
  is about a megabyte of zstandard frames, one per document, in ascending id
  order over shards and blocks; ``docs`` is the block's own offset table;
* ``shards``: (shard, base, n_tokens): ids in all shards before;
* ``index``: one row per document (id, start, n_tokens, shard, block, offset,
  length), to fetch a short document by reading one block.

Ids are little-endian unsigned 32-bit integers; every document ends with
``end_id``.  Cases: a null or empty text is the end id alone; a null document
id sorts first; rows with equal ids are all kept, ordered by a hash of their
text; other columns are ignored; no rows give an empty store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, shuffle_partitions
from .tokens import default_tokenizer, encoder

SAMPLE_DOCS = 1000  # documents the dictionary is trained on, by smallest hash of their id
SAMPLE_BYTES = 4096  # of each one's serialized ids
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 1 << 20
LEVEL = 3

_ENTRY = pa.struct([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dictionary_sha256", pa.string()), ("payload", pa.binary()), ("docs", pa.list_(_ENTRY))])
_BLOCK_DDL = ("shard int, block int, dictionary_sha256 string, payload binary, "
              "docs array<struct<id: bigint, start: bigint, n_tokens: bigint, offset: bigint, length: bigint>>")
_DOC = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def train_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary bytes; with too little to train on, the samples themselves serve as raw content."""
    import zstandard
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _zdict(dictionary: bytes):
    import zstandard
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _sample(docs: DataFrame, path: str) -> list[bytes]:
    ids = docs.where("text IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([enc.encode(t[:SAMPLE_BYTES])[:SAMPLE_BYTES] for t in b.column("text").to_pylist()], pa.binary())], names=["ids"])

    chosen = docs.join(F.broadcast(ids.distinct()), "id").select(F.substring("text", 1, SAMPLE_BYTES).alias("text")).limit(SAMPLE_DOCS)
    return sorted(r[0] for r in chosen.mapInArrow(run, "ids binary").collect() if r[0])


def _pack(path: str, end_id: int, dictionary: bytes) -> Callable:
    digest, end = hashlib.sha256(dictionary).hexdigest(), end_id.to_bytes(4, "little")

    def run(batches):
        import zstandard
        enc, zd = encoder(path), _zdict(dictionary)
        zc = zstandard.ZstdCompressor(level=LEVEL, dict_data=zd)
        shard, block, start, size, frames, entries = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([digest]),
                                               pa.array([b"".join(frames)], pa.binary()), pa.array([entries], pa.list_(_ENTRY))], schema=_BLOCK)

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                frame = zc.compress(ids)
                entries.append({"id": i, "start": start, "n_tokens": len(ids) // 4, "offset": size, "length": len(frame)})
                frames.append(frame)
                start += len(ids) // 4
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield flush()
                    block, size, frames, entries = block + 1, 0, [], []
        if entries:
            yield flush()

    return run


def _unpack(dictionary: bytes) -> Callable:
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        import zstandard
        zd = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        for batch in batches:
            for shard, sha, payload, docs in zip(*(batch.column(c).to_pylist() for c in ("shard", "dictionary_sha256", "payload", "docs"))):
                if sha != digest:
                    raise ValueError(f"block of shard {shard} was written with another dictionary ({sha})")
                for at in range(0, len(docs), 64):
                    part = docs[at:at + 64]
                    ids = [zd.decompress(payload[d["offset"]:d["offset"] + d["length"]]) for d in part]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int32()), pa.array([d["id"] for d in part], pa.int64()),
                                                      pa.array([d["start"] for d in part], pa.int64()), pa.array(ids, pa.binary())], schema=_DOC)

    return run


def write_tokens(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int = 0) -> str:
    """Encode ``docs`` and write the store to ``out``; returns ``out``."""
    spark, path = prepare(docs.sparkSession), tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(_sample(rows, path))
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").write.parquet(f"{out}/dictionary")
    tie = F.xxhash64("text")
    (rows.repartitionByRange(shuffle_partitions(spark), F.col("id"), tie).sortWithinPartitions("id", tie)
     .mapInArrow(_pack(path, end_id, dictionary), _BLOCK_DDL).write.parquet(f"{out}/blocks"))
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{out}/blocks")
    totals = blocks.select("shard", F.expr("aggregate(docs, 0L, (n, d) -> n + d.n_tokens)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    totals.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("shard", "base", "n_tokens").write.parquet(f"{out}/shards")
    (blocks.select("shard", "block", F.explode("docs").alias("d")).join(_shards(spark, out), "shard")
     .select("d.id", (F.col("base") + F.col("d.start")).alias("start"), "d.n_tokens", "shard", "block", "d.offset", "d.length")
     .write.parquet(f"{out}/index"))
    return out


def _shards(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("shard int, base long, n_tokens long").parquet(f"{out}/shards").select("shard", "base")


def _dictionary(spark: SparkSession, out: str) -> bytes:
    sha, data = spark.read.parquet(f"{out}/dictionary").first()
    if hashlib.sha256(data).hexdigest() != sha:
        raise ValueError(f"dictionary of {out} is damaged")
    return bytes(data)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(id, start, ids) of every document of a store, decompressed."""
    prepare(spark, 4)
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{out}/blocks")
    docs = blocks.mapInArrow(_unpack(_dictionary(spark, out)), "shard int, id long, start long, ids binary")
    return docs.join(_shards(spark, out), "shard").select("id", (F.col("base") + F.col("start")).alias("start"), "ids")


def fetch_tokens(spark: SparkSession, out: str, ids: list[int]) -> DataFrame:
    """(id, start, ids) of a few documents: only their frames are decompressed."""
    prepare(spark, 4)
    want = (spark.read.parquet(f"{out}/index").where(F.col("id").isin(ids))
            .select("shard", "block", F.col("start").alias("from"), F.struct("id", "start", "n_tokens", "offset", "length").alias("d")))
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{out}/blocks").drop("docs")
    frames = blocks.join(want, ["shard", "block"]).select(
        "shard", "block", "dictionary_sha256", F.expr("substring(payload, d.offset + 1, d.length)").alias("payload"),
        F.expr("array(named_struct('id', d.id, 'start', d.start, 'n_tokens', d.n_tokens, 'offset', 0L, 'length', d.length))").alias("docs"))
    return frames.mapInArrow(_unpack(_dictionary(spark, out)), "shard int, id long, start long, ids binary").select("id", "start", "ids")
