"""Substring dedup (operator 5): level-wise doubling over word windows.

A word is removed when a window of ``window`` consecutive words that covers it
also starts in a document with a smaller id.  Windows are found level by
level: windows of ``base`` words that repeat across documents are alone
extended to twice that length, and so on up to ``window`` or until none is
left.  At a level shorter than ``window`` each whole window is represented by
its smallest-hash part of that length: equal windows choose equal parts, so no
repeat is lost while about one part in thirteen is shuffled.  The last level
uses the windows themselves under two 64-bit hashes.

Whole copies of a text are collapsed first: only the smallest id of equal
texts takes part, the others are covered entirely.

Cases: null or empty text: no words, empty result text.  Fewer words than
``window``: nothing removed.  Rows with equal id never remove each other's
words.  A null id takes no part and keeps its words.  Other columns are
ignored, whatever their names.  No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (Words, as_int64, drop_scratch, materialize, prepare, text_bytes, text_chunks)


def doubling_lengths(window: int, base: int) -> list[int]:
    """Lengths from ``base`` on, each at most twice the one before, ending at ``window``."""
    sizes = [window]
    while sizes[0] > base:
        sizes.insert(0, -(-sizes[0] // 2))
    return sizes


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """Minimum of ``x[i:i + span]`` (shorter at the end)."""
    y, size = x.copy(), 1
    while size < span:
        step = min(size, span - size)
        y[:-step or None] = np.minimum(y[:-step], y[step:]) if step < len(y) else y
        size += step
    return y


def _lists(col: pa.Array) -> Iterator[np.ndarray]:
    for x in col:
        yield np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) if x.is_valid else np.zeros(0, np.uint64)


def _part_rows(window: int, size: int, before: int | None) -> Callable:
    """mapInArrow function: rows (id, h1, h2) of the distinct parts of ``size`` words
    that represent the windows surviving the level ``before``."""
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for part in text_chunks(batches, "text"):
            words = Words(*text_bytes(part.column("text")))
            if len(words) < window:
                continue
            n = len(words) - window + 1
            live = words.doc[:n] == words.doc[window - 1:]
            if before:
                low = sliding_min(words.windows(before)[0], window - before + 1)[:n]
                for i, seen in enumerate(_lists(part.column("hashes"))):
                    a, b = words.first[i], min(words.first[i + 1], n)
                    live[a:b] &= np.isin(low[a:b], seen)
            low = sliding_min(words.windows(size)[0], window - size + 1)[:n]
            second = words.windows(size, seed=1)[0][:n] if size == window else np.zeros(n, np.uint64)
            at = np.flatnonzero(live)
            if not len(at):
                continue
            order = np.lexsort((second[at], low[at], words.doc[at]))
            at = at[order]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (words.doc[at][1:] != words.doc[at][:-1]) | (low[at][1:] != low[at][:-1]) | (second[at][1:] != second[at][:-1])
            at = at[new]
            ids = part.column("id").to_numpy(zero_copy_only=False)[words.doc[at]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(as_int64(low[at])), pa.array(as_int64(second[at]))], schema=schema)

    return run


def _cut(window: int) -> Callable:
    """mapInArrow function: texts without the words covered by windows listed in h1/h2, or without any if ``copy``."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches):
        for part in text_chunks(batches, "text"):
            data, off = text_bytes(part.column("text"))
            listed = [i for i, x in enumerate(part.column("h1")) if x.is_valid]
            words = Words(data, off) if listed else None
            if listed:
                first, second = words.windows(window)[0], words.windows(window, seed=1)[0]
                h1, h2 = list(_lists(part.column("h1"))), list(_lists(part.column("h2")))
            marked, raw = set(listed), data.tobytes()
            copy = part.column("copy").to_pylist()
            n_words, n_removed, kept = [], [], []
            for i in range(len(part)):
                own = raw[off[i]:off[i + 1]].split()  # bytes.split() parts at exactly the separator bytes
                keep = own
                if copy[i] and len(own) >= window:
                    keep = []
                elif i in marked and len(own) >= window:
                    a, b = words.first[i], words.first[i + 1] - window + 1
                    at = np.flatnonzero(np.isin(first[a:b], h1[i]))
                    pairs = set(zip(h1[i].tolist(), h2[i].tolist()))
                    at = [k for k in at.tolist() if (int(first[a + k]), int(second[a + k])) in pairs]
                    step = np.zeros(len(own) + 1, dtype=np.int64)
                    step[at] += 1
                    np.add.at(step, np.asarray(at, dtype=np.int64) + window, -1)
                    keep = [w for w, c in zip(own, np.cumsum(step)[:-1].tolist()) if not c]
                n_words.append(len(own))
                n_removed.append(len(own) - len(keep))
                kept.append(b" ".join(keep).decode())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = 50, base: int = 25) -> DataFrame:
    """(id, n_words, n_removed, kept_text) per row of ``docs``."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.where("id IS NOT NULL AND text IS NOT NULL")

    # Whole copies: texts that a smaller id has too.  A digest table per id, joined back to its first holder.
    digests = known.select("id", F.md5("text").alias("digest"))
    firsts, firsts_path = materialize(digests.groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "sub-copies")
    copies, _ = materialize(digests.join(firsts, "digest").where("id > lo").groupBy("id").agg(F.collect_set("digest").alias("digests")), "sub-copies")
    drop_scratch(spark, firsts_path)

    held, before, scratch = None, None, []
    for size in doubling_lengths(window, base):
        src = known
        if held is not None:
            src = (known.join(held, "id").join(copies, "id", "left")
                   .where("digests IS NULL OR NOT array_contains(digests, md5(text))").select("id", "text", "hashes"))
        parts, path = materialize(src.mapInArrow(_part_rows(window, size, before), "id long, h1 long, h2 long"), f"sub-{size}")
        drop_scratch(spark, *scratch)
        repeated, rep_path = materialize(parts.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                                         .where("lo < hi").select("h1", "h2", "lo"), f"sub-rep-{size}")
        again = parts.join(repeated, ["h1", "h2"])
        if size < window:
            held, held_path = materialize(again.groupBy("id").agg(F.collect_list("h1").alias("hashes")), "sub-held")
            drop_scratch(spark, path, rep_path)
            scratch, before = [held_path], size
            if held.isEmpty():
                break
    if size < window:
        covered = held.select("id", F.array().cast("array<bigint>").alias("h1"), F.array().cast("array<bigint>").alias("h2"))
    else:
        covered = (again.where("id > lo").groupBy("id")
                   .agg(F.collect_list(F.struct("h1", "h2")).alias("w")).select("id", "w.h1", "w.h2"))
    out = (rows.join(covered, "id", "left").join(copies, "id", "left")
           .select("id", "text", "h1", "h2", F.coalesce(F.array_contains("digests", F.md5("text")), F.lit(False)).alias("copy")))
    return out.mapInArrow(_cut(window), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)
