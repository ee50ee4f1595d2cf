"""Exact top-k search (operator 8): MaxScore over blocks of postings.

Terms are components, weights the integers floor(scale * x), a score the
integer inner product.  A unit of work is a block of queries against a shard of
documents; blocks are about as large as shards, so that few copies of a row
travel, and smaller only where there would be too few units to share out.
Inside a unit the shard's postings are read in slices; for each query
the terms are ordered by the most they can add, and the weakest terms that
together cannot reach the current k-th score are non-essential: only the
essential postings are traversed, then the others are probed for documents that
can still compete.  The k best of each shard are merged.

Cases: vectors that are null, empty, or hold null or non-finite components, and
rows with a null id take no part.  Shorter vectors count as padded with zeros.
Rows with components too large for exact sums in doubles are scored in Python's
integers; a score beyond 64 bits is returned as the nearest 64-bit integer.
Rows with equal ids count once, with the smallest vector in byte order.  Equal
scores: smaller id first.  Other columns are ignored.  No rows: no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, shuffle_partitions
from .vectors import matrix, packed

SHARD_ROWS, BLOCK_QUERIES, SLICE_ROWS, PROBE = 32_768, 32_768, 8_192, 8
LEAST, MOST = -2**63, 2**63 - 1


class Postings:
    """Postings of a slice of documents: per term the documents with a nonzero weight, and bounds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids = ids
        self.lists = []  # (documents, weights); all documents as a slice where most have the term
        for column in weights.T:
            at = np.flatnonzero(column)
            self.lists.append((at, column[at]) if 2 * len(at) < len(column) else (slice(None), np.ascontiguousarray(column)))
        self.high = np.maximum(weights.max(axis=0), 0)
        self.low = np.minimum(weights.min(axis=0), 0)

    def search(self, query: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents' indexes, scores) of all documents that reach ``floor``."""
        terms = np.flatnonzero(query)
        most = np.maximum(query[terms] * self.high[terms], query[terms] * self.low[terms])
        order = np.argsort(-most, kind="stable")
        terms, most = terms[order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what the terms from here on can add
        essential = int(np.argmax(rest < floor)) if (rest < floor).any() else len(terms)
        score, touched = np.zeros(len(self.ids)), np.zeros(len(self.ids), dtype=bool)
        for t in terms[:essential]:
            at, w = self.lists[t]
            score[at] += query[t] * w
            touched[at] = True
        live = np.flatnonzero(touched & (score + rest[essential] >= floor)) if floor > -math.inf else np.arange(len(self.ids))
        score = score[live]
        for a in range(essential, len(terms), PROBE):
            b = min(a + PROBE, len(terms))
            for t in terms[a:b]:
                at, w = self.lists[t]
                if isinstance(at, slice):
                    score += query[t] * w[live]
                else:
                    k = np.minimum(np.searchsorted(at, live), len(at) - 1) if len(at) else None
                    if k is not None:
                        score += np.where(at[k] == live, query[t] * w[k], 0)
            keep = score + rest[b] >= floor
            live, score = live[keep], score[keep]
        return live, score


def exact_best(docs: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, id) by Python's integers, of documents but ``own``."""
    nonzero = np.flatnonzero(query)
    terms = [int(x) for x in query[nonzero]]
    scores = ((sum(q * int(w) for q, w in zip(terms, row)), i) for row, i in zip(docs[:, nonzero].tolist(), ids.tolist()) if i != own)
    return heapq.nsmallest(k, ((s, i) for s, i in scores), key=lambda x: (-x[0], x[1]))


def _unit(k: int, scale: float) -> Callable:
    out_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        ids, weights = table.column("id").to_numpy(), np.floor(scale * matrix(table.column("vec")))
        queries, q_ids = weights[is_query], ids[is_query]
        order = np.argsort(ids[~is_query], kind="stable")
        docs, d_ids = weights[~is_query][order], ids[~is_query][order]
        # Products of two rows below this bound sum exactly in doubles.
        bound = math.sqrt(2.0**53 / max(1, weights.shape[1]))
        large_doc, large_query = (np.abs(x).max(axis=1, initial=0) >= bound for x in (docs, queries))
        large, large_ids = docs[large_doc], d_ids[large_doc]
        all_docs, all_ids_ = docs, d_ids
        docs, d_ids = docs[~large_doc], d_ids[~large_doc]
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        for a in range(0, len(docs), SLICE_ROWS):
            postings = Postings(d_ids[a:a + SLICE_ROWS], docs[a:a + SLICE_ROWS])
            for i in np.flatnonzero(~large_query).tolist():
                have_ids, have = best[i]
                live, score = postings.search(queries[i], have[-1] if len(have) >= k else -math.inf)
                own = postings.ids[live] != q_ids[i]
                all_ids, scores = np.append(have_ids, postings.ids[live][own]), np.append(have, score[own])
                if len(scores) > 4 * k:  # all that reach the k-th best, ties included
                    keep = scores >= np.partition(scores, -k)[-k]
                    all_ids, scores = all_ids[keep], scores[keep]
                top = np.lexsort((all_ids, -scores))[:k]
                best[i] = all_ids[top], scores[top]
        rows = [[(int(s), int(d)) for d, s in zip(*x)] for x in best]
        for i in range(len(queries)) if len(large) else np.flatnonzero(large_query).tolist():
            some, some_ids = (all_docs, all_ids_) if large_query[i] else (large, large_ids)
            rows[i] = heapq.nsmallest(k, rows[i] + exact_best(some, some_ids, queries[i], int(q_ids[i]), k), key=lambda x: (-x[0], x[1]))
        flat = [(int(q), d, min(MOST, max(LEAST, s))) for q, own in zip(q_ids, rows) for s, d in own]
        return pa.Table.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)], schema=out_schema)

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best others for every row whose id is divisible by ``every``."""
    prepare(vectors.sparkSession, 4096)
    rows = packed(vectors, id_col, vec_col).where("id IS NOT NULL AND vec IS NOT NULL")
    rows, _ = materialize(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    is_query = F.pmod("id", F.lit(every)) == 0
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards = max(1, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n_queries // BLOCK_QUERIES), min(n_queries // 64, shuffle_partitions(vectors.sparkSession) // shards))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    docs = rows.select(F.lit(False).alias("is_query"), "id", "vec", part(shards).alias("shard"), to_all(blocks).alias("block"))
    queries = rows.where(is_query).select(F.lit(True).alias("is_query"), "id", "vec", to_all(shards).alias("shard"), part(blocks).alias("block"))
    found = (docs.union(queries.select(docs.columns)).groupBy("shard", "block")
             .applyInArrow(_unit(k, scale), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
