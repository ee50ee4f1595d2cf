"""Ranked lexical search (operator 11): the Best Position Algorithm over impact lists.

One pass over the documents keeps, of every whole text, its number of terms and
the counts of those terms that the queries of a block hold.  Document counts and
lengths over all documents give each posting its integer impact.  A slice of
the documents then has one list per term, ordered by falling impact.  For a
query all its lists are read in step: a document met under sorted access is
looked up in every other list (direct access), which gives its whole score and
marks its positions there.  A list's best position is the end of its contiguous
run of seen positions from the top, which direct accesses push far beyond the
last position read.  No document still unseen can have more in a list than the
posting after the best position; once the sum of these falls strictly below the
k-th best score so far, the search ends, and ties at the k-th score are complete.
The best of each task are merged, over many tasks first and then per query.

Terms are maximal runs of ASCII letters and digits and all characters beyond
ASCII, only A-Z lower-cased.  Queries go in blocks of about ``BLOCK_TERMS`` terms;
a block's terms are what tasks hold of the query set.

Cases: a null or empty text, or one without terms, is no document and no query.
Rows of documents with equal ids are documents of their own; a null id counts as
any other and comes last among equal scores.  Rows of queries with equal ids
(null too) are one query with the terms of all.  Other columns are ignored.
No rows: no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, text_chunks

BLOCK_TERMS = 200_000  # query terms handled in one pass over the documents, about
SLICE_DOCS, SLICE_POSTINGS = 16_384, 2_000_000  # documents of one set of impact lists
FIRST_STEP = 16  # positions read of each list before the first test; doubled from test to test
MERGE_PARTS = 64
NO_ID = np.iinfo(np.int64).max

_TERM_BYTE = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if ok else 32 for b, ok in enumerate(_TERM_BYTE))


def terms_of(data: bytes | None) -> list[bytes]:
    """Terms of a text's UTF-8 bytes, in order."""
    return data.translate(FOLD).split() if data else []


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Integer impact of each posting: tf its count, n its document's terms, docs and terms those of all documents."""
    part = 75 * n
    if len(part) and int(part.max()) * docs >= 2**63:  # exact in Python's integers
        part = (part.astype(object) * docs // terms).astype(np.int64)
    else:
        part = part * docs // terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + part))


class ImpactLists:
    """Postings (doc, term, impact) of ``docs`` documents as one list per term, by falling impact."""

    def __init__(self, docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, -impact, term))
        self.docs, self.doc, self.impact = docs, doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.places: dict[int, tuple] = {}

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[t], self.first[t + 1])
        return self.doc[at], self.impact[at]

    def find(self, t: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: (which of the sorted documents ``some`` the list of ``t`` holds, at which position)."""
        if t not in self.places:
            own = self.postings(t)[0]
            if 8 * len(own) >= self.docs:
                place = np.full(self.docs, -1, dtype=np.int32)
                place[own] = np.arange(len(own))
                self.places[t] = (place, None)
            else:
                by_doc = np.argsort(own, kind="stable")
                self.places[t] = (own[by_doc], by_doc)
        place, position = self.places[t]
        if position is None:
            at = place[some]
            which = np.flatnonzero(at >= 0)
            return which, at[which]
        few, many = (place, some) if len(place) < len(some) else (some, place)
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        hit = np.flatnonzero(many[at] == few)
        return (at[hit], position[hit]) if few is place else (hit, position[at[hit]])


def best_positions(lists: ImpactLists, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all documents that are among the ``k`` best, ties included, or may be skipped below ``floor``."""
    own = [(int(t), int(w), *lists.postings(t)) for t, w in zip(terms, weights) if w and lists.first[t] < lists.first[t + 1]]
    score, known = np.zeros(lists.docs, dtype=np.int64), np.zeros(lists.docs, dtype=bool)
    seen = [np.zeros(len(d), dtype=bool) for _, _, d, _ in own]
    best = [0] * len(own)  # first position of each list not seen yet
    top, step = np.zeros(0, dtype=np.int64), FIRST_STEP
    while own:
        met = np.zeros(lists.docs, dtype=bool)
        for (_, _, docs, _), at in zip(own, best):  # sorted access, from the best position on
            met[docs[at:at + step]] = True
        new = np.flatnonzero(met & ~known)
        known[new] = True
        bound = 0
        for i, (t, w, docs, impact) in enumerate(own):
            which, at = lists.find(t, new)
            score[new[which]] += w * impact[at]
            seen[i][at] = True
            rest = seen[i][best[i]:]
            gap = int(rest.argmin()) if len(rest) else 0
            best[i] += gap if len(rest) and not rest[gap] else len(rest)
            if best[i] < len(impact):
                bound += w * int(impact[best[i]])
        top = np.append(top, score[new])
        if len(top) > k:
            top = np.partition(top, -k)[-k:]
        if bound < max(floor, int(top.min()) if len(top) == k else 1):
            break
        step *= 2
    found = np.flatnonzero(known)
    if len(top) == k:
        found = found[score[found] >= max(floor, top.min())]
    return found, score[found]


def _count_terms(batches) -> Iterator[pa.RecordBatch]:
    for b in text_chunks(batches, "text"):
        ids, terms, counts = [], [], []
        for i, text in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            own = Counter(terms_of(text))
            ids += [i] * len(own)
            terms += own
            counts += own.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())], names=["item", "term", "c"])


def _profiles(vocabulary: dict[bytes, int]) -> Callable:
    """Per document with terms: id, n, and the (term, tf) of the vocabulary's terms it holds."""
    def run(batches):
        for b in text_chunks(batches, "text"):
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                held = [(vocabulary[t], c) for t, c in Counter(words).items() if t in vocabulary]
                ids.append(i)
                sizes.append(len(words))
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                                             names=["id", "n", "terms", "tfs"])

    return run


def _slices(batches) -> Iterator[pa.Table]:
    """The stream cut into tables of at most SLICE_DOCS documents and about SLICE_POSTINGS postings."""
    have, docs, postings = [], 0, 0
    for b in batches:
        for at in range(0, len(b), 1024):
            part = b.slice(at, 1024)
            own = len(part.column("terms").flatten())
            if have and (docs + len(part) > SLICE_DOCS or postings + own > SLICE_POSTINGS):
                yield pa.Table.from_batches(have).combine_chunks()
                have, docs, postings = [], 0, 0
            have.append(part)
            docs, postings = docs + len(part), postings + own
    if have:
        yield pa.Table.from_batches(have).combine_chunks()


def _search(items: list[tuple[int | None, np.ndarray, np.ndarray]], n_terms: int, docs: int, terms: int, k: int) -> Callable:
    """A task's ``k`` best documents for every item (id, term ids, weights)."""
    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for t in _slices(batches):
            column = t.column("id").combine_chunks()
            ids = column.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lists_of = [t.column(c).combine_chunks() for c in ("terms", "tfs")]
            doc = np.repeat(np.arange(len(t)), lists_of[0].value_lengths().to_numpy(zero_copy_only=False))
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists_of)
            lists = ImpactLists(len(t), n_terms, doc, term, impacts(tf, t.column("n").to_numpy()[doc], docs, terms))
            for i, (_, own, weights) in enumerate(items):
                have_ids, have = best[i]
                found, score = best_positions(lists, own, weights, k, int(have[-1]) if len(have) == k else 1)
                some = score > 0
                all_ids, scores = np.append(have_ids, ids[found[some]]), np.append(have, score[some])
                order = np.lexsort((all_ids, -scores))[:k]
                best[i] = all_ids[order], scores[order]
        n = [len(x) for x, _ in best]
        ids = np.concatenate([x for x, _ in best] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in items], pa.int64()).take(pa.array(np.repeat(np.arange(len(items)), n))), pa.array(ids, mask=ids == NO_ID),
                                          pa.array(np.concatenate([s for _, s in best] or [np.zeros(0, np.int64)]))], names=["item", "doc", "score"])

    return run


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _block(spark: SparkSession, rows: DataFrame, counts: list, k: int) -> DataFrame:
    """(item, doc, score) candidates of one block of queries, ``counts`` its rows (item, term, c)."""
    vocabulary: dict[bytes, int] = {}
    by_item: dict[int, list[tuple[int, int]]] = {}
    for item, term, c in counts:
        by_item.setdefault(item, []).append((vocabulary.setdefault(bytes(term), len(vocabulary)), c))
    prepare(spark)
    profiles, _ = materialize(rows.mapInArrow(_profiles(vocabulary), "id long, n long, terms array<int>, tfs array<int>"), "rank-profiles")
    docs, terms = profiles.agg(F.count("*"), F.sum("n")).first()
    if not docs:
        return spark.createDataFrame([], "item long, doc long, score long")
    df = {r["t"]: r["df"] for r in profiles.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row per query term
    items = [(item, np.array([t for t, _ in own]), np.array([c * term_weight(docs, df.get(t, 0)) for t, c in own])) for item, own in by_item.items()]
    prepare(spark, 4096)
    return profiles.mapInArrow(_search(items, len(vocabulary), docs, terms, k), "item long, doc long, score long")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query id, rank, doc id, score): the ``k`` best documents of every query with a score above 0."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_id_col).cast("long").alias("id"), F.col(query_text_col).alias("text")).mapInArrow(_count_terms, "item long, term binary, c long")
    asked, _ = materialize(asked.groupBy("item", "term").agg(F.sum("c").alias("c")), "rank-queries")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    out = spark.createDataFrame([], "item long, doc long, score long")
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").collect()  # about BLOCK_TERMS rows
        if own:
            found, _ = materialize(_block(spark, rows, own, k), "rank-found")
            out = out.union(found)
    order = [F.desc("score"), F.col("doc").asc_nulls_last()]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(MERGE_PARTS))).orderBy(*order)
    first = out.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(query_id_col), "rank", F.col("doc").alias(id_col), "score")
