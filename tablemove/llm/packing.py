"""Best-fit packing (operator 3): best-fit decreasing over the whole corpus.

Which bin a document fits depends on its length alone, so the decision is
made once per length over the corpus' histogram (at most ``capacity`` rows): a
segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and all documents of a length that would fill equal bins
alike are placed in one run.  The result is exactly best-fit decreasing of all
pieces.  Pieces then find their bin from their rank within their length; ranks
come from counts per written part, so nothing is ordered in one task.

Cases: a null or empty text is the end id alone.  Rows with equal ids are each
packed.  A null id is kept.  Other columns are ignored.  No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare
from .tokens import default_tokenizer, encoder


class CapacityTree:
    """How many open bins have each remaining capacity; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.size, dtype=np.int64)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.count[i] += bins
            i //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity >= ``need`` of an open bin."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1 and (i % 2 or not self.count[i + 1]):  # up until a right sibling has a bin
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first bin, pieces per bin, offset in the bin) ordered by
    (length, first rank), and the number of bins."""
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            per = min(room // length, left)
            used = min(n, left // per)
            runs.append((length, rank, first, per, capacity - room))
            rank, left = rank + used * per, left - used * per
            for at, many, rest in ((first, used, room - per * length), (first + used, n - used, room)):
                if many and rest:
                    open_bins.setdefault(rest, []).append((at, many))
                    tree.add(rest, many)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), bins


_PIECE = pa.schema([("part", pa.int32()), ("rank", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids", pa.binary())])


def _pieces(path: str, capacity: int, end_id: int) -> Callable:
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(text) + end
                total = len(ids) // 4
                at, to, piece = 0, (total - 1) % capacity + 1, 0
                while at < total:
                    own = ids[4 * at:4 * to]
                    rows.append((part, seen[to - at], i, piece, at, to - at, own))
                    seen[to - at] += 1
                    at, to, piece = to, to + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    return run


def _place(runs: np.ndarray) -> Callable:
    """mapInArrow function: adds sequence_id and offset from length and rank."""
    key = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            r = runs[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            k = rank - r[:, 1]
            out = {"sequence_id": r[:, 2] + k // r[:, 3], "offset": r[:, 4] + k % r[:, 3] * length}
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(x) for x in out.values()], names=[*names, *out])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                   tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(id, piece, start, length, ids, sequence_id, offset) per piece of a document.

    ``ids`` are the piece's little-endian 32-bit ids.  A
    document over ``capacity`` is cut into pieces of that length, the first
    being what remains.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ddl = "part int, rank long, id long, piece int, start long, length long, ids binary"
    pieces, _ = materialize(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, end_id), ddl), "pieces")
    counts, _ = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    runs, _ = best_fit_decreasing(total, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
              .select("id", "piece", "start", "length", "ids", "rank"))
    schema = "id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return ranked.mapInArrow(_place(runs), schema).withColumnRenamed("id", id_col)
