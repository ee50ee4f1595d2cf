"""Vectors as rows (id, vec): validated, padded to one length, packed as little-endian doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, zero): ``vec`` is the vector's bytes, null where the vector is null, empty or holds a
    null or non-finite component; ``zero`` says that all components are 0.  Lengths may differ."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, zero = [], []
            for v in b.column("v"):
                x, empty = None, False
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                    empty = not x.any()
                    x = x.tobytes() if np.isfinite(x).all() else None
                out.append(x)
                zero.append(empty)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary()), pa.array(zero)], names=["id", "vec", "zero"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, vec binary, zero boolean")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of packed vectors, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    own = column.to_pylist()
    width = (pc.max(pc.binary_length(column)).as_py() or 0) // 8 if len(own) else 0
    if all(len(x) == 8 * width for x in own):
        return np.frombuffer(b"".join(own), dtype="<f8").reshape(len(own), width)
    out = np.zeros((len(own), width))
    for i, x in enumerate(own):
        out[i, :len(x) // 8] = np.frombuffer(x, dtype="<f8")
    return out
