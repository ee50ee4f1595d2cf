"""Byte-level BPE encoding and decoding (operator 13) with the tiktoken library and a local rank file.

A long text is pre-split by a regex where no piece of the tokenizer's pattern
can cross: before white space that follows something else, since a piece has
white space only at its front.  Each part then goes through the library on its
own, so what the library holds at a time is bounded, and the ids are those of
the whole text.  The library's regex engine fails on very long white space (its
look-ahead keeps a stack entry per character), so long runs are cut out: all but
the last character of a run before other text, or the whole run at the text's
end, is one piece by the pattern and is encoded as such.

Ids travel as little-endian unsigned 32-bit integers; decoding gives raw bytes,
which need not be valid UTF-8 for ids that end inside a character.

Cases: a null or empty text has no ids, and decodes to no bytes; null ids decode
like none; an id outside the rank file raises ``ValueError``.  Rows with equal or
null row ids are each handled on their own; other columns are ignored; no rows:
no rows.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_chunks

PART_CHARS = 1 << 16  # longer texts are split
LONG_SPACE = 256  # longer runs of white space are encoded as the pieces they are

# The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_LONG_RUN = re.compile(f"[{WHITE}]{{{LONG_SPACE},}}")


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def parts(text: str, most: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe boundaries into parts of ``most`` characters, or more where there is no boundary."""
    out, at = [], 0
    while len(text) - at > most:
        cut = next((m.start() for m in _CUT.finditer(text, at + most)), len(text))
        out.append(text[at:cut])
        at = cut
    if at < len(text):
        out.append(text[at:])
    return out


class Codec:
    """``encode(text)`` gives the ids, ``decode(ids)`` the bytes."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f))}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _part(self, text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG_RUN.finditer(text):
            to = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[at:m.start()])
            out += self.encoding._encode_single_piece(text[m.start():to])
            at = to
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= PART_CHARS:
            return self._part(text)
        return [i for part in parts(text) for i in self._part(part)]

    def decode(self, ids: list[int]) -> bytes:
        try:
            return self.encoding.decode_bytes(ids)
        except KeyError as e:
            raise ValueError(f"an id is not in the rank file: {e}") from None


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a rank file; it outlives the task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id, ids) per row: the ids of its text as little-endian unsigned 32-bit integers."""
    prepare(docs.sparkSession)
    path = ranks or default_ranks()

    def run(batches):
        own = codec(path)
        for b in text_chunks(batches, "text"):
            ids = [np.array(own.encode(t), dtype="<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks: str | None = None) -> DataFrame:
    """``tokens`` with ``out_col``, the raw bytes that the ids stand for."""
    prepare(tokens.sparkSession)
    path = ranks or default_ranks()

    def run(batches):
        own = codec(path)
        for b in text_chunks(batches, ids_col):
            decoded = [own.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], names=[*b.schema.names, out_col])

    schema = tokens.drop(out_col).schema.add(out_col, "binary")
    return tokens.drop(out_col).mapInArrow(run, schema)


def ids_text(tokens: DataFrame, ids_col: str = "ids", out_col: str = "ids_text") -> DataFrame:
    """``tokens`` with ``out_col``, the ids in decimal joined by one space (for digests and exchange)."""
    prepare(tokens.sparkSession)

    def run(batches):
        for b in text_chunks(batches, ids_col):
            own = [" ".join(map(str, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.string())], names=[*b.schema.names, out_col])

    schema = tokens.drop(out_col).schema.add(out_col, "string")
    return tokens.drop(out_col).mapInArrow(run, schema)
