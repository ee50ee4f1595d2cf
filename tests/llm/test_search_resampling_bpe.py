"""Operators 11 to 13 against brute force: on sf0.001, on edge cases and on random inputs."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemove.llm import byte_bpe, lexical_rank, target_resampling
from tablemove.llm.queries import QUERIES
from tablemove.session import scratch_path

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HOT = "the common line of every page " * 30
EDGE_DOCS = [(1, "Alpha beta GAMMA delta"), (2, None), (3, ""), (4, " .,; "), (5, "alpha " * 5000), (6, "Éé z\x85a alpha_beta"), (6, "Éé z\x85a alpha_beta"),
             (None, "alpha beta"), (None, None), (7, "alpha beta"), (8, "alpha beta"), (9, "x" * 3000 + " 1.2 \U0001F600"), (10, "\x1c   　" + " " * 700 + "a" + "\n" * 900)]
EDGE_DOCS += [(100 + i, HOT + str(i % 7)) for i in range(60)]
EDGE_ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, ""), (4, "nowhere"), (None, "Alpha alpha Éé"), (5, "the common line 3"), (6, "x" * 3000)]


@pytest.fixture(scope="module")
def edge_dir(spark):
    out = scratch_path(spark, "edge3")
    clash = {c: F.lit("x") for c in ("id", "n", "terms", "tfs", "score", "rank", "weight", "ids", "decoded", "item", "doc", "part", "place")}
    spark.createDataFrame(EDGE_DOCS, "doc_id long, text string").withColumns(clash).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(EDGE_ITEMS, "item_id long, text string").withColumns(clash).write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(params=["sf", "edge"])
def sf_dir(request, edge_dir):
    return SF if request.param == "sf" else edge_dir


def rows_of(spark, path, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{path}/{table}.parquet").select(*cols).collect()]


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked(docs, items, k=10):
    """Plain loops over all documents; rows of one item together."""
    held = [(i, collections.Counter(TERM.findall(fold(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_all, l_all = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(TERM.findall(fold(t)))
    out = []
    for item, terms in asked.items():
        best = []
        for i, c, n in held:
            m = 25 + 75 * n * n_all // l_all
            score = sum(q * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if c[t])
            if score > 0:
                best.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(best)[:k])]
    return collections.Counter(out)


def test_lexical_rank(spark, sf_dir):
    want = ranked(rows_of(spark, sf_dir, "documents", "doc_id", "text"), rows_of(spark, sf_dir, "benchmark", "item_id", "text"))
    out = QUERIES["op11_lexical_rank"](spark, sf_dir)
    assert dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert collections.Counter(map(tuple, out.collect())) == want


def test_lexical_rank_blocks_and_slices(spark, monkeypatch):
    """Many blocks of queries and many small slices of documents give the same rows."""
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) if x < 400)
    docs, items = [(i, text(rng.integers(1, 80))) for i in range(700)], [(i, text(12)) for i in range(25)]
    monkeypatch.setattr(lexical_rank, "BLOCK_TERMS", 40)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert collections.Counter(map(tuple, lexical_rank.rank_documents(d, q, k=7).collect())) == ranked(docs, items, 7)


def test_best_positions_random():
    """The search against full scores; with few documents above a floor it stops early."""
    rng = np.random.default_rng(5)
    for case in range(300):
        docs, terms = int(rng.integers(1, 400)), int(rng.integers(1, 9))
        held = rng.random((docs, terms)) < rng.choice([0.02, 0.3, 0.9])
        d, t = np.nonzero(held)
        impact = rng.integers(1, rng.choice([3, 1000]), len(d))
        lists = lexical_rank.ImpactLists(docs, terms, d, t, impact)
        weights, k = rng.integers(0, 5, terms), int(rng.integers(1, 12))
        full = np.zeros(docs, dtype=np.int64)
        np.add.at(full, d, weights[t] * impact)
        floor = int(rng.choice([1, 1, full.max(initial=1)]))
        found, score = lexical_rank.best_positions(lists, np.arange(terms), weights, k, max(1, floor))
        got = sorted(((-int(s), int(i)) for i, s in zip(found, score) if s >= max(1, floor)))[:k]
        assert got == sorted((-int(s), i) for i, s in enumerate(full) if s >= max(1, floor))[:k]


def test_best_positions_stop_early():
    """Direct accesses fill up the lists: the search ends long before the lists do."""
    docs = 10_000
    impact = np.concatenate([np.arange(docs)[::-1]] * 3) + 1
    lists = lexical_rank.ImpactLists(docs, 3, np.tile(np.arange(docs), 3), np.repeat(np.arange(3), docs), impact)
    found, score = lexical_rank.best_positions(lists, np.arange(3), np.ones(3, dtype=np.int64), 5, 1)
    assert found.tolist() == [0, 1, 2, 3, 4] and score.tolist() == [3 * (docs - i) for i in range(5)]
    assert len(lists.places[0][0]) == docs


def test_impacts_of_any_size():
    tf, n = np.array([1, 3]), np.array([5, 10**9])
    want = [10**9 * t // (1000 * t + 8 * (25 + 75 * m * 10**12 // 10**14)) for t, m in ((1, 5), (3, 10**9))]
    assert lexical_rank.impacts(tf, n, 10**12, 10**14).tolist() == want


def drawn(docs, target, most=1, buckets=10_000, least=20, percent=10):
    def features(text):
        w = [x.encode() for x in TERM.findall(fold(text))]
        return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    held = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(b for _, _, f in held for b in f), collections.Counter(b for _, x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, n, f in held:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    take = len(order) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(order[:take])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in rows)


def test_target_resampling(spark, sf_dir):
    want = drawn(rows_of(spark, sf_dir, "documents", "doc_id", "text"), rows_of(spark, sf_dir, "benchmark", "item_id", "text"))
    out = QUERIES["op12_target_resampling"](spark, sf_dir)
    assert set(t for _, t in out.dtypes) == {"bigint"} and out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, out.collect())) == want


@pytest.mark.parametrize("words", [0, 1, 5])
def test_resampling_word_runs_and_small_dictionaries(spark, edge_dir, monkeypatch, words):
    """Runs of up to three words, with dictionaries that miss most words or all."""
    docs, items = spark.read.parquet(f"{edge_dir}/documents.parquet"), spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    monkeypatch.setattr(target_resampling.frequent_words, "__defaults__", (words,))
    got = target_resampling.resample(docs, items, most_words=3, buckets=97, least_words=2, percent=50)
    assert collections.Counter(map(tuple, got.collect())) == drawn(rows_of(spark, edge_dir, "documents", "doc_id", "text"), EDGE_ITEMS, 3, 97, 2, 50)


def test_compose():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 64, 300, 5000):
        a, b = rng.randbytes(rng.randint(0, 20)), rng.randbytes(n)
        got = target_resampling.compose(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)


def library():
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, sf_dir):
    lib, sha, want = library(), lambda b: hashlib.sha256(b).hexdigest(), collections.Counter()
    for i, text in rows_of(spark, sf_dir, "documents", "doc_id", "text"):
        ids = lib.encode_ordinary(text or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())] += 1
    assert collections.Counter(map(tuple, QUERIES["op13_byte_bpe"](spark, sf_dir).collect())) == want


def test_byte_bpe_random(monkeypatch):
    """Cuts everywhere they are allowed, and every run of white space taken for a long one."""
    lib, own, rng = library(), byte_bpe.codec(byte_bpe.default_ranks()), random.Random(1)
    monkeypatch.setattr(byte_bpe, "PART_CHARS", 5)
    monkeypatch.setattr(byte_bpe.parts, "__defaults__", (5,))
    monkeypatch.setattr(byte_bpe, "_LONG_RUN", re.compile(f"[{byte_bpe.WHITE}]{{2,}}"))
    letters = [*"ab1'sé .\n\t\x85\xa0\x1c　  \U0001F600<|>", "  ", "    ", "'ll", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert own.encode(text) == lib.encode_ordinary(text)


def test_byte_bpe_long_texts():
    """The library itself fails on the first two."""
    own = byte_bpe.codec(byte_bpe.default_ranks())
    for text in (" " * 1_000_000 + "x", "\n \t" * 200_000, "a" * 500_000, "word " * 100_000 + "é" * 70_000):
        assert own.decode(own.encode(text)) == text.encode()
    assert own.encode("ab cd " * 50_000) == library().encode_ordinary("ab cd " * 50_000)


def test_decode_raw_bytes(spark):
    """Ids that end inside a character give its bytes; unknown ids are refused."""
    ids = library().encode_ordinary("\U0001F600")
    rows = [(1, bytearray(np.array(ids[:1], "<u4").tobytes())), (2, None), (3, bytearray())]
    out = byte_bpe.decode_ids(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()
    assert [bytes(r.decoded) for r in out] == ["\U0001F600".encode()[:len(library().decode_bytes(ids[:1]))], b"", b""]
    with pytest.raises(ValueError):
        byte_bpe.codec(byte_bpe.default_ranks()).decode([60_000])
