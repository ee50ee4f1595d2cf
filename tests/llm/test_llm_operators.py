"""The training-data operators against brute force, on sf0.001 and on a table of edge cases."""

from __future__ import annotations

import collections
import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemove.llm.queries import QUERIES
from tablemove.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * i % 7919}" for i in range(6000))

EDGE_DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "a"), (2, None, "a"), (3, "", None), (4, " \t\n ", "b"), (5, LONG, "b"),
    (6, LONG + " tail", "b"), (6, LONG + " tail", "b"), (7, "x", "c"), (8, "x", None), (9, "<|endoftext|> a\t\n b  c é\U0001F600 mail a.b@c.de", "c"),
    (None, LONG, "d"), (None, None, None), (10, "alpha  beta gamma delta epsilon zeta eta theta", "a"), (11, "1.2.3.4 +1 (212) 555-0101 4111 1111 1111 1111", "ü"),
]


@pytest.fixture(scope="module")
def edge_dir(spark):
    """A table folder with nulls, empty and long texts, repeated rows and columns whose names clash with helpers'."""
    out = scratch_path(spark, "edge")
    docs = spark.createDataFrame(EDGE_DOCS, "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("id", "n", "hashes", "mix_size", "quality_score", "lang")}).withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 0), (9, 0, 0), (9, None, 0), (None, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    v, inf, nan = [1.0, 0.5, 0.0], float("inf"), float("nan")
    vecs = [(1, v), (2, v), (3, [2.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [nan, 0.0, 0.0]), (9, [inf, 1.0, 0.0]),
            (10, [0.0, 0.0, 1.0]), (20, [1.0, 0.49, 0.01]), (None, v), (40, [1.0, 0.5]), (60, [-1.0, 0.0, 0.3])]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).write.parquet(f"{out}/embeddings.parquet")
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>one<p>two &amp; three<div class=comments>no</div><nav>menu</nav>"), (None, "u", "plain  text"), (4, "u", "<script>x"),
             (5, "u", "<body><header>top</header><main><h1>T</h1><p>a <a href=x>b</a> c<br>d</p><aside>s</aside><form>f</form><p>e&nbsp;f</p></main><footer>z</footer>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)).write.parquet(f"{out}/pages.parquet")
    spark.createDataFrame([(1, "alpha beta"), (None, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def empty_dir(spark, edge_dir):
    out = scratch_path(spark, "empty")
    for t in ("documents", "labels", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(params=["sf", "edge"])
def sf_dir(request, edge_dir):
    return SF if request.param == "sf" else edge_dir


def rows_of(spark, path, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{path}/{table}.parquet").select(*cols).collect()]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("name", [q for q in QUERIES])
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


def test_quality_edge(spark, edge_dir):
    out = QUERIES["op1_quality"](spark, edge_dir).collect()
    assert len(out) == len(EDGE_DOCS)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_held_out(spark):
    path = "/root/testdata/sf0.01"
    label = dict(rows_of(spark, path, "labels", "doc_id", "quality"))
    out = [r for r in QUERIES["op1_quality"](spark, path).collect() if r.held_out and r.doc_id in label]
    score, y = np.array([r.score for r in out]), np.array([label[r.doc_id] for r in out])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]])
    assert auc > 0.95 and np.mean((score >= 0.3) == y) > 0.9


def encode(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = encode.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return t.encode(text or "", add_special_tokens=False).ids


def pack(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_token_output(spark, sf_dir):
    want, start = [], 0
    docs = sorted(rows_of(spark, sf_dir, "documents", "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0))
    out = sorted(QUERIES["op2_token_output"](spark, sf_dir).collect(), key=lambda r: r.start)
    for i, text in docs:
        ids = encode(text) + [0]
        want.append((i, len(ids), zlib.crc32(pack(ids))))
    assert collections.Counter(want) == collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out)
    assert [r.doc_id for r in out] == [d[0] for d in docs]
    for r in out:
        assert r.start == start
        start += r.n_tokens


def test_token_lookup(spark):
    from tablemove.llm.token_store import fetch_tokens, write_tokens
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = write_tokens(docs, scratch_path(spark, "lookup"))
    text = dict(rows_of(spark, SF, "documents", "doc_id", "text"))
    got = fetch_tokens(spark, out, [3, 17]).collect()
    assert {r["id"]: bytes(r["ids"]) for r in got} == {i: pack(encode(text[i]) + [0]) for i in (3, 17)}


def test_packing(spark, sf_dir):
    docs = collections.defaultdict(list)
    for i, text in rows_of(spark, sf_dir, "documents", "doc_id", "text"):
        docs[i].append(encode(text) + [2])
    out = QUERIES["op3_best_fit_packing"](spark, sf_dir).collect()
    places, pieces = collections.defaultdict(list), collections.Counter()
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    want = collections.Counter()
    for i, copies in docs.items():
        for ids in copies:
            at, to, n = 0, (len(ids) - 1) % 1024 + 1, 0
            while at < len(ids):
                want[i, n, at, to - at, zlib.crc32(pack(ids[at:to]))] += 1
                at, to, n = to, to + 1024, n + 1
    assert pieces == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = sorted((k[3] for k, n in want.items() for _ in range(n)), reverse=True)
    bins: list[int] = []
    for n in lengths:  # best-fit decreasing, one piece at a time
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(1024 - n)
    assert len(places) == len(bins)


def test_near_dedup(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "embeddings", "vec_id", "embedding")
    width = max(len(v or []) for _, v in rows)
    ok = [i is not None and bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v) for i, v in rows]
    x = np.array([list(v) + [0.0] * (width - len(v)) if o else [0.0] * width for (_, v), o in zip(rows, ok)])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    near = (x @ x.T >= 0.95) & ~np.eye(len(rows), dtype=bool)
    comp = [i for i, _ in rows]
    for _ in rows:
        comp = [min([c] + [comp[j] for j in np.flatnonzero(n)]) if c is not None else None for c, n in zip(comp, near)]
    want = collections.Counter((rows[i][0], int(near[i].sum()), comp[i], rows[i][0] is not None and comp[i] == rows[i][0]) for i in range(len(rows)))
    assert collections.Counter(tuple(r) for r in QUERIES["op4_near_dedup"](spark, sf_dir).collect()) == want


def test_flat_graph_recall(spark):
    from tablemove.llm.flat_graph import near_dedup
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([rng.normal(size=(800, 16)), centres.repeat(30, axis=0) + 0.03 * rng.normal(size=(1200, 16)), centres[0] + 0.02 * rng.normal(size=(900, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_dedup(df).collect()}
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.9 * true.sum()


def test_substring_dedup(spark, sf_dir):
    rows = [(i, WORD.findall(t or "")) for i, t in rows_of(spark, sf_dir, "documents", "doc_id", "text")]
    first = {}
    for i, w in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    want = collections.Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in QUERIES["op5_substring_dedup"](spark, sf_dir).collect()) == want


def shingles(text, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    comp = [i for i, _ in sets]
    near = [[j for j, (b, s) in enumerate(sets) if a is not None and b is not None and r and s and 100 * len(r & s) >= percent * len(r | s)] for a, r in sets]
    for _ in range(12):
        comp = [min([c] + [comp[j] for j in n]) if c is not None else None for c, n in zip(comp, near)]
    return collections.Counter((i, len(s), c) for (i, s), c in zip(sets, comp))


def test_ngram_join(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "documents", "doc_id", "text")
    assert collections.Counter(tuple(r) for r in QUERIES["op6_ngram_join"](spark, sf_dir).collect()) == groups(rows, 4, 85)


def test_ngram_join_edited_copies(spark):
    """Short and long texts with a few words replaced, so that pairs lie on both sides of the threshold."""
    from tablemove.llm.ngram_join import jaccard_join
    rng = np.random.default_rng(2)
    rows = []
    for length in (6, 9, 14, 30, 80):
        for _ in range(6):
            base = [f"v{x}" for x in rng.integers(0, 5000, length)]
            for edits in (0, 1, 1, 2, 3):
                own = list(base)
                for at in rng.integers(0, length, edits):
                    own[at] = f"e{rng.integers(0, 5000)}"
                rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((1, 70), (2, 80), (4, 85)):
        assert collections.Counter(tuple(r) for r in jaccard_join(df, size=size, percent=percent).collect()) == groups(rows, size, percent)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def valid(kind, x):
        d = [int(c) for c in x if c.isdigit() and c.isascii()]
        luhn = sum(d[-1::-2]) + sum(2 * c - 9 * (c > 4) for c in d[-2::-2])
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in x.split(".")), "card": 13 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_pii(spark, sf_dir):
    want = collections.Counter()
    for i, text in rows_of(spark, sf_dir, "documents", "doc_id", "text"):
        own = base_spans(text)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()
        want[(i, *(sum(x[0] == k for x in own) for k in BASE), digest)] += 1
    out = QUERIES["op7_pii"](spark, sf_dir).collect()
    assert collections.Counter(tuple(r)[:6] for r in out) == want


def test_pii_random():
    from tablemove.llm.pii import mask, spans
    rng = np.random.default_rng(3)
    letters = list("a@.+1 2-3(9)%0é\n")
    for _ in range(20_000):
        text = "".join(rng.choice(letters, rng.integers(1, 40)))
        assert [x for x in spans(text) if x[0] in BASE] == base_spans(text)
    assert mask('IBAN DE89370400440532013000, token = "a5fa9ea468653f69" http://bob:pw@x.com/y clean text') == \
        'IBAN [ACCOUNT], token = "[SECRET]" [URL] clean text'


def test_top_k(spark, sf_dir):
    rows = [(i, v) for i, v in rows_of(spark, sf_dir, "embeddings", "vec_id", "embedding") if i is not None and v and None not in v and np.isfinite(v).all()]
    width = max(len(v) for _, v in rows)
    ids = np.array([i for i, _ in rows])
    w = np.floor(64 * np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows])).astype(np.int64)
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        score = w @ w[q]
        best = [j for j in np.lexsort((ids, -score)) if j != q][:20]
        want |= {(int(ids[q]), n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(best)}
    assert {tuple(r) for r in QUERIES["op8_top_k"](spark, sf_dir).collect()} == want


def test_mixing(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents", "doc_id", "text", "source")
    size = collections.Counter()
    for _, text, s in docs:
        size[s] += len(WORD.findall(text or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / max(1, sum(w for s, w in weight.items() if s not in full))
        more = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in names}
    source = {(i, len(WORD.findall(t or ""))): s for i, t, s in docs}
    out = QUERIES["op9_mixing"](spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in out) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, _ in docs)
    taken = collections.Counter()
    for r in out:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    largest = {s: max(len(WORD.findall(t or "")) for _, t, x in docs if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    again = QUERIES["op9_mixing"](spark, sf_dir).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, out))


def test_curriculum_order(spark):
    """Positions invert the integral of a source's schedule: its share up to any time is as scheduled."""
    from tablemove.llm.mixing import RAMPS, curriculum
    rows = [(i, "a b c d e", f"s{i % 3}") for i in range(3000)]
    out = curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("source", F.explode("mix_positions").alias("p")).collect()
    for k, (start, end) in enumerate(RAMPS):
        own = np.array([r.p for r in out if r.source == f"s{k}"])
        for t in (0.25, 0.5, 0.9):
            assert np.mean(own <= t) == pytest.approx((start * t + (end - start) * t * t / 2) / ((start + end) / 2), abs=0.01)


def test_html_pages(spark):
    out = {r.page_id: r for r in QUERIES["op10_html_text"](spark, SF).collect()}
    for i, page in rows_of(spark, SF, "pages", "page_id", "html"):
        inner = page[page.index("<article>"):page.index("</article>")]
        parts = (html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split() for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(" ".join(x) for x in parts if x)
        assert (out[i].text, out[i].n_chars) == (want, len(want))


def test_html_edge(spark, edge_dir):
    out = {r.page_id: r.text for r in QUERIES["op10_html_text"](spark, edge_dir).collect()}
    assert out == {1: "", 2: "", 3: "one\ntwo & three", None: "plain text", 4: "", 5: "T\na b c d\ne f"}


def test_components(spark):
    from tablemove.llm.components import connected_components
    rng = np.random.default_rng(1)
    edges = [(1, 200), *((200 - i, 199 - i) for i in range(198)), (500, 501), (501, 500), (7000, 7000), (None, 3)] + [(1000, int(x)) for x in rng.integers(1001, 1500, 300)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and got[500] == got[501] == 500
    assert all(got[b] == 1000 for a, b in edges if a == 1000)


def test_pipeline(spark, edge_dir, empty_dir):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    rows = rows_of(spark, SF, "documents", "doc_id", "text")
    one = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert one == {c for _, _, c in groups(rows, 5, 80)}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= one | {i for i, _ in rows} and out
    assert corpus_pipeline.run(spark, edge_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
