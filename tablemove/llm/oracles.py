"""DuckDB SQL for the queries whose contract fixes every column (operators 4, 5, 6, 8, 11, 12)."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Smallest id reachable by links: ids spread along links until none gets smaller.
_REACH = """reach AS (
  SELECT a AS id, a AS c FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.c),
comps AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

ORACLES["op4_near_dedup"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM v),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id
  WHERE p.norm > 0 AND q.norm > 0 AND list_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.95),
{_REACH}
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(least(c.component_id, e.vec_id), e.vec_id) AS component_id,
  coalesce(least(c.component_id, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id LEFT JOIN comps c ON c.id = e.vec_id"""

ORACLES["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, k, list_slice(words, k, k + 49) AS word_list
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM w WHERE len(words) >= 50)),
gone AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY word_list) AS first_doc FROM win) WHERE first_doc < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM gone),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept_text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) ANTI JOIN covered USING (doc_id, p)
  GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) c USING (doc_id)"""

ORACLES["op6_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, list_slice(words, k, k + 3) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS k FROM w WHERE len(words) >= 4)
    UNION ALL SELECT doc_id, words FROM w WHERE len(words) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(c.component_id, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comps c ON c.id = d.doc_id"""

ORACLES["op8_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(64 * e)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.x, d.x) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""

_TERMS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op11_lexical_rank"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
docs AS (SELECT r, doc_id, words, len(words) AS n FROM d WHERE len(words) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
post AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(words) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT item_id, term, c, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM asked JOIN df USING (term), total),
scored AS (
  SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM weights JOIN post USING (term), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""

_WORDS12 = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op12_target_resampling"] = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(b))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS12}, []) AS words FROM documents),
dw AS (SELECT r, unnest(words) AS word FROM d),
tw AS (SELECT unnest({_WORDS12}) AS word FROM benchmark),
hexed AS (SELECT word, hex(word) AS h FROM (SELECT word FROM dw UNION SELECT word FROM tw)),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (bucket), sums),
weights AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank, count(*) OVER () * 10 // 100 AS drawn
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)"""
