"""Embedding near-dedup (operator 4): a robust-pruned flat graph.

1. Equal vectors are collapsed to one row with a multiplicity.
2. Centroids from a bounded sample cut the rows into clusters; every row belongs
   to its ``overlap`` nearest ones, so clusters overlap.  A cluster above
   ``unit_rows`` is split by hash into parts, and every pair of parts is a unit
   of work: units stay bounded however dense a cluster is, and no pair is lost.
3. Each unit builds a graph by robust pruning: a row keeps its nearest others
   that no kept one already covers (within ``alpha``).
4. The adjacency lists of all units are united per row.
5. In each unit a greedy beam search from the unit's medoid and the row itself
   runs for every row over its united list and then expands through everything
   in range; pairs in range are verified in double precision.
6. The links of all units are united.  Units return a spanning forest of their
   links and, per row and set of clusters shared with the linked rows, a count
   and a digest.  Where all those clusters report the same digest the count
   holds; only for rows on which clusters disagree are links listed, made
   distinct and counted again, so no link that any unit verified is lost.
7. Recall is audited against brute force for ``AUDIT_ROWS`` rows and for
   ``PROBES`` planted ones: copies of sampled rows turned to a cosine between the
   threshold and 1, which take part like rows but count for nothing.  So the audit
   rests on at least ``PROBES`` linked rows however sparse the links are.  Recall is
   the mean over linked rows of the share of links found; below ``recall`` the
   overlap and the beam double and the search runs again.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing (n_links 0, their own component).  Shorter vectors count as
padded with zeros.  Rows with equal ids are each a vector.  A null id takes no
part (component null).  Other columns are ignored.  No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, mix, prepare
from .components import connected_components
from .vectors import matrix, packed

CLUSTER_ROWS, UNIT_ROWS = 512, 768
MAX_CENTROIDS, SAMPLE, LLOYD = 4096, 16_384, 5  # centroids are fitted on at most SAMPLE rows
OVERLAP, DEGREE, ALPHA, BEAM, SLACK = 2, 16, 1.2, 24, 0.02
AUDIT_ROWS, PROBES, RECALL = 64, 192, 0.97


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on the sample."""
    c = x[:k].copy()
    for _ in range(LLOYD if len(x) > k else 0):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def robust_prune(x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours (n x degree, -1 where none): each row repeatedly keeps its nearest remaining
    row and drops the rows that lie ``alpha`` times nearer to it."""
    n = len(x)
    dist = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0)).astype(np.float32)
    open_ = dist.copy()
    np.fill_diagonal(open_, np.inf)
    out = np.full((n, degree), -1, dtype=np.int64)
    for r in range(min(degree, n - 1)):
        near = np.argmin(open_, axis=1)
        left = np.isfinite(open_[np.arange(n), near])
        if not left.any():
            break
        out[left, r] = near[left]
        open_[alpha * dist[near] <= dist] = np.inf
        open_[np.arange(n), near] = np.inf
    return out


def range_search(x: np.ndarray, neighbours: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Boolean n x n: pairs with cosine >= threshold that a search for each row, from the medoid and the row itself, found."""
    n = len(x)
    rows = np.arange(n)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    seen, in_range, expanded = (np.zeros((n, n), dtype=bool) for _ in range(3))
    seen[:, medoid] = seen[rows, rows] = True
    ids = np.column_stack([np.full(n, medoid), rows])
    sims = np.column_stack([x @ x[medoid], np.ones(n)])
    done = np.zeros((n, 2), dtype=bool)
    done[medoid, 0] = True  # the medoid is its own row
    degree = neighbours.shape[1]
    while True:  # greedy: expand each row's best unexpanded candidate of its beam
        pick = np.argmax(np.where(done, -np.inf, sims), axis=1)
        active = np.flatnonzero(~done[rows, pick] & (sims[rows, pick] > -np.inf))
        if not len(active):
            break
        done[active, pick[active]] = True
        at = ids[active, pick[active]]
        expanded[active, at] = True
        near = neighbours[at]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[np.repeat(active, degree)[fresh.ravel()], near[fresh]] = True
        new = np.full((n, degree), -np.inf)
        new[active] = np.where(fresh, np.einsum("qd,qrd->qr", x[active], x[near]), -np.inf)
        more = np.zeros((n, degree), dtype=np.int64)
        more[active] = near
        ids, sims, done = np.hstack([ids, more]), np.hstack([sims, new]), np.hstack([done, new == -np.inf])
        a, b = np.nonzero(new >= threshold - SLACK)
        in_range[a, more[a, b]] = True
        if ids.shape[1] > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(v, top, axis=1) for v in (ids, sims, done))
    in_range[:, medoid] |= x @ x[medoid] >= threshold - SLACK
    todo = in_range & ~expanded
    while todo.any():  # expand everything in range until nothing new is
        expanded |= todo
        q, v = np.nonzero(todo)
        reached = np.zeros((n, n), dtype=bool)
        for r in range(degree):
            w = neighbours[v, r]
            reached[q[w >= 0], w[w >= 0]] = True
        reached &= ~seen
        seen |= reached
        q, w = np.nonzero(reached)
        near = np.zeros(len(q), dtype=bool)
        for a in range(0, len(q), 65_536):
            near[a:a + 65_536] = np.einsum("nd,nd->n", x[q[a:a + 65_536]], x[w[a:a + 65_536]]) >= threshold - SLACK
        todo = np.zeros((n, n), dtype=bool)
        todo[q[near], w[near]] = True
        in_range |= todo
    np.fill_diagonal(in_range, False)
    in_range |= in_range.T
    q, w = np.nonzero(in_range)
    ok = np.zeros(len(q), dtype=bool)
    for a in range(0, len(q), 65_536):
        ok[a:a + 65_536] = np.einsum("nd,nd->n", x[q[a:a + 65_536]], x[w[a:a + 65_536]]) >= threshold
    in_range[q[~ok], w[~ok]] = False
    return in_range


def _build(degree: int, alpha: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        near = robust_prune(units(matrix(table.column("vec"))), degree, alpha)
        back = [[] for _ in ids]
        for a, own in enumerate(near.tolist()):
            for b in own:
                if b >= 0 and len(back[b]) < 2 * degree:
                    back[b].append(a)
        lists = [ids[sorted({*own, *extra} - {-1})].tolist() for own, extra in zip(near.tolist(), back)]
        return pa.Table.from_arrays([pa.array(ids), pa.array(lists, pa.list_(pa.int64()))], names=["id", "near"])

    return run


def _unit_links(table: pa.Table, threshold: float, beam: int) -> tuple[pa.Table, np.ndarray]:
    """(the unit's rows by id, boolean matrix of its links); alike whatever order the rows come in."""
    table = table.sort_by("id")
    ids, x = table.column("id").to_numpy(), units(matrix(table.column("vec")))
    local = []
    for own in table.column("near").to_pylist():
        own = np.asarray(own, dtype=np.int64)
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        local.append(at[ids[at] == own])
    near = np.full((len(ids), max(1, max(map(len, local)))), -1, dtype=np.int64)
    for i, own in enumerate(local):
        near[i, :len(own)] = own
    links = range_search(x, near, threshold, beam)
    part, i, j = (table.column(c).to_numpy() for c in ("part", "i", "j"))
    if i[0] != j[0]:  # pairs inside one part belong to that part's own unit
        links &= part[:, None] != part[None, :]
    return table, links


def shared_clusters(shards: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair (a, b) of rows: bit p says that b lies in a's p-th cluster."""
    out = np.zeros(len(a), dtype=np.int64)
    for at in range(0, len(a), 65_536):
        mine, other = shards[a[at:at + 65_536]], shards[b[at:at + 65_536]]
        for p in range(shards.shape[1]):
            out[at:at + 65_536] |= (mine[:, p, None] == other).any(axis=1).astype(np.int64) << p
    return out


def _search(threshold: float, beam: int) -> Callable:
    """Per unit: digests (id, shared, shard, n, digest) of each row's links and forest edges (id, to)."""
    schema = pa.schema([("id", pa.int64()), ("to", pa.int64()), ("shared", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("digest", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table, links = _unit_links(table, threshold, beam)
        ids, times, shard = (table.column(c).to_numpy() for c in ("id", "times", "shard"))
        a, b = np.nonzero(links)
        shared = shared_clusters(np.array(table.column("shards").to_pylist(), dtype=np.int64), a, b)
        order = np.lexsort((shared, a))
        a, b, shared = a[order], b[order], shared[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (shared[1:] != shared[:-1]))) if len(a) else np.zeros(0, dtype=np.int64)
        n = np.add.reduceat(times[b], first) if len(a) else first
        digest = np.bitwise_xor.reduceat(mix(ids[b].astype(np.uint64)), first) if len(a) else first
        edges, group, real = [], np.arange(len(ids)), times > 0
        for r in np.flatnonzero(real):  # spanning forest of the unit's links
            others = np.flatnonzero(links[r, r + 1:] & real[r + 1:]) + r + 1
            for g in np.unique(group[others]).tolist() if len(others) else ():
                if g != group[r]:
                    edges.append((ids[r], ids[others[group[others] == g][0]]))
                    group[group == g] = group[r]
        none = [None] * len(edges)
        return pa.Table.from_arrays([pa.array(ids[a[first]].tolist() + [int(e[0]) for e in edges], pa.int64()),
                                     pa.array([None] * len(first) + [int(e[1]) for e in edges], pa.int64()),
                                     *(pa.array(v.tolist() + none, pa.int64()) for v in (shared[first], shard[a[first]], n, digest.view(np.int64)))], schema=schema)

    return run


def _list(threshold: float, beam: int) -> Callable:
    """Per unit: the links (id, to, n) of the rows in doubt, over the sets of clusters in doubt alone."""
    def run(table: pa.Table) -> pa.Table:
        table, links = _unit_links(table, threshold, beam)
        ids, times = table.column("id").to_numpy(), table.column("times").to_numpy()
        doubt = table.column("doubt").to_pylist()
        links[[d is None for d in doubt]] = False
        a, b = np.nonzero(links)
        shared = shared_clusters(np.array(table.column("shards").to_pylist(), dtype=np.int64), a, b)
        keep = np.array([s in doubt[r] for r, s in zip(a.tolist(), shared.tolist())], dtype=bool)
        a, b = a[keep], b[keep]
        return pa.Table.from_arrays([pa.array(v, pa.int64()) for v in (ids[a], ids[b], times[b])], names=["id", "to", "n"])

    return run


def _true_counts(sample_ids: np.ndarray, sample: np.ndarray, threshold: float) -> Callable:
    def run(batches):
        total = np.zeros(len(sample_ids), dtype=np.int64)
        for b in batches:
            if len(b):
                hit = sample @ units(matrix(b.column("vec"))).T >= threshold
                hit &= sample_ids[:, None] != b.column("id").to_numpy()[None, :]
                total += hit @ b.column("times").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(sample_ids), pa.array(total)], names=["id", "n"])

    return run


def _probes(reps: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float) -> pa.Table:
    """PROBES rows (id, vec, times = 0), each a sampled unit vector turned at random to a cosine in [threshold, 1)."""
    rng = np.random.default_rng(len(ids))
    taken = rng.integers(-2**63, 2**63, size=4 * PROBES, dtype=np.int64)
    used = {r[0] for r in reps.where(F.col("id").isin(taken.tolist())).select("id").collect()}
    free = [i for i in dict.fromkeys(taken.tolist()) if i not in used][:PROBES]
    at = x[rng.integers(len(x), size=len(free))]
    side = rng.normal(size=at.shape)
    side -= np.einsum("nd,nd->n", side, at)[:, None] * at
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.where(norm > 1e-9, side / np.maximum(norm, 1e-9), 0)  # one dimension: an equal vector
    cos = rng.uniform(threshold, 1, size=(len(free), 1))
    vec = cos * at + np.sqrt(1 - cos * cos) * side
    return pa.table({"vec": pa.array([v.tobytes() for v in vec.astype("<f8")], pa.binary()), "id": pa.array(free, pa.int64()), "times": pa.array([0] * len(free), pa.int64())})


def near_dedup(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding",
               overlap: int = OVERLAP, beam: int = BEAM, recall: float = RECALL, on_audit: Callable[[dict], None] | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    ``on_audit`` is called after each search with its measured ``recall``, the
    ``linked`` rows it rests on, ``overlap``, ``beam`` and the rows in ``doubt``.
    """
    spark = prepare(vectors.sparkSession, 2048)
    rows, _ = materialize(packed(vectors, id_col, vec_col), "graph-rows")
    valid = rows.where("id IS NOT NULL AND vec IS NOT NULL AND NOT zero")
    reps, _ = materialize(valid.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("times")), "graph-reps")
    n = reps.count()
    k = max(1, min(MAX_CENTROIDS, n // CLUSTER_ROWS))
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE if k > 1 else AUDIT_ROWS).select("id", "vec", "times").toArrow()  # bounded
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    width = max(len(v) for v in sample.column("vec").to_pylist()) // 8
    x = units(matrix(sample.column("vec")))
    centroids = fit_centroids(x, k)
    planted = _probes(reps, sample.column("id").to_numpy(), x, threshold)
    audit_ids = np.append(sample.column("id").to_numpy()[:AUDIT_ROWS], planted.column("id").to_numpy())
    audit_x = np.concatenate([x[:AUDIT_ROWS], units(matrix(planted.column("vec")))])
    true = {r[0]: r[1] for r in reps.mapInArrow(_true_counts(audit_ids, audit_x, threshold), "id long, n long").groupBy("id").agg(F.sum("n")).collect()}
    searched = reps.select("vec", "id", "times").union(spark.createDataFrame(planted))
    while True:
        found, edges, doubt, paths = _links(searched, centroids, width, min(overlap, k), beam, threshold)
        got = {r[0]: r[1] for r in found.where(F.col("id").isin(audit_ids.tolist())).collect()}
        shares = [min(1.0, got.get(i, 0) / want) for i, want in true.items() if want]
        measured = sum(shares) / len(shares) if shares else 1.0
        if on_audit:
            on_audit({"recall": measured, "linked": len(shares), "overlap": min(overlap, k), "beam": beam, "doubt": doubt})
        if measured >= recall or (overlap >= k and beam >= n):
            break
        drop_scratch(spark, *paths)
        overlap, beam = 2 * overlap, 2 * beam
    comps = connected_components(edges, "id", "to")
    per_rep, _ = materialize(reps.join(found, "id", "left").join(comps, "id", "left")
                             .select("vec", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "graph-result")
    drop_scratch(spark, *paths)
    out = rows.join(per_rep, "vec", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _links(reps: DataFrame, centroids: np.ndarray, width: int, overlap: int, beam: int, threshold: float) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """(counts (id, n), forest edges (id, to), rows in doubt, scratch paths) of one build and search."""
    def assign(batches):
        for b in batches:
            x = matrix(b.column("vec"))
            if x.shape[1] < centroids.shape[1]:
                x = np.pad(x, ((0, 0), (0, centroids.shape[1] - x.shape[1])))
            near = np.sort(np.argpartition(-(units(x[:, :centroids.shape[1]]) @ centroids.T), overlap - 1, axis=1)[:, :overlap], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], names=[*b.schema.names, "shards"])

    placed, placed_path = materialize(reps.select("id", "vec", "times").mapInArrow(assign, "id long, vec binary, times long, shards array<long>"), "graph-placed")
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / UNIT_ROWS).alias("parts"))
    member = (placed.withColumn("shard", F.explode("shards")).join(sizes, "shard")
              .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
              .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")))
    unit = ["shard", "i", "j"]
    near = (member.select(*unit, "id", "vec").groupBy(*unit).applyInArrow(_build(DEGREE, ALPHA), "id long, near array<long>")
            .groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    graph, graph_path = materialize(near, "graph")
    walk = member.join(graph, "id").select(*unit, "id", "vec", "times", "shards", "part", "near")
    found, found_path = materialize(walk.groupBy(*unit).applyInArrow(_search(threshold, beam), "id long, to long, shared long, shard long, n long, digest long"), "graph-found")
    # The clusters of a shared set agree, or their links are listed and united.
    per_set, per_set_path = materialize(
        found.where("to IS NULL").groupBy("id", "shared", "shard").agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"))
        .groupBy("id", "shared").agg(F.max("n").alias("n"), ((F.count("*") == F.bit_count("shared")) & (F.min("n") == F.max("n")) & (F.min("digest") == F.max("digest"))).alias("agreed")), "graph-sets")
    open_sets = per_set.where("NOT agreed").groupBy("id").agg(F.collect_list("shared").alias("doubt"))
    doubt, paths, counts = open_sets.count(), [found_path, per_set_path], per_set.where("agreed").select("id", "n")
    if doubt:
        marked = walk.join(open_sets, "id", "left")
        here = marked.where("doubt IS NOT NULL").select(*unit).distinct()
        listed, listed_path = materialize(marked.join(here, unit, "left_semi").groupBy(*unit).applyInArrow(_list(threshold, beam), "id long, to long, n long").distinct(), "graph-listed")
        counts, paths = counts.union(listed.groupBy("id").agg(F.sum("n").alias("n"))), [*paths, listed_path]
    drop_scratch(reps.sparkSession, graph_path, placed_path)
    return counts.groupBy("id").agg(F.sum("n").alias("n")), found.where("to IS NOT NULL").select("id", "to"), doubt, paths
