"""Iterative graph jobs on an edge DataFrame.

Each iteration is a join + aggregate; lineage is cut every round by files
below the shared root, so the plan and its size estimates stay small and a lost
executor recomputes from the last round, not from the start.  The only driver traffic per round is one count (convergence test).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_path


def _undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter(
        F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared root and read back: a short plan whose size is that of its files.

    A ``checkpoint()`` keeps the estimate of the plan it cuts.  Joins multiply
    estimates, so over rounds these numbers grow to millions of digits on the
    driver.  Plain encoding keeps the files as large as their rows, so that what
    looks small enough to broadcast is small.
    """
    path = scratch_path(df.sparkSession, "rounds")
    df.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cut_observe(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """Cut ``df`` and collect the given aggregate metrics in the same job."""
    obs = Observation()
    out = _cut(df.observe(obs, *[m.alias(k) for k, m in metrics.items()]))
    return out, dict(obs.get)


def _cut_count(df: DataFrame, counted=None) -> tuple[DataFrame, int]:
    """Cut and count in one job: the count rides along as an Observation.

    ``counted`` is an optional boolean column; then only rows where it holds
    are counted.
    """
    obs = Observation()
    c = F.count(F.lit(1)) if counted is None else F.count(F.when(counted, 1))
    out = _cut(df.observe(obs, c.alias("n")))
    return out, int(obs.get["n"])


# In graphs whose nodes have more edges than this on average, a subset with about so many a node is connected first.
FIRST_DEGREE = 4


def _hooked(e: DataFrame) -> DataFrame:
    """(node, comp) of undirected edges, both directions given: the smallest node id of each component.

    Hooking and pointer jumping: every round each node finds the smallest
    label of a label among itself and its neighbours, and both the node and the
    node it is labelled with take it.  Because labels are moved too, whole
    trees merge at once and the rounds grow with about the logarithm of the
    diameter.  Labels are node ids of the same component and only fall; when
    none does, neighbours agree, and the smallest node always labels itself.
    The minima are partial aggregates, so a hub node with a third of all edges
    is combined map-side; the joins have one row per node on one side, so AQE
    can split a hot key on the other.
    """
    labels = _cut(e.select(F.col("src").alias("node")).distinct().withColumn("comp", F.col("node")))
    while True:
        hop = labels.select(F.col("node").alias("_via"), F.col("comp").alias("_top"))
        jumped = _cut(labels.join(hop, labels["comp"] == hop["_via"]).select("node", "comp", "_top"))
        near = (e.join(jumped, e["src"] == jumped["node"])
                 .groupBy(F.col("dst").alias("node")).agg(F.min("_top").alias("_near")))
        own = jumped.join(near, "node").select("node", "comp", F.least("_top", "_near").alias("_low"))
        taken = own.select(F.explode(F.array("node", "comp")).alias("node"), "_low")
        new = taken.groupBy("node").agg(F.min("_low").alias("_low")).join(labels, "node")
        new, changed = _cut_count(new.select("node", F.least("_low", "comp").alias("comp"), F.col("comp").alias("_old")),
                                  F.col("comp") != F.col("_old"))
        labels = new.drop("_old")
        if changed == 0:
            return labels


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for an undirected graph; component = smallest node id.

    The rounds of ``_hooked`` read all their edges.  A graph with many edges a
    node is therefore joined up by a few of them first (a subset chosen by hash,
    ``FIRST_DEGREE`` a node on average); then every edge is held against these
    labels once, and only those between different ones, mostly few, go through
    the rounds again.  No edge is left out, whatever the subset was.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    e, m = _cut_observe(e, n=F.count(F.lit(1)), left=F.approx_count_distinct("src"), right=F.approx_count_distinct("dst"))
    share = m["n"] / (FIRST_DEGREE / 2 * max(1, m["left"], m["right"]))  # nodes: from the larger side to both together
    if share < 4:
        return _hooked(_cut(_undirected(e, "src", "dst"))).select("node", F.col("comp").alias("component"))
    first = _hooked(_cut(_undirected(e.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(int(share))) == 0), "src", "dst")))
    own = lambda end: first.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}"))
    placed = e.join(own("src"), "src", "left").join(own("dst"), "dst", "left")
    rest = placed.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), F.col("_src").isNull().alias("_new"))
    rest = _hooked(_cut(_undirected(rest.filter((F.col("src") != F.col("dst")) | F.col("_new")), "src", "dst")))
    later = rest.select(F.col("node").alias("_of"), F.col("comp").alias("_then"))
    joined = first.join(later, first["comp"] == later["_of"], "left").select("node", F.coalesce("_then", "comp").alias("component"))
    return _cut(joined.unionByName(rest.join(first, "node", "left_anti").select("node", F.col("comp").alias("component"))))


# Levels of a search up to this size leave the edges as they are.
SMALL_LEVEL = 50_000


class _Visited:
    """Nodes seen so far in a handful of parts on disk: a part is merged with the one before it
    when it has grown as large, so each node is rewritten a logarithmic number of times and plans stay short."""

    def __init__(self):
        self.parts: list[tuple[DataFrame, int]] = []

    def add(self, nodes: DataFrame, n: int) -> None:
        self.parts.append((nodes, n))
        while len(self.parts) > 1 and self.parts[-1][1] >= self.parts[-2][1]:
            (a, x), (b, y) = self.parts[-2:]
            self.parts[-2:] = [(_cut(a.unionByName(b)), x + y)]

    def without(self, df: DataFrame) -> DataFrame:
        for part, _ in self.parts:
            df = df.join(part.select("node"), "node", "left_anti")
        return df

    def all(self) -> DataFrame:
        out = self.parts[0][0]
        for part, _ in self.parts[1:]:
            out = out.unionByName(part)
        return out


def search_tree(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst",
                directed: bool = False, target: str | None = None) -> DataFrame:
    """Breadth-first search from the ``seeds`` frame (column ``node``): (node, hops, parent), a seed's parent NULL.

    Of the shortest paths to a node the smallest in array order is kept.  Rows
    carry no paths for that: a level is range-sorted by (the parent's place,
    node), and a node's place in its level, an increasing number from that sort,
    is what the next level compares; the parent is fetched by it afterwards, so
    the minima are plain numbers.  One frontier join and one sort per level; a
    level above ``SMALL_LEVEL`` nodes takes its edges out of those that later
    levels read (a node is expanded once).  An undirected search is held against the last two
    levels only, a directed one against all nodes seen.  With ``target`` the
    search ends at the level that reaches it.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    e = _cut(_undirected(e, "src", "dst") if not directed else e.distinct())
    depth = 0
    hit = F.count(F.when(F.col("node") == F.lit(target), 1)) if target is not None else F.lit(0)
    kind = e.schema["src"].dataType.simpleString()
    first = seeds.select("node").distinct().orderBy("node").select("node", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("parent"), F.monotonically_increasing_id().alias("place"))
    level, m = _cut_observe(first, n=F.count(F.lit(1)), hit=hit)
    visited, before = _Visited(), None
    while True:
        visited.add(level.select("node", "hops", "parent"), m["n"])
        if m["hit"] or not m["n"]:
            return visited.all()
        depth += 1
        near = level.select(F.col("node").alias("src"), "place")
        if m["n"] <= SMALL_LEVEL:
            met = e.join(near, "src")
        else:
            met = _cut(e.join(near, "src", "left"))
            e, met = met.filter(F.col("place").isNull()).select("src", "dst"), met.filter(F.col("place").isNotNull())
        reached = met.groupBy(F.col("dst").alias("node")).agg(F.min("place").alias("_from"))
        if directed:
            reached = visited.without(reached)
        else:  # neighbours of a level lie in it, the one before or the one after
            for seen in (level, before):
                reached = reached if seen is None else reached.join(seen.select("node"), "node", "left_anti")
        reached = reached.join(level.select(F.col("place").alias("_from"), F.col("node").alias("parent")), "_from")
        ordered = reached.orderBy("_from", "node")
        before = level
        level, m = _cut_observe(ordered.select("node", F.lit(depth).alias("hops"), "parent", F.monotonically_increasing_id().alias("place")),
                                n=F.count(F.lit(1)), hit=hit)


def tree_paths(tree: DataFrame) -> DataFrame:
    """(node, hops, path) from (node, hops, parent): paths double in length each round, by pointer jumping."""
    paths, left = _cut_count(tree.select("node", "hops", F.array("node").alias("path"), F.col("parent").alias("_up")))
    while left:
        above = paths.select(F.col("node").alias("_above"), F.col("path").alias("_head"), F.col("_up").alias("_next"))
        longer = paths.join(above, paths["_up"] == above["_above"], "left")
        paths, left = _cut_count(longer.select("node", "hops", F.concat(F.coalesce("_head", F.array().cast(paths.schema["path"].dataType.simpleString())), F.col("path")).alias("path"),
                                               F.col("_next").alias("_up")), F.col("_up").isNotNull())
    return paths.select("node", "hops", "path")


def shortest_paths(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst",
                   directed: bool = False, target: str | None = None) -> DataFrame:
    """(node, hops, path) for every node reachable from the ``seeds`` frame (column ``node``).

    Among equally short paths the smallest in array order wins.  With ``target``
    only that node's row is sure to be there, and the search ends with it.
    """
    return tree_paths(search_tree(edges, seeds, src, dst, directed, target))


def join_path(edges: DataFrame, source: str, target: str, src: str = "source_table",
              dst: str = "target_table") -> DataFrame:
    """H8: shortest undirected path between two tables; empty frame if none."""
    spark = edges.sparkSession
    seeds = spark.createDataFrame([(source,)], "node string")
    paths = shortest_paths(edges.select(F.col(src).cast("string").alias("src"),
                                        F.col(dst).cast("string").alias("dst")), seeds, target=target)
    return paths.filter(F.col("node") == target).select("hops", "path")


def _chain_roots(nodes: DataFrame, n: int) -> DataFrame:
    """(node, root, done) from (node, up, done): pointers double until they end at a root (``done``); those that
    never do after log2(n) rounds lie on a cycle of chain nodes or hang from one."""
    p, rounds, left = nodes, 0, True
    while left and rounds <= n.bit_length():
        q = p.select(F.col("node").alias("_up"), F.col("up").alias("_next"), F.col("done").alias("_done"))
        p, left = _cut_count(p.join(q, p["up"] == q["_up"]).select("node", F.col("_next").alias("up"), F.col("_done").alias("done")), ~F.col("done"))
        rounds += 1
    return p.withColumnRenamed("up", "root")


def cycle_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node on a directed cycle or downstream of one; none if the graph has no cycle.

    A node survives if one of its predecessors does, so a node with a single
    one shares its fate: whole chains are contracted into their first node
    by pointer jumping, in rounds that grow with the logarithm of their
    length.  Nodes without predecessors then go, with all that was contracted
    into them, and the rest is contracted again.  A self-loop marks a node that is
    known to survive.  When every node left has a predecessor, all survive.
    """
    e, n_edges = _cut_count(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
                            .filter(F.col("src").isNotNull() & F.col("dst").isNotNull()))
    member, n = _cut_count(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
                           .select("node", F.col("node").alias("rep")))
    alive = member.select("node").limit(0)
    while n_edges:
        into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_in"), F.min("src").alias("_only"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("_loop"))
        here = member.select(F.col("rep").alias("node")).distinct().join(into, "node", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
        chained = (F.col("_in") == 1) & (F.col("_loop") == 0)
        here, m = _cut_observe(here.select("node", F.when(chained, F.col("_only")).otherwise(F.col("node")).alias("up"), (~chained).alias("done"), "_in"),
                               dead=F.count(F.when(F.col("_in") == 0, 1)), n=F.count(F.lit(1)))
        if not m["dead"]:
            break
        roots = _chain_roots(here.select("node", "up", "done"), m["n"])
        dead = here.where("_in = 0").select(F.col("node").alias("root"), F.lit(True).alias("dead"))
        fate = _cut(roots.join(dead, "root", "left").select("node", "root", "done", F.coalesce("dead", F.lit(False)).alias("dead")))
        moved = member.join(fate.withColumnRenamed("node", "rep"), "rep").where(~F.col("dead"))
        alive = _cut(alive.unionByName(moved.where(~F.col("done")).select("node")))
        member = _cut(moved.where("done").select("node", F.col("root").alias("rep")))
        into_roots = e.join(here.where((F.col("_in") > 0) & F.col("done")).select(F.col("node").alias("dst")), "dst", "left_semi")
        kept = into_roots.join(fate.select(F.col("node").alias("src"), "root", "done", "dead"), "src").where(~F.col("dead"))
        # A predecessor that hangs from a cycle is as good as a loop; a chain back to the node itself is one.
        e, n_edges = _cut_count(kept.select(F.when(F.col("done"), F.col("root")).otherwise(F.col("dst")).alias("src"), "dst").distinct())
    left = member.join(e.select(F.col("dst").alias("rep")).distinct(), "rep", "left_semi").select("node")
    return alive.unionByName(left).distinct()


def nodes_on_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The nodes that lie on a directed cycle themselves.

    Nodes that no cycle reaches or that reach none are trimmed first.  In what is
    left every node takes the largest node that reaches it as its colour; the nodes of
    a colour that reach back to that node, inside the colour, are its strongly connected
    part.  Parts found leave the graph, the rest is coloured again.
    """
    e = _cut(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct().filter(F.col("src").isNotNull() & F.col("dst").isNotNull()))
    found = _cut(e.where("src = dst").select(F.col("src").alias("node")))
    e, n_edges = _cut_count(e.where("src <> dst"))
    while n_edges:
        for a, b in (("src", "dst"), ("dst", "src")):
            keep = cycle_nodes(e, a, b)
            e, n_edges = _cut_count(e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if not n_edges:
            break
        colour = _cut(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        changed = 1
        while changed:
            sent = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_new"))
            colour, changed = _cut_count(colour.join(sent, "node", "left").select("node", F.greatest("colour", "_new").alias("colour"), (F.col("_new") > F.col("colour")).alias("_up")), F.col("_up"))
            colour = colour.drop("_up")
        of = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}"))
        inside = _cut(e.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst"))
        back, n = _cut_count(colour.where("node = colour").select("node"))
        part = back
        while n:  # against the edges, from the colour's own node
            before = inside.join(back.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct()
            back, n = _cut_count(before.join(part, "node", "left_anti"))
            part = _cut(part.unionByName(back)) if n else part
        many = inside.join(part.withColumnRenamed("node", "src"), "src", "left_semi").join(part.withColumnRenamed("node", "dst"), "dst", "left_semi")
        found = _cut(found.unionByName(many.select(F.explode(F.array("src", "dst")).alias("node"))).distinct())
        e, n_edges = _cut_count(e.join(part.withColumnRenamed("node", "src"), "src", "left_anti").join(part.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return found.distinct()


def has_cycle(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    rem = cycle_nodes(edges, src, dst)
    return rem.agg((F.count(F.lit(1)) > 0).alias("has_cycle"), F.count(F.lit(1)).alias("nodes_left"))


def auto_join(tables: dict[str, DataFrame], edges: DataFrame, names: list[str],
              confirmed: tuple = (), min_confidence: float = 0.85) -> DataFrame:
    """Join ``names``, finding keys from the edge table.

    A set of joined tables grows from the first name.  Each further name not
    in it yet is reached by the shortest path (H8) from any joined table, and
    no table is joined twice.  A hop uses all key columns of its best edge
    (rows of one ``edge_id``; either direction); an edge below
    ``min_confidence`` that is not explicit is refused unless the pair is in
    ``confirmed``.  Only edge metadata (a path and one edge per hop) reaches
    the driver; the joins run on the data.
    """
    from .relational import join
    edges = _cut(edges)  # small metadata table; evaluated once for path search and hop lookups
    src, dst = F.col("source_table").cast("string").alias("src"), F.col("target_table").cast("string").alias("dst")
    pairs = edges.select(src, dst)
    joined, df = [names[0]], tables[names[0]]
    for name in names[1:]:
        if name in joined:
            continue
        seeds = edges.sparkSession.createDataFrame([(t,) for t in joined], "node string")
        p = shortest_paths(pairs, seeds, target=name).filter(F.col("node") == name).select("path").collect()
        if not p:
            raise ValueError(f"no join path between {joined[0]} and {name}")
        path = list(p[0]["path"])  # only its first table is joined already
        for left, right in zip(path, path[1:]):
            df = join(df, tables[right], how="inner", keys=_edge_keys(edges, left, right, confirmed, min_confidence))
            joined.append(right)
    return df


def _edge_keys(edges: DataFrame, left: str, right: str, confirmed: tuple, min_confidence: float) -> list:
    """All key column pairs (left, right) of the best edge between two tables."""
    cand = edges.filter(((F.col("source_table") == left) & (F.col("target_table") == right))
                        | ((F.col("source_table") == right) & (F.col("target_table") == left)))
    rows = cand.orderBy(F.col("confidence").desc(), "source_column").collect()  # the edges of one table pair
    best = rows[0]
    if best["confidence"] < min_confidence and best["kind"] != "explicit" and (left, right) not in confirmed:
        raise ValueError(f"edge {left}-{right} needs confirmation (confidence {best['confidence']})")
    same = [r for r in rows if r["edge_id"] == best["edge_id"]] if "edge_id" in edges.columns else [best]
    turned = best["source_table"] != left
    return list(dict.fromkeys((r["target_column"], r["source_column"]) if turned else (r["source_column"], r["target_column"]) for r in same))
