"""Graph measures on edge tables ``src, dst[, weight]``, undirected unless said otherwise.

Iterative measures write each step to the checkpoint folder, so the plan stays short and a lost executor only
costs the current step.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranking import numbered
from cohortlens.session import cut_lineage, stored

col, lit = F.col, F.lit


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge once in each direction, no loops, no duplicates."""
    e = edges.select("src", "dst").where(col("src") != col("dst"))
    return e.unionByName(e.select(col("dst").alias("src"), col("src").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` with the smallest node id as the component.

    Nodes are numbered. In each round every node goes into the one that comes first among itself and its neighbours, and the
    edges between what is left go on. Rounds by number settle hubs; every other round draws an order by hash, by which a
    quarter of the nodes that still have edges is expected to go at least, whatever the graph. The first is a map-side combined minimum, so a node with
    very many edges is never collected. Rounds are written as files: their sizes are known, so late rounds join by broadcast.
    """
    # Written once: the edges may be an expensive plan, and they are read for the nodes and for the first round.
    edges = cut_lineage(edges.select("src", "dst").distinct())
    nodes = edges.select(col("src").alias("node")).unionByName(edges.select(col("dst").alias("node"))).distinct()
    nodes = cut_lineage(nodes.withColumn("id", F.monotonically_increasing_id()))
    number = lambda c, n: nodes.select(col("node").alias(c), col("id").alias(n))
    pairs = lambda d: stored(d.where(col("a") != col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    cur = pairs(edges.where(col("src") != col("dst")).join(number("src", "a"), "src").join(number("dst", "b"), "dst"))
    steps = []
    while not cur.isEmpty():
        order = lambda c: F.xxhash64(lit(len(steps)), c) if len(steps) % 2 else col(c)
        both = cur.unionByName(cur.select(col("b").alias("a"), col("a").alias("b")))
        low = both.groupBy("a").agg(F.min_by("b", order("b")).alias("m"), F.min(order("b")).alias("h"))
        step = stored(low.select("a", F.when(col("h") < order("a"), col("m")).otherwise(col("a")).alias("m")), "steps")
        steps.append(step)
        cur = pairs(cur.join(step.withColumnRenamed("m", "_a"), "a").join(step.select(col("a").alias("b"), col("m").alias("_b")), "b").select(
            col("_a").alias("a"), col("_b").alias("b")))
    roots = nodes.select(col("id").alias("a"), col("id").alias("m")).limit(0)
    for step in reversed(steps):
        later = roots.select(col("a").alias("m"), col("m").alias("_m"))
        roots = step.join(later, "m", "left").select("a", F.coalesce("_m", "m").alias("m"))
    named = cut_lineage(nodes.join(roots.withColumnRenamed("a", "id"), "id", "left").select("node", F.coalesce("m", "id").alias("_root")))
    first = named.groupBy("_root").agg(F.min("node").alias("component"))
    return named.join(first, "_root").select("node", "component")


def degree_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, and the node with the highest degree centrality."""
    deg = degrees(edges)
    n, m = F.count(lit(1)), F.sum("degree") / 2
    return deg.agg(
        n.alias("nodes"), m.cast("bigint").alias("edges"), (2 * m / (n * (n - 1))).alias("density"),
        F.max_by("node", F.struct(col("degree"), -col("node"))).alias("most_central"),
        (F.max("degree") / (n - 1)).alias("max_degree_centrality"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(col("src").alias("node")).agg(F.count(lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    total = d.agg(F.count(lit(1)).alias("_n"))
    return d.join(F.broadcast(total)).select("node", "degree", (col("degree") / (col("_n") - 1)).alias("centrality"))


def triangles_per_node(edges: DataFrame) -> DataFrame:
    """Triangle count per node. Edges point from the lower to the higher (degree, id) end, which bounds the out-degree
    of every node by the square root of the edge count, so no hub expands all pairs of its neighbours."""
    e = both_ways(edges)
    deg = e.groupBy("src").agg(F.count(lit(1)).alias("d"))
    rank = F.struct
    o = (
        e.join(deg.withColumnRenamed("d", "ds"), "src")
        .join(deg.select(col("src").alias("dst"), col("d").alias("dd")), "dst")
        .where(rank("ds", "src") < rank("dd", "dst")).select("src", "dst", "dd"))
    wedge = o.select("src", col("dst").alias("b"), col("dd").alias("db")).join(
        o.select("src", col("dst").alias("c"), col("dd").alias("dc")), "src").where(rank("db", "b") < rank("dc", "c"))
    tri = wedge.join(o.select(col("src").alias("b"), col("dst").alias("c")), ["b", "c"], "left_semi")
    return tri.select(F.explode(F.array("src", "b", "c")).alias("node")).groupBy("node").agg(F.count(lit(1)).alias("triangles"))


def average_clustering(edges: DataFrame) -> DataFrame:
    """Mean over all nodes of triangles / possible neighbour pairs (0 for nodes of degree below two)."""
    d = degrees(edges).join(triangles_per_node(edges), "node", "left")
    local = F.when(col("degree") > 1, F.coalesce("triangles", lit(0)) * 2 / (col("degree") * (col("degree") - 1))).otherwise(0.0)
    return d.agg(F.avg(local).alias("average_clustering"), (F.sum(F.coalesce("triangles", lit(0))) / 3).cast("bigint").alias("triangles"))


def _dependencies(e: DataFrame, start: DataFrame) -> DataFrame:
    """``node, raw``: dependencies of the searches out of ``start``, added up by node. State is one row per (source, reached
    node); each level is one join of the frontier with the edges ``src, dst``."""
    levels = [cut_lineage(start.select(col("node").alias("s"), "node", lit(0).alias("depth"), lit(1.0).alias("paths")))]
    seen = levels[0]
    for depth in itertools.count(1):  # ends when no search reaches a new node
        step = (
            levels[-1].join(e, col("node") == col("src")).groupBy("s", "dst").agg(F.sum("paths").alias("paths"))
            .join(seen.select("s", col("node").alias("dst")), ["s", "dst"], "left_anti")
            .select("s", col("dst").alias("node"), lit(depth).alias("depth"), "paths"))
        step = cut_lineage(step)
        if step.isEmpty():
            break
        levels.append(step)
        seen = seen.unionByName(step)
    # Dependencies flow back level by level: delta(v) = sum over successors w of paths(v)/paths(w) * (1 + delta(w)).
    delta = levels[-1].withColumn("delta", lit(0.0))
    parts = [delta]
    for level in reversed(levels[:-1]):
        share = delta.select("s", col("node").alias("dst"), ((1 + col("delta")) / col("paths")).alias("share"))
        back = (
            level.join(e, col("node") == col("src")).join(share, ["s", "dst"])
            .groupBy("s", "node").agg(F.sum("share").alias("share")))
        delta = cut_lineage(level.join(back, ["s", "node"], "left").withColumn(
            "delta", F.coalesce(col("share") * col("paths"), lit(0.0))).drop("share"))
        parts.append(delta)
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return allp.where(col("depth") > 0).groupBy("node").agg(F.sum("delta").alias("raw"))


def source_batches(start: DataFrame, nodes: int, max_state: int) -> tuple[DataFrame, int]:
    """``node, batch`` and the number of batches: sources cut by rank, so that batch size times ``nodes`` stays within
    ``max_state`` rows (one source a batch at least)."""
    size = max(1, max_state // max(1, nodes))
    placed = numbered(start.select("node", lit(0).alias("_all")), ["_all"], [col("node")])
    ranked = cut_lineage(placed.select("node", F.floor(col("pos") / size).alias("batch")))
    return ranked, (ranked.agg(F.max("batch")).first()[0] or 0) + 1


def betweenness(edges: DataFrame, sources: DataFrame | None = None, normalized: bool = True, max_state: int = 2_000_000_000) -> DataFrame:
    """Betweenness from breadth-first search out of every node of ``sources`` (all nodes by default, which is exact).

    Sources are taken in batches of at most ``max_state`` rows of state (source, reached node); the dependencies of each
    batch are added to those before and written, so what is kept between batches is one row per node. Choosing
    ``sources`` is the caller's way to bound the work: the values then scale by nodes / sources.
    """
    e = cut_lineage(both_ways(edges))
    nodes = cut_lineage(e.select(col("src").alias("node")).distinct())
    start = nodes if sources is None else sources.select("node").distinct().join(nodes, "node", "left_semi")
    n_nodes = nodes.count()
    ranked, batches = source_batches(start, n_nodes, max_state)
    scores = None
    for i in range(batches):
        part = _dependencies(e, ranked.where(col("batch") == i).select("node"))
        scores = cut_lineage(part if scores is None else scores.unionByName(part).groupBy("node").agg(F.sum("raw").alias("raw")))
    counts = nodes.agg(F.count(lit(1)).alias("n"))
    # Each unordered pair is seen from both ends, hence the half; normalising divides by the number of pairs.
    norm = F.when(col("n") > 2, 1 / ((col("n") - 1) * (col("n") - 2))).otherwise(0.0) if normalized else lit(0.5)
    used = ranked.agg(F.count(lit(1)).alias("k"))
    return nodes.join(scores, "node", "left").join(F.broadcast(counts)).join(F.broadcast(used)).select(
        "node", (F.coalesce("raw", lit(0.0)) * norm * col("n") / col("k")).alias("betweenness"))


def communities(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """``node, community`` by label propagation: each step a node takes its neighbours' most frequent label, ties to the
    smallest, until the labels have come up before (unchanged, or in a cycle) or after ``steps`` if the caller limits
    them. Label counts per node are aggregated, never collected."""
    e = cut_lineage(both_ways(edges))
    labels = e.select(col("src").alias("node")).distinct().withColumn("label", col("node"))
    seen = set()
    for _ in itertools.count() if steps is None else range(steps):
        votes = e.join(labels, col("dst") == col("node")).groupBy(col("src").alias("n"), "label").agg(F.count(lit(1)).alias("c"))
        labels = cut_lineage(votes.groupBy(col("n").alias("node")).agg(F.max_by("label", F.struct("c", -col("label"))).alias("label")))
        if steps is None:
            state = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
            if state in seen:
                break
            seen.add(state)
    return labels.withColumnRenamed("label", "community")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of ``node, community`` on the unweighted graph."""
    e = both_ways(edges)
    m = membership.select("node", "community")
    tagged = e.join(m.select(col("node").alias("src"), col("community").alias("c1")), "src").join(
        m.select(col("node").alias("dst"), col("community").alias("c2")), "dst")
    per = tagged.groupBy(col("c1").alias("community")).agg(F.count(lit(1)).alias("deg"), F.count_if(col("c1") == col("c2")).alias("inside"))
    total = per.agg(F.sum("deg").alias("two_m"))
    return per.join(F.broadcast(total)).agg(
        F.count(lit(1)).alias("communities"),
        F.sum(col("inside") / col("two_m") - F.pow(col("deg") / col("two_m"), lit(2))).alias("modularity"))


def clique_edge_counts(df: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Size of the graph that links two nodes when they share ``a`` or ``b``, from group sizes alone."""
    pairs = lambda *k: df.groupBy(*k).agg(F.count(lit(1)).alias("n")).agg(
        F.sum(col("n") * (col("n") - 1) / 2).alias("p")).select("p")
    ea, eb, eab = pairs(a).withColumnRenamed("p", "ea"), pairs(b).withColumnRenamed("p", "eb"), pairs(a, b).withColumnRenamed("p", "eab")
    n = df.agg(F.count(lit(1)).alias("nodes"))
    m = col("ea") + col("eb") - col("eab")
    return n.join(F.broadcast(ea)).join(F.broadcast(eb)).join(F.broadcast(eab)).select(
        "nodes", m.cast("bigint").alias("edges"), (2 * m / (col("nodes") * (col("nodes") - 1))).alias("density"))


def correlation_network(df: DataFrame, columns: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """Edges ``src, dst, weight`` where the absolute correlation of two columns passes the threshold; one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "weight")
    return long.where(F.abs("weight") > threshold).select(
        F.substring_index("pair", "|", 1).alias("src"), F.substring_index("pair", "|", -1).alias("dst"), "weight")


def outcome_network(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """Weighted edges treatment -> outcome with the share of each outcome in its treatment."""
    e = df.groupBy(col(treatment).alias("src"), col(outcome).alias("dst")).agg(F.count(lit(1)).alias("weight"))
    totals = e.groupBy("src").agg(F.sum("weight").alias("total"))
    return e.join(totals, "src").withColumn("share", col("weight") / col("total"))
