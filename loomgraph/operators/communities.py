"""Communities by greedy modularity on the undirected call graph.

The gain of joining two communities depends only on the weight between them, their degree sums and the total weight, and is
negative for communities without a link; so connected components are independent given the total. Components of up to
GROUP_NODES nodes are solved exactly in the order of the greedy method, one task a component. In larger ones communities
that are each other's best gain join in distributed rounds until at most GROUP_NODES are left, which are then solved alike."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.paths import components
from loomgraph.plans.storage import stored

#: Communities of a component that one task solves, at most; and rounds of pairwise joining beyond that.
GROUP_NODES, MAX_ROUNDS = 10_000, 40
#: Rows (communities and links) of the components that one task solves, about; one component stays in one task.
TASK_ROWS = 10_000


def greedy(links: dict[tuple[str, str], float], degree: dict[str, float], total: float) -> dict[str, str]:
    """Community (its least member) of each node: the pair of best positive gain joins, again and again; ties by name."""
    near: dict[str, dict[str, float]] = {v: {} for v in degree}
    for (a, b), w in links.items():
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    deg, into, version = dict(degree), {v: v for v in degree}, dict.fromkeys(degree, 0)

    def gain(a: str, b: str) -> float:
        return near[a][b] / total - deg[a] * deg[b] / (2 * total * total)

    heap = [(-gain(a, b), a, b, 0, 0) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b, va, vb = heapq.heappop(heap)
        if a not in near or b not in near or version[a] != va or version[b] != vb:
            continue
        if -g <= 1e-15:
            break
        keep, gone = min(a, b), max(a, b)
        into[gone] = keep
        for c, w in near.pop(gone).items():
            near[c].pop(gone)
            if c != keep:
                near[keep][c] = near[keep].get(c, 0.0) + w
                near[c][keep] = near[keep][c]
        deg[keep] += deg.pop(gone)
        version[keep] += 1
        for c in near[keep]:
            x, y = min(keep, c), max(keep, c)
            heapq.heappush(heap, (-gain(x, y), x, y, version[x], version[y]))

    def root(v: str) -> str:
        while into[v] != v:
            into[v] = into[into[v]]
            v = into[v]
        return v

    return {v: root(v) for v in degree}


def _links(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("w", F.lit(1.0))


def _degrees(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("d"))


def _pair_up(links: DataFrame, degree: DataFrame, total: float) -> DataFrame:
    """(id, into): communities that are each other's best positive gain, under the lesser name."""
    d = degree.select("id", "d")
    g = links.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b").select("a", "b", (F.col("w") / total - F.col("da") * F.col("db") / (2 * total * total)).alias("g")).filter("g > 1e-15")
    both = g.unionByName(g.select(F.col("b").alias("a"), F.col("a").alias("b"), "g"))
    best = both.groupBy("a").agg(F.min_by("b", F.struct(-F.col("g"), F.col("b"))).alias("b"))
    other = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(other, ["a", "b"]).filter("a > b").select(F.col("a").alias("id"), F.col("b").alias("into"))


def communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, community): the least member's id of the community of each of nodes(id); nodes without links stand alone. Fewer
    than three nodes have none."""
    if nodes.select("id").distinct().limit(3).count() < 3:
        return nodes.select("id", F.col("id").alias("community")).limit(0)
    ids = nodes.select("id").distinct()
    e = stored(edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "edges")
    comp = stored(components(e, ids), "comp")
    links = stored(_links(e), "links")
    total = links.agg(F.sum("w")).first()[0] or 1.0
    degree = stored(_degrees(links), "deg")
    member = comp.select("id", F.col("id").alias("community"), "component")
    for _ in range(MAX_ROUNDS):
        big = stored(member.select("component", "community").distinct().groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_NODES), "big")
        if big.isEmpty():
            break
        own = member.join(big.select("component"), "component", "left_semi").select(F.col("community").alias("a")).distinct()
        in_big = links.join(own, "a", "left_semi")
        pairs = stored(_pair_up(in_big, degree, total), "pairs")
        if pairs.isEmpty():
            break
        to = lambda c: F.coalesce("into", F.col(c))
        for c in ("a", "b"):
            links = links.join(pairs.withColumnRenamed("id", c), c, "left").withColumn(c, to(c)).drop("into")
        links = stored(links.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "links")
        degree = stored(degree.join(pairs, "id", "left").groupBy(to("id").alias("id")).agg(F.sum("d").alias("d")), "deg")
        member = stored(member.join(pairs.withColumnRenamed("id", "community"), "community", "left").select("id", to("community").alias("community"), "component"), "member")
    left = member.select("component", F.col("community").alias("id")).distinct().join(degree, "id").select("component", "id", F.lit(None).cast("string").alias("b"), F.col("d").alias("w"))
    where = member.select(F.col("community").alias("id"), "component").distinct()
    rows = stored(left.unionByName(links.join(where.withColumnRenamed("id", "a"), "a").select("component", F.col("a").alias("id"), "b", "w")), "solve")
    # few bytes are much work here, so the planner is not to put them together by bytes
    parts = rows.count() // TASK_ROWS + 1

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        own = df[df["b"].isna()]
        pairs = df[df["b"].notna()]
        got = greedy(dict(zip(zip(pairs["id"], pairs["b"]), pairs["w"])), dict(zip(own["id"], own["w"])), total)
        return pd.DataFrame({"community": list(got), "into": list(got.values())})

    final = rows.repartition(parts, "component").groupBy("component").applyInPandas(solve, "community string, into string")
    out = member.join(final, "community", "left").select("id", F.coalesce("into", "community").alias("community"))
    return out.join(out.groupBy("community").agg(F.min("id").alias("least")), "community").select("id", F.col("least").alias("community"))
