"""Paths over edges(src, dst, ...): trails, reachability, descendants, breadth-first order, components.

Trail enumeration is one row a path, with no edge twice on a path, in chained equi-joins; predicates on all edges of a path
are for the caller to apply to the edges beforehand. What needs only end points uses the reachability forms, which keep
one row a pair or a node and don't grow with the number of paths."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import dropped, stored


def trails(edges: DataFrame, starts: DataFrame, depth: int, carry: tuple[str, ...] = (), shortest: int = 1) -> DataFrame:
    """(start, end, depth, nodes array, <carry>s arrays) of every trail of shortest..depth edges from starts(id)."""
    e = edges.select("src", "dst", *carry)
    eid = F.concat_ws("\u0001", "src", "dst")
    cur = starts.select(F.col("id").alias("start")).join(e, F.col("start") == F.col("src")).select(
        "start", F.col("dst").alias("end"), F.lit(1).alias("depth"), F.array("start", "dst").alias("nodes"), F.array(eid).alias("eids"), *(F.array(c).alias(f"{c}s") for c in carry))
    out = cur
    for d in range(2, depth + 1):
        cur = cur.join(e, F.col("end") == F.col("src")).filter(~F.array_contains("eids", eid)).select(
            "start", F.col("dst").alias("end"), F.lit(d).alias("depth"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("eids", F.array(eid)).alias("eids"),
            *(F.concat(f"{c}s", F.array(c)).alias(f"{c}s") for c in carry))
        out = out.unionByName(cur)
    return out.filter(F.col("depth") >= shortest).drop("eids")


def trails_between(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int, carry: tuple[str, ...] = ()) -> Iterator[DataFrame]:
    """Trails of exactly 1, 2, ... depth edges from starts(id) to ends(id), one table a length, columns as trails(). Before a
    step is taken it is known how far each node is from the nearest end, so only steps that can still reach one are."""
    e = edges.select("src", "dst", *carry)
    far = reachable(reverse(e), ends, depth).groupBy(F.col("end").alias("dst")).agg(F.min("depth").alias("far"))
    far = stored(far.unionByName(ends.select(F.col("id").alias("dst"), F.lit(0).alias("far"))).groupBy("dst").agg(F.min("far").alias("far")), "far")
    e = stored(e.join(far, "dst").select("src", "dst", "far", *carry), "edges")
    eid = F.concat_ws("\u0001", "src", "dst")
    cur = starts.select(F.col("id").alias("start")).join(e.filter(F.col("far") < depth), F.col("start") == F.col("src")).select(
        "start", F.col("dst").alias("end"), F.lit(1).alias("depth"), F.array("start", "dst").alias("nodes"), F.array(eid).alias("eids"), *(F.array(c).alias(f"{c}s") for c in carry))
    for d in range(1, depth + 1):
        if d > 1:
            cur = cur.join(e.filter(F.col("far") <= depth - d), F.col("end") == F.col("src")).filter(~F.array_contains("eids", eid)).select(
                "start", F.col("dst").alias("end"), F.lit(d).alias("depth"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("eids", F.array(eid)).alias("eids"),
                *(F.concat(f"{c}s", F.array(c)).alias(f"{c}s") for c in carry))
        cur = stored(cur, "trails")
        yield cur.join(ends.select(F.col("id").alias("end")).distinct(), "end", "left_semi").drop("eids")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, end, depth): pairs within depth hops, with the least number; the start itself only by a cycle."""
    e = stored(edges.select("src", "dst").distinct(), "edges")
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("end")).distinct()
    out = None
    for d in range(1, depth + 1):
        level = level.join(e, F.col("end") == F.col("src")).select("start", F.col("dst").alias("end")).distinct()
        if d > 1:
            level = level.join(out.select("start", "end"), ["start", "end"], "left_anti")
        level = stored(level, "reach")
        one = level.withColumn("depth", F.lit(d))
        out = one if out is None else out.unionByName(one)
    return out


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of the roots and everything reachable from them over any number of edges, semi-naively."""
    e = stored(edges.select("src", "dst").distinct(), "edges")
    seen = stored(roots.select("id").distinct().withColumn("depth", F.lit(0)), "desc")
    front, d = seen, 0
    while True:
        d += 1
        nxt = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = stored(nxt.withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if d % 10 == 0:
            seen = stored(seen, "desc")


def bfs(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, depth, step): what a queue visits from each start within depth hops, in its order. A node's place is that
    of the first visited node that leads to it, then the edge's seq (null first), then its id. A level is ordered by the
    places of the one before, so what a row carries doesn't grow with the depth."""
    e = stored(edges.groupBy("src", "dst").agg(F.min("seq").alias("seq")), "calls")
    cur = stored(starts.select(F.col("id").alias("start"), F.col("id")).distinct().select("start", "id", F.lit(0).alias("depth"), F.lit(0).alias("step")), "bfs")
    seen = cur
    for d in range(1, depth + 1):
        nxt = cur.join(e, F.col("id") == F.col("src")).groupBy("start", F.col("dst").alias("id")).agg(F.min(F.struct("step", "seq", "dst")).alias("place"))
        nxt = nxt.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        base = seen.groupBy("start").agg(F.max("step").alias("base"))
        rank = F.row_number().over(Window.partitionBy("start").orderBy("place"))
        cur = stored(nxt.join(base, "start").select("start", "id", F.lit(d).alias("depth"), (F.col("base") + rank).cast("int").alias("step")), "bfs")
        if cur.isEmpty():
            break
        seen = seen.unionByName(cur)
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id that each of nodes(id) is joined to, edges taken as undirected. Stars are turned
    alternately towards greater and smaller neighbours, in O(log n) rounds."""
    pairs = edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    cur, mark = stored(pairs.distinct(), "cc"), None
    last = cur
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        little = big.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = stored(little.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
        dropped(last)
        last = cur
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    lab = cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return nodes.select("id").distinct().join(lab, "id", "left").withColumn("component", F.coalesce("component", "id"))
