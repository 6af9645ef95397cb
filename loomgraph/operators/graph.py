"""Graph container algebra: nodes(id, label, seq, properties...) and edges(src, dst, type, seq, properties...)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_KEY, EDGE_KEY = ("id",), ("src", "dst", "type")


def last_present(value: str, order: str = "seq") -> Column:
    """The value of the last row, in order, that has one."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def merge(self, other: Graph) -> Graph:
        """All rows of both; nothing is made distinct."""
        return Graph(self.nodes.unionByName(other.nodes, allowMissingColumns=True), self.edges.unionByName(other.edges, allowMissingColumns=True))

    def deduplicate(self) -> Graph:
        return Graph(dedup_nodes(self.nodes), dedup_edges(self.edges))

    def stats(self) -> DataFrame:
        """(kind, name, n): nodes by label and edges by type."""
        n = self.nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
        e = self.edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
        return n.unionByName(e).select("kind", "name", "n")

    def stored_edges(self) -> DataFrame:
        """Edges whose ends both exist; a store keeps no others."""
        ids = self.nodes.select("id").distinct()
        return self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*self.edges.columns)


def dedup_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: the label of the first, and of each property the last value that is present."""
    rest = [c for c in nodes.columns if c not in ("id", "label", "seq")]
    return nodes.groupBy("id").agg(F.min_by("label", "seq").alias("label"), F.min("seq").alias("seq"), *(last_present(c).alias(c) for c in rest)).select(*nodes.columns)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst, type): the first one whole."""
    rest = [c for c in edges.columns if c not in EDGE_KEY]
    one = edges.groupBy(*EDGE_KEY).agg(F.min_by(F.struct(*rest), "seq").alias("x"))
    return one.select(*EDGE_KEY, *(F.col(f"x.{c}").alias(c) for c in rest)).select(*edges.columns)


def added(old: DataFrame, new: DataFrame, key: tuple[str, ...] = NODE_KEY) -> DataFrame:
    """Rows of new whose key old lacks."""
    return new.join(old.select(*key).distinct(), list(key), "left_anti").select(*new.columns)


def modified(old: DataFrame, new: DataFrame, properties: list[str]) -> DataFrame:
    """(id, property, old, new): properties, as strings, that differ between nodes that both have; absent is null."""
    changes = F.array(*(F.when(~F.col(f"o.{p}").eqNullSafe(F.col(f"n.{p}")), F.struct(F.lit(p).alias("property"), F.col(f"o.{p}").cast("string").alias("old"), F.col(f"n.{p}").cast("string").alias("new"))) for p in properties))
    both = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"))
    return both.select(F.col("n.id").alias("id"), F.explode(F.array_compact(changes)).alias("c")).select("id", "c.property", "c.old", "c.new")


def diff_summary(old: Graph, new: Graph, properties: list[str]) -> DataFrame:
    """One row: nodes_added, nodes_removed, nodes_modified, edges_added, edges_removed, has_changes."""
    parts = [
        ("nodes_added", added(old.nodes, new.nodes).select("id")), ("nodes_removed", added(new.nodes, old.nodes).select("id")),
        ("nodes_modified", modified(old.nodes, new.nodes, properties).select("id").distinct()),
        ("edges_added", added(old.edges, new.edges, EDGE_KEY).select(F.col("src").alias("id"))), ("edges_removed", added(new.edges, old.edges, EDGE_KEY).select(F.col("src").alias("id"))),
    ]
    rows = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.agg(*(F.count(F.when(F.col("part") == n, 1)).alias(n) for n, _ in parts))
    return counts.withColumn("has_changes", sum((F.col(n) for n, _ in parts), F.lit(0)) > 0)


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two manifests (path, hash): added, deleted or modified; unchanged files are left out."""
    both = old.select("path", F.col("hash").alias("h0"), F.lit(True).alias("in0")).join(new.select("path", F.col("hash").alias("h1"), F.lit(True).alias("in1")), "path", "full")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "deleted").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def label_rollup(nodes: DataFrame) -> DataFrame:
    """(label, n) with a row for all nodes, called _Node."""
    return nodes.rollup("label").agg(F.count("*").alias("n")).withColumn("label", F.coalesce("label", F.lit("_Node")))
