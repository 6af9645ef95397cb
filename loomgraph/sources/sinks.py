"""Stores and exports of a graph."""

from __future__ import annotations

import os
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import EDGE_KEY, Graph, dedup_edges, dedup_nodes
from loomgraph.operators.paths import descendants
from loomgraph.plans.storage import stored


def _union(old: DataFrame | None, new: DataFrame, later: int) -> DataFrame:
    new = new.withColumn("seq", F.struct(F.lit(later), F.col("seq")))
    return new if old is None else old.withColumn("seq", F.struct(F.lit(later - 1), F.col("seq"))).unionByName(new, allowMissingColumns=True)


class Store:
    """Nodes by repo and label, edges by repo and type, as Parquet. An upsert keeps the first label, sets the properties that
    are present, drops edges whose ends don't exist, and replaces the repo's partitions only once all is written apart."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{kind}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def load(self, repo: str | None = None) -> Graph:
        n, e = self._read("nodes"), self._read("edges")
        if n is None:
            raise FileNotFoundError(self.path)
        e = self.spark.createDataFrame([], "src string, dst string, type string, seq long, repo string") if e is None else e
        return Graph(n, e) if repo is None else Graph(n.filter(F.col("repo") == repo), e.filter(F.col("repo") == repo))

    def upsert(self, graph: Graph, repo: str) -> None:
        old_n, old_e = self._read("nodes"), self._read("edges")
        mine = lambda d: None if d is None else d.filter(F.col("repo") == repo).drop("repo")
        nodes = dedup_nodes(_union(mine(old_n), graph.nodes.drop("repo"), 1)).withColumn("seq", F.col("seq.seq"))
        edges = dedup_edges(_union(mine(old_e), graph.edges.drop("repo"), 1)).withColumn("seq", F.col("seq.seq"))
        edges = Graph(nodes, edges).stored_edges()
        schema = {}
        for kind, df, by in (("nodes", nodes, "label"), ("edges", edges, "type")):
            df = df.withColumn("repo", F.lit(repo))
            schema[kind] = df.schema
            df.write.mode("overwrite").partitionBy("repo", by).parquet(f"{self.path}/_next_{kind}")
        for kind, by in (("nodes", "label"), ("edges", "type")):
            new = self.spark.read.schema(schema[kind]).parquet(f"{self.path}/_next_{kind}")
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", by).parquet(f"{self.path}/{kind}")

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self, repo: str) -> None:
        for kind in ("nodes", "edges"):
            self._delete(f"{self.path}/{kind}/repo={repo}")

    def clear_all(self) -> None:
        for kind in ("nodes", "edges"):
            self._delete(f"{self.path}/{kind}")

    def delete_files(self, repo: str, files: DataFrame) -> None:
        """Takes files(path), all that they contain, and the edges of these out of a repo."""
        g = self.load(repo)
        inside = g.edges.filter(F.col("type").isin("CONTAINS", "HAS_ANNOTATION"))
        gone = descendants(inside, files.select(F.concat(F.lit("file:"), "path").alias("id"))).select("id").distinct()
        nodes = g.nodes.join(gone, "id", "left_anti")
        edges = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = Graph(stored(nodes, "left"), stored(edges, "left"))
        self.clear(repo)
        self.upsert(left, repo)


def write_json(graph: Graph, path: str) -> None:
    """Nodes, edges and stats as JSON lines, one folder each."""
    graph.nodes.write.mode("overwrite").json(f"{path}/nodes")
    graph.edges.write.mode("overwrite").json(f"{path}/edges")
    graph.stats().coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def json_document(graph: Graph) -> str:
    """Nodes, edges and stats as one JSON document, for graphs small enough for a file. Properties without a value are left
    out; nodes are in order of their id, edges of their ends."""
    part = lambda df, by: [r[0] for r in df.select(*by, F.to_json(F.struct(*df.columns)).alias("x")).orderBy(*by).select("x").toLocalIterator()]
    lists = {"nodes": part(graph.nodes, ["id"]), "edges": part(graph.edges, ["src", "dst", "type"]), "stats": part(graph.stats(), ["kind", "name"])}
    return "{" + ", ".join(f'"{k}": [{", ".join(v)}]' for k, v in lists.items()) + "}"


def write_csv(graph: Graph, path: str) -> None:
    """Both tables with a header; the columns are the union of the properties, as text."""
    for kind, df in (("nodes", graph.nodes), ("edges", graph.edges)):
        flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c).cast("string").alias(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{path}/{kind}")


def graphml(graph: Graph) -> str:
    """One GraphML document, for graphs small enough for a file. Of parallel edges between two nodes the last stays."""
    last = graph.edges.groupBy("src", "dst").agg(F.max_by(F.struct("type"), "seq").alias("e")).select("src", "dst", "e.type").orderBy("src", "dst")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="type" for="edge" attr.name="type" attr.type="string"/>', '<graph edgedefault="directed">']
    out += [f'<node id={quoteattr(r["id"])}><data key="label">{escape(r["label"] or "")}</data></node>' for r in graph.nodes.select("id", "label").orderBy("id").toLocalIterator()]
    out += [f'<edge source={quoteattr(r["src"])} target={quoteattr(r["dst"])}><data key="type">{escape(r["type"])}</data></edge>' for r in last.toLocalIterator()]
    return "\n".join([*out, "</graph>", "</graphml>"])


def write_graphml(graph: Graph, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(graphml(graph))


def report(graph: Graph, k: int = 20) -> str:
    """An HTML page: counts, riskiest functions, sources, sinks, advisories, clusters and processes."""
    n = graph.nodes
    has = lambda *c: set(c) <= set(n.columns)
    tables = {"Counts": graph.stats().orderBy("kind", F.desc("n"), "name")}
    f = n.filter("label = 'Function'")
    if has("risk_score"):
        tables["High risk"] = f.filter("risk_score > 50").select("name", "file", "risk_score").orderBy(F.desc("risk_score"), "name").limit(k)
        tables["Input sources"] = f.filter("is_input_source = true").select("name", "file").orderBy("file", "name").limit(k)
        tables["Dangerous sinks"] = f.filter("is_dangerous_sink = true").select("name", "file").orderBy("file", "name").limit(k)
    if has("severity"):
        v = n.filter("label = 'Vulnerability'").select(F.col("id").alias("dst"), "severity")
        tables["Advisories"] = graph.edges.filter("type = 'AFFECTED_BY'").join(v, "dst").select("src", "dst", "severity").orderBy(F.desc("severity"), "src").limit(k)
    for title, label, by in (("Clusters", "Cluster", "size"), ("Processes", "Process", "step_count")):
        if has(by):
            tables[title] = n.filter(F.col("label") == label).select("name", by).orderBy(F.desc(by), "name").limit(k)
    html = ["<!doctype html><meta charset='utf-8'><title>Code graph</title>"]
    for title, df in tables.items():
        rows = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        html.append(f"<h2>{escape(title)}</h2><table><tr>{''.join(f'<th>{escape(c)}</th>' for c in df.columns)}</tr>{rows}</table>")
    return "\n".join(html)


__all__ = ["EDGE_KEY", "Store", "graphml", "json_document", "report", "write_csv", "write_graphml", "write_json"]
