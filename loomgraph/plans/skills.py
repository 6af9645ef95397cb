"""Notes on a graph as Markdown: what it holds, its hubs, its security, its clusters, and what changing hubs would touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.operators.graph import Graph
from loomgraph.operators.impact import taint_paths
from loomgraph.operators.paths import reachable, reverse


def _lines(df, form: str) -> list[str]:
    return [form.format(**r.asDict()) for r in df.collect()]


def overview(graph: Graph, k: int = 10) -> str:
    """The counts by label and type, the k most called functions, and up to k sources, sinks and risky functions."""
    out = ["# Overview", ""]
    out += _lines(graph.stats().orderBy("kind", F.desc("n"), "name"), "- {kind} {name}: {n}")
    f = graph.nodes.filter("label = 'Function'")
    hubs = graph.edges.filter("type = 'CALLS'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).join(f.select("id", "name"), "id")
    out += ["", "## Most called", "", *_lines(hubs.orderBy(F.desc("n"), "id").limit(k), "- {name}: {n}")]
    for title, flag in (("Input sources", "is_input_source"), ("Dangerous sinks", "is_dangerous_sink")):
        if flag in f.columns:
            out += ["", f"## {title}", "", *_lines(f.filter(F.col(flag) == F.lit(True)).select("name", "file").orderBy("file", "name").limit(k), "- {name} ({file})")]
    if "risk_score" in f.columns:
        out += ["", "## High risk", "", *_lines(f.filter("risk_score > 50").select("name", "file", "risk_score").orderBy(F.desc("risk_score"), "name").limit(k), "- {name} ({file}): {risk_score}")]
    return "\n".join(out) + "\n"


def security(graph: Graph, k: int = 20) -> str:
    """Sources, sinks and risky functions, the shortest trails from a source to a sink, and advisories, severest first."""
    e = Engine(graph)
    f = graph.nodes.filter("label = 'Function'")
    out = ["# Security", ""]
    for title, flag in (("Input sources", "is_input_source"), ("Dangerous sinks", "is_dangerous_sink"), ("Allocators", "is_allocator"), ("Cryptography", "is_crypto"), ("Parsers", "is_parser")):
        if flag in f.columns:
            out += [f"## {title}", "", *_lines(f.filter(F.col(flag) == F.lit(True)).select("name", "file").orderBy("file", "name").limit(k), "- {name} ({file})"), ""]
    if {"is_input_source", "is_dangerous_sink"} <= set(f.columns):
        out += ["## From source to sink", "", *_lines(taint_paths(f, e.calls(), 5, k).select("source_name", "sink_name", "depth"), "- {source_name} reaches {sink_name} in {depth}"), ""]
    out += ["## Advisories", "", *_lines(e.find_vulnerabilities(limit=k).select("dependency", "vulnerability", "severity"), "- {dependency}: {vulnerability} ({severity})")]
    return "\n".join(out) + "\n"


def clusters(graph: Graph, k: int = 20) -> dict[str, str]:
    """A note for each of the k largest clusters, by its id: its functions in order of file and name."""
    notes: dict[str, list[str]] = {}
    for r in Engine(graph).cluster_members(k).orderBy("cluster", "place").toLocalIterator():
        notes.setdefault(r["cluster"], [f"# {r['cluster']}", "", f"{r['size']} functions", ""]).append(f"- {r['name']} ({r['file']})")
    return {i: "\n".join(lines) + "\n" for i, lines in notes.items()}


def impact_guide(graph: Graph, k: int = 10) -> str:
    """For the k most called functions: how many functions call them, directly and within three calls."""
    e = Engine(graph)
    f = e.functions().select("id", "name")
    hubs = e.calls().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).join(f, "id").orderBy(F.desc("n"), "id").limit(k)
    far = reachable(reverse(e.calls()), hubs.select("id"), 3).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("reached"))
    rows = hubs.join(far, "id").select("name", "n", "reached").orderBy(F.desc("n"), "name")
    return "\n".join(["# Impact", "", *_lines(rows, "- {name}: called from {n} functions, reached from {reached} within three calls")]) + "\n"
