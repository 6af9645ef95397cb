"""python -m loomgraph extract|query|search|stats|schema|diff|mcp|serve|repos|impact|export|report|skills ... over a stored graph."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from loomgraph.engine import Engine
from loomgraph.plans.skills import overview
from loomgraph.serve import Session, http_server, serve_lines
from loomgraph.sources import sinks


def show(df: DataFrame, limit: int) -> None:
    for r in df.limit(limit).collect():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--store", default="loom_store")
    p.add_argument("--repo", default="default")
    p.add_argument("--limit", type=int, default=100)
    sub = p.add_subparsers(dest="verb", required=True)
    p.add_argument("--registry", default="loom_registry.json")
    e = sub.add_parser("extract")
    e.add_argument("root")
    e.add_argument("--incremental", action="store_true")
    sub.add_parser("query").add_argument("statement")
    s = sub.add_parser("search")
    s.add_argument("text")
    s.add_argument("--kind", default="function")
    sub.add_parser("stats")
    sub.add_parser("schema")
    i = sub.add_parser("impact")
    i.add_argument("id")
    i.add_argument("--direction", default="upstream", choices=("upstream", "downstream", "both"))
    i.add_argument("--depth", type=int, default=3)
    x = sub.add_parser("export")
    x.add_argument("path")
    x.add_argument("--format", default="json", choices=("json", "csv", "graphml"))
    sub.add_parser("report").add_argument("path")
    sub.add_parser("skills")
    sub.add_parser("diff").add_argument("root")
    sub.add_parser("mcp")
    sub.add_parser("serve").add_argument("--port", type=int, default=8080)
    sub.add_parser("repos")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    store = sinks.Store(spark, a.store)
    session = Session(spark, a.store, a.registry, a.repo)
    if a.verb == "extract":
        print(json.dumps(session.call("extract", {"root": a.root, "name": a.repo, "incremental": a.incremental})))
        return None
    if a.verb == "repos":
        print(json.dumps(session.call("repos")))
        return None
    if a.verb == "diff":
        print(json.dumps(session.diff_summary(a.root)))
        return None
    if a.verb == "mcp":
        return serve_lines(session)
    if a.verb == "serve":
        return http_server(session, port=a.port).serve_forever()
    e = Engine(store.load(a.repo))
    if a.verb == "query":
        show(e.query(a.statement), a.limit)
    elif a.verb == "search":
        show(e.search(a.text, a.kind), a.limit)
    elif a.verb == "stats":
        show(e.stats(), a.limit)
    elif a.verb == "schema":
        show(spark.createDataFrame([(k, n, t) for k, df in (("node", e.graph.nodes), ("edge", e.graph.edges)) for n, t in df.dtypes], "kind string, property string, type string"), 1000)
    elif a.verb == "impact":
        show(e.impact(a.id, a.direction, a.depth).orderBy("depth", "id"), a.limit)
    elif a.verb == "export":
        {"json": sinks.write_json, "csv": sinks.write_csv, "graphml": sinks.write_graphml}[a.format](e.graph, a.path)
    elif a.verb == "report":
        with open(a.path, "w", encoding="utf-8") as f:
            f.write(sinks.report(e.graph))
    elif a.verb == "skills":
        print(overview(e.graph))


if __name__ == "__main__":
    main()
