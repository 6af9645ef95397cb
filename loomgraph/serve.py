"""Thin shells over the engine: tools by name, a line-by-line tool server, and HTTP routes. Answers are JSON values."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO, Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.engine import Engine, extract, incremental
from loomgraph.operators.graph import diff_summary
from loomgraph.sources.sinks import Store, report
from loomgraph.sources.state import Cache, Registry

#: Rows of an answer, at most.
ROWS = 200
RESOURCES = ("schema", "security", "clusters", "processes")
#: Tools, the arguments that they need and those that they may have. Those of FREE work without an active repository, and
#: answers of FRESH are not remembered.
TOOLS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "query": (("text",), ("limit", "label")), "cypher": (("statement",), ("params",)), "search": ((), ("text", "kind", "file", "limit")), "search_calls": ((), ("caller", "callee", "depth", "source")),
    "impact": (("id",), ("direction", "depth")), "context": (("id",), ()), "detect_changes": (("files",), ()), "find_vulnerabilities": ((), ("severity", "limit")), "stats": ((), ()), "source": (("id",), ()),
    "extract": (("root",), ("name", "incremental")), "repos": ((), ()), "use_repo": (("name",), ()),
}
FREE, FRESH = frozenset(("extract", "repos", "use_repo")), frozenset(("extract", "use_repo", "repos"))


class Unknown(ValueError):
    """A tool, argument, repository or resource that there is not."""


def payload(df: DataFrame, limit: int = ROWS) -> list[dict[str, Any]]:
    return [json.loads(x) for x in df.limit(limit).select(F.to_json(F.struct(*df.columns)).alias("x")).toPandas()["x"]]


class Session:
    """Tools over the repositories of one store, of which one is active."""

    def __init__(self, spark: SparkSession, store: str, registry: str, active: str | None = None):
        self.spark, self.store, self.registry, self.cache = spark, Store(spark, store), Registry(registry), Cache()
        self.active = active

    def engine(self) -> Engine:
        if self.active is None:
            raise Unknown("no repository is active: use_repo or extract first")
        return Engine(self.store.load(self.active))

    def call(self, name: str, args: dict[str, Any] | None = None) -> Any:
        args = {k: v for k, v in (args or {}).items() if v is not None}
        if name not in TOOLS:
            raise Unknown(f"no tool {name}")
        need, may = TOOLS[name]
        if missing := [k for k in need if k not in args]:
            raise Unknown(f"{name} needs {', '.join(missing)}")
        if extra := [k for k in args if k not in need + may]:
            raise Unknown(f"{name} has no {', '.join(extra)}")
        if name not in FREE and self.active is None:
            raise Unknown("no repository is active: use_repo or extract first")
        keyed = args | {"_repo": self.active}
        if name not in FRESH and (held := self.cache.get(name, keyed)) is not None:
            return held
        out = getattr(self, f"_{name}")(**args)
        if name not in FRESH:
            self.cache.put(name, keyed, out)
        return out

    # --- tools
    def _query(self, text: str, limit: int = 20, label: str | None = None):
        return payload(self.engine().ranked(text, limit, label))

    def _cypher(self, statement: str, params: dict | None = None):
        return payload(self.engine().query(statement, **(params or {})))

    def _search(self, text: str = "*", kind: str = "function", file: str | None = None, limit: int = 100):
        return payload(self.engine().search(text, kind, file, limit), limit)

    def _search_calls(self, **args):
        return payload(self.engine().search_calls(**args))

    def _impact(self, id: str, direction: str = "upstream", depth: int = 3):  # noqa: A002
        return payload(self.engine().impact(id, direction, depth).orderBy("depth", "id"))

    def _context(self, id: str):  # noqa: A002
        e = self.engine()
        return {"properties": {r["property"]: r["value"] for r in payload(e.properties(id))}, "related": payload(e.context(id))} if e.exists(id) else None

    def _detect_changes(self, files: list[str]):
        changed = self.spark.createDataFrame([(f,) for f in files], "path string")
        return {k: payload(df) for k, df in self.engine().change_report(changed).items()}

    def _find_vulnerabilities(self, severity: str | None = None, limit: int = ROWS):
        return payload(self.engine().find_vulnerabilities(severity, limit), limit)

    def _stats(self):
        return payload(self.engine().stats().orderBy("kind", F.desc("n"), "name"))

    def _source(self, id: str):  # noqa: A002
        return next(iter(payload(self.engine().source(id))), None)

    def _extract(self, root: str, name: str | None = None, incremental: bool = False):
        from loomgraph.sources.history import repo_name

        repo = name or repo_name(root)
        if incremental:
            how = _incremental(self.spark, root, self.store, repo, f"{self.store.path}/_manifest_{repo}")
        else:
            how = "full"
            self.store.clear(repo)
            self.store.upsert(extract(self.spark, root), repo)
        self.active = repo
        self.cache = Cache()
        counts = {r["name"]: r["n"] for r in self._stats()}
        self.registry.register(root.split("://")[-1], self.store.path, counts=counts)
        return {"repo": repo, "how": how, "counts": counts}

    def _repos(self):
        return [vars(e) | {"active": e.name == self.active} for e in self.registry.all()]

    def _use_repo(self, name: str):
        if self.registry.get(name) is None:
            raise Unknown(f"no repository {name}")
        self.active = name
        return {"repo": name}

    # --- resources and what only HTTP has
    def resource(self, name: str) -> Any:
        e = self.engine()
        if name == "schema":
            return {k: [r["name"] for r in payload(df)] for k, df in e.schema().items()}
        if name == "security":
            f = e.functions()
            by = {"sources": f.filter("is_input_source = true"), "sinks": f.filter("is_dangerous_sink = true"), "high_risk": f.filter("risk_score > 50").orderBy(F.desc("risk_score"), "id")}
            return {k: payload(df.select("id", "name", "file", "risk_score")) for k, df in by.items()} | {"vulnerabilities": self._find_vulnerabilities()}
        if name == "clusters":
            return payload(e.clusters().select("id", "name", "size"))
        if name == "processes":
            return payload(e.processes().select("id", "name", "step_count"))
        raise Unknown(f"no resource {name}")

    def neighbours(self, id: str) -> Any:  # noqa: A002
        e = self.engine().graph.edges
        out = e.filter(F.col("src") == id).select("type", F.col("dst").alias("id"), F.lit("out").alias("way"))
        return payload(out.unionByName(e.filter(F.col("dst") == id).select("type", F.col("src").alias("id"), F.lit("in").alias("way"))))

    def diff_summary(self, root: str) -> Any:
        """What extracting the tree again would change in the active repository."""
        now, old = extract(self.spark, root), self.engine().graph
        both = [c for c in ("name", "file", "line_start", "line_end", "params", "is_exported") if c in now.nodes.columns and c in old.nodes.columns]
        return payload(diff_summary(old, type(old)(now.nodes, now.stored_edges()), both))[0]


_incremental = incremental


def serve_lines(session: Session, source: IO[str] = sys.stdin, to: IO[str] = sys.stdout) -> None:
    """A tool server: a JSON-RPC request a line in, an answer a line out; notifications have none."""

    def answer(method: str, p: dict) -> Any:
        if method == "initialize":
            return {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "loomgraph", "version": "1"}, "capabilities": {"tools": {}, "resources": {}}}
        if method == "tools/list":
            return {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {} for k in need + may}, "required": list(need)}} for n, (need, may) in TOOLS.items()]}
        if method == "tools/call":
            return {"content": [{"type": "text", "text": json.dumps(session.call(p.get("name", ""), p.get("arguments")), default=str)}]}
        if method == "resources/list":
            return {"resources": [{"uri": f"loomgraph://{n}", "name": n} for n in RESOURCES]}
        if method == "resources/read":
            uri = p.get("uri", "")
            return {"contents": [{"uri": uri, "text": json.dumps(session.resource(uri.rsplit("/", 1)[-1]), default=str)}]}
        raise Unknown(f"no method {method}")

    for line in source:
        if not line.strip():
            continue
        q: dict[str, Any] = {"id": None}
        try:
            q = json.loads(line)
            out: dict[str, Any] = {"jsonrpc": "2.0", "id": q.get("id"), "result": answer(q.get("method", ""), q.get("params") or {})}
        except (ValueError, FileNotFoundError) as e:
            out = {"jsonrpc": "2.0", "id": q.get("id"), "error": {"code": -32602, "message": str(e)}}
        if "id" in q:
            print(json.dumps(out), file=to, flush=True)


def routes(session: Session) -> dict[str, Callable[[dict[str, str]], Any]]:
    """GET routes by path; each takes the query's arguments."""
    edge = lambda who: lambda q: [r for r in session.call("context", {"id": q.get("id", "")})["related"] if r["relation"] == who]
    return {
        "/": lambda q: report(session.engine().graph), "/api/stats": lambda q: session.call("stats"), "/api/schema": lambda q: session.resource("schema"),
        "/api/search": lambda q: session.call("search", {"text": q.get("q", "*"), "kind": q.get("type", "function"), "limit": int(q.get("limit", 50))}),
        "/api/node": lambda q: session.call("context", {"id": q.get("id", "")}), "/api/callers": edge("caller"), "/api/callees": edge("callee"), "/api/security": lambda q: session.resource("security"),
        "/api/clusters": lambda q: session.resource("clusters"), "/api/processes": lambda q: session.resource("processes"), "/api/graph/neighbors": lambda q: session.neighbours(q.get("id", "")),
    }


def http_server(session: Session, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    known = routes(session)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path)
            status, body, kind = 200, "", "application/json"
            if at.path not in known:
                status, body = 404, json.dumps({"error": "no such route"})
            else:
                try:
                    got = known[at.path]({k: v[0] for k, v in parse_qs(at.query).items()})
                    status, body = (404, json.dumps({"error": "not found"})) if got is None else (200, got if at.path == "/" else json.dumps(got, default=str))
                    kind = "text/html; charset=utf-8" if at.path == "/" else kind
                except (ValueError, TypeError, FileNotFoundError) as e:
                    status, body = 400, json.dumps({"error": str(e)})
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
