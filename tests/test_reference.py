"""Graph algebra, resolution, enrichment, sources, data flow and search on small inputs."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loomgraph.engine import Engine, changed_since, extract
from loomgraph.functions import python_front as pf
from loomgraph.functions import text as tx
from loomgraph.operators import enrich, graph, impact, paths, resolve, search
from loomgraph.sources import code_index, files, history, manifests, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dedup(spark):
    n = spark.createDataFrame([("f1", "File", 1, None, "a"), ("f1", "Other", 2, 100, None)], "id string, label string, seq long, size int, name string")
    assert rows(graph.dedup_nodes(n)) == [("f1", "File", 1, 100, "a")]
    e = spark.createDataFrame([("a", "b", "CALLS", 2, "y"), ("a", "b", "CALLS", 1, "x")], "src string, dst string, type string, seq long, p string")
    assert rows(graph.dedup_edges(e)) == [("a", "b", "CALLS", 1, "x")]
    assert rows(graph.Graph(n, e).stats()) == [("edge", "CALLS", 2), ("node", "File", 1), ("node", "Other", 1)]


def test_diff_of_itself_is_empty(spark):
    n = spark.createDataFrame([("a", "L", 1, None), ("b", "L", 2, 3)], "id string, label string, seq long, v int")
    e = spark.createDataFrame([("a", "b", "X", 1)], "src string, dst string, type string, seq long")
    g = graph.Graph(n, e)
    assert graph.diff_summary(g, g, ["v"]).first().asDict() == dict(nodes_added=0, nodes_removed=0, nodes_modified=0, edges_added=0, edges_removed=0, has_changes=False)


def test_bfs_order(spark):
    e = spark.createDataFrame([("m", "b", 2), ("m", "a", 1), ("a", "z", 1), ("b", "c", 1), ("z", "m", 1)], "src string, dst string, seq long")
    got = paths.bfs(e, spark.createDataFrame([("m",)], "id string"), 10).orderBy("step").collect()
    assert [(r["id"], r["step"], r["depth"]) for r in got] == [("m", 0, 0), ("a", 1, 1), ("b", 2, 1), ("z", 3, 2), ("c", 4, 2)]


def test_resolution_levels(spark):
    f = spark.createDataFrame([("h1", "helper", "a.py", 1, 1), ("h50", "helper", "a.py", 50, 2), ("me", "caller", "a.py", 45, 3), ("u", "util", "lib/utils.ts", 3, 4), ("m", "run", "c.py", 1, 5), ("x1", "twice", "c.py", 1, 6), ("x2", "twice", "d.py", 1, 7), ("only", "single", "d.py", 9, 8)], "id string, name string, file string, line_start int, seq long")
    c = spark.createDataFrame([("1", "me", "helper", None), ("2", "me", "run", "Job"), ("3", "me", "util", None), ("4", "me", "twice", None), ("5", "me", "single", None)], "call_id string, caller string, callee string, qualifier string")
    methods = spark.createDataFrame([("Job", "run", "m", 5)], "owner string, name string, id string, seq long")
    imports = spark.createDataFrame([("a.py", "./lib/utils", "util", 1)], "file string, target string, names string, seq long")
    got = resolve.resolve(c, f, methods, imports, f.select(F.col("file").alias("path")).distinct())
    assert {r["call_id"]: (r["target"], r["level"]) for r in got.collect()} == {"1": ("h50", "file"), "2": ("m", "qualifier"), "3": ("u", "import"), "4": (None, None), "5": ("only", "unique")}
    assert {r["dst"] for r in resolve.resolved_edges(got).collect()} == {"h50", "m", "u", "funcref:twice", "only"}


def test_index_calls(spark):
    def msg(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    def occ(line, symbol, role):
        return msg(2, msg(1, bytes([line, 0, 4])) + msg(2, symbol.encode()) + bytes([3 << 3, role]))

    data = msg(2, msg(1, b"a.py") + occ(0, "pkg a/main().", 1) + occ(2, "pkg a/helper().", 0) + occ(9, "pkg a/helper().", 1))
    assert list(code_index.occurrences_of(data))[1] == ("a.py", 2, "pkg a/helper().", False)
    o = code_index.occurrences(spark.createDataFrame([("i", bytearray(data))], "path string, content binary"))
    f = spark.createDataFrame([("f:main", "main", "a.py", 1, 5), ("f:helper", "helper", "a.py", 10, 12)], "id string, name string, file string, line_start int, line_end int")
    assert rows(resolve.index_calls(o, f)) == [("f:main", "f:helper")]


def test_labels_and_risk(spark):
    f = spark.createDataFrame([("1", "recv_data", None), ("2", "memcpy", "void* p"), ("3", "innocent", None), ("4", None, None), ("5", "thread", None)], "id string, name string, params string")
    got = {r["id"]: r for r in enrich.security_labels(f).collect()}
    assert got["1"]["is_input_source"] and got["2"]["is_dangerous_sink"] and got["2"]["touches_unsafe"] and got["2"]["risk_score"] == 50
    assert got["3"]["risk_score"] == 0 and got["4"]["risk_score"] is None and got["5"]["is_input_source"]


def test_vulnerabilities(spark):
    d = spark.createDataFrame([("lodash", "^4.17.0", "package.json"), ("nover", "", "package.json"), ("x", "1", "unknown")], "name string, version string, source string")
    o = spark.createDataFrame([("V-1", "npm", "lodash", ["4.17.0"], "bad", "9.8", "HIGH")], "vuln_id string, ecosystem string, package string, versions array<string>, summary string, severity string, severity_label string")
    assert rows(enrich.vulnerabilities(d, o)) == [("dep:lodash", "V-1", "bad", "9.8", "HIGH")]


def test_processes(spark):
    f = spark.createDataFrame([("m", "main", "a.c", False, None, None), ("r", "read", "a.c", False, None, None), ("x", "exec", "a.c", False, None, None), ("l", "lone", "a.c", True, None, None)], "id string, name string, file string, is_exported boolean, is_input_source boolean, is_dangerous_sink boolean")
    c = spark.createDataFrame([("m", "r", 1), ("r", "x", 2)], "src string, dst string, seq long")
    p = enrich.processes(f, c)
    assert rows(p) == [("process:m", "m", 0), ("process:m", "r", 1), ("process:m", "x", 2)]
    assert rows(enrich.classify(p, f)) == [("process:m", "data_flow", 3)]


def test_impact(spark):
    e = spark.createDataFrame([("a", "b", "scip"), ("b", "c", "heuristic"), ("c", "d", None), ("c", "a", "scip")], "src string, dst string, source string")
    p = impact.impact(e, spark.createDataFrame([("a",)], "id string"), "downstream", 3)
    assert sorted((r["id"], r["bucket"], r["confidence"]) for r in p.collect()) == [("a", "transitive", "medium"), ("b", "immediate", "high"), ("c", "downstream", "medium"), ("d", "transitive", "medium")]
    s = impact.summary(p).first()
    assert (s["total"], s["scip_edges"], s["heuristic_edges"], s["unknown_edges"], s["confidence"]) == (4, 5, 3, 1, "medium")


def test_search(spark):
    assert spark.range(1).select(search.tokens(F.lit("parseData XMLHttp2 a_b"))).first()[0][:3] == ["parsedata", "parse", "data"]
    d = spark.createDataFrame([("1", "parse", "parse parse input", True), ("2", "other", "nothing here", None), ("3", "parse_more", "parse", None)], "id string, name string, text string, is_input_source boolean")
    got = search.fused(d, "parse").orderBy(F.desc("score")).collect()
    assert got[0]["id"] == "1" and all(0 <= r["score"] <= 1 for r in got) and {r["id"] for r in got} == {"1", "3"}
    long = "x" * 300 + " needle " + "y" * 300
    assert "needle" in spark.createDataFrame([(long,)], "t string").select(search.snippet(F.col("t"), ["needle"])).first()[0]


def test_text(spark):
    d = spark.createDataFrame([("a.c", "x // TODO fix\r\nunsafe { }\n// HACK BUG\n")], "path string, text string")
    assert [(r["line"], r["type"]) for r in tx.annotations(d).orderBy("line", "type").collect()] == [(1, "TODO"), (2, "UNSAFE"), (3, "BUG"), (3, "HACK")]
    cases = {"#include <stdio.h>": "stdio.h", "use std::io;": "std::io", "import x from './y'": "./y", "from os import path": "os", "import os.path": "os.path"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", tx.import_target(F.col("s")).alias("t")).collect()} == cases
    df = spark.createDataFrame([("a->b.c",), ("x::y::z",), ("self.run",), ("plain",)], "s string").select(tx.call_parts(F.col("s")).alias("c"))
    assert [tuple(r["c"]) for r in df.collect()] == [("b.c", "a"), ("z", "x::y"), ("run", None), ("plain", None)]


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { version = "1" }\n[dev-dependencies]\ncriterion = "0.5"', ["serde", "tokio", "criterion"]),
        ("package.json", '{"dependencies": {"express": "^4"}, "devDependencies": {"jest": "1"}}', ["express", "jest"]),
        ("go.mod", "module x\nrequire (\n  a.com/b v1.2\n  c.com/d v0.1\n)\nrequire e.com/f v2", ["a.com/b", "c.com/d", "e.com/f"]),
        ("CMakeLists.txt", "find_package(OpenSSL 1.1)\nFetchContent_Declare(googletest)", ["OpenSSL", "googletest"]),
        ("Podfile", "pod 'Alamofire', '~> 5.0'\npod 'SwiftyJSON'", ["Alamofire", "SwiftyJSON"]),
        ("build.gradle", "implementation 'g:a:1'\napi(\"h:b\")", ["g:a", "h:b"]),
        ("conanfile.txt", "[requires]\nzlib/1.2\n[generators]\ncmake/x", ["zlib"]),
        ("vcpkg.json", '{"dependencies": ["fmt", {"name": "zlib", "version>=": "1"}]}', ["fmt", "zlib"]),
        ("Package.swift", '.package(url: "https://x/y/Vapor.git", from: "4")', ["Vapor"]),
        ("package.json", "not json", []),
    ],
)
def test_manifests(name, text, want):
    assert [n for n, _, _ in manifests.parse(name, text)] == want


def test_history(spark):
    a, b = "a" * 40, "b" * 40
    log = f"{a}|{b}|Ann|ann@x|2024-02-01T00:00:00Z|Fix buffer overflow | now\n\n3\t1\tsrc/a.c\n-\t-\tlogo.png\n{b}||Bob|bob@x|2024-01-01T00:00:00Z|start\n\n5\t0\tsrc/a.c"
    l = history.lines_of(spark, log)
    c = {r["hash"]: r for r in history.commit_nodes(l).collect()}
    assert c[a]["message"] == "Fix buffer overflow | now" and c[a]["parents"] == [b] and (c[a]["total_insertions"], c[a]["files_changed"]) == (3, 2) and c[a]["is_security_fix"] and not c[b]["is_security_fix"]
    assert {r["path"]: (r["churn_count"], r["last_modified"][:7]) for r in history.churn(l).collect()} == {"src/a.c": (2, "2024-02"), "logo.png": (1, "2024-02")}
    assert {r["type"]: r["count"] for r in history.edges(l).groupBy("type").count().collect()} == {"AUTHORED_BY": 2, "PARENT": 1, "MODIFIED_IN": 3, "FIXED_BY": 1, "AFFECTS": 2}


def flow(code):
    import ast

    return pf.Flow(ast.parse(code).body[0]).blocks


def test_data_flow():
    f = pf.flows(flow("def f():\n    a = 1\n    b = a\n    c = b\n"))
    assert [(x[0], x[2]) for x in f] == [("a", "b"), ("b", "c")]
    assert len(flow("def f(x):\n    if x:\n        y = 1\n    else:\n        y = 2\n    return y\n")) >= 3
    loop = flow("def f(x):\n    for i in x:\n        y = i\n    return y\n")
    assert len(loop) >= 4 and any(s <= b.index for b in loop for s in b.after)
    assert pf.taints(flow("def f():\n    d = recv(s)\n    e = d\n    os.system(e)\n")) == [("recv", "os.system", "e")]
    assert pf.taints(flow("def f():\n    d = 1\n    os.system(d)\n")) == []


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nfrom x import y\n\nclass A(B):\n    def run(self, n):\n        # TODO later\n        return helper(n)\n\ndef helper(n):\n    d = input_read(n)\n    os.system(d)\n")
    (tmp_path / "src" / "bad.py").write_text("def (:")
    (tmp_path / "node_modules" / "z.js").write_text("x")
    (tmp_path / "package.json").write_text('{"dependencies": {"express": "^4"}}')
    return tmp_path


def test_extract_store_and_verbs(spark, tree, tmp_path):
    g = extract(spark, str(tree))
    labels = {r["name"]: r["n"] for r in g.stats().filter("kind = 'node'").collect()}
    assert labels["File"] == 2 and labels["Function"] == 4 and labels["Class"] == 1 and labels["Dependency"] == 1 and labels["Annotation"] == 1
    assert "func:src/a.py:helper:8" in {r["id"] for r in g.nodes.collect()}
    s = sinks.Store(spark, str(tmp_path / "store"))
    s.upsert(g, "one")
    s.upsert(g, "one")
    back = s.load("one")
    assert back.nodes.count() == g.nodes.count() and back.edges.count() == g.stored_edges().count()
    e = Engine(back)
    assert rows(e.search("help*").select("name")) == [("helper",)]
    assert e.query("MATCH (f:Function)<-[:CONTAINS]-(c:Class) RETURN f.name, c.name").collect() == [("run", "A")]
    assert sinks.graphml(g).count("<node ") == g.nodes.count() and "<h2>Counts</h2>" in sinks.report(g)
    sinks.write_csv(g, str(tmp_path / "csv"))
    sinks.write_json(g, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/nodes")).count() == g.nodes.count()
    old = spark.createDataFrame([(r["path"], r["hash"]) for r in files.source_files(spark, str(tree)).collect()], "path string, hash string")
    (tree / "src" / "a.py").write_text("x = 1\n")
    (tree / "src" / "new.py").write_text("y = 1\n")
    os.remove(tree / "src" / "bad.py")
    assert rows(changed_since(spark, str(tree), old)) == [("src/a.py", "modified"), ("src/bad.py", "deleted"), ("src/new.py", "added")]


def test_stream(spark, tree, tmp_path):
    from loomgraph.streaming.incremental import annotation_stream

    out, at = str(tmp_path / "out"), str(tmp_path / "ck")
    annotation_stream(spark, str(tree / "src"), out, at).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    (tree / "src" / "more.py").write_text("# FIXME\n# HACK\n")
    annotation_stream(spark, str(tree / "src"), out, at).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_git_dump(tmp_path):
    if subprocess.run(["git", "init", "-q", str(tmp_path)]).returncode:
        pytest.skip("no git")
    (tmp_path / "a").write_text("1\n")
    subprocess.run(["git", "-C", str(tmp_path), "add", "a"])
    subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "one"])
    assert "1\t0\ta" in history.dump(str(tmp_path)) and history.dump(str(tmp_path / "no")) == ""


def test_entry_without_llm(tmp_path):
    """The entry module imports and offers its other queries when the subpackage and the pipeline are gone."""
    import shutil
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'taint_paths' in q and not any(k.startswith('op') for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
