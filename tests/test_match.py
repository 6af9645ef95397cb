"""Statements of the pattern language on a small graph."""

import pytest

from loomgraph.operators.graph import Graph
from loomgraph.plans.match import Refused, run

NODES = [
    ("f1", "Function", "parse_data", "src/a.c", 30, None, True), ("f2", "Function", "read_file", "src/a.c", 60, True, None), ("f3", "Function", "exec_cmd", "lib/b.c", 90, None, True),
    ("f4", "Function", "helper", "lib/b.c", 0, None, None), ("c1", "Class", "Parser", "src/a.c", None, None, None), ("k1", "Cluster", "src_cluster", None, None, None, None),
]
EDGES = [("f2", "f1", "CALLS", "scip"), ("f1", "f3", "CALLS", "heuristic"), ("f1", "f4", "CALLS", None), ("f4", "f1", "CALLS", "scip"), ("f1", "k1", "BELONGS_TO", None), ("f3", "k1", "BELONGS_TO", None)]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame(NODES, "id string, label string, name string, file string, risk_score int, is_input_source boolean, is_dangerous_sink boolean")
    return Graph(n, spark.createDataFrame(EDGES, "src string, dst string, type string, source string"))


def q(g, text, **params):
    return [tuple(r) for r in run(g, text, params).collect()]


def test_match_and_where(g):
    assert sorted(q(g, "MATCH (n:Function {file: 'src/a.c'}) RETURN n.name")) == [("parse_data",), ("read_file",)]
    assert q(g, "MATCH (n) WHERE (n:Function OR n:Class) AND n.name =~ 'P.*' RETURN n.id AS id") == [("c1",)]
    assert q(g, "MATCH (f:Function) WHERE f.risk_score > $x AND toLower(f.name) CONTAINS 'exec' RETURN f.id", x=50) == [("f3",)]
    assert q(g, "MATCH (f:Function) WHERE f.name IN $names AND f.is_input_source IS NOT NULL RETURN f.id", names=["read_file", "x"]) == [("f2",)]


def test_hops(g):
    assert sorted(q(g, "MATCH (a:Function)-[r:CALLS]->(b:Function) WHERE r.source = 'scip' RETURN a.id, b.id, type(r)")) == [("f2", "f1", "CALLS"), ("f4", "f1", "CALLS")]
    assert sorted(q(g, "MATCH (a {id: 'f1'})-[]-(b) RETURN b.id")) == [("f2",), ("f3",), ("f4",), ("f4",), ("k1",)]
    assert q(g, "MATCH (a)<-[:CALLS]-(b {id: 'f2'}) RETURN a.id") == [("f1",)]


def test_trails(g):
    got = q(g, "MATCH p = (s:Function {id: 'f2'})-[:CALLS*1..4]->(t:Function) RETURN t.id, length(p) ORDER BY length(p), t.id")
    assert got == [("f1", 1), ("f3", 2), ("f4", 2), ("f1", 3), ("f3", 4)]
    got = q(g, "MATCH p=(s {id:'f2'})-[:CALLS*1..3]->(t) WHERE ALL(r IN relationships(p) WHERE r.source = 'scip') RETURN [x IN nodes(p) | x] AS n")
    assert got == [(["f2", "f1"],)]
    assert sorted(q(g, "MATCH (s {id: 'f2'})-[:CALLS*1..5]->(t) RETURN DISTINCT t.id")) == [("f1",), ("f3",), ("f4",)]
    assert sorted(q(g, "MATCH (s {id: 'f2'})-[:CALLS*]->(t) RETURN DISTINCT t.id")) == [("f1",), ("f3",), ("f4",)]


def test_aggregates_and_pipelines(g):
    assert q(g, "MATCH (f:Function)-[:BELONGS_TO]->(k) RETURN k.name AS name, count(f) AS n, collect(f.id)[..1] AS some ORDER BY n DESC LIMIT 5")[0][:2] == ("src_cluster", 2)
    assert q(g, "MATCH (n) UNWIND labels(n) AS l WITH l, count(*) AS c RETURN l, c ORDER BY c DESC, l") == [("Function", 4), ("Class", 1), ("Cluster", 1)]
    assert q(g, "MATCH (f:Function) WITH f WHERE f.risk_score > 80 MATCH (f)-[:BELONGS_TO]->(k) RETURN f.id, k.id") == [("f3", "k1")]
    assert q(g, "MATCH (f:Function) WITH split(f.file, '/')[0] AS d, count(*) AS n RETURN d, n ORDER BY d") == [("lib", 2), ("src", 2)]
    assert q(g, "MATCH (f:Function) RETURN count(DISTINCT f.file) AS files, sum(f.risk_score) AS s") == [(2, 180)]


def test_optional_and_order(g):
    got = q(g, "MATCH (f:Function) OPTIONAL MATCH (f)-[:BELONGS_TO]->(k:Cluster) RETURN f.id, k.name ORDER BY k.name, f.id")
    assert got == [("f1", "src_cluster"), ("f3", "src_cluster"), ("f2", None), ("f4", None)]


@pytest.mark.parametrize("bad", ["MATCH (a) RETURN b.x", "CREATE (n)", "MATCH (a)-[:X*1..50]->(b) RETURN a.id", "MATCH (a), (b) RETURN a.id", "MATCH (a) RETURN a.id MATCH (b)", "MATCH (a) RETURN foo(a.id)", "RETURN", "MATCH (a) WHERE a.x = $nope RETURN a.id"])
def test_refused(g, bad):
    with pytest.raises(Refused):
        run(g, bad)
