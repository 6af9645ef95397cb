"""The shells: tools, the line server, HTTP routes and the command line."""

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from loomgraph import __main__ as cli
from loomgraph.serve import RESOURCES, TOOLS, Session, Unknown, http_server, routes, serve_lines


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "a.py").write_text("def main():\n    return helper()\n\ndef helper():\n    return 1\n")
    home = tmp_path_factory.mktemp("home")
    s = Session(spark, str(home / "store"), str(home / "registry.json"))
    with pytest.raises(Unknown):
        s.call("stats")
    got = s.call("extract", {"root": str(root), "name": root.name})
    assert got["how"] == "full" and got["counts"]["Function"] == 2
    s.root = str(root)
    return s


def test_tools(session):
    me = next(r["id"] for r in session.call("search", {"text": "helper"}))
    assert len(TOOLS) == 13 and session.call("stats") == session.call("stats")
    assert session.call("query", {"text": "helper", "label": "Function"})[0]["id"] == me
    assert session.call("cypher", {"statement": "MATCH (f:Function) WHERE f.name = $n RETURN f.id AS id", "params": {"n": "helper"}}) == [{"id": me}]
    assert [r["caller"] for r in session.call("search_calls", {"callee": "helper"})] == ["main"]
    assert [r["depth"] for r in session.call("impact", {"id": me})] == [1]
    assert session.call("context", {"id": me})["properties"]["name"] == "helper" and session.call("context", {"id": "no"}) is None
    assert session.call("detect_changes", {"files": ["a.py"]})["risk"][0]["changed_functions"] == 2
    assert session.call("find_vulnerabilities") == [] and "return 1" in session.call("source", {"id": me})["body"]
    assert session.call("repos")[0]["active"] and session.call("use_repo", {"name": session.active})["repo"] == session.active
    for name, args in (("no", {}), ("impact", {}), ("stats", {"x": 1}), ("use_repo", {"name": "none"})):
        with pytest.raises(Unknown):
            session.call(name, args)
    assert session.diff_summary(session.root)["nodes_added"] == 0
    assert {k: bool(session.resource(k) is not None) for k in RESOURCES} == dict.fromkeys(RESOURCES, True)


def test_lines(session):
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "stats"}}, {"id": 4, "method": "resources/list"}, {"id": 5, "method": "resources/read", "params": {"uri": "loomgraph://schema"}}, {"id": 6, "method": "tools/call", "params": {"name": "no"}}]
    out = io.StringIO()
    serve_lines(session, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert len(got[2]["result"]["tools"]) == 13 and len(got[4]["result"]["resources"]) == 4 and "error" in got[6] and "error" in got[None]
    assert any(r["name"] == "Function" for r in json.loads(got[3]["result"]["content"][0]["text"]))
    assert "Function" in json.loads(got[5]["result"]["contents"][0]["text"])["labels"]


def test_http(session):
    server = http_server(session, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    me = next(r["id"] for r in session.call("search", {"text": "helper"}))
    try:
        for path in routes(session):
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}?id={me}&q=helper") as r:
                body = r.read().decode()
                assert r.status == 200 and (path == "/" or json.loads(body) is not None)
        for path, status in (("/none", 404), ("/api/node?id=no", 404), ("/api/search?limit=x", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}")
            assert e.value.code == status
    finally:
        server.shutdown()


def test_command_line(session, capsys, tmp_path):
    at = ["--store", session.store.path, "--registry", session.registry.path, "--repo", session.active]
    for verb in (["stats"], ["schema"], ["search", "helper"], ["query", "MATCH (f:Function) RETURN f.name AS name"], ["repos"], ["diff", session.root], ["skills"], ["report", str(tmp_path / "r.html")], ["export", str(tmp_path / "x"), "--format", "csv"], ["extract", session.root, "--incremental"]):
        cli.main([*at, *verb])
    assert "helper" in capsys.readouterr().out and (tmp_path / "r.html").exists()
