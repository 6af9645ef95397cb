"""The front ends on small files of every language, pattern flags, and a whole tree's extraction with resolved calls."""

import json
import subprocess
import textwrap

import pytest

from loomgraph.engine import Engine, extract
from loomgraph.functions import brace_front, fronts
from loomgraph.plans import skills
from loomgraph.sources import history, sinks


def read(path, language, text):
    rows = fronts.rows_of(path, language, textwrap.dedent(text))
    nodes = {(r[2], r[3]): json.loads(r[4]) for r in rows if r[0] == "node"}
    edges = {(r[1], r[2], r[3]) for r in rows if r[0] == "edge"}
    return nodes, edges


def calls(edges):
    return {(a.split(":")[2], b.removeprefix("funcref:")) for a, b, t in edges if t == "CALLS"}


def test_c():
    n, e = read("main.c", "c", """\
        #include <stdio.h>
        #include "util.h"
        struct Point { int x; int y; };
        typedef unsigned int uint;
        typedef struct { int q; } Pair;
        #define MAX_SIZE 1024
        int add(int a, int b) { return a + b; } // { not a brace
        static void helper(void) { printf("hello {"); }
        int main(int argc, char *argv[]) {
            int result = add(1, 2); helper(); memcpy(NULL, NULL, 0);
            if (result) { p->go(1); }
            return 0;
        }
        """)  # fmt: skip
    assert {k for k in n if k[0] in ("Struct", "TypeAlias", "Macro", "Function")} == {("Struct", "Point"), ("TypeAlias", "uint"), ("TypeAlias", "Pair"), ("Macro", "MAX_SIZE"), ("Function", "add"), ("Function", "helper"), ("Function", "main")}
    assert n["Function", "main"]["is_exported"] and not n["Function", "helper"]["is_exported"] and n["Function", "add"]["return_type"] == "int"
    assert calls(e) == {("helper", "printf"), ("main", "add"), ("main", "helper"), ("main", "memcpy"), ("main", "p.go")}
    assert {b for _, b, t in e if t == "IMPORTS"} == {"module:stdio.h", "module:util.h"}
    assert {("Parameter", x) for x in ("a", "b", "argc", "argv")} <= n.keys() and ("Field", "x") in n
    assert ("file:main.c", "func:main.c:add:6", "CONTAINS") in e


def test_rust():
    n, e = read("lib.rs", "rust", """\
        use std::io::Read;
        use crate::a::{b, c};
        pub struct Config { pub name: String, pub value: i32, }
        pub trait Processor { fn process(&self, data: &[u8]) -> Vec<u8>; }
        impl Processor for Config {
            fn process(&self, data: &[u8]) -> Vec<u8> { data.to_vec() }
        }
        pub fn parse_input<'a>(input: &'a str) -> Config { Config { name: input.to_string(), value: 42, } }
        fn internal_helper() { println!("helper"); std::mem::drop(1); self.x(); }
        type Id = u64;
        """)  # fmt: skip
    assert {("Struct", "Config"), ("Interface", "Processor"), ("Function", "process"), ("Function", "parse_input"), ("TypeAlias", "Id"), ("Field", "name"), ("Field", "value")} <= n.keys()
    assert ("struct:lib.rs:Config", "interface:lib.rs:Processor", "IMPLEMENTS") in e and ("struct:lib.rs:Config", "func:lib.rs:process:5", "CONTAINS") in e
    assert n["Function", "parse_input"]["is_exported"] and not n["Function", "internal_helper"]["is_exported"]
    assert {("internal_helper", "std::mem.drop"), ("internal_helper", "x")} <= calls(e)


def test_java():
    n, e = read("App.java", "java", """\
        package x;
        import com.example.utils.Foo;
        public abstract class App extends Base implements Runnable, Foo<T> {
          private int n = 3;
          public App(int a) { super(a); }
          @Override public void run() { Foo.bar(1); this.helper(); new Thing().go(); }
          private static List<String> helper() throws IOException { if (n > 2) { secret(); } return null; }
        }
        """)  # fmt: skip
    assert n["Class", "App"]["is_abstract"] and "{ ... }" in n["Class", "App"]["body"] and "secret" not in n["Class", "App"]["body"]
    assert {("class:App.java:App", "class:App.java:Base", "INHERITS"), ("class:App.java:App", "interface:App.java:Runnable", "IMPLEMENTS")} <= e
    assert {("run", "Foo.bar"), ("run", "helper"), ("helper", "secret")} <= calls(e) and ("Field", "n") in n
    assert n["Function", "run"]["is_exported"] and not n["Function", "helper"]["is_exported"]


def test_go():
    n, e = read("a.go", "go", """\
        package main
        import (
          "fmt"
          u "a/b/util"
        )
        type Config struct {
          Name string
          n int
        }
        type Doer interface { Do() error }
        type ID string
        func (c *Config) Run(x int) error { defer f(); return u.Do(x) }
        func main() { fmt.Println("x"); c.Run(1) }
        """)  # fmt: skip
    assert {("Struct", "Config"), ("Interface", "Doer"), ("TypeAlias", "ID"), ("Function", "Run"), ("Function", "main"), ("Field", "Name"), ("Parameter", "x")} <= n.keys()
    assert ("struct:a.go:Config", "func:a.go:Run:11", "CONTAINS") in e and calls(e) == {("Run", "f"), ("Run", "u.Do"), ("main", "fmt.Println"), ("main", "c.Run")}
    assert {b for _, b, t in e if t == "IMPORTS"} == {"module:fmt", "module:a/b/util"}


def test_typescript():
    n, e = read("a.ts", "typescript", """\
        import { foo, bar as baz } from "./utils";
        import Def from 'react';
        export class A extends B implements C { x: number = 1; go(a: string): void { foo(a); this.y(); } }
        export interface I { a: string }
        export type T = string | number;
        enum E { X }
        export const f = (a: number) => { return baz(a as any); };
        export async function g(a) { await f(1); }
        const h = x => x.map(y);
        const plain = { a: 1 };
        """)  # fmt: skip
    assert {("Class", "A"), ("Interface", "I"), ("TypeAlias", "T"), ("Enum", "E"), ("Function", "go"), ("Function", "f"), ("Function", "g"), ("Function", "h"), ("Field", "x")} <= n.keys()
    assert calls(e) == {("go", "foo"), ("go", "y"), ("f", "baz"), ("g", "f"), ("h", "x.map")}
    assert n["Function", "f"]["flags"] == ["has_type_assertion", "has_any_type"] and ("Function", "plain") not in n


def test_kotlin_swift_cpp_objc():
    n, e = read("a.kt", "kotlin", """\
        import com.example.utils.Foo
        class A(val x: Int) : B(), C {
          fun go(a: Int): Int { return foo(a!!) }
          private fun p() = q(1)
        }
        object O { fun z() { launch { a() } } }
        """)  # fmt: skip
    assert {("Class", "A"), ("Class", "O"), ("Function", "go"), ("Function", "p")} <= n.keys() and calls(e) == {("go", "foo"), ("p", "q"), ("z", "a")}
    assert not n["Function", "p"]["is_exported"] and n["Function", "z"]["flags"] == ["has_coroutine"]
    n, e = read("a.swift", "swift", """\
        import Foundation
        public class A: B, P {
          var x: Int = 1
          init(a: Int) { self.x = a }
          public func go(_ a: Int) -> Int { return try! foo(a) }
        }
        protocol P { func f() }
        """)  # fmt: skip
    assert {("Class", "A"), ("Interface", "P"), ("Function", "go"), ("Function", "init"), ("Field", "x")} <= n.keys() and ("go", "foo") in calls(e)
    n, e = read("a.cpp", "cpp", """\
        #include <vector>
        namespace n { class A : public B { public: int x; void go(int a) { std::sort(a); b->c(); } }; }
        int n::A::f(int a) const { return g(a); }
        """)  # fmt: skip
    assert {("Class", "A"), ("Function", "go"), ("Function", "f"), ("Field", "x")} <= n.keys() and calls(e) == {("go", "std.sort"), ("go", "b.c"), ("f", "g")}
    n, e = read("a.m", "objc", """\
        #import "B.h"
        - (int)run:(int)x { [self go]; NSLog(@"x"); return 1; }
        """)  # fmt: skip
    assert ("Function", "run") in n and {("run", "NSLog"), ("run", "go")} <= calls(e)


@pytest.mark.parametrize("language,text,want", [
    ("rust", "unsafe fn f() { let x = transmute(y).unwrap(); }", {"is_unsafe_fn", "has_transmute", "has_unwrap"}),
    ("java", "synchronized void f() { Class.forName(x); new ObjectInputStream(s); }", {"has_reflection", "has_serialization", "has_synchronized"}),
    ("go", "func f() { go run(x); defer g(); c <- 1; if err != nil {} ; p := unsafe.Pointer(q) }", {"has_goroutine", "has_defer", "has_channel_op", "has_unsafe_pointer", "has_error_check"}),
    ("javascript", "function f() { eval(x); e.innerHTML = y; import(z); o.__proto__ = 1 }", {"has_dangerous_eval", "has_innerHTML", "has_dynamic_import", "has_prototype_pollution"}),
    ("python", "def f(): pickle.loads(x); subprocess.run(c, shell=True); q = f'SELECT {x}'", {"has_unsafe_deserialization", "has_subprocess_shell", "has_sql_string_format"}),
    ("kotlin", "suspend fun f() { a?.b(); c!!.d() }", {"has_coroutine", "has_force_unwrap", "has_safe_call"}),
    ("swift", "func f() { weak var a = b?.c; try! d() }", {"has_optional_chain", "has_force_try", "has_weak_ref", "has_force_unwrap"}),
])
def test_flags(language, text, want):
    assert {k for k, v in brace_front.flags(language, text).items() if v} == want


@pytest.mark.parametrize("language", fronts.LANGUAGES)
@pytest.mark.parametrize("text", ["", "}", "{{{", "fn (", "/* open", '"open', "class", "\x00\xff", "func f(", "a = ((((", "#define", "é∂ƒ {", "type", "impl {", "- ("])
def test_broken_sources(language, text):
    assert isinstance(fronts.rows_of("x", language, text), list)


def test_tree(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "main.py").write_text("from src.util import shout\n\ndef main():\n    shout(read())\n    return helper()\n\ndef helper():\n    return 1\n\ndef read():\n    return helper()\n")
    (src / "util.py").write_text("def shout(x):\n    return twice(x)\n\ndef twice(x):\n    missing(x)\n    return x\n")
    (src / "App.java").write_text("public class App { public void go() { help(); } private void help() { } }\n")
    (tmp_path / "package.json").write_text('{"dependencies": {"lodash": "^4.17.0"}}')
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], capture_output=True).returncode
    if git("init", "-q"):
        pytest.skip("no git")
    git("add", "-A")
    git("commit", "-qm", "fix the overflow")
    git("tag", "v1")
    osv = spark.createDataFrame([("V-1", "npm", "lodash", ["9"], [("4.0.0", "4.18")], "bad", None, "HIGH")], "vuln_id string, ecosystem string, package string, versions array<string>, ranges array<struct<introduced:string,fixed:string>>, summary string, severity string, severity_label string")
    g = extract(spark, str(tmp_path), osv=osv)
    name = {r["id"]: r["name"] for r in g.nodes.collect()}
    called = {(name[r["src"]], name.get(r["dst"]), r["resolved"]) for r in g.edges.filter("type = 'CALLS'").collect()}
    assert called == {("main", "shout", True), ("main", "read", True), ("main", "helper", True), ("read", "helper", True), ("shout", "twice", True), ("twice", "missing", False), ("go", "help", True)}
    types = {r["name"]: r["n"] for r in g.stats().filter("kind = 'edge'").collect()}
    assert types["AUTHORED_BY"] == 1 and types["MODIFIED_IN"] == 4 and types["FIXED_BY"] == 1 and types["TAGGED_AS"] == 1 and types["AFFECTED_BY"] == 1 and types["BELONGS_TO"] >= 5 and types["PARTICIPATES_IN"] >= 5
    store = sinks.Store(spark, str(tmp_path / "store"))
    store.upsert(g, "r")
    e = Engine(store.load("r"))
    assert {r["end"].split(":")[2] for r in e.search_calls("main", depth=3).collect() if r["end"].startswith("func:")} == {"shout", "read", "helper", "twice"}
    me = next(i for i in name if i.startswith("func:src/main.py:helper"))
    assert {(r["relation"]) for r in e.context(me).collect()} >= {"caller", "cluster", "process"}
    assert {r["id"].split(":")[2] for r in e.impact(me, "upstream").collect()} == {"main", "read"}
    assert [tuple(r) for r in e.find_vulnerabilities("high").collect()] == [("dep:lodash", "lodash", "vuln:V-1", "HIGH")]
    files = spark.createDataFrame([("src/main.py",)], "path string")
    report = e.change_report(files)
    assert report["functions"].count() == 3 and {r["relation"] for r in report["groups"].collect()} == {"cluster", "process"} and report["risk"].first()["changed_functions"] == 3
    assert e.exists(me) and not e.exists("no") and "Function" in {r["name"] for r in e.schema()["labels"].collect()}
    assert {r["name"] for r in e.ranked("twice", label="Function").limit(1).collect()} == {"twice"}
    assert history.is_ancestor(str(tmp_path), history.head(str(tmp_path))) and history.repo_name("git@host.org:a/b.git") == "b" and history.is_url("https://host.org/a") and not history.is_url("./a")
    f = next(r for r in g.nodes.filter("label = 'File' AND path = 'src/main.py'").collect())
    assert f["churn_count"] == 1
    assert "twice" in skills.impact_guide(g) and "V-1" in skills.security(g) and all(n.startswith("# cluster:") for n in skills.clusters(g).values())
    page, doc = sinks.report(g), json.loads(sinks.json_document(g))
    assert all(f"<h2>{t}</h2>" in page for t in ("Counts", "High risk", "Input sources", "Dangerous sinks", "Advisories", "Clusters", "Processes"))
    assert len(doc["nodes"]) == len(name) and len(doc["edges"]) == g.edges.count() and doc["stats"]


def test_advisory_documents(spark):
    from loomgraph.sources import advisories

    doc = {"id": "V-9", "summary": "bad", "aliases": ["CVE-1"], "severity": [{"type": "CVSS_V3", "score": "7.5"}], "database_specific": {"severity": "HIGH"},
           "affected": [{"package": {"ecosystem": "npm", "name": "x"}, "versions": ["1.0"], "ranges": [{"type": "SEMVER", "events": [{"introduced": "2"}, {"fixed": "2.5"}, {"introduced": "3"}]}]}, {"package": {}}]}
    got = advisories.advisories(spark.createDataFrame([(bytearray(json.dumps(doc).encode()),), (bytearray(b"{"),), (bytearray(b"[]"),), (None,)], "content binary"))
    d = spark.createDataFrame([("x", v, "package.json") for v in ("1.0", "v2.4.9", "2.5.0", "3.1-rc1", "1.9")], "name string, version string, source string")
    from loomgraph.operators.enrich import vulnerabilities

    assert [tuple(r) for r in got.select("vuln_id", "package", "severity", "aliases").collect()] == [("V-9", "x", "7.5", "CVE-1")]
    hit = {v for v in ("1.0", "v2.4.9", "2.5.0", "3.1-rc1", "1.9") if vulnerabilities(d.filter(d["version"] == v), got).count()}
    assert hit == {"1.0", "v2.4.9", "3.1-rc1"}


def test_manifest_and_incremental(spark, tmp_path):
    from loomgraph.engine import incremental
    from loomgraph.sources import state

    src, at = tmp_path / "src", str(tmp_path / "manifest")
    src.mkdir()
    (src / "a.py").write_text("def one():\n    return two()\n\ndef two():\n    return 1\n")
    (src / "b.py").write_text("def three():\n    return 3\n")
    store = sinks.Store(spark, str(tmp_path / "store"))
    quick = {"git": False, "clusters": False, "processes": False}
    assert state.load_manifest(spark, at) is None
    assert incremental(spark, str(src), store, "r", at, **quick) == "full"
    assert incremental(spark, str(src), store, "r", at, **quick) == "none"
    (src / "a.py").write_text("def one():\n    return 1\n")
    (src / "b.py").unlink()
    (src / "c.py").write_text("def four():\n    return 4\n")
    assert incremental(spark, str(src), store, "r", at, **quick) == "changed"
    assert {r["name"] for r in store.load("r").nodes.filter("label = 'Function'").collect()} == {"one", "four"}
    (src / "package.json").write_text('{"dependencies": {"x": "1"}}')
    old = state.load_manifest(spark, at)
    assert old is not None and state.changes(old, old.files, "", "other").any() and not state.changes(old, old.files).any()
    store.clear_all()
    with pytest.raises(FileNotFoundError):
        store.load()


def test_registry_and_cache(tmp_path):
    from loomgraph.sources.state import Cache, Registry

    at = str(tmp_path / "deep" / "registry.json")
    r = Registry(at)
    r.register(str(tmp_path / "one"), languages=["go"], counts={"nodes": 3})
    assert Registry(at).get("one").languages == ["go"] and Registry(at).find_by_path(str(tmp_path / "one")).name == "one"
    assert r.unregister("one") and not r.unregister("one") and not Registry(at).all()
    (tmp_path / "bad.json").write_text("{")
    assert Registry(str(tmp_path / "bad.json")).all() == []
    now = [0.0]
    c = Cache(10, 2, lambda: now[0])
    for i in range(3):
        now[0] = i
        c.put("q", {"a": i}, i)
    assert c.get("q", {"a": 0}) is None and c.get("q", {"a": 2}) == 2
    now[0] = 20
    assert c.get("q", {"a": 2}) is None
