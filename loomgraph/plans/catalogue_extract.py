"""More registered queries: readers, history, call resolution by imports and index, stores and the engine's verbs.

What they read is written from the tables first (a manifest file for every order, a log line for every order line), so the
rows that must come out are known to SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.engine import Engine
from loomgraph.functions import text as tx
from loomgraph.operators import enrich, resolve, search
from loomgraph.operators.graph import Graph
from loomgraph.plans.catalogue import _TOK, BAG, CALLS, FN, QUERIES, QUERY, SQL, query
from loomgraph.plans.storage import shared_dir
from loomgraph.sources import history, manifests
from loomgraph.sources.sinks import Store

# --- dependency manifests: one file an order, one dependency a line of it ---

_LINES = "ln AS (SELECT DISTINCT l_orderkey AS o, 'pkg' || l_partkey || 'x' || l_linenumber || 's' || l_suppkey AS name, l_suppkey || '.' || l_linenumber AS version, l_linenumber % 2 = 0 AS even FROM lineitem)"


def _line_files(c, name: str, item, head: str = "", tail: str = "", sep: str = "\n") -> DataFrame:
    """(path, name, content): a manifest called `name` for every order; item(x) writes a dependency."""
    l = c.table("lineitem")
    x = l.select(F.col("l_orderkey").alias("o"), F.concat(F.lit("pkg"), "l_partkey", F.lit("x"), "l_linenumber", F.lit("s"), "l_suppkey").alias("name"), F.concat_ws(".", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("version"), (F.col("l_linenumber") % 2 == 0).alias("even")).distinct()
    g = x.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("name", "version", "even"))).alias("xs"))
    body = F.concat(F.lit(head), F.array_join(F.transform("xs", item), sep), F.lit(tail))
    return g.select(F.concat(F.col("o").cast("string"), F.lit("/" + name)).alias("path"), F.lit(name).alias("name"), F.encode(body, "UTF-8").alias("content"))


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _if_even(a, b):
    return lambda x: F.when(x["even"], a(x)).otherwise(b(x))


_FORMATS = {
    # name: file, item, head, tail, separator, SQL of the name, SQL of the version, source
    "cargo": ("Cargo.toml", _if_even(lambda x: _cat(x["name"], ' = "', x["version"], '"'), lambda x: _cat(x["name"], ' = { version = "', x["version"], '", features = ["a"] }')), '[package]\nname = "own"\n\n[dependencies]\n', "\n", "\n", "name", "version", "Cargo.toml"),
    "cargo_broken": ("Cargo.toml", lambda x: _cat(x["name"], ' = "', x["version"], '"'), '[dependencies\nname = "own"\n', "\n", "\n", "name", "version", "Cargo.toml"),
    "go_mod": ("go.mod", lambda x: _cat("\thost.org/", x["name"], " v", x["version"]), "module own\n\nrequire (\n", "\n)\n", "\n", "'host.org/' || name", "'v' || version", "go.mod"),
    "package_json": ("package.json", lambda x: _cat('"', x["name"], '": "^', x["version"], '"'), '{"name": "own", "devDependencies": {', "}}", ", ", "name", "'^' || version", "package.json"),
    "gradle": ("build.gradle", _if_even(lambda x: _cat("  implementation 'org.g:", x["name"], ":", x["version"], "'"), lambda x: _cat('  api("org.g:', x["name"], '")')), "dependencies {\n", "\n}\n", "\n", "'org.g:' || name", "CASE WHEN even THEN version ELSE '' END", "gradle"),
    "podfile": ("Podfile", _if_even(lambda x: _cat("  pod '", x["name"], "', '~> ", x["version"], "'"), lambda x: _cat("  pod '", x["name"], "'")), "target 'own' do\n", "\nend\n", "\n", "name", "CASE WHEN even THEN '~> ' || version ELSE '' END", "Podfile"),
    "cmake": ("CMakeLists.txt", _if_even(lambda x: _cat("find_package(", x["name"], " ", x["version"], " REQUIRED)"), lambda x: _cat("FetchContent_Declare(", x["name"], " GIT_TAG v1)")), "project(own)\n", "\n", "\n", "name", "CASE WHEN even THEN version ELSE '' END", "CMakeLists.txt"),
    "conanfile": ("conanfile.txt", lambda x: _cat(x["name"], "/", x["version"]), "[requires]\n", "\n[generators]\nother/1\n", "\n", "name", "version", "conanfile.txt"),
    "vcpkg": ("vcpkg.json", _if_even(lambda x: _cat('{"name": "', x["name"], '", "version>=": "', x["version"], '"}'), lambda x: _cat('"', x["name"], '"')), '{"dependencies": [', "]}", ", ", "name", "CASE WHEN even THEN version ELSE '' END", "vcpkg.json"),
    "swift_package": ("Package.swift", lambda x: _cat('.package(url: "https://host.org/', x["name"], '.git", from: "', x["version"], '")'), "dependencies: [\n", "\n]", ",\n", "name", "''", "Package.swift"),
}


def _register(kind: str, file: str, item, head: str, tail: str, sep: str, name: str, version: str, source: str) -> None:
    def run(c):
        return manifests.dependencies(_line_files(c, file, item, head, tail, sep))

    run.__name__ = f"manifest_{kind}"
    query(f"WITH {_LINES} SELECT o || '/{file}' AS path, {name} AS name, {version} AS version, '{source}' AS source FROM ln")(run)


for _kind, _spec in _FORMATS.items():
    _register(_kind, *_spec)


@query(f"WITH {_LINES}, f AS (SELECT o || '/go.mod' AS path, sha256('module own' || chr(10) || chr(10) || 'require (' || chr(10) || string_agg(chr(9) || 'host.org/' || name || ' v' || version, chr(10) ORDER BY name) || chr(10) || ')' || chr(10)) AS h FROM ln GROUP BY o) SELECT sha256(string_agg(h, '' ORDER BY path)) AS hash FROM f")
def manifest_hash(c):
    return manifests.content_hash(_line_files(c, *_FORMATS["go_mod"][:5]))


# --- version history: an order is a commit, its lines are the files that it changes ---

_SUBJECT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Fix heap overflow | CVE-2024-' || o_orderkey WHEN '2-HIGH' THEN 'fix a DOS in parser' ELSE 'Tidy up' END"
_FIX = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
_LOG = f"""cm AS (SELECT 'r' || o_custkey AS repo, sha1(o_orderkey::VARCHAR) AS hash, CASE WHEN o_orderkey % 3 > 0 THEN sha1((o_orderkey - 1)::VARCHAR) END AS parent, 'c' || o_custkey || '@x.org' AS email, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date, {_SUBJECT} AS message, {_FIX} AS fix, o_orderkey FROM orders),
st AS (SELECT 'r' || o_custkey AS repo, sha1(o_orderkey::VARCHAR) AS hash, p_type || '/' || p_brand AS path, CASE WHEN l_linestatus = 'F' THEN l_quantity::INT ELSE 0 END AS a, l_linenumber AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def _log(c) -> DataFrame:
    """(repo, record, n, line): the log of every customer's repository; binary files have a dash for a number."""
    o = c.table("orders")
    key = F.sha1(F.col("o_orderkey").cast("string").cast("binary"))
    parent = F.when(F.col("o_orderkey") % 3 > 0, F.sha1((F.col("o_orderkey") - 1).cast("string").cast("binary"))).otherwise("")
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Fix heap overflow | CVE-2024-"), "o_orderkey")).when(F.col("o_orderpriority") == "2-HIGH", "fix a DOS in parser").otherwise("Tidy up")
    head = o.select(F.concat(F.lit("r"), "o_custkey").alias("repo"), F.col("o_orderkey").alias("record"), F.lit(0).cast("long").alias("n"), F.concat_ws("|", key, parent, F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("c"), "o_custkey", F.lit("@x.org")), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), subject).alias("line"))
    p = c.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", "p_brand").alias("path"))
    l = c.table("lineitem").join(p, "l_partkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    added = F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int").cast("string")).otherwise("-")
    body = l.select(F.concat(F.lit("r"), "o_custkey").alias("repo"), F.col("l_orderkey").alias("record"), F.col("l_linenumber").cast("long").alias("n"), F.concat_ws("\t", added, F.col("l_linenumber").cast("string"), "path").alias("line"))
    return head.unionByName(body)


@query(f"WITH {_LOG} SELECT repo, hash, coalesce(parent, '') AS parents, email AS author_email, date, message, fix AS is_security_fix, coalesce(sum(a), 0)::BIGINT AS total_insertions, coalesce(sum(d), 0)::BIGINT AS total_deletions, count(path) AS files_changed FROM cm LEFT JOIN st USING (repo, hash) GROUP BY ALL")
def commit_nodes(c):
    n = history.commit_nodes(_log(c))
    return n.select("repo", "hash", F.array_join("parents", " ").alias("parents"), "author_email", "date", "message", "is_security_fix", F.col("total_insertions").cast("long").alias("total_insertions"), F.col("total_deletions").cast("long").alias("total_deletions"), F.col("files_changed").cast("long").alias("files_changed"))


@query(f"""WITH {_LOG} SELECT 'commit:' || hash AS src, 'author:' || email AS dst, 'AUTHORED_BY' AS type FROM cm UNION ALL SELECT 'commit:' || hash, 'commit:' || parent, 'PARENT' FROM cm WHERE parent IS NOT NULL
UNION ALL SELECT 'file:' || path, 'commit:' || hash, 'MODIFIED_IN' FROM st UNION ALL SELECT 'secfix:' || hash, 'commit:' || hash, 'FIXED_BY' FROM cm WHERE fix UNION ALL SELECT 'secfix:' || hash, 'file:' || path, 'AFFECTS' FROM st JOIN cm USING (repo, hash) WHERE fix""")
def commit_edges(c):
    return history.edges(_log(c)).select("src", "dst", "type")


@query(f"WITH {_LOG} SELECT path, count(*) AS churn_count, arg_max(date, -o_orderkey) AS last_modified FROM st JOIN cm USING (repo, hash) GROUP BY path")
def log_churn(c):
    return history.churn(_log(c))


# --- text rules ---


@query(f"SELECT o_orderkey AS id, {_FIX} AS fix FROM orders")
def security_fix_messages(c):
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", "Buffer  overflow in reader").when(F.col("o_orderpriority") == "2-HIGH", "fix the old XSS").otherwise(F.concat(F.lit("Fixture for CVE list, prefix overflows "), "o_orderkey"))
    return c.table("orders").select(F.col("o_orderkey").alias("id"), tx.is_security_fix(subject).alias("fix"))


_LANGS = ["rust", "c", "java", "go", "typescript", "python", "kotlin", "swift", "zig"]
_HEADS = ["pub fn f()", "static int f()", "public void f()", "func f()", "export function f()", "def f()", "private fun f()", "open func f()", "pub fn f()"]


@query("SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 2 = 1 WHEN 2 THEN p_size % 2 = 0 WHEN 3 THEN regexp_matches(p_name, '^[A-Z]') WHEN 4 THEN p_size % 2 = 0 WHEN 5 THEN p_name NOT LIKE '\\_%' ESCAPE '\\' WHEN 6 THEN p_size % 2 = 1 WHEN 7 THEN p_size % 2 = 0 ELSE false END AS exported FROM part")
def exported_heads(c):
    k = (F.col("p_partkey") % 9).cast("int") + 1
    head = F.when(F.col("p_size") % 2 == 0, F.element_at(F.array(*map(F.lit, _HEADS)), k)).otherwise("fn f()")
    return c.table("part").select(F.col("p_partkey").alias("id"), tx.exported(F.element_at(F.array(*map(F.lit, _LANGS)), k), head, F.col("p_name")).alias("exported"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'get' WHEN 4 THEN 'plain' ELSE p_brand END AS callee, CASE p_size % 5 WHEN 0 THEN p_type || '.' || p_brand WHEN 1 THEN p_type || '.x' WHEN 2 THEN p_type END AS qualifier FROM part")
def called_names(c):
    t, b = F.col("p_type"), F.col("p_brand")
    text = F.when(F.col("p_size") % 5 == 0, F.concat_ws(".", t, b, F.lit("get"))).when(F.col("p_size") % 5 == 1, F.concat(t, F.lit(".x->"), b)).when(F.col("p_size") % 5 == 2, F.concat(t, F.lit("::"), b)).when(F.col("p_size") % 5 == 3, F.concat(F.lit("self."), b)).otherwise("plain")
    return c.table("part").select(F.col("p_partkey").alias("id"), tx.call_parts(text).alias("x")).select("id", "x.callee", "x.qualifier")


# --- resolution by imports and by index ---

_TS = f"""{FN}, {CALLS}, ts AS (SELECT id, name, seq, line_start, split_part(file, '/', 1) AS dir, split_part(file, '/', 2) AS stem FROM fn), im AS (SELECT DISTINCT dir, stem FROM ts WHERE stem <> 'Brand#22'),
cl AS (SELECT src || '>' || dst AS call_id, a.dir, a.stem, b.name AS callee, src FROM calls JOIN ts a ON a.id = src JOIN ts b ON b.id = dst),
hit AS (SELECT call_id, arg_min(t.id, t.seq) AS target FROM cl JOIN im USING (dir, stem) JOIN ts t ON t.dir = cl.dir AND t.stem = 'Brand#22' AND t.name = callee GROUP BY call_id)"""


def _modules(c):
    """functions, calls, imports and files: every file imports all names from ./Brand#22 of its folder."""
    f = c.functions().withColumn("file", F.concat("file", F.lit(".ts")))
    calls = c.calls().join(f.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").join(f.select(F.col("id").alias("src"), F.col("file").alias("caller_file"), F.col("line_start").alias("caller_line")), "src")
    calls = calls.select(F.concat_ws(">", "src", "dst").alias("call_id"), F.col("src").alias("caller"), "caller_file", "caller_line", "callee", F.lit(None).cast("string").alias("qualifier"))
    names = f.agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))  # a few dozen names
    files = f.select(F.col("file").alias("path")).distinct()
    imports = files.filter(~F.col("path").endswith("/Brand#22.ts")).crossJoin(F.broadcast(names)).select(F.col("path").alias("file"), F.lit("./Brand#22").alias("target"), "names", F.lit(1).cast("long").alias("seq"))
    return f, calls, imports, files


@query(f"WITH {_TS} SELECT dir || '/' || stem || '.ts' AS file, './Brand#22' AS target, dir || '/Brand#22.ts' AS path FROM im WHERE dir IN (SELECT dir FROM ts WHERE stem = 'Brand#22')")
def import_files(c):
    _, _, imports, files = _modules(c)
    return resolve.module_files(imports, files)


@query(f"WITH {_TS} SELECT call_id, target FROM hit")
def resolve_import(c):
    f, calls, imports, files = _modules(c)
    return resolve.by_import(calls, imports, files, f)


@query(f"""WITH {_TS}, own AS (SELECT call_id, arg_min(t.id, abs(t.line_start - s.line_start)::BIGINT * 100000000 + t.seq) AS target FROM cl JOIN ts s ON s.id = cl.src JOIN ts t ON t.dir = cl.dir AND t.stem = cl.stem AND t.name = callee GROUP BY call_id),
one AS (SELECT name AS callee, min(id) AS target FROM ts GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT src, callee, coalesce(own.target, hit.target, one.target) AS target FROM cl LEFT JOIN own USING (call_id) LEFT JOIN hit USING (call_id) LEFT JOIN one USING (callee))
SELECT src, coalesce(target, 'funcref:' || callee) AS dst, target IS NOT NULL AS resolved, CASE WHEN target IS NOT NULL THEN 'heuristic' END AS source FROM x""")
def resolved_calls(c):
    f, calls, imports, files = _modules(c)
    methods = f.select(F.lit("none").alias("owner"), "name", "id", "seq").limit(0)
    done = resolve.resolve(calls.drop("caller_file", "caller_line"), f, methods, imports, files)
    return resolve.resolved_edges(done).select("src", "dst", "resolved", "source")


def _index(c):
    """Occurrences and functions: every function lies on lines of its own; every call is an occurrence inside it of the
    symbol of the other."""
    p = c.table("part").select(F.concat(F.lit("func:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_type", "p_brand").alias("file"), (F.col("p_partkey") * 10).cast("int").alias("line_start"), F.col("p_partkey").alias("seq"))
    f = p.withColumn("line_end", F.col("line_start") + 8)
    symbol = F.concat(F.lit("pkg "), "file", F.lit("#"), "name", F.lit("@"), "id", F.lit("()."))
    s = f.withColumn("symbol", symbol)
    defs = s.select("file", (F.col("line_start") - 1).alias("line"), "symbol", "name", F.lit(True).alias("is_def"), "seq")
    at = s.select(F.col("id").alias("src"), "file", (F.col("line_start") + 2).alias("line"))
    uses = c.calls().select("src", "dst", "seq").join(at, "src").join(s.select(F.col("id").alias("dst"), "symbol", "name"), "dst").select("file", "line", "symbol", "name", F.lit(False).alias("is_def"), "seq")
    return defs.unionByName(uses), f


@query(f"WITH {FN}, {CALLS} SELECT DISTINCT src, dst FROM calls")
def index_calls(c):
    return resolve.index_calls(*_index(c))


@query(f"""WITH {_TS}, own AS (SELECT call_id, arg_min(t.id, abs(t.line_start - s.line_start)::BIGINT * 100000000 + t.seq) AS target FROM cl JOIN ts s ON s.id = cl.src JOIN ts t ON t.dir = cl.dir AND t.stem = cl.stem AND t.name = callee GROUP BY call_id),
one AS (SELECT name AS callee, min(id) AS target FROM ts GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT src, callee, coalesce(own.target, hit.target, one.target) AS target FROM cl LEFT JOIN own USING (call_id) LEFT JOIN hit USING (call_id) LEFT JOIN one USING (callee) WHERE cl.dir NOT IN ('SMALL', 'ECONOMY'))
SELECT src, coalesce(target, 'funcref:' || callee) AS dst, target IS NOT NULL AS resolved, CASE WHEN target IS NOT NULL THEN 'heuristic' END AS source FROM x
UNION ALL SELECT DISTINCT src, dst, true, 'scip' FROM calls JOIN ts ON ts.id = src WHERE dir IN ('SMALL', 'ECONOMY')""")
def orchestrated_calls(c):
    """An index covers the files of two types; it takes their calls over, and the levels keep the others."""
    f, calls, imports, files = _modules(c)
    methods = f.select(F.lit("none").alias("owner"), "name", "id", "seq").limit(0)
    done = resolve.resolve(calls.drop("caller_file", "caller_line"), f, methods, imports, files)
    occurrences, g = _index(c)
    here = F.split("file", "/")[0].isin("SMALL", "ECONOMY")
    index = resolve.index_calls(occurrences, g).join(g.filter(here).select(F.col("id").alias("src")), "src", "left_semi")
    spoken = f.select("id", F.split("file", "/")[0].alias("language"))
    covered = resolve.languages_of(spoken).filter("language IN ('SMALL', 'ECONOMY')")
    return resolve.orchestrate(done, index, spoken, covered).select("src", "dst", "resolved", "source")


@query()
def call_communities(c):
    """Greedy modularity over the calls; SQL cannot say it, the tests compare it with the plain method."""
    from loomgraph.operators.communities import communities

    return communities(c.calls(), c.functions().select("id"))


@query(f"WITH {FN}, {CALLS} SELECT DISTINCT 'funcref:' || name || line_start AS id FROM fn WHERE name || line_start NOT IN (SELECT name || line_start FROM calls JOIN fn ON id = dst WHERE source IS NULL)")
def orphan_refs(c):
    f = c.functions()
    ref = F.concat(F.lit("funcref:"), "name", F.col("line_start").cast("string"))
    left = c.calls().filter("source IS NULL").join(f.select(F.col("id").alias("dst"), ref.alias("ref")), "dst").select(F.col("ref").alias("dst"))
    return resolve.orphans(f.select(ref.alias("id")).distinct(), left)


# --- advisories ---


@query("""WITH d AS (SELECT DISTINCT 'pkg' || l_suppkey AS name, l_linenumber || '.' || (l_partkey % 12) AS v FROM lineitem),
a AS (SELECT 'pkg' || s_suppkey AS package, 'V' || s_suppkey AS vuln_id, s_suppkey % 7 AS k, s_name FROM supplier)
SELECT DISTINCT 'dep:' || name AS dep, vuln_id, s_name AS summary FROM d JOIN a ON package = name
WHERE v IN ('1.2', k || '.3') OR (split_part(v, '.', 1)::INT, split_part(v, '.', 2)::INT) >= (2, 9) AND (split_part(v, '.', 1)::INT, split_part(v, '.', 2)::INT) < (k, 10)""")
def advisories(c):
    """Versions that an advisory lists, or that lie in its range."""
    l = c.table("lineitem")
    dep = l.select(F.concat(F.lit("pkg"), "l_suppkey").alias("name"), F.concat(F.lit("^ "), "l_linenumber", F.lit("."), F.col("l_partkey") % 12).alias("version"), F.lit("package.json").alias("source")).distinct()
    k = F.col("s_suppkey") % 7
    osv = c.table("supplier").select(F.concat(F.lit("V"), "s_suppkey").alias("vuln_id"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg"), "s_suppkey").alias("package"), F.array(F.lit("1.2"), F.concat(k, F.lit(".3"))).alias("versions"), F.array(F.struct(F.lit("2.9").alias("introduced"), F.concat(k, F.lit(".10")).alias("fixed"))).alias("ranges"), F.col("s_name").alias("summary"), F.lit("7.5").alias("severity"), F.lit(None).cast("string").alias("severity_label"))
    return enrich.vulnerabilities(dep, osv).select("dep", "vuln_id", "summary")


# --- stores ---


@query(f"""WITH {BAG}, n AS (SELECT id, arg_min(label, seq) AS label, arg_max(flag, seq) FILTER (flag IS NOT NULL) AS flag, arg_max(tax, seq) FILTER (tax IS NOT NULL) AS tax FROM bag GROUP BY id), {CALLS}
SELECT 'node' AS kind, id AS a, label AS b, flag AS x, tax AS y FROM n UNION ALL SELECT 'edge', src, dst, 'CALLS', NULL FROM calls WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def store_roundtrip(c):
    """Two upserts, the later rows second, then a load: first labels, last properties, no dangling edges."""
    bag = c.bag()
    path = f"{shared_dir(c.spark)}/loom/store-{c.sf_dir.strip('/').replace('/', '-')}"
    store = Store(c.spark, path)
    store.clear("r")
    dangling = c.calls().limit(0).select("src", F.lit("func:none").alias("dst"), "type", "seq", "source")
    half = F.col("seq") < bag.agg(F.percentile_approx("seq", 0.5)).first()[0]
    store.upsert(Graph(bag.filter(half), c.calls().limit(0)), "r")
    store.upsert(Graph(bag.filter(~half), c.calls().unionByName(dangling)), "r")
    g = store.load("r")
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("flag").alias("x"), F.col("tax").alias("y"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("x"), F.lit(None).cast("double").alias("y")))


# --- the engine's verbs: brands are clusters, types processes ---

_VERB = f"{FN}, v AS (SELECT *, 'cluster:' || split_part(file, '/', 2) AS cl, 'process:' || split_part(file, '/', 1) AS pr FROM fn)"


def _engine(c) -> Engine:
    f = c.functions().withColumn("extra", F.lit(None).cast("string"))
    part = lambda i: F.split("file", "/")[i]
    cluster = f.select(F.concat(F.lit("cluster:"), part(1)).alias("id"), F.lit("Cluster").alias("label"), part(1).alias("name")).distinct()
    process = f.select(F.concat(F.lit("process:"), part(0)).alias("id"), F.lit("Process").alias("label"), part(0).alias("name")).distinct()
    size = f.groupBy(F.concat(F.lit("cluster:"), part(1)).alias("id")).agg(F.count("*").alias("size"))
    steps = f.groupBy(F.concat(F.lit("process:"), part(0)).alias("id")).agg(F.count("*").alias("step_count"))
    a = c.affected()
    deps = a.select(F.col("dep").alias("id"), F.lit("Dependency").alias("label"), F.col("dep_name").alias("name")).distinct()
    vulns = a.select(F.col("vuln").alias("id"), F.lit("Vulnerability").alias("label"), F.col("vuln").alias("name"), "severity").distinct()
    nodes = f
    for x in (cluster.join(size, "id"), process.join(steps, "id"), deps, vulns):
        nodes = nodes.unionByName(x, allowMissingColumns=True)
    e = c.calls().select("src", "dst", "type", "seq", "source")
    for kind, i, name in (("BELONGS_TO", 1, "cluster:"), ("PARTICIPATES_IN", 0, "process:")):
        e = e.unionByName(f.select(F.col("id").alias("src"), F.concat(F.lit(name), part(i)).alias("dst"), F.lit(kind).alias("type"), "seq"), allowMissingColumns=True)
    e = e.unionByName(a.select(F.col("dep").alias("src"), F.col("vuln").alias("dst"), F.lit("AFFECTED_BY").alias("type")), allowMissingColumns=True)
    return Engine(Graph(nodes, e))


@query(f"WITH {_VERB} SELECT 'Cluster' AS label, count(DISTINCT cl) AS n FROM v UNION ALL SELECT 'Process', count(DISTINCT pr) FROM v")
def group_counts(c):
    return _engine(c).group_counts()


@query(f"WITH {_VERB} SELECT cl AS id, substr(cl, 9) AS name, count(*) AS size FROM v GROUP BY ALL ORDER BY size DESC, id LIMIT 20")
def cluster_list(c):
    return _engine(c).clusters(20).select("id", "name", "size")


@query(f"WITH {_VERB} SELECT pr AS id, substr(pr, 9) AS name, count(*) AS step_count FROM v GROUP BY ALL ORDER BY step_count DESC, id LIMIT 20")
def process_list(c):
    return _engine(c).processes(20).select("id", "name", "step_count")


@query(f"WITH {_VERB}, t AS (SELECT cl, count(*) AS size FROM v GROUP BY 1 ORDER BY size DESC, cl LIMIT 20) SELECT cl AS cluster, size, v.id, name, file, row_number() OVER (PARTITION BY cl ORDER BY file, name, v.id)::INT AS place FROM v JOIN t USING (cl)")
def cluster_members(c):
    return _engine(c).cluster_members(20)


@query(f"WITH {_VERB} SELECT DISTINCT 'cluster' AS relation, cl AS id FROM v WHERE file LIKE '%Brand#11' UNION SELECT 'process', pr FROM v WHERE file LIKE '%Brand#11'")
def changed_groups(c):
    return _engine(c).changed_groups(c.changed_files())


@query("SELECT 'dep:' || s_suppkey AS dependency_id, s_name AS dependency, 'vuln:' || n_name AS vulnerability, r_name AS severity FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE contains(upper(r_name), 'A') ORDER BY severity DESC, dependency_id, vulnerability LIMIT 100")
def vulnerability_list(c):
    return _engine(c).find_vulnerabilities("a", 100)


@query(f"WITH {_VERB}, {CALLS}, m AS (SELECT min(id) AS id FROM fn WHERE id IN (SELECT src FROM calls)) SELECT 'callee' AS relation, dst AS id, b.name FROM calls JOIN m ON m.id = src JOIN fn b ON b.id = dst UNION ALL SELECT 'caller', src, b.name FROM calls JOIN m ON m.id = dst JOIN fn b ON b.id = src UNION ALL SELECT 'cluster', cl, substr(cl, 9) FROM v JOIN m USING (id) UNION ALL SELECT 'process', pr, substr(pr, 9) FROM v JOIN m USING (id)")
def context_of(c):
    e = _engine(c)
    one = c.calls().agg(F.min("src")).first()[0]
    return e.context(one or "")


@query(f"WITH {_VERB}, m AS (SELECT min(id) AS id FROM fn), x AS (SELECT id, name, file, line_start, is_exported FROM fn JOIN m USING (id)) SELECT u.k AS property, u.v AS value FROM (SELECT unnest([{{'k': 'name', 'v': name}}, {{'k': 'file', 'v': file}}, {{'k': 'line_start', 'v': line_start::VARCHAR}}, {{'k': 'is_exported', 'v': is_exported::VARCHAR}}]) AS u FROM x)")
def node_properties(c):
    one = c.functions().agg(F.min("id")).first()[0]
    return _engine(c).properties(one or "").filter(F.col("property").isin("name", "file", "line_start", "is_exported"))


_LAB = "lb AS (SELECT 'doc:' || doc_id AS id, CASE lang WHEN 'en' THEN 'Function' WHEN 'fr' THEN 'Class' WHEN 'de' THEN 'Author' ELSE 'Module' END AS label FROM documents)"


@query(f"""WITH {_TOK.replace('FROM documents)', "FROM (SELECT doc_id, coalesce(source || ' ', '') || coalesce(text, '') AS text FROM documents WHERE lang IS DISTINCT FROM 'de'))")}, {_LAB}, dl AS (SELECT id, count(*) AS dl FROM tk GROUP BY 1),
nd AS (SELECT count(*) AS n FROM lb WHERE label <> 'Author'), st AS (SELECT n, (SELECT count(*) FROM tk) / n AS a FROM nd),
tf AS (SELECT id, token, count(*) AS tf FROM tk WHERE token IN ('the', 'ing', '4', 'src0', 'src') GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN df USING (token) JOIN dl USING (id), st GROUP BY id)
SELECT id, round(0.7 * s / (SELECT max(s) FROM bm), 4) AS score FROM bm JOIN lb USING (id) WHERE label = 'Class' ORDER BY score DESC, id LIMIT 20""")
def ranked_label(c):
    d = c.table("documents")
    label = F.when(F.col("lang") == "en", "Function").when(F.col("lang") == "fr", "Class").when(F.col("lang") == "de", "Author").otherwise("Module")
    return search.ranked(d.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), label.alias("label"), F.col("source").alias("name"), F.col("text").alias("body")), QUERY, "Class")


@query("SELECT unnest(['Cluster', 'Dependency', 'Function', 'Process', 'Vulnerability']) AS label WHERE (SELECT count(*) FROM part) > 0")
def db_labels(c):
    return _engine(c).query("CALL db.labels()")


@query("SELECT unnest(['AFFECTED_BY', 'BELONGS_TO', 'CALLS', 'PARTICIPATES_IN']) AS kind WHERE (SELECT count(*) FROM part) > 0")
def db_types(c):
    return _engine(c).query("CALL db.relationshipTypes() YIELD relationshipType RETURN relationshipType AS kind")


__all__ = ["QUERIES", "SQL"]
