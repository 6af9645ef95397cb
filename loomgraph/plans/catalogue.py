"""The registered queries over the carrier graph, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.operators import enrich, graph, impact, paths, resolve, search
from loomgraph.plans import match
from loomgraph.plans.carrier import Carrier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FN = """fn AS (SELECT *, least(30 * coalesce(is_input_source, false)::INT + 30 * coalesce(is_dangerous_sink, false)::INT + 10 * coalesce(is_allocator, false)::INT + 10 * coalesce(is_parser, false)::INT, 100) AS risk_score FROM (
  SELECT 'func:' || p_partkey AS id, p_partkey AS seq, p_name AS name, p_type || '/' || p_brand AS file, p_size AS line_start, p_size > 25 AS is_exported,
    CASE WHEN contains(lower(p_name), 'red') THEN true END AS is_input_source, CASE WHEN contains(lower(p_name), 'gear') THEN true END AS is_dangerous_sink,
    CASE WHEN contains(lower(p_name), 'bolt') THEN true END AS is_allocator, CASE WHEN contains(lower(p_name), 'gizmo') THEN true END AS is_parser, CASE WHEN contains(lower(p_name), 'blue') THEN true END AS is_crypto
  FROM part))"""
CALLS = """calls AS (SELECT DISTINCT 'func:' || a.l_partkey AS src, 'func:' || b.l_partkey AS dst, CASE a.l_partkey % 3 WHEN 0 THEN 'scip' WHEN 1 THEN 'heuristic' END AS source
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= 45 AND b.l_quantity >= 25 AND a.l_partkey <> b.l_partkey)"""
SNAP = """o AS (SELECT 'func:' || p_partkey AS id, p_name AS name, p_size AS line_start FROM part WHERE p_brand <> 'Brand#12'),
n AS (SELECT 'func:' || p_partkey AS id, CASE WHEN p_size > 40 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_size > 30 THEN p_size + 1 ELSE p_size END AS line_start FROM part WHERE p_brand <> 'Brand#11')"""
BAG = """bag AS (SELECT 'func:' || l_partkey AS id, 'L' || l_linestatus AS label, l_orderkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT AS seq, nullif(l_returnflag, 'N') AS flag, CASE WHEN l_discount > 0.05 THEN l_tax END AS tax FROM lineitem)"""


def trail_sql(depth: int, edges: str = "calls", starts: str = "fn") -> str:
    return f"""t(start_id, end_id, depth, eids, sources, trail) AS (
  SELECT e.src, e.dst, 1, [e.src || '>' || e.dst], [coalesce(e.source, 'unknown')], e.src || ' ' || e.dst FROM {edges} e JOIN {starts} s ON s.id = e.src
  UNION ALL SELECT t.start_id, e.dst, depth + 1, list_append(eids, e.src || '>' || e.dst), list_append(sources, coalesce(e.source, 'unknown')), trail || ' ' || e.dst
  FROM t JOIN {edges} e ON e.src = t.end_id WHERE depth < {depth} AND NOT list_contains(eids, e.src || '>' || e.dst))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Carrier(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- graph algebra -------------------------------------------------------------------------------------------------


@query(f"WITH {FN} SELECT 'Function' AS label, count(*) AS n FROM fn UNION ALL SELECT 'File', count(DISTINCT file) FROM fn UNION ALL SELECT '_Node', count(*) + count(DISTINCT file) FROM fn")
def label_rollup(c):
    return graph.label_rollup(c.functions().select("label").unionByName(c.files().select(F.lit("File").alias("label"))))


@query(f"WITH {FN}, {CALLS} SELECT 'CALLS' AS type, count(*) AS n FROM calls UNION ALL SELECT 'CONTAINS', count(*) FROM fn UNION ALL SELECT 'AUTHORED_BY', count(*) FROM orders")
def edge_stats(c):
    cols = ("src", "dst", "type")
    e = c.calls().select(*cols).unionByName(c.contains().select(*cols)).unionByName(c.authored().select(*cols))
    return e.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {FN}, {CALLS} SELECT 'node' AS kind, 'Function' AS name, count(*) AS n FROM fn UNION ALL SELECT 'edge', 'CALLS', count(*) FROM calls")
def graph_stats(c):
    return graph.Graph(c.functions(), c.calls()).stats()


@query(f"WITH {BAG} SELECT id, arg_min(label, seq) AS label, min(seq) AS seq, arg_max(flag, seq) FILTER (flag IS NOT NULL) AS flag, arg_max(tax, seq) FILTER (tax IS NOT NULL) AS tax FROM bag GROUP BY id")
def dedup_nodes(c):
    return graph.dedup_nodes(c.bag())


@query("""WITH e AS (SELECT 'func:' || l_partkey AS src, 'dep:' || l_suppkey AS dst, l_returnflag AS type, l_orderkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT AS seq, l_shipdate::DATE::VARCHAR AS date FROM lineitem)
SELECT src, dst, type, min(seq) AS seq, arg_min(date, seq) AS date FROM e GROUP BY ALL""")
def dedup_edges(c):
    l = c.table("lineitem")
    e = l.select(F.concat(F.lit("func:"), "l_partkey").alias("src"), F.concat(F.lit("dep:"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("seq"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    return graph.dedup_edges(e)


@query(f"WITH {SNAP} SELECT id, name FROM n WHERE id NOT IN (SELECT id FROM o)")
def diff_added(c):
    o, n = c.snapshots()
    return graph.added(o, n).select("id", "name")


@query(f"WITH {SNAP} SELECT id, name FROM o WHERE id NOT IN (SELECT id FROM n)")
def diff_removed(c):
    o, n = c.snapshots()
    return graph.added(n, o).select("id", "name")


@query(f"""WITH {SNAP} SELECT n.id, 'name' AS property, o.name AS old, n.name AS new FROM o JOIN n USING (id) WHERE o.name IS DISTINCT FROM n.name
UNION ALL SELECT n.id, 'line_start', o.line_start::VARCHAR, n.line_start::VARCHAR FROM o JOIN n USING (id) WHERE o.line_start IS DISTINCT FROM n.line_start""")
def diff_modified(c):
    return graph.modified(*c.snapshots(), ["name", "line_start"])


@query(f"""WITH {SNAP}, {CALLS}, a AS (SELECT src, dst FROM calls WHERE src IN (SELECT id FROM o) AND dst IN (SELECT id FROM o)), b AS (SELECT src, dst FROM calls WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def diff_edges(c):
    o, n = c.snapshots()
    a, b = (graph.Graph(x, c.calls()).stored_edges() for x in (o, n))
    return graph.added(a, b, graph.EDGE_KEY).select(F.lit("added").alias("change"), "src", "dst").unionByName(graph.added(b, a, graph.EDGE_KEY).select(F.lit("removed").alias("change"), "src", "dst"))


@query(f"""WITH {SNAP}, {CALLS}, a AS (SELECT src, dst FROM calls WHERE src IN (SELECT id FROM o) AND dst IN (SELECT id FROM o)), b AS (SELECT src, dst FROM calls WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM o)) AS nodes_added, (SELECT count(*) FROM o WHERE id NOT IN (SELECT id FROM n)) AS nodes_removed,
 (SELECT count(*) FROM o JOIN n USING (id) WHERE o.name <> n.name OR o.line_start <> n.line_start) AS nodes_modified,
 (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS edges_added, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS edges_removed, true AS has_changes""")
def diff_summary(c):
    o, n = c.snapshots()
    return graph.diff_summary(graph.Graph(o, graph.Graph(o, c.calls()).stored_edges()), graph.Graph(n, graph.Graph(n, c.calls()).stored_edges()), ["name", "line_start"])


@query(f"""WITH {SNAP}, o2 AS (SELECT id AS path, md5(name || line_start) AS h FROM o), n2 AS (SELECT id AS path, md5(name || line_start) AS h FROM n)
SELECT path, CASE WHEN o2.h IS NULL THEN 'added' WHEN n2.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o2 FULL JOIN n2 USING (path) WHERE o2.h IS DISTINCT FROM n2.h""")
def changeset(c):
    return graph.change_set(*(x.select(F.col("id").alias("path"), F.md5(F.concat("name", F.col("line_start").cast("string"))).alias("hash")) for x in c.snapshots()))


@query(f"WITH {SNAP}, {CALLS} SELECT src, dst FROM calls WHERE src NOT IN (SELECT id FROM o) OR dst NOT IN (SELECT id FROM o)")
def dangling_edges(c):
    e = c.calls().select("src", "dst", "type")
    return e.join(graph.Graph(c.snapshots()[0], e).stored_edges(), ["src", "dst"], "left_anti").select("src", "dst")


# --- lookups and hops ----------------------------------------------------------------------------------------------


@query(f"WITH {FN} SELECT id, name, file FROM fn WHERE regexp_full_match(name, '(?i)RED.*') ORDER BY file, name, id LIMIT 100")
def symbol_search_wild(c):
    return c.functions().filter(tx.wildcard(F.col("name"), "RED*")).select("id", "name", "file").orderBy("file", "name", "id").limit(100)


@query(f"WITH {FN} SELECT id, name, file FROM fn WHERE contains(lower(name), 'gear')")
def symbol_search_sub(c):
    return c.functions().filter(tx.wildcard(F.col("name"), "GEAR")).select("id", "name", "file")


@query(f"WITH {FN}, {CALLS} SELECT src, a.name AS caller, dst, b.name AS callee, source FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst")
def calls_direct(c):
    f = c.functions().select("id", "name")
    return c.calls().join(f.toDF("src", "caller"), "src").join(f.toDF("dst", "callee"), "dst").select("src", "caller", "dst", "callee", "source")


@query(f"WITH {FN}, {CALLS} SELECT src, dst FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE a.is_input_source AND b.is_dangerous_sink")
def calls_both_filters(c):
    f = c.functions()
    return c.calls().join(f.filter("is_input_source").select(F.col("id").alias("src")), "src", "left_semi").join(f.filter("is_dangerous_sink").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


@query(f"WITH RECURSIVE {FN}, {CALLS}, {trail_sql(3)} SELECT start_id, end_id, depth, trail FROM t")
def calls_transitive(c):
    return paths.trails(c.calls(), c.functions(), 3).select(F.col("start").alias("start_id"), F.col("end").alias("end_id"), "depth", F.array_join("nodes", " ").alias("trail"))


@query(f"WITH RECURSIVE {FN}, {CALLS}, sc AS (SELECT * FROM calls WHERE source = 'scip'), {trail_sql(3, 'sc')} SELECT start_id, end_id, depth, trail FROM t")
def calls_all_scip(c):
    return paths.trails(c.calls().filter("source = 'scip'"), c.functions(), 3).select(F.col("start").alias("start_id"), F.col("end").alias("end_id"), "depth", F.array_join("nodes", " ").alias("trail"))


@query(f"WITH {FN}, {CALLS} SELECT dst AS id, count(*) AS callers, count(DISTINCT file) AS caller_files FROM calls JOIN fn ON fn.id = src GROUP BY dst")
def context_callers(c):
    return c.calls().join(c.functions().select(F.col("id").alias("src"), "file"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.countDistinct("file").alias("caller_files"))


@query(f"WITH {FN}, {CALLS} SELECT src AS id, string_agg(name, ',' ORDER BY name, dst) AS callees FROM calls JOIN fn ON fn.id = dst GROUP BY src")
def context_callees(c):
    j = c.calls().join(c.functions().select(F.col("id").alias("dst"), "name"), "dst").groupBy(F.col("src").alias("id"))
    return j.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "dst"))), lambda x: x["name"]), ",").alias("callees"))


@query(f"WITH {CALLS} SELECT id, count(*) AS n FROM (SELECT src AS id, dst AS other FROM calls UNION SELECT dst, src FROM calls) GROUP BY id")
def neighbors(c):
    e = c.calls().select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


@query(f"WITH {FN}, {CALLS} SELECT dst AS id, name, count(*) AS n FROM calls JOIN fn ON fn.id = dst GROUP BY dst, name ORDER BY n DESC, dst LIMIT 10")
def hub_functions(c):
    n = c.calls().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).join(c.functions().select("id", "name"), "id")
    return n.select("id", "name", "n").orderBy(F.desc("n"), "id").limit(10)


@query(f"WITH {FN} SELECT id, name, risk_score FROM fn WHERE risk_score > 50 ORDER BY risk_score DESC, id LIMIT 20")
def high_risk(c):
    return c.functions().filter("risk_score > 50").select("id", "name", "risk_score").orderBy(F.desc("risk_score"), "id").limit(20)


@query(f"WITH {FN} SELECT id, name, file FROM fn WHERE is_input_source ORDER BY file, name, id LIMIT 100")
def input_sources(c):
    return c.functions().filter("is_input_source = true").select("id", "name", "file").orderBy("file", "name", "id").limit(100)


@query(f"WITH {FN} SELECT string_split(file, '/')[1] AS root, count(DISTINCT file) AS files FROM fn GROUP BY 1 ORDER BY files DESC, root LIMIT 10")
def path_roots(c):
    return c.files().groupBy(F.split("path", "/")[0].alias("root")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "root").limit(10)


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, lang LIMIT 5")
def lang_top5(c):
    return c.table("documents").filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(5)


# --- impact and taint ----------------------------------------------------------------------------------------------

_CONF = "CASE WHEN list_contains({0}, 'heuristic') AND NOT list_contains({0}, 'scip') THEN 'low' WHEN list_contains({0}, 'scip') AND NOT list_contains({0}, 'heuristic') THEN 'high' WHEN list_contains({0}, 'scip') THEN 'medium' ELSE 'unknown' END"
_BUCKET = "CASE depth WHEN 1 THEN 'immediate' WHEN 2 THEN 'downstream' ELSE 'transitive' END"


@query(f"WITH RECURSIVE {FN}, {CALLS}, {trail_sql(3)} SELECT start_id AS symbol, end_id AS id, depth, {_BUCKET} AS bucket, {_CONF.format('sources')} AS confidence FROM t")
def impact_down(c):
    return impact.impact(c.calls(), c.functions(), "downstream", 3).drop("sources")


@query(f"WITH RECURSIVE {FN}, {CALLS}, rev AS (SELECT dst AS src, src AS dst, source FROM calls), {trail_sql(3, 'rev')} SELECT start_id AS symbol, end_id AS id, depth, {_BUCKET} AS bucket, {_CONF.format('sources')} AS confidence FROM t")
def impact_up(c):
    return impact.impact(c.calls(), c.functions(), "upstream", 3).drop("sources")


@query(f"""WITH RECURSIVE {FN}, {CALLS}, {trail_sql(3)},
s AS (SELECT start_id AS symbol, count(*) AS total, count(*) FILTER (depth = 1) AS immediate, count(*) FILTER (depth = 2) AS downstream, count(*) FILTER (depth > 2) AS transitive,
  sum(len(list_filter(sources, lambda x: x = 'scip')))::BIGINT AS scip_edges, sum(len(list_filter(sources, lambda x: x = 'heuristic')))::BIGINT AS heuristic_edges, sum(len(list_filter(sources, lambda x: x = 'unknown')))::BIGINT AS unknown_edges FROM t GROUP BY 1)
SELECT *, CASE WHEN heuristic_edges = 0 THEN 'high' WHEN scip_edges = 0 THEN 'low' ELSE 'medium' END AS confidence FROM s""")
def impact_summary(c):
    return impact.summary(impact.impact(c.calls(), c.functions(), "downstream", 3))


@query(f"""WITH RECURSIVE {FN}, {CALLS}, {trail_sql(2)}, x AS (SELECT start_id AS symbol, fn.* FROM t JOIN fn ON fn.id = end_id)
SELECT symbol, 'input_source:' || id AS flag FROM x WHERE is_input_source UNION ALL SELECT symbol, 'dangerous_sink:' || id FROM x WHERE is_dangerous_sink UNION ALL SELECT symbol, 'crypto:' || id FROM x WHERE is_crypto""")
def impact_flags(c):
    return impact.security_flags(impact.impact(c.calls(), c.functions(), "downstream", 2), c.functions())


@query(f"WITH {FN} SELECT id, name, file FROM fn WHERE file LIKE '%Brand#11'")
def change_impact_funcs(c):
    return impact.changed_functions(c.functions(), c.changed_files()).select("id", "name", "file")


_SINKS = f"""{FN}, {CALLS}, r(id, d) AS (SELECT id, 0 FROM fn WHERE file LIKE '%Brand#11' UNION SELECT dst, d + 1 FROM r JOIN calls ON src = r.id WHERE d < 3),
sinks AS (SELECT DISTINCT r.id FROM r JOIN fn ON fn.id = r.id WHERE d > 0 AND is_dangerous_sink)"""


@query(f"WITH RECURSIVE {_SINKS} SELECT id FROM sinks")
def change_impact_sinks(c):
    return impact.reached_sinks(c.functions(), c.calls(), c.changed_files())


@query(f"""WITH RECURSIVE {_SINKS}, k AS (SELECT count(*) AS changed_functions, coalesce(bool_or(is_input_source), false) AS i, coalesce(bool_or(is_dangerous_sink), false) AS s FROM fn WHERE file LIKE '%Brand#11'), m AS (SELECT count(*) AS sinks_reached FROM sinks)
SELECT changed_functions, sinks_reached, CASE WHEN i AND s THEN 'CRITICAL' WHEN s OR sinks_reached > 3 THEN 'HIGH' WHEN i OR sinks_reached > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM k, m""")
def change_risk(c):
    return impact.change_risk(c.functions(), c.calls(), c.changed_files())


@query(f"""WITH RECURSIVE {FN}, {CALLS}, src AS (SELECT id FROM fn WHERE is_input_source), {trail_sql(5, 'calls', 'src')}
SELECT a.name AS source_name, start_id, b.name AS sink_name, end_id, depth, trail FROM t JOIN fn a ON a.id = start_id JOIN fn b ON b.id = end_id WHERE b.is_dangerous_sink ORDER BY depth, trail LIMIT 50""")
def taint_paths(c):
    return impact.taint_paths(c.functions(), c.calls(), 5, 50)


@query(f"""WITH RECURSIVE {FN}, {CALLS}, r(id) AS (SELECT id FROM fn WHERE is_input_source UNION SELECT dst FROM r JOIN calls ON src = r.id) SELECT id FROM r""")
def reach_descendants(c):
    return paths.descendants(c.calls(), c.functions().filter("is_input_source = true")).select("id")


@query(f"""WITH {FN} SELECT id FROM fn WHERE file NOT LIKE '%Brand#11' UNION ALL SELECT DISTINCT 'file:' || file FROM fn WHERE file NOT LIKE '%Brand#11'""")
def delete_subgraph(c):
    gone = paths.descendants(c.contains(), c.changed_files().select(F.concat(F.lit("file:"), "path").alias("id")))
    return c.functions().select("id").unionByName(c.files().select("id")).join(gone, "id", "left_anti")


# --- enrichment ----------------------------------------------------------------------------------------------------


@query(f"WITH {FN} SELECT id, coalesce(is_input_source, false) AS i, coalesce(is_dangerous_sink, false) AS s, coalesce(is_allocator, false) AS a, coalesce(is_parser, false) AS p, coalesce(is_crypto, false) AS c FROM fn")
def security_labels(c):
    names = {"is_input_source": "i", "is_dangerous_sink": "s", "is_allocator": "a", "is_parser": "p", "is_crypto": "c"}
    return c.functions().select("id", *(F.coalesce(k, F.lit(False)).alias(v) for k, v in names.items()))


@query(f"WITH {FN} SELECT id, risk_score FROM fn")
def risk_scores(c):
    return c.functions().select("id", "risk_score")


@query(f"""WITH {FN}, t AS (SELECT p_type || '/' || p_brand AS path, l_orderkey AS k, o_orderdate AS d FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT path, count(*) AS churn_count, strftime(max(d), '%Y-%m-%d') AS last_modified FROM t GROUP BY path""")
def churn_files(c):
    return enrich.churn(c.files().select("path"), c.touched()).withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd"))


@query("SELECT o_custkey AS author, count(*) AS commits, min(o_orderdate)::DATE::VARCHAR AS first_date FROM orders GROUP BY 1")
def author_commits(c):
    return c.table("orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count("*").alias("commits"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_date"))


@query(r"SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '(?i)\berror\b')")
def commit_pattern_scan(c):
    return c.table("events").filter(F.col("event_type").rlike(r"(?i)\berror\b")).select("event_id", "event_type")


@query("""SELECT DISTINCT 'dep:' || s_suppkey AS dep, s_name AS name, 'vuln:' || n_name AS vuln, r_name AS severity FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN lineitem ON l_suppkey = s_suppkey WHERE contains(upper(r_name), 'A')""")
def dep_vulns(c):
    a = c.affected().filter(F.upper("severity").contains("A"))
    return a.join(c.depends().select("dep").distinct(), "dep", "left_semi").select("dep", F.col("dep_name").alias("name"), "vuln", "severity")


@query(f"""WITH {FN} SELECT 'author:' || o_custkey AS author, count(DISTINCT file) AS sink_files FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN fn ON seq = l_partkey WHERE is_dangerous_sink GROUP BY 1""")
def authors_of_sinks(c):
    sinks = c.functions().filter("is_dangerous_sink = true").select(F.col("seq").alias("l_partkey"), "file")
    t = c.table("lineitem").select("l_orderkey", "l_partkey").join(sinks, "l_partkey").select("l_orderkey", "file").distinct()
    return t.join(c.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy(F.concat(F.lit("author:"), "o_custkey").alias("author")).agg(F.countDistinct("file").alias("sink_files"))


_ENTRY = f"{FN}, {CALLS}, en AS (SELECT id FROM fn WHERE is_exported AND id NOT IN (SELECT dst FROM calls))"


@query(f"WITH {_ENTRY} SELECT id FROM en")
def entry_points(c):
    return enrich.entry_points(c.functions(), c.calls()).select("id")


_PROC = f"""{_ENTRY}, r(s, id, d) AS (SELECT id, id, 0 FROM en UNION SELECT s, dst, d + 1 FROM r JOIN calls ON src = r.id WHERE d < 10),
m AS (SELECT DISTINCT s, id FROM r), big AS (SELECT s, count(*) AS step_count FROM m GROUP BY s HAVING count(*) > 1)"""


@query(f"WITH RECURSIVE {_PROC} SELECT 'process:' || m.s AS process, m.id FROM m JOIN big USING (s)")
def process_trace(c):
    return enrich.processes(c.functions(), c.calls()).select("process", "id")


@query(f"""WITH RECURSIVE {_PROC} SELECT 'process:' || m.s AS process, CASE WHEN bool_or(coalesce(is_input_source, false)) AND bool_or(coalesce(is_dangerous_sink, false)) THEN 'data_flow' WHEN bool_or(coalesce(is_input_source, false)) THEN 'input_handler'
 WHEN bool_or(coalesce(is_dangerous_sink, false)) THEN 'sink_caller' ELSE 'computation' END AS type, count(*) AS step_count FROM m JOIN big USING (s) JOIN fn ON fn.id = m.id GROUP BY m.s""")
def process_class(c):
    return enrich.classify(enrich.processes(c.functions(), c.calls()), c.functions())


@query(f"""WITH RECURSIVE {_PROC}, dist AS (SELECT s, id, min(d) AS d FROM r GROUP BY ALL),
w(s, id, d, o) AS (SELECT id, id, 0, '' FROM en UNION ALL
  SELECT w.s, e.dst, w.d + 1, min(w.o || lpad(substr(e.dst, 6), 20, '0') || e.dst || chr(1)) FROM w JOIN calls e ON e.src = w.id JOIN dist ON dist.s = w.s AND dist.id = e.dst AND dist.d = w.d + 1 GROUP BY w.s, e.dst, w.d)
SELECT 'process:' || w.s AS process, w.id, (row_number() OVER (PARTITION BY w.s ORDER BY w.d, w.o) - 1)::INT AS step FROM w JOIN big USING (s)""")
def process_steps(c):
    return enrich.processes(c.functions(), c.calls())


# inside files, calls between functions of one brand: small components
_COMP = f"""{FN}, {CALLS}, l AS (SELECT src, dst FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE split_part(a.file, '/', 2) = split_part(b.file, '/', 2)),
u AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), r(s, id) AS (SELECT id, id FROM fn UNION SELECT s, dst FROM r JOIN u ON u.src = r.id), comp AS (SELECT s AS id, min(id) AS component FROM r GROUP BY s)"""


def _brand_links(c):
    f = c.functions().select("id", F.element_at(F.split("file", "/"), -1).alias("brand"))
    return c.calls().join(f.toDF("src", "a"), "src").join(f.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst")


@query(f"WITH RECURSIVE {_COMP} SELECT id, component FROM comp")
def components(c):
    return paths.components(_brand_links(c), c.functions())


@query(f"""WITH RECURSIVE {_COMP}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT component, count(*) AS links FROM (SELECT DISTINCT a.component, least(src, dst), greatest(src, dst) FROM l JOIN comp a ON a.id = src) GROUP BY 1),
p AS (SELECT component, place FROM (SELECT component, split_part(file, '/', 1) AS place, count(*) AS c FROM comp JOIN fn USING (id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY component ORDER BY c DESC, place) = 1)
SELECT component, place || '_cluster' AS name, size, round(2.0 * links / (size * (size - 1)), 3) AS cohesion FROM z JOIN k USING (component) JOIN p USING (component)""")
def cluster_cohesion(c):
    e = _brand_links(c)
    return enrich.cluster_facts(paths.components(e, c.functions()), e, c.functions())


# --- call resolution -----------------------------------------------------------------------------------------------

_REF = f"""{FN}, {CALLS}, cc AS (SELECT src || '>' || dst AS call_id, a.file AS f, a.line_start AS line, b.name AS callee FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst)"""


def _refs(c):
    f = c.functions()
    return c.calls().join(f.select(F.col("id").alias("src"), F.col("file").alias("caller_file"), F.col("line_start").alias("caller_line")), "src").join(f.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").select(F.concat_ws(">", "src", "dst").alias("call_id"), "caller_file", "caller_line", "callee")


@query(f"WITH {_REF} SELECT call_id, arg_min(id, abs(line_start - line)::BIGINT * 100000000 + seq) AS target FROM cc JOIN fn ON file = f AND name = callee GROUP BY call_id")
def resolve_intra(c):
    return resolve.in_file(_refs(c), c.functions())


@query(f"WITH {_REF}, q AS (SELECT name || line_start AS n, min(id) AS id FROM fn GROUP BY 1 HAVING count(*) = 1), k AS (SELECT src || '>' || dst AS call_id, name || line_start AS n FROM calls JOIN fn ON id = dst) SELECT call_id, id AS target FROM k JOIN q USING (n)")
def resolve_unique(c):
    f = c.functions().withColumn("name", F.concat("name", F.col("line_start").cast("string")))
    calls = c.calls().join(f.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").select(F.concat_ws(">", "src", "dst").alias("call_id"), "callee")
    return resolve.unique_name(calls, f)


@query(f"""WITH {_REF}, intra AS (SELECT call_id, arg_min(id, abs(line_start - line)::BIGINT * 100000000 + seq) AS target FROM cc JOIN fn ON file = f AND name = callee GROUP BY call_id)
SELECT call_id, coalesce(q.id, intra.target) AS target, CASE WHEN q.id IS NOT NULL THEN 'qualifier' WHEN intra.target IS NOT NULL THEN 'file' END AS level
FROM cc LEFT JOIN intra USING (call_id) LEFT JOIN (SELECT file, name, arg_max(id, seq) AS id FROM fn WHERE is_exported GROUP BY ALL) q ON q.name = callee AND q.file = replace(f, 'SMALL', 'ECONOMY')""")
def resolve_chain(c):
    f = c.functions()
    r = _refs(c).withColumn("qualifier", F.regexp_replace("caller_file", "SMALL", "ECONOMY")).withColumn("caller", F.substring_index("call_id", ">", 1)).drop("caller_file", "caller_line")
    none = c.spark.createDataFrame([], "file string, target string, names string, seq long")
    # two definitions of every name keep the last level from answering
    twice = f.unionByName(f.withColumn("file", F.lit("-")).withColumn("id", F.concat(F.lit("x"), "id")))
    done = resolve.resolve(r, twice, f.filter("is_exported").select(F.col("file").alias("owner"), "name", "id", "seq"), none, c.files().select("path"))
    return done.select("call_id", "target", "level")


@query("""WITH r AS (SELECT doc_id AS id, lang AS f, n_chars AS a, n_chars + 2000 AS b FROM documents), p AS (SELECT DISTINCT lang AS f, n_chars + 100 AS l FROM documents)
SELECT p.f AS file, p.l AS line, arg_max(id, a * 10000000 + id) AS owner FROM p JOIN r ON p.f = r.f AND l BETWEEN a AND b GROUP BY ALL""")
def enclosing_range(c):
    d = c.table("documents")
    ranges = d.select(F.col("lang").alias("file"), F.col("n_chars").alias("start"), (F.col("n_chars") + 2000).alias("stop"), F.col("doc_id").alias("id"))
    return resolve.enclosing(d.select(F.col("lang").alias("file"), (F.col("n_chars") + 100).alias("line")).distinct(), ranges)


@query(f"""WITH {FN}, p AS (SELECT DISTINCT file, name, (line_start * 7) % 50 AS line FROM fn)
SELECT p.file, p.name, line, arg_min(id, lpad(abs(line_start - line - 1)::VARCHAR, 9, '0') || id) AS target FROM p JOIN fn ON fn.file = p.file AND fn.name = p.name GROUP BY ALL""")
def nearest_def(c):
    f = c.functions()
    return resolve.nearest(f.select("file", "name", ((F.col("line_start") * 7) % 50).alias("line")).distinct(), f)


# --- search --------------------------------------------------------------------------------------------------------

QUERY = "the ing 4 src0"
_TOK = "tk AS (SELECT 'doc:' || doc_id AS id, unnest(flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: list_concat([w], CASE WHEN len(regexp_extract_all(w, '[a-z]+|[0-9]+')) > 1 THEN list_filter(regexp_extract_all(w, '[a-z]+|[0-9]+'), lambda p: len(p) > 1) ELSE [] END)))) AS token FROM documents)"
_BM = f"""{_TOK}, dl AS (SELECT id, count(*) AS dl FROM tk GROUP BY 1), st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tk) / (SELECT count(*) FROM documents) AS a),
tf AS (SELECT id, token, count(*) AS tf FROM tk WHERE token IN ('the', 'ing', '4', 'src0', 'src') GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM tf JOIN df USING (token) JOIN dl USING (id), st GROUP BY id),
gr AS (SELECT id, s FROM (SELECT 'doc:' || doc_id AS id, (n_chars > 5000)::INT * 2.0 + (lang = 'en')::INT * 0.5 + CASE WHEN lower(source) = 'the ing 4 src0' THEN 5.0 WHEN contains(lower(source), 'the ing 4 src0') THEN 2.0 ELSE 0.0 END AS s FROM documents) WHERE s > 0)"""


@query(f"WITH {_TOK} SELECT token, count(*) AS n, count(DISTINCT id) AS docs FROM tk GROUP BY token")
def token_counts(c):
    return search.postings(c.search_docs()).groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query(f"WITH {_TOK}, d AS (SELECT token, count(DISTINCT id) AS df FROM tk GROUP BY 1) SELECT token, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM d")
def idf(c):
    d = c.search_docs()
    return search.idf(search.postings(d), d.count()).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_BM} SELECT id, round(s, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 50")
def bm25_top(c):
    return search.bm25(c.search_docs(), QUERY).select("id", F.round("bm25", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query(f"WITH {_BM} SELECT id, s AS score FROM gr")
def graph_relevance(c):
    return search.relevance(c.search_docs(), QUERY).withColumnRenamed("graph", "score")


@query(f"WITH {_BM} SELECT id, round(0.7 * coalesce(bm.s, 0) / (SELECT max(s) FROM bm) + 0.3 * coalesce(gr.s, 0) / (SELECT max(s) FROM gr), 4) AS score FROM bm FULL JOIN gr USING (id)")
def fused_search(c):
    return search.fused(c.search_docs(), QUERY)


@query(r"""WITH d AS (SELECT 'doc:' || doc_id AS id, text, length(text) AS n FROM documents), p AS (SELECT id, text, n, unnest(range(0, greatest(coalesce(n, 0) - 1, 0) + 1, 20)) AS p FROM d),
k AS (SELECT *, contains(lower(substr(text, p + 1, 150)), 'license')::INT + contains(lower(substr(text, p + 1, 150)), 'thing')::INT AS k FROM p), b AS (SELECT id, any_value(text) AS text, any_value(n) AS n, arg_max(p, coalesce(k, 0) * 1000000000 - p) AS p FROM k GROUP BY id)
SELECT id, CASE WHEN coalesce(n, 0) = 0 THEN '' ELSE CASE WHEN p > 0 THEN '...' ELSE '' END || regexp_replace(substr(text, p + 1, 150), '^\s+|\s+$', '', 'g') || CASE WHEN p + 150 < n THEN '...' ELSE '' END END AS snippet FROM b""")
def snippets(c):
    return c.search_docs().select("id", search.snippet(F.col("text"), ["license", "thing"]).alias("snippet"))


# --- text scans ----------------------------------------------------------------------------------------------------


@query(r"""WITH l AS (SELECT doc_id, u.line, u.i FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'line': x, 'i': i})) AS u FROM documents))
SELECT 'doc:' || doc_id AS path, i::INT AS line, k AS type FROM l JOIN (VALUES ('LICENSE', '(?i)\blicensed?\b'), ('WORD', '\bidiot\b')) v(k, p) ON regexp_matches(line, p)""")
def annotations_scan(c):
    d = c.table("documents").select(F.concat(F.lit("doc:"), "doc_id").alias("path"), "text")
    return tx.annotations(d, {"LICENSE": r"(?i)\blicensed?\b", "WORD": r"\bidiot\b"}).select("path", "line", "type")


@query(r"""SELECT page_id, CASE WHEN contains(h, 'from') AND regexp_matches(h, '["''][^"'']+["'']') THEN regexp_extract(h, '["'']([^"'']+)["'']', 1) WHEN regexp_matches(h, '["''][^"'']+["'']') THEN regexp_extract(h, '["'']([^"'']+)["'']', 1) ELSE h END AS target
FROM (SELECT page_id, trim(regexp_extract(html, '<a [^>]*>')) AS h FROM pages)""")
def import_targets(c):
    return c.table("pages").select("page_id", tx.import_target(F.regexp_extract("html", "<a [^>]*>", 0)).alias("target"))


@query("SELECT page_id, sha256(html) AS hash, octet_length(encode(html))::BIGINT AS size FROM pages")
def manifest(c):
    return c.table("pages").select("page_id", F.sha2("html", 256).alias("hash"), F.octet_length("html").cast("long").alias("size"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(c):
    return c.table("events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


# --- the pattern language ------------------------------------------------------------------------------------------


def _graph(c) -> graph.Graph:
    f = c.functions().withColumn("path", F.lit(None).cast("string"))
    files = c.files().select("id", F.lit("File").alias("label"), F.lit(0).cast("long").alias("seq"), "path")
    return graph.Graph(f.unionByName(files, allowMissingColumns=True), c.calls().unionByName(c.contains(), allowMissingColumns=True))


@query(f"WITH {FN}, {CALLS} SELECT a.name AS caller, b.name AS callee, count(*) AS n FROM calls JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE a.is_input_source AND b.risk_score >= 30 GROUP BY ALL")
def match_hops(c):
    return match.run(_graph(c), "MATCH (a:Function)-[r:CALLS]->(b:Function) WHERE a.is_input_source = true AND b.risk_score >= 30 RETURN a.name AS caller, b.name AS callee, count(*) AS n")


@query(f"WITH RECURSIVE {FN}, {CALLS}, src AS (SELECT id FROM fn WHERE is_input_source), {trail_sql(3, 'calls', 'src')} SELECT start_id, end_id, depth FROM t JOIN fn ON fn.id = end_id WHERE is_dangerous_sink")
def match_trails(c):
    return match.run(_graph(c), "MATCH p = (s:Function {is_input_source: true})-[:CALLS*1..3]->(t:Function {is_dangerous_sink: true}) RETURN s.id AS start_id, t.id AS end_id, length(p) AS depth")


@query(f"WITH RECURSIVE {FN}, {CALLS}, r(s, id, d) AS (SELECT id, id, 0 FROM fn WHERE is_input_source UNION SELECT s, dst, d + 1 FROM r JOIN calls ON src = r.id WHERE d < 3) SELECT DISTINCT s AS start_id, r.id AS end_id FROM r WHERE d > 0")
def match_reach(c):
    return match.run(_graph(c), "MATCH (s:Function {is_input_source: true})-[:CALLS*1..3]->(t:Function) RETURN DISTINCT s.id AS start_id, t.id AS end_id")


@query(f"WITH {FN}, {CALLS} SELECT f.id, 'file:' || f.file AS file, count(c.dst) AS calls FROM fn f LEFT JOIN calls c ON c.src = f.id GROUP BY f.id, f.file")
def match_optional(c):
    return match.run(_graph(c), "MATCH (x:File)-[:CONTAINS]->(f:Function) OPTIONAL MATCH (f)-[:CALLS]->(g:Function) RETURN f.id AS id, x.id AS file, count(g) AS calls")


# trails that may cross an edge either way, but no edge twice
_BOTH = f"""{FN}, {CALLS}, far AS (SELECT * FROM calls WHERE source IS NULL), u AS (SELECT src, dst, src || '>' || dst AS e FROM far UNION ALL SELECT dst, src, src || '>' || dst FROM far),
t AS (SELECT src AS s, dst AS x, [e] AS es, 1 AS depth FROM u), t2 AS (SELECT s, u.dst AS x, 2 AS depth FROM t JOIN u ON u.src = t.x WHERE NOT list_contains(es, u.e))"""


def _unknown_calls(c) -> graph.Graph:
    g = _graph(c)
    return graph.Graph(g.nodes, g.edges.filter("type = 'CALLS' AND source IS NULL"))


@query(f"WITH {_BOTH} SELECT s AS start_id, x AS end_id FROM t UNION SELECT s, x FROM t2")
def match_undirected(c):
    return match.run(_unknown_calls(c), "MATCH (a:Function)-[:CALLS*1..2]-(b:Function) RETURN DISTINCT a.id AS start_id, b.id AS end_id")


@query(f"WITH {_BOTH} SELECT s AS start_id, x AS end_id, depth FROM t UNION ALL SELECT s, x, depth FROM t2")
def match_undirected_trails(c):
    return match.run(_unknown_calls(c), "MATCH p = (a:Function)-[:CALLS*1..2]-(b:Function) RETURN a.id AS start_id, b.id AS end_id, length(p) AS depth")
