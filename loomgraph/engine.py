"""The verbs of the engine: each returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import fronts
from loomgraph.functions.text import annotations, wildcard
from loomgraph.operators import enrich, impact, paths, resolve, search
from loomgraph.operators.communities import communities
from loomgraph.operators.graph import Graph, change_set
from loomgraph.plans import match
from loomgraph.plans.storage import stored
from loomgraph.sources import code_index, files, history, manifests, state
from loomgraph.sources.sinks import Store

TYPES = {"annotation": "Annotation", "class": "Class", "enum": "Enum", "file": "File", "function": "Function", "interface": "Interface", "macro": "Macro", "module": "Module", "struct": "Struct", "typealias": "TypeAlias"}


def _with(df: DataFrame, column: str, kind: str) -> DataFrame:
    """df with the column, null where no row ever had it."""
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))


@dataclass
class Engine:
    """A graph with the questions that can be asked of it."""

    graph: Graph

    def query(self, statement: str, **params) -> DataFrame:
        return match.run(self.graph, statement, params)

    def functions(self) -> DataFrame:
        return self.graph.nodes.filter("label = 'Function'")

    def calls(self) -> DataFrame:
        e = self.graph.edges.filter("type = 'CALLS'")
        return e if "source" in e.columns else e.withColumn("source", F.lit(None).cast("string"))

    def search(self, text: str, kind: str = "function", file: str | None = None, limit: int = 100) -> DataFrame:
        """Symbols by name, with * as a wildcard; an unknown kind is taken for a label."""
        n = self.graph.nodes.filter((F.col("label") == TYPES.get(kind.lower(), kind)) & wildcard(F.col("name"), text))
        n = n if file is None else n.filter(wildcard(F.col("file"), file))
        return n.select("id", "name", "file").orderBy(F.asc_nulls_last("file"), "name", "id").limit(limit)

    def ranked(self, text: str, limit: int = 20, label: str | None = None) -> DataFrame:
        return search.ranked(self.graph.nodes, text, label, limit).join(self.graph.nodes.select("id", "name", "label"), "id").orderBy(F.desc("score"), "id")

    def search_calls(self, caller: str | None = None, callee: str | None = None, depth: int = 1, source: str | None = None) -> DataFrame:
        """Call trails of up to depth edges between functions by name; with a source, on edges of that source alone."""
        f, e = self.functions().select("id", "name"), self.calls()
        e = e if source is None else e.filter(F.col("source") == source)
        start = f if caller is None else f.filter(wildcard(F.col("name"), caller))
        end = f if callee is None else f.filter(wildcard(F.col("name"), callee))
        t = paths.trails(e, start, min(10, max(1, depth)))
        return t.join(end.select(F.col("id").alias("end"), F.col("name").alias("callee")), "end").join(start.select(F.col("id").alias("start"), F.col("name").alias("caller")), "start").select("caller", "start", "callee", "end", "depth", "nodes")

    def source(self, node_id: str) -> DataFrame:
        return self.graph.nodes.filter((F.col("id") == node_id) & F.col("body").isNotNull()).select("id", "name", "file", "body")

    def context(self, node_id: str) -> DataFrame:
        """(relation, id, name): callers, callees, cluster and processes of a node."""
        n = self.graph.nodes.select("id", "name")
        out = self.graph.edges.filter(F.col("src") == node_id).filter(F.col("type").isin("CALLS", "BELONGS_TO", "PARTICIPATES_IN"))
        names = F.when(F.col("type") == "CALLS", "callee").when(F.col("type") == "BELONGS_TO", "cluster").otherwise("process")
        into = self.graph.edges.filter((F.col("dst") == node_id) & (F.col("type") == "CALLS"))
        return out.select(names.alias("relation"), F.col("dst").alias("id")).unionByName(into.select(F.lit("caller").alias("relation"), F.col("src").alias("id"))).join(n, "id", "left")

    def impact(self, node_id: str, direction: str = "downstream", depth: int = 3) -> DataFrame:
        one = self.graph.nodes.filter(F.col("id") == node_id).select("id")
        return impact.impact(self.calls(), one, direction, depth)

    def detect_changes(self, changed_files: DataFrame) -> DataFrame:
        return impact.change_risk(self.functions(), self.calls(), changed_files)

    def change_report(self, changed_files: DataFrame) -> dict[str, DataFrame]:
        """What changed files touch: functions, sinks that they reach, clusters and processes, and the risk."""
        return {
            "functions": impact.changed_functions(self.functions(), changed_files), "sinks": impact.reached_sinks(self.functions(), self.calls(), changed_files),
            "groups": self.changed_groups(changed_files), "risk": self.detect_changes(changed_files),
        }

    def changed_groups(self, changed_files: DataFrame) -> DataFrame:
        """(relation, id): the clusters and processes of functions in changed files(path), each once."""
        f = impact.changed_functions(self.functions(), changed_files).select(F.col("id").alias("src"))
        e = self.graph.edges.filter(F.col("type").isin("BELONGS_TO", "PARTICIPATES_IN")).join(f, "src", "left_semi")
        return e.select(F.when(F.col("type") == "BELONGS_TO", "cluster").otherwise("process").alias("relation"), F.col("dst").alias("id")).distinct()

    def properties(self, node_id: str) -> DataFrame:
        """(property, value) of a node: the properties that it has, as text."""
        n = self.graph.nodes.filter(F.col("id") == node_id)
        cols = [c for c, t in n.dtypes if c not in ("id", "label", "seq") and not t.startswith(("map", "array", "struct"))]
        pairs = F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in cols))
        return n.select(F.explode(pairs).alias("x")).select("x.property", "x.value").filter("value IS NOT NULL")

    def group_counts(self) -> DataFrame:
        """(label, n) of clusters and processes."""
        return self.graph.nodes.filter(F.col("label").isin("Cluster", "Process")).groupBy("label").agg(F.count("*").alias("n"))

    def clusters(self, limit: int | None = None) -> DataFrame:
        return self._largest("Cluster", "size", limit)

    def processes(self, limit: int | None = None) -> DataFrame:
        return self._largest("Process", "step_count", limit)

    def _largest(self, label: str, by: str, limit: int | None) -> DataFrame:
        n = _with(self.graph.nodes, by, "long").filter(F.col("label") == label).orderBy(F.desc_nulls_last(by), "id")
        return n if limit is None else n.limit(limit)

    def cluster_members(self, limit: int = 20) -> DataFrame:
        """(cluster, size, id, name, file, place): the functions of the largest clusters, in order of file and name."""
        top = self.clusters(limit).select(F.col("id").alias("cluster"), "size")
        e = self.graph.edges.filter("type = 'BELONGS_TO'").select(F.col("src").alias("id"), F.col("dst").alias("cluster"))
        m = e.join(F.broadcast(top), "cluster").join(self.functions().select("id", "name", "file"), "id")
        w = Window.partitionBy("cluster").orderBy("file", "name", "id")
        return m.select("cluster", "size", "id", "name", "file", F.row_number().over(w).alias("place"))

    def exists(self, node_id: str) -> bool:
        return not self.graph.nodes.filter(F.col("id") == node_id).limit(1).isEmpty()

    def schema(self) -> dict[str, DataFrame]:
        """The labels, edge types and property names in use, each as (name)."""
        return {k: match.procedure(self.graph, p, "name") for k, p in (("labels", "labels"), ("types", "relationshipTypes"), ("keys", "propertyKeys"))}

    def find_vulnerabilities(self, severity: str | None = None, limit: int | None = None) -> DataFrame:
        """(dependency_id, dependency, vulnerability, severity), the severest first; with a severity, of those that hold it."""
        n = _with(self.graph.nodes, "severity", "string")
        e = self.graph.edges.filter("type = 'AFFECTED_BY'").select("src", "dst")
        j = e.join(n.select(F.col("id").alias("src"), F.col("name").alias("dependency")), "src").join(n.filter("label = 'Vulnerability'").select(F.col("id").alias("dst"), "severity"), "dst")
        j = j if severity is None else j.filter(F.upper("severity").contains(severity.upper()))
        j = j.select(F.col("src").alias("dependency_id"), "dependency", F.col("dst").alias("vulnerability"), "severity").orderBy(F.desc_nulls_last("severity"), "dependency_id", "vulnerability")
        return j if limit is None else j.limit(limit)

    def stats(self) -> DataFrame:
        return self.graph.stats()


def calls_of(got: DataFrame, index: DataFrame | None = None, covered: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The CALLS edges of a front end's rows, each resolved by qualifier, file, import or unique name, and the nodes that
    stand for what stays unresolved."""
    order = F.concat_ws("#", "path", F.format_string("%09d", "seq"))
    prop = lambda k: F.get_json_object("props", f"$.{k}")
    functions = got.filter("kind = 'node' AND other = 'Function'").select("id", "name", prop("file").alias("file"), prop("line_start").cast("int").alias("line_start"), order.alias("seq"))
    edges = got.filter("kind = 'edge'")
    calls = edges.filter("name = 'CALLS'").select(order.alias("call_id"), F.col("id").alias("caller"), prop("callee").alias("callee"), F.nullif(prop("qualifier"), F.lit("")).alias("qualifier"))
    inside = edges.filter("name = 'CONTAINS'").select(F.element_at(F.split("id", ":"), -1).alias("owner"), F.col("other").alias("id"), F.regexp_extract("id", "^(class|struct|interface):", 1).alias("kind")).filter("kind <> ''")
    methods = inside.join(functions.select("id", "name", "seq"), "id").select("owner", "name", "id", "seq")
    imports = edges.filter("name = 'IMPORTS'").select(F.substring_index("id", "file:", -1).alias("file"), F.regexp_replace("other", "^module:", "").alias("target"), prop("names").alias("names"), order.alias("seq"))
    done = stored(resolve.resolve(calls, functions, methods, imports, got.select("path").distinct()), "resolved")
    if index is None or not covered:
        out = resolve.resolved_edges(done)
    else:
        ended = functions.join(got.filter("kind = 'node'").select("id", prop("line_end").cast("int").alias("line_end")), "id").withColumn("language", files.language(F.col("file")))
        sure = resolve.index_calls(code_index.occurrences(index), ended.select("id", "name", "file", "line_start", "line_end"))
        known = got.sparkSession.createDataFrame([(x,) for x in covered], "language string").join(resolve.languages_of(ended), "language", "left_semi")
        out = resolve.orchestrate(done, sure, ended, known)
        done = done.join(ended.select(F.col("id").alias("caller"), "language"), "caller", "left").join(known, "language", "left_anti")
    out = out.withColumn("seq", F.concat(F.lit("1#"), "src", F.lit("#"), "dst"))
    refs = done.filter("target IS NULL").select(F.concat(F.lit("funcref:"), F.when(F.coalesce("qualifier", F.lit("")) != "", F.concat("qualifier", F.lit("."))).otherwise(""), "callee").alias("id"), F.col("callee").alias("name"))
    return out, refs.distinct().select("id", F.lit("Function").alias("label"), F.concat(F.lit("4#"), "id").alias("seq"), "name")


def extract(spark: SparkSession, root: str, changed: DataFrame | None = None, git: bool = True, osv: DataFrame | None = None, clusters: bool = True, processes: bool = True, index: DataFrame | None = None, covered: tuple[str, ...] = ()) -> Graph:
    """The graph of a source tree: files, symbols of all languages with resolved calls and flows, annotations, dependencies,
    history with churn (where the tree is a repository on this machine), advisories of the snapshot osv, security labels,
    communities of calls and processes. With changed(path), only these files are read. index(path, content) are compiler
    index files for the languages `covered`, whose calls then come from there alone."""
    src = files.source_files(spark, root, changed)
    got = stored(fronts.extract(src), "front")
    num = lambda k: F.get_json_object("props", f"$.{k}").cast("int").alias(k)
    word = lambda k: F.get_json_object("props", f"$.{k}").alias(k)
    truth = lambda k: F.get_json_object("props", f"$.{k}").cast("boolean").alias(k)
    symbols = got.filter("kind = 'node'").select("id", F.col("other").alias("label"), F.concat_ws("#", F.lit("1"), "path", F.format_string("%09d", "seq")).alias("seq"), "name", word("file"), word("path"), num("line_start"), num("line_end"), word("params"), word("return_type"), truth("is_exported"), truth("is_abstract"), word("body"), truth("body_truncated"), word("flags"))
    calls, refs = calls_of(got, index, covered)
    labelled = enrich.security_labels(symbols.filter("label = 'Function'").unionByName(refs, allowMissingColumns=True))
    f = src.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("label"), F.concat(F.lit("0#"), "path").alias("seq"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "language", "hash", F.col("size").cast("long").alias("size"))
    notes = annotations(src.select("path", "text"))
    ann = notes.select("id", F.lit("Annotation").alias("label"), F.concat(F.lit("3#"), "id").alias("seq"), F.col("type").alias("name"), F.col("path").alias("file"), F.col("text").alias("body"))
    deps = manifests.scan_dependencies(spark, root)
    dep = deps.select(F.concat(F.lit("dep:"), "name").alias("id"), F.lit("Dependency").alias("label"), F.concat(F.lit("2#"), "path", F.lit("#"), "name").alias("seq"), "name", "version", F.col("source").alias("file"))
    order = F.concat_ws("#", F.lit("1"), "path", F.format_string("%09d", "seq")).alias("seq")
    edges = got.filter("kind <> 'node' AND NOT (kind = 'edge' AND name = 'CALLS')").select(F.col("id").alias("src"), F.col("other").alias("dst"), F.col("name").alias("type"), order, word("names"), word("from_var"), word("to_var"), word("via_function"), word("via_variable"))
    more = notes.select(F.concat(F.lit("file:"), "path").alias("src"), F.col("id").alias("dst"), F.lit("HAS_ANNOTATION").alias("type"), F.concat(F.lit("3#"), "id").alias("seq"))
    need = deps.select(F.concat(F.lit("module:"), F.regexp_replace("path", "/?[^/]*$", "")).alias("src"), F.concat(F.lit("dep:"), "name").alias("dst"), F.lit("DEPENDS_ON").alias("type"), F.concat(F.lit("2#"), "path", F.lit("#"), "name").alias("seq"))
    graph = Graph(labelled, edges)

    def add(nodes: DataFrame | None, links: DataFrame | None) -> None:
        nonlocal graph
        named = lambda d, at: d if "seq" in d.columns else d.withColumn("seq", F.concat(F.lit("9#"), at))
        n = graph.nodes if nodes is None else graph.nodes.unionByName(named(nodes, "id"), allowMissingColumns=True)
        e = graph.edges if links is None else graph.edges.unionByName(named(links, F.concat("src", F.lit("#"), "dst")), allowMissingColumns=True)
        graph = Graph(n, e)

    add(symbols.filter("label <> 'Function'"), calls)
    add(ann, more)
    add(dep, need)
    log = history.dump(root.split("://")[-1]) if git else ""
    if log:
        lines = stored(history.lines_of(spark, log), "log")
        c = history.commit_nodes(lines)
        add(c.select(F.concat(F.lit("commit:"), "hash").alias("id"), F.lit("Commit").alias("label"), F.col("message").alias("name"), "date", "is_security_fix"), history.edges(lines))
        add(c.select(F.concat(F.lit("author:"), "author_email").alias("id"), F.lit("Author").alias("label"), F.col("author_name").alias("name")).distinct(), None)
        add(c.filter("is_security_fix").select(F.concat(F.lit("secfix:"), "hash").alias("id"), F.lit("SecurityFix").alias("label"), F.col("message").alias("name")), None)
        f = enrich.churn(f, history.numstat(lines).join(history.commits(lines).select("repo", "hash", "date", (-F.col("record")).alias("ord")), ["repo", "hash"]).select("path", "date", "ord")).select(*f.columns, "churn_count", "last_modified")
        found = history.tags(root.split("://")[-1])
        if found:
            tag, tagged = history.tag_rows(spark, found)
            add(tag.select("id", F.lit("Tag").alias("label"), "name", "date"), tagged)
    add(f, None)
    if osv is not None:
        v = stored(enrich.vulnerabilities(deps.select("name", "version", "source"), osv), "vuln")
        severity = enrich.severity_of(F.col("severity"), F.col("severity_label")).alias("severity")
        add(v.select(F.concat(F.lit("vuln:"), "vuln_id").alias("id"), F.lit("Vulnerability").alias("label"), F.col("vuln_id").alias("name"), F.col("summary").alias("body"), severity).distinct(), v.select(F.col("dep").alias("src"), F.concat(F.lit("vuln:"), "vuln_id").alias("dst"), F.lit("AFFECTED_BY").alias("type")))
    known = labelled.filter(~F.col("id").startswith("funcref:"))
    if clusters or processes:
        known = stored(known.select("id", "name", "file", "is_exported", "is_input_source", "is_dangerous_sink"), "known")
    if clusters:
        m = stored(communities(calls.select("src", "dst"), known.select("id")).withColumnRenamed("community", "component"), "communities")
        facts = enrich.cluster_facts(m, calls.select("src", "dst"), known)
        node = F.concat(F.lit("cluster:"), "component")
        add(facts.select(node.alias("id"), F.lit("Cluster").alias("label"), "name", F.col("size").cast("long").alias("size"), "cohesion"), m.join(facts.select("component"), "component", "left_semi").select(F.col("id").alias("src"), node.alias("dst"), F.lit("BELONGS_TO").alias("type")))
    if processes:
        m = stored(enrich.processes(known, calls.select("src", "dst", "seq")), "processes")
        kinds = enrich.classify(m, known).join(known.select(F.concat(F.lit("process:"), "id").alias("process"), "name"), "process")
        add(kinds.select(F.col("process").alias("id"), F.lit("Process").alias("label"), "name", F.col("type").alias("process_type"), F.col("step_count").cast("long").alias("step_count")), m.select(F.col("id").alias("src"), F.col("process").alias("dst"), F.lit("PARTICIPATES_IN").alias("type"), "step"))
    return graph.deduplicate()


def incremental(spark: SparkSession, root: str, store: Store, repo: str, manifest: str, **options) -> str:
    """Brings a repo of the store up to date with its tree and saves the manifest: `full` without a usable manifest or where
    history has taken another way, `none` if nothing changed, else `changed`: only changed files are read again, and what
    they and deleted ones had held goes first."""
    local = root.split("://")[-1]
    now = stored(files.manifest(files.source_files(spark, root)), "manifest")
    head, deps = history.head(local), state.deps_hash(files.scan(spark, root, manifests.SKIP))
    old = state.load_manifest(spark, manifest)
    how = "full"
    if old is not None:
        c = state.changes(old, now, head, deps)
        diverged = old.head and head and old.head != head and not history.is_ancestor(local, old.head)
        if not diverged:
            how = "changed" if c.any() or old.head != head else "none"
    if how == "none":
        return how
    if how == "full":
        store.clear(repo)
        store.upsert(extract(spark, root, **options), repo)
    else:
        again, gone = (stored(x, "paths") for x in state.changed_paths(c))
        if not gone.isEmpty():
            store.delete_files(repo, gone)
        store.upsert(extract(spark, root, changed=again, **options), repo)
    state.save_manifest(now, manifest, head, deps)
    return how


def changed_since(spark: SparkSession, root: str, old_manifest: DataFrame) -> DataFrame:
    """(path, change) of the tree against an earlier manifest(path, hash)."""
    return change_set(old_manifest, files.manifest(files.source_files(spark, root)))
