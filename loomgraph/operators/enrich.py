"""Labels and enrichment: security flags, risk, churn, vulnerabilities, entry points, processes, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.paths import bfs
from loomgraph.schema import ENTRY_DEFAULT, ENTRY_NAMES, ENTRY_SUFFIXES, OSV_ECOSYSTEM, PATTERNS


def has_pattern(name: Column, patterns: tuple[str, ...]) -> Column:
    """True where the name contains a pattern in any case, else null: a flag is only ever set."""
    low = F.lower(name)
    hit = F.lit(False)
    for p in sorted({p.lower() for p in patterns}):
        hit = hit | low.contains(p)
    return F.when(hit, F.lit(True))


def security_labels(functions: DataFrame, patterns: dict[str, tuple[str, ...]] = PATTERNS) -> DataFrame:
    """functions with the flags of `patterns`, touches_unsafe and risk_score. Rows without a name have no flags and score."""
    params = F.lower(F.coalesce("params", F.lit(""))) if "params" in functions.columns else F.lit("")
    out = functions.withColumns({k: has_pattern(F.col("name"), v) for k, v in patterns.items()})
    unsafe = F.lower("name").contains("unsafe") | params.contains("void*") | params.contains("void *")
    out = out.withColumn("touches_unsafe", F.when(unsafe, F.lit(True)))
    points = {"is_input_source": 30, "is_dangerous_sink": 30, "touches_unsafe": 20, "is_allocator": 10, "is_parser": 10}
    score = sum((F.when(F.col(k), v).otherwise(0) for k, v in points.items() if k in out.columns), F.lit(0))
    return out.withColumn("risk_score", F.when(F.col("name").isNotNull(), F.least(score, F.lit(100)).cast("int")))


def churn(files: DataFrame, touched: DataFrame) -> DataFrame:
    """files(path) with churn_count and last_modified from touched(path, date, ord): the number of changes and the date of
    the latest; 0 and null for files without any."""
    t = touched.groupBy("path").agg(F.count("*").alias("churn_count"), F.max_by("date", "ord").alias("last_modified"))
    return files.join(t, "path", "left").withColumn("churn_count", F.coalesce("churn_count", F.lit(0).cast("long")))


def clean_version(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(v), r"^[~^>=<vV!*]+\s*", ""))


def version_key(v: Column) -> Column:
    """A version's numbers as an array, which compares as versions do; what follows a dash or plus sign is left out, and a
    part that is no number counts as 0."""
    parts = F.split(F.regexp_replace(clean_version(v), r"[-+].*$", ""), r"\.")
    key = F.transform(parts, lambda x: F.coalesce(F.regexp_extract(x, r"^\d{1,18}", 0).try_cast("long"), F.lit(0).cast("long")))
    return F.concat(key, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), 6 - F.size(key))))


def severity_of(severity: Column, label: Column) -> Column:
    """The first severity score if there is one, else the label of the database, else UNKNOWN."""
    return F.coalesce(F.when(severity != "", severity), F.when(label != "", label), F.lit("UNKNOWN"))


def vulnerabilities(dependencies: DataFrame, osv: DataFrame) -> DataFrame:
    """(dep, vuln_id, summary, severity, severity_label): dependencies(name, version, source) of a known ecosystem, with a
    name and a version, that the snapshot osv(vuln_id, ecosystem, package, versions, ...) lists, or that lie in one of its
    ranges (array of introduced and fixed, where it has such a column), fixed itself left out."""
    eco = F.create_map(*(F.lit(x) for kv in OSV_ECOSYSTEM.items() for x in kv))
    d = dependencies.withColumn("version", clean_version(F.col("version"))).withColumn("ecosystem", eco[F.col("source")]).filter("name <> '' AND version <> '' AND ecosystem IS NOT NULL")
    d = d.select("name", F.col("version").alias("own_version"), "ecosystem").distinct().withColumn("own_key", version_key(F.col("own_version")))
    hit = F.coalesce(F.array_contains("versions", F.col("own_version")), F.lit(False))
    if "ranges" in osv.columns:
        hit = hit | F.coalesce(F.exists("ranges", lambda r: (F.col("own_key") >= version_key(F.coalesce(r["introduced"], F.lit("0")))) & (r["fixed"].isNull() | (F.col("own_key") < version_key(r["fixed"])))), F.lit(False))
    j = d.join(osv.withColumnsRenamed({"package": "name"}), ["name", "ecosystem"]).filter(hit)
    return j.select(F.concat(F.lit("dep:"), "name").alias("dep"), "vuln_id", F.substring("summary", 1, 500).alias("summary"), "severity", "severity_label").distinct()


def entry_points(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions(id, name, file, is_exported) that are an entry by name and language, or exported and never called; a call
    by the function itself counts."""
    lang = F.create_map(*(F.lit(x) for kv in ENTRY_SUFFIXES.items() for x in kv))[F.element_at(F.split("file", r"\."), -1)]
    named = F.col("name").isin(*ENTRY_DEFAULT)
    for k, names in ENTRY_NAMES.items():
        named = F.when(lang == k, F.col("name").isin(*names)).otherwise(named)
    f = functions.withColumn("__named", F.coalesce(named, F.lit(False)))
    free = f.filter("NOT __named AND is_exported AND name <> ''").join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return f.filter("__named").select(*functions.columns).unionByName(free.select(*functions.columns))


def processes(functions: DataFrame, calls: DataFrame, depth: int = 10) -> DataFrame:
    """(process, id, step): the functions that each entry point's flow visits within depth hops, for flows of two or more."""
    ids = functions.select("id")
    inner = calls.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if "seq" not in inner.columns:
        inner = inner.withColumn("seq", F.lit(0))
    seen = bfs(inner, entry_points(functions, calls).select("id"), depth)
    big = seen.groupBy("start").agg(F.count("*").alias("steps")).filter("steps >= 2").select("start")
    return seen.join(big, "start", "left_semi").select(F.concat(F.lit("process:"), "start").alias("process"), "id", "step")


def classify(members: DataFrame, functions: DataFrame) -> DataFrame:
    """(process, type, step_count): data_flow, input_handler, sink_caller or computation, by what a process touches."""
    x = members.join(functions.select("id", "name", "is_input_source", "is_dangerous_sink"), "id", "left")
    i = F.coalesce(F.bool_or(F.coalesce("is_input_source", F.lit(False)) | F.col("name").isin(*PATTERNS["is_input_source"])), F.lit(False))
    s = F.coalesce(F.bool_or(F.coalesce("is_dangerous_sink", F.lit(False)) | F.col("name").isin(*PATTERNS["is_dangerous_sink"])), F.lit(False))
    g = x.groupBy("process").agg(i.alias("i"), s.alias("s"), F.count("*").alias("step_count"))
    kind = F.when(F.col("i") & F.col("s"), "data_flow").when(F.col("i"), "input_handler").when(F.col("s"), "sink_caller").otherwise("computation")
    return g.select("process", kind.alias("type"), "step_count")


def cluster_facts(members: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(component, name, size, cohesion) of members(id, component): the most frequent parent folder (or file) with _cluster,
    ties by name, and the density of undirected links among members, to three places."""
    m = members.select("id", "component")
    sizes = m.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    a = m.withColumnsRenamed({"id": "src", "component": "component"})
    b = m.withColumnsRenamed({"id": "dst", "component": "other"})
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inner = e.join(a, "src").join(b, "dst").filter("component = other").groupBy("component").agg(F.count("*").alias("links"))
    parts = F.split("file", "/")
    place = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.col("file"))
    named = m.join(functions.select("id", place.alias("place")), "id").groupBy("component", "place").agg(F.count("*").alias("k"))
    top = named.groupBy("component").agg(F.min_by("place", F.struct(-F.col("k"), F.col("place"))).alias("place"))
    n = F.col("size")
    return sizes.join(inner, "component", "left").join(top, "component", "left").select("component", F.concat("place", F.lit("_cluster")).alias("name"), "size", F.round(2 * F.coalesce("links", F.lit(0)) / (n * (n - 1)), 3).alias("cohesion"))
