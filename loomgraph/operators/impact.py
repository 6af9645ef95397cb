"""Impact of a symbol or of changed files, and its risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.paths import reachable, reverse, trails, trails_between
from loomgraph.plans.storage import stored


def confidence(sources: str) -> Column:
    """high, low, medium or unknown, by the resolution sources along a path."""
    s, h = F.array_contains(sources, "scip"), F.array_contains(sources, "heuristic")
    return F.when(h & ~s, "low").when(s & ~h, "high").when(s & h, "medium").otherwise("unknown")


def impact(calls: DataFrame, symbols: DataFrame, direction: str = "downstream", depth: int = 3) -> DataFrame:
    """(symbol, id, depth, bucket, confidence, sources): one row for each call trail of up to depth edges from (or, upstream,
    to) each of symbols(id). Buckets: immediate, downstream (two edges), transitive."""
    if direction == "both":
        return impact(calls, symbols, "upstream", depth).unionByName(impact(calls, symbols, "downstream", depth))
    e = calls.withColumn("source", F.coalesce("source", F.lit("unknown")))
    t = trails(reverse(e) if direction == "upstream" else e, symbols, depth, carry=("source",))
    bucket = F.when(F.col("depth") == 1, "immediate").when(F.col("depth") == 2, "downstream").otherwise("transitive")
    return t.select(F.col("start").alias("symbol"), F.col("end").alias("id"), "depth", bucket.alias("bucket"), confidence("sources").alias("confidence"), "sources")


def summary(paths: DataFrame) -> DataFrame:
    """One row a symbol: total (paths), the three buckets, scip, heuristic and unknown edges (counted again on each path)
    and the overall confidence."""
    edges = lambda v: F.size(F.filter("sources", lambda x: x == v))
    g = paths.groupBy("symbol").agg(
        F.count("*").alias("total"), *(F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in ("immediate", "downstream", "transitive")),
        F.sum(edges("scip")).alias("scip_edges"), F.sum(edges("heuristic")).alias("heuristic_edges"), F.sum(F.size("sources")).alias("edges"))
    g = g.withColumn("unknown_edges", F.col("edges") - F.col("scip_edges") - F.col("heuristic_edges"))
    level = F.when(F.col("edges") == 0, "unknown").when(F.col("heuristic_edges") == 0, "high").when(F.col("scip_edges") == 0, "low").otherwise("medium")
    return g.withColumn("confidence", level).drop("edges")


def security_flags(paths: DataFrame, functions: DataFrame) -> DataFrame:
    """(symbol, flag): a row for each flag of the end of each path; duplicates stay."""
    names = {"is_input_source": "input_source", "is_dangerous_sink": "dangerous_sink", "is_crypto": "crypto"}
    have = {k: v for k, v in names.items() if k in functions.columns}
    j = paths.join(functions.select("id", *have), "id")
    return j.select("symbol", F.explode(F.array_compact(F.array(*(F.when(F.col(k), F.concat(F.lit(f"{v}:"), "id")) for k, v in have.items())))).alias("flag"))


def changed_functions(functions: DataFrame, files: DataFrame) -> DataFrame:
    return functions.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select(*functions.columns)


def reached_sinks(functions: DataFrame, calls: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """(id): dangerous sinks within depth calls of the files' functions. Only end points count, so this is reachability."""
    starts = changed_functions(functions, files).select("id")
    ends = reachable(calls, starts, depth).select(F.col("end").alias("id")).distinct()
    return ends.join(functions.filter("is_dangerous_sink = true").select("id"), "id", "left_semi")


def change_risk(functions: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """One row: changed_functions, sinks_reached, risk_level."""
    c = changed_functions(functions, files).select(F.lit(True).alias("changed"), F.coalesce("is_input_source", F.lit(False)).alias("i"), F.coalesce("is_dangerous_sink", F.lit(False)).alias("s"))
    r = reached_sinks(functions, calls, files).select(F.lit(False).alias("changed"), F.lit(False).alias("i"), F.lit(False).alias("s"))
    x = c.unionByName(r).agg(F.count(F.when(F.col("changed"), 1)).alias("changed_functions"), F.count(F.when(~F.col("changed"), 1)).alias("sinks_reached"), F.coalesce(F.bool_or("i"), F.lit(False)).alias("i"), F.coalesce(F.bool_or("s"), F.lit(False)).alias("s"))
    n = F.col("sinks_reached")
    level = F.when(F.col("i") & F.col("s"), "CRITICAL").when(F.col("s") | (n > 3), "HIGH").when(F.col("i") | (n > 0), "MEDIUM").otherwise("LOW")
    return x.select("changed_functions", "sinks_reached", level.alias("risk_level"))


def taint_paths(functions: DataFrame, calls: DataFrame, depth: int = 5, limit: int = 50) -> DataFrame:
    """(source_name, start_id, sink_name, end_id, depth, trail): the first `limit` call trails from input sources to dangerous
    sinks, shortest first. Lengths are worked out one after the other, and none beyond the one that fills the limit."""
    f = stored(functions.select("id", "name", "is_input_source", "is_dangerous_sink"), "functions")
    found, n = None, 0
    for t in trails_between(calls, f.filter("is_input_source = true").select("id"), f.filter("is_dangerous_sink = true").select("id"), depth):
        t = stored(t.select("start", "end", "depth", F.array_join("nodes", " ").alias("trail")).orderBy("trail").limit(limit), "taint")
        found = t if found is None else found.unionByName(t)
        n += t.count()
        if n >= limit:
            break
    j = found.join(f.select(F.col("id").alias("start"), F.col("name").alias("source_name")), "start").join(f.select(F.col("id").alias("end"), F.col("name").alias("sink_name")), "end")
    return j.select("source_name", F.col("start").alias("start_id"), "sink_name", F.col("end").alias("end_id"), "depth", "trail").orderBy("depth", "trail").limit(limit)
