"""Call resolution: qualifier, same file, import, unique name; and index occurrences by range and nearest line.

functions(id, name, file, line_start, seq), calls(call_id, caller, callee, qualifier), imports(file, target, names, seq).
Each level is a keyed join against a table with one row a key, so no call meets more rows than its level has candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXTENSIONS = (".py", ".ts", ".js", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".c", ".cpp")


def with_caller(calls: DataFrame, functions: DataFrame) -> DataFrame:
    f = functions.select(F.col("id").alias("caller"), F.col("file").alias("caller_file"), F.col("line_start").alias("caller_line"))
    return calls.join(f, "caller", "left")


def by_qualifier(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(call_id, target): methods(owner, name, id, seq) under the call's qualifier; of several the last defined."""
    last = methods.groupBy(F.col("owner").alias("qualifier"), F.col("name").alias("callee")).agg(F.max_by("id", "seq").alias("target"))
    return calls.join(last, ["qualifier", "callee"]).select("call_id", "target")


def closest(points: DataFrame, defs: DataFrame, keys: list[str]) -> DataFrame:
    """points(<keys>, x, p) with target: of defs(<keys>, at, tie, target) with the same keys the one with `at` nearest to x,
    the least tie among equals; points without any are left out. Both are sorted together by place and looked up to either
    side, so a key with many points and many definitions takes their sum and not their product."""
    one = defs.groupBy(*keys, "at").agg(F.min(F.struct("tie", "target")).alias("d"))
    none_p, none_d = F.lit(None).cast(points.schema["p"].dataType), F.lit(None).cast(one.select(F.struct("at", "d.tie", "d.target").alias("d")).schema["d"].dataType)
    both = points.select(*keys, F.col("x").alias("place"), F.lit(1).alias("kind"), "p", none_d.alias("d")).unionByName(one.select(*keys, F.col("at").alias("place"), F.lit(0).alias("kind"), none_p.alias("p"), F.struct("at", "d.tie", "d.target").alias("d")))
    up = Window.partitionBy(*keys).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("place"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    c = both.withColumn("a", F.last("d", ignorenulls=True).over(up)).withColumn("b", F.last("d", ignorenulls=True).over(down)).filter("kind = 1")
    found = F.array_min(F.transform(F.array_compact(F.array("a", "b")), lambda d: F.struct(F.abs(d["at"] - F.col("place")), d["tie"], d["target"].alias("target"))))
    return c.select(*keys, F.col("place").alias("x"), "p", found["target"].alias("target")).filter("target IS NOT NULL")


def in_file(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, target): the function of that name in the caller's file that begins nearest to the caller; ties go to the
    first defined. calls need caller_file and caller_line."""
    zero = F.lit(0)
    f = functions.select(F.col("file").alias("caller_file"), F.col("name").alias("callee"), F.coalesce("line_start", zero).cast("long").alias("at"), F.struct("seq", "id").alias("tie"), F.col("id").alias("target"))
    c = calls.filter("caller_file IS NOT NULL AND callee IS NOT NULL").select("caller_file", "callee", F.coalesce("caller_line", zero).cast("long").alias("x"), F.col("call_id").alias("p"))
    return closest(c, f, ["caller_file", "callee"]).select(F.col("p").alias("call_id"), "target")


def unique_name(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, target): where a name has one definition in all files."""
    one = functions.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1").drop("n")
    return calls.join(one, "callee").select("call_id", "target")


def module_candidates(file, spec):
    """The paths an import may stand for, in the order in which they are tried, as an array column."""
    folder = F.regexp_replace(F.regexp_extract(file, r"^(.*/)[^/]*$", 1), "/$", "")
    bare = F.regexp_replace(spec, r"\.(ts|tsx|js|jsx|mjs|py)$", "")
    joined = F.regexp_replace(F.concat_ws("/", F.when(folder != "", folder), bare), r"(^|/)\./", "$1")
    for _ in range(4):  # one parent step each
        joined = F.regexp_replace(joined, r"(^|/)[^/.][^/]*/\.\./", "$1")
    tails = (".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py")
    relative = F.array(joined, *(F.concat(joined, F.lit(t)) for t in tails))
    crate = F.regexp_replace(F.regexp_replace(spec, "^crate::", ""), "::", "/")
    rust = F.array(*(F.concat(F.lit(p), crate, F.lit(t)) for p in ("src/", "") for t in (".rs", "/mod.rs")))
    dotted = F.regexp_replace(spec, r"\.", "/")
    jvm = F.array(*(F.concat(F.lit(p), dotted, F.lit(t)) for p in ("", "src/main/java/", "src/main/kotlin/", "src/") for t in (".java", ".kt")))
    plain = F.array(spec, *(F.concat(spec, F.lit(t)) for t in EXTENSIONS))
    return F.when(spec.startswith("."), relative).when(spec.startswith("crate::"), rust).when(spec.contains(".") & ~spec.contains("/"), F.concat(jvm, plain)).otherwise(plain)


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, target, path): the first candidate of each import that is a file; a last segment that names a folder stands for
    the first file in it."""
    cand = imports.select("file", "target").distinct().select("file", "target", F.posexplode(module_candidates(F.col("file"), F.col("target"))).alias("place", "path"))
    hit = cand.join(files.select("path").distinct(), "path")
    folder = files.select(F.element_at(F.split("path", "/"), -2).alias("last"), "path").filter("size(split(path, '/')) > 1").groupBy("last").agg(F.min("path").alias("path"))
    go = imports.select("file", "target", F.element_at(F.split("target", "/"), -1).alias("last")).filter(~F.col("target").startswith(".") & F.col("target").contains("/")).distinct().join(folder, "last").select("file", "target", F.lit(1000).alias("place"), "path")
    return hit.select("file", "target", "place", "path").unionByName(go).groupBy("file", "target").agg(F.min_by("path", F.struct("place", "path")).alias("path"))


def by_import(calls: DataFrame, imports: DataFrame, files: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, target): the name is imported (the last import of it counts), its module is a file, and that has the
    function; of several the first."""
    names = imports.select("file", "target", "seq", F.explode(F.split("names", ",")).alias("callee")).withColumn("callee", F.trim("callee")).filter("callee <> ''")
    last = names.groupBy(F.col("file").alias("caller_file"), "callee").agg(F.max_by("target", "seq").alias("module"))
    at = module_files(imports, files).select(F.col("file").alias("caller_file"), F.col("target").alias("module"), "path")
    first = functions.groupBy(F.col("file").alias("path"), F.col("name").alias("callee")).agg(F.min_by("id", "seq").alias("target"))
    return calls.join(last, ["caller_file", "callee"]).join(at, ["caller_file", "module"]).join(first, ["path", "callee"]).select("call_id", "target")


def resolve(calls: DataFrame, functions: DataFrame, methods: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """calls with target and level (qualifier, file, import, unique; null if unresolved): the first level that yields one."""
    c = with_caller(calls, functions)
    levels = {"qualifier": by_qualifier(c, methods), "file": in_file(c, functions), "import": by_import(c, imports, files, functions), "unique": unique_name(c, functions)}
    for k, df in levels.items():
        c = c.join(df.withColumnRenamed("target", f"t_{k}"), "call_id", "left")
    level = F.coalesce(*(F.when(F.col(f"t_{k}").isNotNull(), F.lit(k)) for k in levels))
    return c.select(*calls.columns, F.coalesce(*(F.col(f"t_{k}") for k in levels)).alias("target"), level.alias("level"))


def resolved_edges(calls: DataFrame) -> DataFrame:
    """CALLS edges of resolve(): to the target, or to funcref:<qualifier.>name."""
    ref = F.concat(F.lit("funcref:"), F.when(F.coalesce("qualifier", F.lit("")) != "", F.concat("qualifier", F.lit("."))).otherwise(""), F.col("callee"))
    done = F.col("target").isNotNull()
    return calls.select(F.col("caller").alias("src"), F.coalesce("target", ref).alias("dst"), F.lit("CALLS").alias("type"), done.alias("resolved"), F.when(done, "heuristic").alias("source"))


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(point columns, owner): the range(file, start, stop, id) of the point's file that holds its line and begins last, the
    greatest id among equals. Ranges lie in bins of half their width or more, by powers of two, and so in three at most; a
    point is looked up in the one bin of each width in use. No range ends in the bin where it starts, unless a bin is one
    line, so the owner is the last that starts in the bin before the point, else, of those from before it, the last started
    that ends behind the point. Both are kept while the places of a bin are passed in order: points and ranges of a bin
    cost their sum and not their product."""
    power = F.length(F.bin(F.col("stop").cast("long") - F.col("start").cast("long"))) - 1
    r = ranges.filter("stop >= start AND file IS NOT NULL").select("file", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("id").alias("owner"), power.alias("power"))
    r = r.groupBy("file", "power", "start", "stop").agg(F.max("owner").alias("owner"))
    powers = [x["power"] for x in r.select("power").distinct().collect()]  # some of 64
    r = r.withColumn("bin", F.explode(F.expr("sequence(shiftright(start, power), shiftright(stop, power))")))
    fresh = F.col("bin") == F.expr("shiftright(start, power)")
    place = F.when(fresh, F.col("start")).otherwise(F.least("stop", F.expr("shiftleft(bin + 1, power) - 1")))
    d = F.struct("start", "owner")
    r = r.select("file", "power", "bin", place.alias("place"), F.lit(0).alias("kind"), F.when(fresh, d).alias("a"), F.when(~fresh, d).alias("b"))
    # a place needs only the best that starts there and the best that ends there
    r = r.groupBy("file", "power", "bin", "place", "kind").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    p = points.filter("file IS NOT NULL AND line IS NOT NULL").select("file", F.col("line").cast("long").alias("place")).distinct()
    p = p.withColumn("power", F.explode(F.array(*map(F.lit, powers)).cast("array<int>"))).withColumn("bin", F.expr("shiftright(place, power)"))
    none = F.lit(None).cast(r.schema["a"].dataType)
    both = r.unionByName(p.select("file", "power", "bin", "place", F.lit(1).alias("kind"), none.alias("a"), none.alias("b")))
    w = Window.partitionBy("file", "power", "bin").rowsBetween(Window.unboundedPreceding, 0)
    best = both.withColumn("a", F.max("a").over(w.orderBy("place", "kind"))).withColumn("b", F.max("b").over(w.orderBy(F.desc("place"), "kind")))
    best = best.filter("kind = 1").select("file", F.col("place").alias("line"), F.coalesce("a", "b").alias("d")).filter("d IS NOT NULL").groupBy("file", "line").agg(F.max("d")["owner"].alias("owner"))
    found = best.withColumn("line", F.col("line").cast(points.schema["line"].dataType))
    return points.distinct().join(found, ["file", "line"]).select(*points.columns, "owner")


def nearest(points: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, name, line, target): the function of the name in the file that begins on line + 1, else nearest to it."""
    f = functions.select("file", "name", F.col("line_start").cast("long").alias("at"), F.col("id").alias("tie"), F.col("id").alias("target")).filter("at IS NOT NULL")
    c = points.select("file", "name", (F.col("line") + 1).cast("long").alias("x"), F.col("line").alias("p")).distinct().filter("file IS NOT NULL AND name IS NOT NULL")
    return closest(c, f, ["file", "name"]).select("file", "name", F.col("p").alias("line"), "target")


def index_calls(occurrences: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst) from occurrences(file, line, symbol, name, is_def, seq): each use, joined with the definition of its symbol
    (the last, if there are several), from the function around it to the one defined there; self calls left out."""
    defs = occurrences.filter("is_def").groupBy("symbol").agg(F.max_by(F.struct("file", "line", "name"), "seq").alias("d"))
    d = defs.select("symbol", F.col("d.file").alias("file"), F.col("d.line").alias("line"), F.col("d.name").alias("name"))
    target = d.join(nearest(d.select("file", "name", "line"), functions), ["file", "name", "line"]).select("symbol", F.col("target").alias("dst"))
    ranges = functions.select("file", (F.col("line_start") - 1).alias("start"), (F.col("line_end") - 1).alias("stop"), "id")
    uses = enclosing(occurrences.filter("NOT is_def").select("file", "line", "symbol").distinct(), ranges).select("symbol", F.col("owner").alias("src"))
    return uses.join(target, "symbol").filter("src <> dst").select("src", "dst").distinct()


def orchestrate(calls: DataFrame, index: DataFrame, functions: DataFrame, covered: DataFrame) -> DataFrame:
    """CALLS edges (src, dst, type, resolved, source) from both ways. calls are resolve()'s rows, index (src, dst) the index's,
    covered(language) the languages that an index covers. In files of these the index alone counts, and what the levels
    say, resolved or not, goes; other files keep theirs."""
    lang = functions.select(F.col("id").alias("src"), "language")
    own = resolved_edges(calls).join(lang, "src", "left").join(F.broadcast(covered.select("language").distinct()), "language", "left_anti")
    sure = index.select("src", "dst").distinct().select("src", "dst", F.lit("CALLS").alias("type"), F.lit(True).alias("resolved"), F.lit("scip").alias("source"))
    return sure.unionByName(own.select(*sure.columns))


def languages_of(functions: DataFrame) -> DataFrame:
    """(language) of the functions, those that are known."""
    return functions.filter("language IS NOT NULL").select("language").distinct()


def orphans(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Function references that no call leads to any more."""
    return nodes.filter(F.col("id").startswith("funcref:")).join(calls.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def symbol_name(symbol):
    """The plain name in an index symbol: the last segment after # and /, without trailing dots and brackets."""
    s = F.regexp_replace(symbol, r"\.+$", "")
    return F.regexp_replace(F.element_at(F.split(F.element_at(F.split(s, "#"), -1), "/"), -1), r"[()]+$", "")
