"""Source trees as DataFrames: one distributed scan of a folder, pruned by path parts, names and suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import LANGUAGE_OF, SKIP_DIRS, SKIP_FILES


def language(path: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in LANGUAGE_OF.items() for x in kv))
    return m[F.regexp_extract(path, r"\.([^./]+)$", 1)]


def scan(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """(path, name, content, size) of every file under root that lies in no skipped folder; paths are relative to root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    parts = F.split("path", "/")
    f = raw.select(rel.alias("path"), F.col("content"), F.col("length").alias("size"))
    return f.filter(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, skip_dirs)))).withColumn("name", F.element_at(F.split("path", "/"), -1))


def source_files(spark: SparkSession, root: str, changed: DataFrame | None = None) -> DataFrame:
    """(path, language, content, text, size, hash, lines) of source files; with changed(path), only of these."""
    f = scan(spark, root).withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull() & ~F.col("name").isin(*SKIP_FILES))
    if changed is not None:
        f = f.join(F.broadcast(changed.select("path").distinct()) if changed.limit(500_001).count() <= 500_000 else changed.select("path").distinct(), "path", "left_semi")
    text = F.decode("content", "UTF-8")
    return f.select("path", "language", "content", text.alias("text"), "size", F.sha2("content", 256).alias("hash"), F.size(F.split(text, "\n")).alias("lines"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", "hash", "size", "language")


def top_languages(files: DataFrame, k: int = 5) -> DataFrame:
    return files.groupBy("language").count().orderBy(F.desc("count"), "language").limit(k)
