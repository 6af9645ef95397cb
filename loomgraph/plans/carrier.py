"""A code graph laid over relational tables, so that every operator runs, and can be compared, on them.

Parts are functions (their file is type/brand), neighbouring large lines of an order are calls, orders are commits,
customers authors, suppliers dependencies and nations vulnerabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.enrich import security_labels
from loomgraph.plans.storage import measured_broadcasts

PATTERNS = {"is_input_source": ("red",), "is_dangerous_sink": ("gear",), "is_allocator": ("bolt",), "is_parser": ("gizmo",), "is_crypto": ("blue",)}

#: Order lines of a part of what commits touch, about.
TOUCHED_ROWS = 1_000_000


@dataclass(frozen=True)
class Carrier:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        measured_broadcasts(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def functions(self) -> DataFrame:
        p = self.table("part")
        f = p.select(
            F.concat(F.lit("func:"), "p_partkey").alias("id"), F.lit("Function").alias("label"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"),
            F.concat_ws("/", "p_type", "p_brand").alias("file"), F.col("p_size").alias("line_start"), (F.col("p_size") > 25).alias("is_exported"))
        return security_labels(f, PATTERNS)

    def files(self) -> DataFrame:
        return self.functions().select(F.concat(F.lit("file:"), "file").alias("id"), F.col("file").alias("path")).distinct()

    def calls(self) -> DataFrame:
        l = self.table("lineitem")
        a = l.filter("l_quantity >= 45").select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("s"))
        b = l.filter("l_quantity >= 25").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("d"))
        e = a.join(b, ["l_orderkey", "n"]).filter("s <> d").select("s", "d").distinct()
        source = F.when(F.col("s") % 3 == 0, "scip").when(F.col("s") % 3 == 1, "heuristic")
        return e.select(F.concat(F.lit("func:"), "s").alias("src"), F.concat(F.lit("func:"), "d").alias("dst"), F.lit("CALLS").alias("type"), F.col("d").alias("seq"), source.alias("source"))

    def contains(self) -> DataFrame:
        return self.functions().select(F.concat(F.lit("file:"), "file").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), "seq")

    def authored(self) -> DataFrame:
        return self.table("orders").select(F.concat(F.lit("commit:"), "o_orderkey").alias("src"), F.concat(F.lit("author:"), "o_custkey").alias("dst"), F.lit("AUTHORED_BY").alias("type"), F.col("o_orderkey").alias("seq"))

    def touched(self) -> DataFrame:
        """(path, commit, date, ord, lines_added): one row for each file that a commit changes. In parts of about TOUCHED_ROWS
        lines, however many there are; date and ord are fixed in width, so that sums over them need no sorting."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        parts = lines.count() // TOUCHED_ROWS + 1
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", "p_brand").alias("path"))
        l = lines.repartition(parts, "l_partkey").join(p, "l_partkey").repartition(parts, "l_orderkey")
        t = l.groupBy("path", F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("lines_added"))
        o = self.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
        return t.join(o, "o_orderkey").select("path", F.col("o_orderkey").alias("commit"), "date", F.unix_date("date").alias("ord"), "lines_added")

    def depends(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", "p_brand").alias("path"))
        return self.table("lineitem").select("l_partkey", "l_suppkey").distinct().join(p, "l_partkey").select("path", F.concat(F.lit("dep:"), "l_suppkey").alias("dep")).distinct()

    def affected(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("dep:"), "s_suppkey").alias("dep"), F.col("s_name").alias("dep_name"), F.concat(F.lit("vuln:"), "n_name").alias("vuln"), F.col("r_name").alias("severity"))

    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Nodes before and after: some brands are gone, others new, and the large parts have another line and name."""
        f = self.table("part").select(F.concat(F.lit("func:"), "p_partkey").alias("id"), F.lit("Function").alias("label"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_size").alias("line_start"), "p_brand")
        new = f.filter("p_brand <> 'Brand#11'").withColumn("name", F.when(F.col("line_start") > 40, F.upper("name")).otherwise(F.col("name"))).withColumn("line_start", F.when(F.col("line_start") > 30, F.col("line_start") + 1).otherwise(F.col("line_start")))
        return f.filter("p_brand <> 'Brand#12'").drop("p_brand"), new.drop("p_brand")

    def changed_files(self) -> DataFrame:
        return self.files().filter(F.col("path").endswith("Brand#11")).select("path")

    def bag(self) -> DataFrame:
        """A node for each line: many rows an id, with properties that are there or not."""
        l = self.table("lineitem")
        return l.select(F.concat(F.lit("func:"), "l_partkey").alias("id"), F.concat(F.lit("L"), "l_linestatus").alias("label"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")).alias("seq"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.when(F.col("l_discount") > 0.05, F.col("l_tax")).alias("tax"))

    def search_docs(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("source").alias("name"), "text", (F.col("lang") == "en").alias("is_exported"), (F.col("n_chars") > 5000).alias("is_input_source"))
