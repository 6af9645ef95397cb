"""Mixing sources to target weights by hash-threshold histograms.

Each source takes whole passes over its documents and, for the rest of its budget, the documents whose hash is below a
threshold. The threshold comes from sums of sizes by source and hash bucket: the bucket in which the budget ends is cut
into finer buckets, and only that one, until a bucket is a single hash value. Nothing is sorted and no document text
moves; a source however large is a few thousand partial sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, stored
from loomgraph.llm.common import small as counted

#: The weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is read more than so often.
MAX_EPOCHS = 3
#: Hash values have 60 bits; each level of a histogram resolves this many.
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def _target_table(sources: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """sources(source, source_size) with its target: its share of all sizes by weight, at most epochs times its own size;
    what goes beyond is shared again among the others. Weights go by the place of the source in code point order, null
    last, worked out range by range. The cap is solved on the table: sources whose share at the level `unit` exceeds
    their cap are fixed, and unit is summed anew, until none is fixed any more."""
    ranged = sources.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source").sortWithinPartitions("none", "source")
    at = F.monotonically_increasing_id()
    ranged = stored(ranged.select("source", "source_size", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    first = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("first") + F.col("place"), F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = ranged.join(F.broadcast(first), "part").select("source", "source_size", w.alias("w"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    unit, before = math.inf, -1
    while True:
        fixed = F.col("w") * unit > epochs * F.col("source_size") if before >= 0 else F.lit(False)
        r = s.agg(F.sum(F.when(fixed, epochs * F.col("source_size"))), F.sum(F.when(~fixed, F.col("w"))), F.count(F.when(fixed, 1))).first()
        if before >= 0 and r[2] == before or not r[1]:
            break
        unit, before = (total - (r[0] or 0)) / r[1], r[2]
    return s.select("source", "source_size", F.least(F.col("w") * unit, (epochs * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, text_col: str = "text", ids_only: bool = False) -> DataFrame:
    """One row for each row of docs: its columns (with ids_only doc_id alone, and no text is read twice), and size, source_size, target, copies (how often the mix takes the
    document) and taken = copies * size. Columns of docs with these names are replaced.

    size is the number of words; a null text has none. Sources are ordered by code point with null last; weights repeat.
    A source takes target // source_size whole passes, and of one more pass the documents with a hash below its threshold,
    which leaves it off its target by at most half of one document (or of documents of equal id). A document with size 0 is
    taken with its pass, but counts nothing. The hash is of the id alone (of the text where the id is null), so reruns
    agree and rows of the same id go together, ties of hashes too. A source without words has target 0 and takes nothing."""
    with scratch() as made:
        out, read = _mix(docs, weights, epochs, text_col, ids_only)
        made[:] = [x for x in made if not any(x is y for y in read)]
    return out


def _mix(docs: DataFrame, weights: tuple[int, ...], epochs: int, text_col: str, ids_only: bool) -> tuple[DataFrame, list[DataFrame]]:
    """mix(), and the stored tables that its rows are read from."""
    own = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*own)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_col), F.lit(""))))
    d = docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")).withColumn("__h", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"))
    t = stored(d.select("doc_id", F.col("source").cast("string").alias("source"), "__h", "size"), "mix")
    sources = _target_table(t.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = stored(sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mixsrc")
    n = sources.count()

    def small(x: DataFrame) -> DataFrame:
        return counted(x, n)

    # state: hashes below `low` are taken and hold `sum` words; the budget ends among those below low + 2^bits
    state = sources.select(F.col("source").alias("s_source"), "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("got"), F.lit(0).cast("long").alias("step"))
    bits = HASH_BITS
    while bits > 0:
        fine = max(0, bits - LEVEL_BITS)
        inside = t.join(small(state.select("s_source", "low")), F.col("source").eqNullSafe(F.col("s_source")), "inner").filter((F.col("__h") >= F.col("low")) & (F.col("__h") - F.col("low") < F.lit(1 << bits)))
        hist = inside.groupBy("s_source", F.shiftright(F.col("__h") - F.col("low"), fine).alias("b")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("s_source").orderBy("b")
        run = hist.withColumn("upto", F.sum("words").over(w))
        at = run.join(small(state.withColumnRenamed("s_source", "k_source")), F.col("s_source").eqNullSafe(F.col("k_source")), "inner")
        # the first bucket that takes the sum to the budget or beyond; where none does, all is taken
        cut = at.groupBy("k_source", "rest", "low", "got").agg(
            F.min(F.when(F.col("got") + F.col("upto") >= F.col("rest"), F.struct("b", (F.col("upto") - F.col("words")).alias("before"), "words"))).alias("x"),
            F.max("b").alias("last"), F.max("upto").alias("all"),
        )
        state = stored(
            cut.select(
                F.col("k_source").alias("s_source"), "rest",
                (F.col("low") + F.shiftleft(F.coalesce("x.b", F.lit((1 << (bits - fine)) - 1).cast("long")), fine)).alias("low"),
                (F.col("got") + F.coalesce("x.before", F.col("all"))).alias("got"),
                F.coalesce("x.words", F.lit(0).cast("long")).alias("step"),
            ),
            "mixcut",
        )
        bits = fine
    # at single hash values: the boundary value is taken if that comes nearer to the budget
    cut = state.select("s_source", F.when((F.col("rest") > 0) & (F.col("got") + F.col("step") - F.col("rest") < F.col("rest") - F.col("got")), F.col("low")).otherwise(F.col("low") - 1).alias("upto"))
    plan = stored(sources.join(small(cut), F.col("source").eqNullSafe(F.col("s_source")), "left").select(F.col("source").alias("s_source"), "source_size", "target", "passes", F.coalesce("upto", F.lit(-1).cast("long")).alias("upto")), "mixplan")
    d = t if ids_only else d
    out = d.join(small(plan), F.col("source").cast("string").eqNullSafe(F.col("s_source")), "inner")
    copies = F.when(F.col("target") > 0, F.least(F.col("passes") + (F.col("__h") <= F.col("upto")).cast("long"), F.lit(epochs).cast("long"))).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*(["doc_id"] if ids_only else docs.columns), *own)
    return out, [t, plan] if ids_only else [plan]
