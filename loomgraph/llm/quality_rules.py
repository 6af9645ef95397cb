"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic lies beyond a cutoff. The cutoffs are chosen on labelled documents, stratum
by stratum: on a fixed grid, the tightest cutoff at which an exact binomial test shows that no more than ALPHA / rules of
the stratum's good documents would be rejected. The level DELTA is divided by the number of tests (rules x grid points x
strata), so with probability 1 - DELTA no stratum loses more than ALPHA of its good documents to the rules together.
A stratum with too few labelled good documents to show anything has no cutoffs and rejects nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_ROWS, mapped, scratch, stored

#: False rejection of good documents per stratum, at most, and the level of all tests together.
ALPHA, DELTA = 0.04, 0.05
#: The rules: statistics of which large values are bad. Cutoffs are k / GRID of them.
RULES = ("symbols", "dup_lines", "repeats", "upper")
GRID = 20
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
_NO_BLANK = str.maketrans("", "", BLANK)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words which the list holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = a[:-1] * len(ids) + a[1:]
    if len(ids) > 2_000_000:  # three ids would not fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * len(ids) + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for i in range(3):
        hit[i : n - 2 + i] |= twice
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text; zeros for null."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    return len(raw), len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(raw), len(lines), upper, letters


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang, `und` where null) and STATS of every document; repeated rows each have theirs."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    d = docs.select("doc_id", lang.alias("stratum"), F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_stats(t.as_py()) for t in b.column(2)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(STATS)))], ["doc_id", "stratum", *STATS])

    return mapped(d, run, f"doc_id {kind}, stratum string, " + ", ".join(f"{s} long" for s in STATS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def grid_place(rule: str) -> F.Column:
    """The grid place of a document's statistic: the number k of the first cutoff k / GRID that is not below it."""
    num, den = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_letters")}[rule]
    return F.when(F.col(den) > 0, F.least(F.lit(GRID), F.floor((F.col(num) * GRID + F.col(den) - 1) / F.col(den)))).otherwise(0).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable of n trials with chance p."""
    if n <= 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    m = max(logs)
    return min(1.0, math.exp(m) * math.fsum(math.exp(x - m) for x in logs))


def thresholds(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one int column per rule): documents with a grid place above it are rejected; GRID rejects none. All labelled documents that pass the base rules count; an id with several labels has the smallest quality."""
    y = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    good = stats.filter(~base_failed()).join(y, "doc_id").select("stratum", *(grid_place(r).alias(r) for r in RULES))
    places = good.select("stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("k")) for r in RULES))).alias("x")).groupBy("stratum", "x.rule", "x.k").count()
    places = stored(places, "places")
    strata = places.select("stratum").distinct().count()
    level = delta / max(1, strata * len(RULES) * GRID)
    risk = alpha / len(RULES)
    w = Window.partitionBy("stratum", "rule")
    total = places.withColumn("n", F.sum("count").over(w))
    every = total.select("stratum", "rule", "n").distinct().withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    above = every.join(total.select("stratum", "rule", "k", "count"), ["stratum", "rule"]).groupBy("stratum", "rule", "n", "cut").agg(F.sum(F.when(F.col("k") > F.col("cut"), F.col("count")).otherwise(0)).alias("bad"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [x <= risk * n and binomial_tail(x, n, risk) <= level for x, n in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), pa.array(ok, pa.bool_())], ["stratum", "rule", "cut", "ok"])

    tested = mapped(above.select("stratum", "rule", "n", "bad", "cut"), test, "stratum string, rule string, cut int, ok boolean")
    return tested.groupBy("stratum").agg(*(F.coalesce(F.min(F.when((F.col("rule") == r) & F.col("ok"), F.col("cut"))), F.lit(GRID)).alias(f"cut_{r}") for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, rejected_by (the names of the rules, comma-joined) and
    kept. A null or empty text has no words and fails the base rules; strata without labels keep what passes these.
    Columns of docs other than doc_id, text and lang are not read."""
    stats = stored(statistics(docs), "stats")
    with scratch() as made:
        cuts = stored(thresholds(stats, labels, alpha, delta), "cuts")
        made[:] = [x for x in made if x is not cuts]
    n = cuts.count()
    out = stats.join(F.broadcast(cuts) if n <= BROADCAST_ROWS else cuts, "stratum", "left")
    names = F.array_compact(F.array(*(F.when(grid_place(r) > F.coalesce(F.col(f"cut_{r}"), F.lit(GRID)), F.lit(r)) for r in RULES)))
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.concat_ws(",", names))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).drop(*(f"cut_{r}" for r in RULES))
