"""Hybrid search: tokens, inverse document frequency, BM25, graph relevance, weighted fusion, snippets."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.storage import stored

#: Labels whose nodes a ranked search looks at.
SEARCHABLE = ("Function", "Class", "File", "Struct", "Module")
K1, B = 1.5, 0.75
PART = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"


def tokens(text: Column) -> Column:
    """Words of letters and digits, in lower case, each followed by its parts of more than one character if it has several
    (by case and between letters and digits)."""
    raw = F.regexp_extract_all(text, F.lit("([a-zA-Z0-9]+)"), 1)

    def expand(w: Column) -> Column:
        parts = F.regexp_extract_all(w, F.lit(f"({PART})"), 1)
        more = F.filter(F.transform(parts, F.lower), lambda p: F.length(p) > 1)
        several = F.concat(F.array(F.lower(w)), F.when(F.size(parts) > 1, more).otherwise(F.array().cast("array<string>")))
        return F.when(w.rlike("[A-Z0-9]"), several).otherwise(F.array(w))  # small letters alone are one part

    return F.flatten(F.transform(raw, expand))


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, token, tf) of docs(id, text); the text is lowered before it is cut."""
    return docs.select("id", F.explode(tokens(F.lower(F.coalesce(text, F.lit(""))))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def idf(posts: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf)."""
    d = posts.groupBy("token").agg(F.count("*").alias("df"))
    return d.withColumn("idf", F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))


def counted(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """(id, dl, tf0, tf1, ...): each document's tokens, and how often it has each of the words. Stored, as totals and scores
    both need it and the texts are to be cut once; the generator keeps the plan from cutting them once a column."""
    t = docs.select("id", F.explode(F.array(tokens(F.lower(F.coalesce(text, F.lit("")))))).alias("t"))
    tf = [(F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(words)]
    return stored(t.select("id", F.size("t").alias("dl"), *tf), "tf")


def bm25(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """(id, bm25) of the documents with a token of the query; a token said twice counts twice. One scan: each document is
    reduced to its length and its frequencies of the query's tokens, so nothing is shuffled but sums."""
    spark = docs.sparkSession
    q = [r[0] for r in spark.range(1).select(F.explode(tokens(F.lower(F.lit(query))))).collect()]
    words = sorted(set(q))
    d = counted(docs, words, text)
    r = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words)))).first()  # one row of totals
    total = F.lit(0.0)
    for w in q:
        i = words.index(w)
        f = math.log((r["n"] - r[f"df{i}"] + 0.5) / (r[f"df{i}"] + 0.5) + 1)
        tf = F.col(f"tf{i}")
        total = total + F.when(tf > 0, f * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / (r["avg"] or 1.0)))).otherwise(0.0)
    return d.select("id", total.alias("bm25")).filter("bm25 > 0")


def relevance(docs: DataFrame, query: str) -> DataFrame:
    """(id, graph): points for security flags, export, and a name that is the query or contains it. Flags that docs lacks
    count as not set."""
    q = " ".join(query.lower().split())
    flag = {"is_input_source": 2.0, "is_dangerous_sink": 2.0, "is_crypto": 1.0, "is_exported": 0.5}
    score = sum((F.when(F.col(c), v).otherwise(0.0) for c, v in flag.items() if c in docs.columns), F.lit(0.0))
    name = F.lower(F.coalesce("name", F.lit("")))
    score = score + F.when(name == q, 5.0).when((name != "") & name.contains(q), 2.0).otherwise(0.0)
    return docs.select("id", score.alias("graph")).filter("graph > 0")


def fused(docs: DataFrame, query: str, text: str = "text", weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(id, score): both scores, each divided by its maximum, weighted and added, over all documents with either."""
    b, g = bm25(docs, query, text), relevance(docs, query)
    j = stored(b.join(g, "id", "full"), "fused")
    mb, mg = (x or 1.0 for x in j.agg(F.max("bm25"), F.max("graph")).first())
    return j.select("id", F.round(weights[0] * F.coalesce("bm25", F.lit(0.0)) / mb + weights[1] * F.coalesce("graph", F.lit(0.0)) / mg, 4).alias("score"))


def ranked(nodes: DataFrame, query: str, label: str | None = None, limit: int = 20, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(id, score): the best of the nodes with a searchable label, scored among all of these; a label filter comes before
    the cut. A query without tokens finds nothing. nodes need id and label; of name, file, path, body, message and summary
    those that they have are searched."""
    n = nodes.filter(F.col("label").isin(*SEARCHABLE))
    cols = [c for c in ("name", "file", "path", "body", "message", "summary") if c in nodes.columns]
    docs = n.withColumn("text", F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in cols)))
    if not re.search("[a-zA-Z0-9]", query):
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    found = fused(docs, query, "text", weights)
    if label is not None:
        found = found.join(n.filter(F.col("label") == label).select("id").distinct(), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(limit)


def best_window(text: str, words: list[str], width: int = 150, stride: int = 20) -> int:
    """Where the window begins, of those that begin every `stride` characters, that has the most of the words in lower case;
    the first among equals. Passes over the text once. In plain ASCII, windows that no word reaches are skipped."""
    low = text.lower() if text.isascii() else None
    nxt = dict.fromkeys(words, -1)
    most, best, p = 0, 0, 0
    while p < len(text) and most < len(words):
        if low is not None:
            for w, at in nxt.items():
                if 0 <= at < p or at == -1:
                    at = low.find(w, p)
                    nxt[w] = at if at >= 0 else len(text)
            first = min((at + len(w) for w, at in nxt.items() if at < len(text)), default=None)
            if first is None and "" not in nxt:
                break
            if first is not None and first - width > p:
                p += -(-(first - width - p) // stride) * stride
                continue
        win = text[p : p + width].lower()
        n = sum(w in win for w in words)
        if n > most:
            most, best = n, p
        p += stride
    return best


def snippet(text: Column, words: list[str], width: int = 150, stride: int = 20) -> Column:
    """The window, of those that begin every `stride` characters, with the most of the words; the first among equals. Its
    place is found in Python, where a character of a text is reached in one step; in a column expression every window
    walks there from the beginning."""

    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else best_window(t, words, width, stride) for t in texts], dtype="int32")

    n, pos = F.length(text), F.pandas_udf(places, "int")(text)
    body = F.regexp_replace(F.substring(text, pos + 1, F.lit(width)), r"^\s+|\s+$", "")
    return F.when(F.coalesce(n, F.lit(0)) == 0, "").otherwise(F.concat(F.when(pos > 0, "...").otherwise(""), body, F.when(pos + width < n, "...").otherwise("")))
