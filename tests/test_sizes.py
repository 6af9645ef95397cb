"""Plans that must not grow on the driver or in one task as the tables do."""

import hashlib
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import communities, resolve, search
from loomgraph.plans import carrier
from loomgraph.plans import catalogue_extract as catalogue
from loomgraph.sources import manifests

DATA = os.environ.get("LOOM_TEST_DATA", "/root/testdata/sf0.001")


def joins(df) -> list[str]:
    """The joins of the plan as it is before anything has run."""
    return [x.strip() for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_orchestrated_calls_broadcasts_hinted_sides_only(spark):
    # the names (one row) and the covered languages
    found = [x for x in joins(catalogue.QUERIES["orchestrated_calls"](spark, DATA)) if "Broadcast" in x]
    assert found and all("NestedLoop" in x or "language" in x for x in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_resolve_chain_broadcasts_nothing_unmeasured(spark):
    found = joins(catalogue.QUERIES["resolve_chain"](spark, DATA))
    assert found and not any("Broadcast" in x for x in found)


def test_content_hash_in_parts(spark, monkeypatch):
    """The hashes of many files are sorted in parts, none of which holds all; the result is that of one string."""
    monkeypatch.setattr(manifests, "HASH_PART", 50, raising=False)
    content = {f"d{i}/go.mod": b"module m%d" % i for i in range(1000)}
    files = spark.createDataFrame([(p, "go.mod", c) for p, c in content.items()] + [("x/none.txt", "none.txt", b"")], "path string, name string, content binary").repartition(3)
    seen, plain = [], type(files).toLocalIterator

    def taken(df):
        seen.append([r for r in plain(df)])
        return iter(seen[-1])

    monkeypatch.setattr(type(files), "toLocalIterator", taken)
    got = manifests.content_hash(files).first()["hash"]
    text = "".join(hashlib.sha256(content[p]).hexdigest() for p in sorted(content))
    assert got == hashlib.sha256(text.encode()).hexdigest()
    assert len(seen) == 1 and len(seen[0]) >= 15 and max(len(r["h"]) for r in seen[0]) < 32 * 200
    assert manifests.content_hash(files.filter("name = 'none.txt'")).first()["hash"] == ""


def test_enclosing_pairs_no_points_with_ranges(spark):
    r = random.Random(6)
    ranges = [(f, a, a + n, i) for i in range(600) for f, a, n in [(r.choice("fg"), r.randrange(-300, 300), r.choice([0, 1, 2, 3, 7, 8, 9, 100, 500]) + r.randrange(3))]]
    ranges += [("f", 5, 4, 9999), (None, 0, 9, 9998), ("g", 0, 9, 7), ("g", 0, 9, 3)]
    points = [(f, x, s) for f in ("f", "g", "h", None) for x in range(-350, 850, 3) for s in ("u", "v")] + [("f", 1, "u"), ("f", 1, "u"), ("f", None, "u")]
    p = spark.createDataFrame(points, "file string, line int, symbol string")
    q = spark.createDataFrame(ranges, "file string, start int, stop int, id long")
    df = resolve.enclosing(p, q)
    assert df.columns == ["file", "line", "symbol", "owner"] and df.schema["line"].dataType == p.schema["line"].dataType
    want = {}
    for f, x, s in points:
        on = [(a, i) for g, a, b, i in ranges if None not in (f, x) and g == f and a <= x <= b]
        if on:
            want[f, x, s] = max(on)[1]
    got = [tuple(x) for x in df.collect()]
    assert len(got) == len(want) and {x[:3]: x[3] for x in got} == want
    assert not any("bin#" in x for x in joins(df))  # before, each point met every range of its bin


def test_snippet_reads_a_text_once(spark):
    """Brute force over windows, with texts that are not ASCII; before, a long text took time by the square of its length."""
    r = random.Random(4)
    texts = ["".join(r.choice(a) for _ in range(n)) for a in ("ab ", "aÉb ", "AbIİ ", "xy") for n in (0, 1, 19, 151, 700) for _ in range(5)]
    words = ["ab", "bab"]
    for t in texts:
        best = max((sum(w in t[p : p + 150].lower() for w in words), -p) for p in range(0, max(len(t), 1), 20))
        assert search.best_window(t, words) == -best[1]
    long = "x " * 1_000_000 + "Needle" + " y" * 100
    df = spark.createDataFrame([(0, long), (1, None), (2, ""), (3, " needle in it")], "id int, t string")
    began = time.time()
    got = [x[0] for x in df.select("id", search.snippet(F.col("t"), ["needle"]).alias("s")).orderBy("id").select("s").collect()]
    assert time.time() - began < 30
    at = 1_999_860
    assert got == ["..." + long[at : at + 150].strip() + "...", "", "", "needle in it"]


def test_communities_are_solved_in_many_tasks(spark, monkeypatch):
    """Components are small in bytes and much work, so their number of tasks goes by their rows."""
    monkeypatch.setattr(communities, "TASK_ROWS", 20, raising=False)
    edges = [(f"n{i}{a}", f"n{i}{b}") for i in range(40) for a, b in ("ab", "bc", "ca")]
    e = spark.createDataFrame(edges, "src string, dst string")
    df = communities.communities(e, e.select(F.col("src").alias("id")))
    got = {x["id"]: x["community"] for x in df.collect()}
    assert got == {f"n{i}{x}": f"n{i}a" for i in range(40) for x in "abc"}
    # 40 components of three communities and three links
    parts = re.findall(r"hashpartitioning\(component#\d+, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())
    assert parts and set(parts) == {"13"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_churn_goes_in_parts_and_sorts_for_no_sum(spark, monkeypatch):
    monkeypatch.setattr(carrier, "TOUCHED_ROWS", 500, raising=False)
    df = catalogue.QUERIES["churn_files"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500 + 1
    assert f"{n}), REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan
