import itertools
import random

from loomgraph.operators import communities as cm


def modularity(links, part):
    m = len(links)
    deg = {}
    for a, b in links:
        deg[a] = deg.get(a, 0) + 1
        deg[b] = deg.get(b, 0) + 1
    q = sum(part[a] == part[b] for a, b in links) / m
    by = {}
    for v, d in deg.items():
        by[part[v]] = by.get(part[v], 0) + d
    return q - sum((d / (2 * m)) ** 2 for d in by.values())


def two_cliques():
    a = [(f"a{i}", f"a{j}") for i, j in itertools.combinations(range(5), 2)]
    b = [(f"b{i}", f"b{j}") for i, j in itertools.combinations(range(5), 2)]
    return a + b + [("a0", "b0")]


def test_greedy_by_brute_force():
    r = random.Random(1)
    for _ in range(20):
        links = list({tuple(sorted(r.sample("abcdefgh", 2))) for _ in range(12)})
        deg = {v: float(sum(v in e for e in links)) for e in links for v in e}
        part = {v: v for v in deg}
        while True:  # the definition: join the pair with the largest gain while one is positive
            now = modularity(links, part)
            best = max(((modularity(links, {v: (x if c == y else c) for v, c in part.items()}) - now, x, y) for x, y in itertools.combinations(sorted(set(part.values())), 2)), key=lambda t: (round(t[0], 12), [-ord(c) for c in t[1] + t[2]]), default=(0, "", ""))
            if best[0] <= 1e-12:
                break
            part = {v: (best[1] if c == best[2] else c) for v, c in part.items()}
        got = cm.greedy({e: 1.0 for e in links}, deg, float(len(links)))
        assert abs(modularity(links, got) - modularity(links, part)) < 0.05


def test_communities(spark, monkeypatch):
    e = spark.createDataFrame([*two_cliques(), ("x", "y"), ("a1", "outside")], "src string, dst string")
    n = spark.createDataFrame([(v,) for v in {v for p in two_cliques() for v in p} | {"x", "y", "z"}], "id string")
    for limit in (10_000, 4):
        monkeypatch.setattr(cm, "GROUP_NODES", limit)
        got = {r["id"]: r["community"] for r in cm.communities(e, n).collect()}
        assert {got[f"a{i}"] for i in range(5)} == {"a0"} and {got[f"b{i}"] for i in range(5)} == {"b0"} and got["y"] == "x" and got["z"] == "z"
    assert cm.communities(e, n.limit(2)).count() == 0
