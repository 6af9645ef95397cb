"""Near-duplicate embeddings by an inverted multi-index.

Vectors are scaled to length one and cut into halves. Each half has a codebook, and the pairs of codewords form a grid of
cells; a vector is listed in the cell of its nearest codewords. A search visits cells by increasing sum of the two half
distances (the multi-sequence order) and compares the vector with those listed there. How many cells it visits is fixed
beforehand, on pairs of known similarity, as the number that reaches TARGET_RECALL; all vectors are listed and all search.

The codebooks and the number of visits come from a sample that grows with the square root of the table. Neighbouring
codewords of a half form groups, and pairs of groups regions of the grid: a vector is sent once to each region that its
search enters, with the cells that it visits there, and not once a cell. Vectors equal in all components are one class
with a count. Full regions are compared in blocks, cell by cell, by matrix products, and only counts and a spanning forest
leave a block. A pair that both of its vectors' searches meet is counted once, as each vector knows the cells that the
other visits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import claim, connected, dropped, groups_of, join_counted, mapped, scratch, small, stored

#: Vectors of the sample that the codebooks are fitted on, at least (or all), and for each codeword.
SAMPLE, PER_WORD = 20_000, 16
#: Vectors listed in a cell, about.
PER_CELL = 32
#: Vectors of one length that are too few for a grid: they share one cell.
FEW = 256
#: Share of the pairs at or above the threshold that searches shall meet.
TARGET_RECALL = 0.99
#: Vectors listed in a comparison block, at most, and bytes of these; so many times more search in it, STEP at once.
LISTED, LISTED_BYTES, ASK_RATIO, STEP = 16_384, 8 << 20, 4, 512


def parse(values: list | None) -> np.ndarray | None:
    """A vector in double precision; None if it is null, zero, empty or holds a null or non-finite component."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(((c * c).sum(1) - 2 * (x[i : i + 2048] @ c.T))).argmin(1) for i in range(0, len(x), 2048)])
        n = np.bincount(at, minlength=len(c))
        new = np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    visits: int
    #: the group of each codeword of either half
    groups: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1, np.int64), np.zeros(1, np.int64)))

    def regions(self, cells: np.ndarray) -> np.ndarray:
        """The region of each cell."""
        a, b = self.groups
        return a[cells // len(self.second)] * (b.max() + 1) + b[cells % len(self.second)]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        a, b = x[:, :h], x[:, h:]
        return tuple(np.maximum((y * y).sum(1)[:, None] + (c * c).sum(1) - 2 * (y @ c.T), 0) for y, c in ((a, self.first), (b, self.second)))

    def traverse(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """For each row of x the ids of the `visits` nearest cells, nearest first. The v nearest cells of the grid are
        among those whose ranks i, j (from 1) in the two halves have i * j <= v, so only these are ordered."""
        d1, d2 = self.distances(x)
        v = min(visits or self.visits, d1.shape[1] * d2.shape[1])
        n1, n2 = min(v, d1.shape[1]), min(v, d2.shape[1])
        o1, o2 = np.argsort(d1, 1, kind="stable")[:, :n1], np.argsort(d2, 1, kind="stable")[:, :n2]
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        i, j = (np.array(z) for z in zip(*((i, j) for i in range(n1) for j in range(min(n2, v // (i + 1))))))
        order = np.argsort(s1[:, i] + s2[:, j], 1, kind="stable")[:, :v]
        return (o1[np.arange(len(x))[:, None], i[order]] * len(self.second) + o2[np.arange(len(x))[:, None], j[order]]).astype(np.int64)

    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place (from 0) of the given cell in the traversal of each row."""
        d1, d2 = self.distances(x)
        out = np.empty(len(x), np.int64)
        for i, c in enumerate(cells):
            own = d1[i, c // len(self.second)] + d2[i, c % len(self.second)] - 1e-12
            out[i] = np.searchsorted(np.sort(d2[i]), own - d1[i], "left").sum()
        return out


def listed_of(dim: int) -> int:
    """Vectors of this length that a block lists, at most."""
    return max(1, min(LISTED, LISTED_BYTES // (8 * max(dim, 1))))


def grouped(words: np.ndarray, dim: int) -> np.ndarray:
    """Groups of neighbouring codewords, as many in one as let a region's vectors fit into a block."""
    size = max(1.0, 0.9 * (listed_of(dim) / PER_CELL) ** 0.5)
    c = kmeans(words, max(1, round(len(words) / size)))
    at = ((c * c).sum(1) - 2 * (words @ c.T)).argmin(1)
    return np.unique(at, return_inverse=True)[1]


def fit(sample: np.ndarray, rows: int, cosine: float, recall: float = TARGET_RECALL, seed: int = 5) -> Index:
    """Codebooks for `rows` vectors, and the visits that meet the share `recall` of pairs at or above the threshold: of
    those in the sample, and of as many made by turning sampled vectors by angles up to the threshold's."""
    k = int(np.clip(round((rows / PER_CELL) ** 0.5), 1, max(1, len(sample) // 4)))
    h = sample.shape[1] // 2
    index = Index(kmeans(sample[:, :h], k), kmeans(sample[:, h:], k), 1)
    rng = np.random.default_rng(seed)
    n = min(len(sample), 1000)
    x = sample[rng.choice(len(sample), n, replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
    c = rng.uniform(cosine, 1.0, (n, 1))
    pairs = [(x, unit(c * x + np.sqrt(1 - c * c) * noise))]
    s = np.triu(x @ x.T, 1) >= cosine
    i, j = np.nonzero(s)
    if len(i):
        pick = rng.choice(len(i), min(len(i), 1000), replace=False)
        pairs.append((x[i[pick]], x[j[pick]]))
    need = 1
    for a, b in pairs:
        ranks = []
        for at in range(0, len(a), 50):
            p, q = a[at : at + 50], b[at : at + 50]
            cp, cq = index.traverse(p, 1)[:, 0], index.traverse(q, 1)[:, 0]
            ranks.append(np.minimum(index.rank(p, cq), index.rank(q, cp)))
        r = np.sort(np.concatenate(ranks))
        need = max(need, int(r[min(len(r) - 1, int(np.ceil(recall * len(r))) - 1)]) + 1)
    index.visits = need
    index.groups = grouped(index.first, sample.shape[1]), grouped(index.second, sample.shape[1])
    return index


def sample_size(rows: int) -> int:
    """Vectors of the sample for a table of so many: it grows as the codebooks do, with the square root."""
    return max(SAMPLE, int(PER_WORD * (rows / PER_CELL) ** 0.5))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vecs = [parse(v) for v in b.column(1).to_pylist()]
        raw = [None if v is None else pack(v) for v in vecs]
        digest = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0 if v is None else len(v) for v in vecs], pa.int32()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "dim", "digest", "raw"])


def pack(v: np.ndarray) -> bytes:
    """A vector's components: in single precision where that keeps them all, else in double."""
    with np.errstate(over="ignore"):
        f = v.astype(np.float32)
    return f.tobytes() if (f == v).all() else v.tobytes()


def _unit_rows(rows: list[bytes], dim: int) -> np.ndarray:
    return unit(np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in rows]).astype(np.float64))


def _parts(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each vector length, in pieces."""
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        for low in range(0, len(rows), 500):
            yield int(d), rows[low : low + 500]


def _visits(indexes: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("multi_index")
        for whole in batches:
            for dim, rows in _parts(whole.column("dim").to_numpy()):
                index = indexes.value[dim]
                b = whole.take(pa.array(rows))
                cells = index.traverse(_unit_rows(b.column("raw").to_pylist(), dim))
                own = cells[:, 0].copy()
                cells.sort(1)
                region = index.regions(cells)
                order = np.argsort(region, 1, kind="stable")
                cells, region = np.take_along_axis(cells, order, 1), np.take_along_axis(region, order, 1)
                regions, parts = [], []
                for c, r in zip(cells, region):
                    cut = np.flatnonzero(np.diff(r)) + 1
                    regions.append(r[np.append(0, cut)])
                    parts.append([x.astype(np.int32).tobytes() for x in np.split(c, cut)])
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("dim"), b.column("m"), b.column("raw"), pa.array(own), pa.array(index.regions(own)), pa.array(regions, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.binary()))],
                    ["row", "dim", "m", "raw", "own", "home", "regions", "cells"],
                )

    return run


def _links(x: np.ndarray, row: np.ndarray, m: np.ndarray, own: np.ndarray, seen: list[np.ndarray], listed: np.ndarray, asks: np.ndarray, cosine: float) -> pa.RecordBatch | None:
    """What the searches of `asks` find among `listed`, cell by cell: each row's links, and its label in a spanning forest."""
    visited = np.concatenate([seen[i] for i in asks])
    who = np.repeat(asks, [len(seen[i]) for i in asks])
    by = np.argsort(visited, kind="stable")
    visited, who = visited[by], who[by]
    there = listed[np.argsort(own[listed], kind="stable")]
    cells, start = np.unique(own[there], return_index=True)
    low, high = np.searchsorted(visited, cells, "left"), np.searchsorted(visited, cells, "right")
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for c, (s, e) in enumerate(zip(start, [*start[1:], len(there)])):
        a, t = who[low[c] : high[c]], there[s:e]
        if not len(a):
            continue
        near = (x[a] @ x[t].T >= cosine) & (row[a][:, None] != row[t][None, :])
        if near.any():
            i, j = np.nonzero(near)
            links.append((a[i], t[j]))
    if not links:
        return None
    i, j = (np.concatenate(z) for z in zip(*links))
    # a listed vector whose own search meets the asker's cell counts the pair there
    back = np.ones(len(i), bool)
    by = np.argsort(j, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(j[by])) + 1):
        back[part] = ~np.isin(own[i[part]], seen[j[part[0]]])
    rows, at = np.unique(np.concatenate([row[i], row[j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    total = np.bincount(a, m[j], len(rows)) + np.bincount(b[back], m[i][back], len(rows))
    lab = np.arange(len(rows))
    while True:  # the least row that each reaches
        new = lab.copy()
        np.minimum.at(new, a, lab[b])
        np.minimum.at(new, b, lab[a])
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(total.astype(np.int64)), pa.array(rows[lab])], ["row", "links", "label"])


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("multi_index")
        for g in groups_of(batches, ["dim", "region", "p", "q"]):
            g = g.combine_chunks()
            listed = np.flatnonzero(g.column("listed").to_numpy(zero_copy_only=False))
            asks = np.flatnonzero(~g.column("listed").to_numpy(zero_copy_only=False))
            if not len(listed) or not len(asks):
                continue
            row, m, own = (g.column(n).to_numpy() for n in ("row", "m", "own"))
            dim, raw = g.column("dim")[0].as_py(), g.column("raw").to_pylist()
            seen = [np.frombuffer(c, np.int32) for c in g.column("seen").to_pylist()]
            x = _unit_rows([raw[i] for i in listed], dim)
            for low in range(0, len(asks), STEP):
                a = asks[low : low + STEP]
                at = np.concatenate([a, listed])
                both = np.concatenate([_unit_rows([raw[i] for i in a], dim), x])
                out = _links(both, row[at], m[at], own[at], [seen[i] for i in at], np.arange(len(a), len(at)), np.arange(len(a)), cosine)
                if out is not None:
                    yield out

    return run


def _found(reps: DataFrame, cosine: float, recall: float) -> DataFrame | None:
    """(row, links, label) of the classes that found others, by blocks; None where no length has two vectors."""
    spark = reps.sparkSession
    many = reps.groupBy("dim").count().filter("count > 1")
    # a length for each row
    indexes = {(d := r["dim"]): Index(np.zeros((1, d // 2)), np.zeros((1, d - d // 2)), 1) for r in many.select("dim").collect()}
    for r in many.filter(F.col("count") > FEW).collect():
        dim, n = r["dim"], r["count"]
        own, want = reps.filter(F.col("dim") == dim), sample_size(n)
        picked = own if n <= want else own.filter(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < max(1, int(1_000_000 * want / n)))
        sample = picked.select("raw").orderBy(F.xxhash64("raw")).toPandas()["raw"]
        indexes[dim] = fit(_unit_rows(list(sample), dim), n, cosine, recall)
    if not indexes:
        return None
    shared = spark.sparkContext.broadcast(indexes)
    v = reps.select("row", "dim", "m", "raw").join(F.broadcast(many.select("dim")), "dim", "left_semi").select("row", "dim", "m", "raw")
    v = stored(mapped(v, _visits(shared), "row long, dim int, m long, raw binary, own long, home long, regions array<long>, cells array<binary>"), "visits")
    sizes = v.select("dim", F.explode("regions").alias("region"), F.col("home")).groupBy("dim", "region").agg(F.count("*").alias("asks"), F.count(F.when(F.col("home") == F.col("region"), 1)).alias("listed"))
    # regions where nothing or only the asker itself is listed need no comparison
    most = F.greatest(F.lit(1), F.least(F.lit(LISTED), F.floor(F.lit(LISTED_BYTES) / (8 * F.col("dim")))))
    sizes = stored(sizes.filter("listed > 0 AND asks > 1").select("dim", "region", F.ceil(F.col("listed") / most).cast("long").alias("nl"), F.ceil(F.col("asks") / (ASK_RATIO * most)).cast("long").alias("na")), "regions")
    n = sizes.count()
    place = lambda k: F.pmod(F.xxhash64("row"), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    asks = v.select("row", "dim", "m", "raw", "own", F.explode(F.arrays_zip("regions", "cells")).alias("x")).select("row", "dim", "m", "raw", "own", F.col("x.regions").alias("region"), F.col("x.cells").alias("seen"))
    asks = asks.join(small(sizes, n), ["dim", "region"]).select("dim", "region", every("nl").alias("p"), place("na").alias("q"), F.lit(False).alias("listed"), "row", "m", "raw", "own", "seen")
    lists = v.withColumnRenamed("home", "region").join(small(sizes, n), ["dim", "region"])
    lists = lists.select("dim", "region", place("nl").alias("p"), every("na").alias("q"), F.lit(True).alias("listed"), "row", "m", "raw", "own", F.expr("aggregate(cells, X'', (a, c) -> concat(a, c))").alias("seen"))
    pairs = asks.unionByName(lists).repartition("dim", "region", "p", "q").sortWithinPartitions("dim", "region", "p", "q")
    return stored(mapped(pairs, _compare(cosine), "row long, links long, label long"), "links")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = TARGET_RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a found cosine at or above the threshold), component_id (the
    smallest vec_id reachable by links, itself included), kept (vec_id = component_id).

    Vectors are compared in double precision. Those that are null, zero or hold null or non-finite components link with
    nothing, and vectors of different lengths don't link. Repeated rows are vectors of their own; a vector of null id
    gets its component's id, and kept false where that is not null, else true. Other columns are not read."""
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    kind = d.schema["vec_id"].dataType.simpleString()
    t = stored(mapped(d, _classes, f"vec_id {kind}, dim int, digest binary, raw binary"), "vec")
    total = t.count()
    reps = t.filter("digest IS NOT NULL").groupBy("dim", "digest").agg(F.first("raw").alias("raw"), F.count("*").alias("m"), F.min("vec_id").alias("vec_id"))
    reps = stored(reps.withColumn("row", F.monotonically_increasing_id()), "reps")
    with scratch() as made:
        found = _found(reps, cosine, recall)
        made[:] = [x for x in made if x is not found]
    key = ["dim", "digest"]
    if found is None:
        info = reps.select(*key, "m", (F.col("m") - 1).alias("n_links"), F.col("vec_id").alias("low"))
    else:
        links = found.groupBy("row").agg(F.sum("links").alias("links"))
        comp = connected(found.select(F.col("row").alias("u"), F.col("label").alias("v")))
        named = comp.withColumnRenamed("node", "row").join(reps.select("row", "vec_id"), "row")
        least = named.groupBy("component").agg(F.min("vec_id").alias("least"))
        named = named.join(least, "component").select("row", "least")
        info = reps.join(links, "row", "left").join(named, "row", "left").select(*key, "m", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "vec_id").alias("low"))
    info = stored(info, "info")
    dropped(reps, *([] if found is None else [found]))
    whole = join_counted(t.filter("digest IS NOT NULL").select("vec_id", *key), info, key, "m", total).select("vec_id", "n_links", F.coalesce("low", "vec_id").alias("component_id"))
    alone = t.filter("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
