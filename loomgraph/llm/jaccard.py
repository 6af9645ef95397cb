"""N-gram Jaccard self-join with PartEnum signatures.

Every document is the set of its distinct word n-grams. Sets of one size band that are similar enough differ in at most
k elements, so if the feature domain is cut into n1 parts of three sub-parts each, with 2 * n1 > k, some part has at
most one difference and hence two of its three sub-parts agree exactly. The projections of a set on every such pair of
sub-parts are its signatures; sets within the threshold share at least one, so no link is lost. Candidates are then
verified exactly.

Documents with equal sets are collapsed first and stand as one class. Signature collisions form candidate components. One
that fits into a block is compared whole; a wider one is first parted by a prefix filter, so that pages with a common
frame are not compared with each other. Sets are compared by matrix products in blocks of bounded size, and only counts
and a spanning forest leave a block, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_ROWS, as_bytes, claim, connected, dropped, groups_of, hashed_words, join_counted, least_labels, mapped, mix, pieces, scratch, small, stored

#: Documents and elements a comparison block holds at most on each side.
BLOCK_DOCS, BLOCK_ELEMENTS = 2048, 4_000_000
#: Hash bins by whose counts the elements of wide components are ordered, rarest first.
BINS = 1 << 20
#: Ratio between the smallest and the largest size that start in one band.
BAND_RATIO = 1.3
_P = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(64)]


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles; of the whole sequence where it has fewer than
    n words."""
    words, counts = hashed_words(texts)
    out, at = [], 0
    for c in counts.tolist():
        h, m = words[at : at + c], min(n, c)
        at += c
        if not c:
            out.append(np.empty(0, np.uint64))
            continue
        s = np.full(c - m + 1, np.uint64(m), np.uint64)
        for i in range(m):
            s = s + h[i : c - m + 1 + i] * _P[i + 1]
        out.append(np.unique(mix(s)))
    return out


def bands(num: int, den: int, largest: int, ratio: float = BAND_RATIO) -> list[tuple[int, int, int]]:
    """(lowest size, highest size, k) of each instance for threshold num / den: a pair of sets that meets it lies in the
    instance in whose band its smaller set starts, and differs in at most k elements there."""
    out, low = [], -(-num // (den - num))
    while low <= largest:
        end = max(low, int(low * ratio))
        high = end * den // num
        out.append((low, high, (den - num) * (end + high) // (den + num)))
        low = end + 1
    return out


class _Signer:
    def __init__(self, num: int, den: int):
        self.num, self.den, self.bands = num, den, bands(num, den, 1 << 12)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        size = len(s)
        if self.bands[-1][0] < size:
            self.bands = bands(self.num, self.den, 4 * size)
        out = []
        for j, (low, high, k) in enumerate(self.bands):
            if low > size:
                break
            if size > high:
                continue
            n1 = k // 2 + 1
            at = ((s >> np.uint64(20)) % np.uint64(3 * n1)).astype(np.int64)
            e = mix(s + np.uint64(j + 1))
            lo = np.bincount(at, (e & np.uint64(0xFFFFFFFF)).astype(np.float64), 3 * n1).astype(np.uint64)
            hi = np.bincount(at, (e >> np.uint64(32)).astype(np.float64), 3 * n1).astype(np.uint64)
            cells = (lo + (hi << np.uint64(32))).reshape(n1, 3)
            pairs = cells.sum(1, dtype=np.uint64)[:, None] - cells
            out.append(mix(pairs.ravel() ^ mix(np.arange(3 * n1, dtype=np.uint64) + np.uint64((j + 1) << 32))))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _prints(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(s).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=off[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _sign(n: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("jaccard")
        sign, row = _Signer(num, den), TaskContext.get().partitionId() << 36
        for b in batches:
            for c in pieces(b, 1):
                sets = shingles(as_bytes(c.column(1)), n)
                p = [_prints(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(sets))), c.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in p], pa.int64()), pa.array([x for _, x in p], pa.int64()), _lists([sign(s) for s in sets])],
                    ["row", "doc_id", "n", "f1", "f2", "sigs"],
                )
                row += len(sets)

    return run


def _shingled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        seen: set[tuple[int, int]] = set()  # each class once a task
        for b in batches:
            for c in pieces(b, 0):
                sets = shingles(as_bytes(c.column(0)), n)
                p = [_prints(s) for s in sets]
                new = [i for i, x in enumerate(p) if x not in seen and not seen.add(x)]
                sets, p = [sets[i] for i in new], [p[i] for i in new]
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in p], pa.int64()), pa.array([x for _, x in p], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["n", "f1", "f2", "elements"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[at] > 1
    owner, at = owner[keep], at[keep]
    ids = np.cumsum(df > 1) - 1
    at, width = ids[at], int((df > 1).sum())
    out = np.zeros((n, n), np.float32)
    step = max(256, 8_000_000 // max(n, 1))
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, width, step):
        i, j = np.searchsorted(at, [low, low + step])
        m = np.zeros((n, min(step, width - low)), np.float32)
        m[owner[i:j], at[i:j] - low] = 1
        out += m @ m.T
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by comp, p, q and row without rows that repeat the one before: a text that a table holds very often
    is held once here."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(x).to_numpy() for x in ("comp", "p", "q", "row")])
        new = np.append(last is None or (k[0] != last).any(), (k[1:] != k[:-1]).any(1))
        last = k[-1]
        yield b if new.all() else b.filter(pa.array(new))


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(_once(batches), ["comp", "p", "q"]):
            row, first = np.unique(g.column("row").to_numpy(), return_index=True)
            side = g.column("b").to_numpy()[first]
            m = g.column("m").to_numpy()[first]
            raw = g.column("elements").to_pylist()
            sets = [np.frombuffer(raw[i], np.uint64) for i in first]
            both = common_counts(sets)
            size = np.array([len(s) for s in sets], np.float64)
            linked = den * both.astype(np.float64) >= num * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(linked, False)
            if g.column("p")[0].as_py() != g.column("q")[0].as_py():
                linked &= side[:, None] != side[None, :]
            lab = least_labels(linked)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array((linked @ m).astype(np.int64)), pa.array(row[lab])], ["row", "links", "label"])

    return run


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many elements of the batches' sets fall into each hash bin."""
    total = np.zeros(BINS, np.int64)
    for b in batches:
        for e in b.column(0).to_pylist():
            total += np.bincount((np.frombuffer(e, np.uint64) >> np.uint64(44)).astype(np.int64), minlength=BINS)
    hit = np.flatnonzero(total)
    for at in range(0, len(hit), 100_000):
        h = hit[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(total[h])], ["bin", "c"])


def prefix(s: np.ndarray, weight: np.ndarray, num: int, den: int) -> np.ndarray:
    """The elements of a set that come first, those of the rarest bins before others, so many that two sets within the
    threshold have one in common."""
    n = len(s)
    order = np.lexsort((s, weight[(s >> np.uint64(44)).astype(np.int64)]))
    return s[order[: n - -(-num * n // den) + 1]]


def _prefixes(weight: Broadcast, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists([prefix(np.frombuffer(e, np.uint64), w, num, den) for e in b.column(2).to_pylist()])], ["row", "component", "tokens"])

    return run


def _sized(cand: DataFrame) -> DataFrame:
    """cand with nb, the number of blocks that its component is cut into."""
    size = cand.groupBy("component").agg(F.count("*").alias("c"), F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).cast("int").alias("nb"))
    return join_counted(cand, size, ["component"], "c", cand.count(), "inner").drop("c")


def _sets(docs: DataFrame, cand: DataFrame, n: int) -> DataFrame:
    """cand's rows with `elements`, the sets of their texts."""
    rows = cand.count()
    ids = cand.select(F.col("doc_id").alias("c_id")).distinct()
    if rows <= BROADCAST_ROWS:
        text = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("c_id")), "left_semi")
    else:
        text = docs.join(ids, F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == F.coalesce(F.col("c_id").cast("string"), F.lit("")), "left_semi")
    sets = mapped(text.select("text"), _shingled(n), "n long, f1 long, f2 long, elements binary")
    return sets.join(small(cand.drop("doc_id"), rows), ["n", "f1", "f2"])


def _narrowed(docs: DataFrame, wide: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of components too wide for one block, with the components in which they share an element of their prefix;
    rows that share none are left out. So only colliding pairs that pass the prefix filter are compared: pages that have
    a frame in common but differ in the rest part here."""
    spark = docs.sparkSession
    bins = mapped(_sets(docs, wide, n).select("elements"), _bins, "bin long, c long").groupBy("bin").agg(F.sum("c").alias("c")).toPandas()
    weight = np.zeros(BINS, np.int64)
    weight[bins["bin"].to_numpy()] = bins["c"].to_numpy()
    shared = spark.sparkContext.broadcast(weight)
    pre = stored(mapped(_sets(docs, wide, n).select("row", "component", "elements"), _prefixes(shared, num, den), "row long, component long, tokens array<long>"), "prefix")
    total = pre.agg(F.sum(F.size("tokens"))).first()[0] or 0
    tok = pre.select("row", "component", F.explode("tokens").alias("token"))
    met = tok.groupBy("component", "token").agg(F.min("row").alias("v"), F.count("*").alias("c")).filter("c > 1")
    edges = join_counted(tok, met, ["component", "token"], "c", total, "inner").filter("row <> v").select(F.col("row").alias("u"), "v")
    parts = connected(edges)
    out = stored(wide.drop("component", "nb").join(parts.withColumnRenamed("node", "row"), "row"), "narrow")
    dropped(pre)
    return out


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 90, den: int = 100) -> DataFrame:
    """Documents whose sets of n-word shingles have Jaccard similarity >= num / den are linked.

    Returns one row a document: doc_id, n_shingles, n_similar (other documents linked directly), component_id (the
    smallest doc_id reachable by links, itself included). Words are runs of characters other than ASCII white space,
    lower-cased in A-Z; a text with fewer than n words is one shingle. A null text, or one without words, is an empty
    set and linked with nothing. Repeated rows count as documents of their own; a null id is never a component's
    smallest unless all its ids are null, and a linked document without id gets its component's. Other columns are not
    read. Shingles are compared by 64-bit hashes."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    t = stored(mapped(docs, _sign(n, num, den), f"row long, doc_id {kind}, n long, f1 long, f2 long, sigs array<long>"), "sig")
    total, n_sigs = t.agg(F.count("*"), F.sum(F.size("sigs"))).first()
    key = ["n", "f1", "f2"]
    with scratch() as made:
        reps = stored(t.filter("n > 0").groupBy(*key).agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.count("*").alias("m")), "reps")
        sig = t.filter(F.size("sigs") > 0).join(reps.select("row"), "row", "left_semi").select("row", F.explode("sigs").alias("sig"))
        met = sig.groupBy("sig").agg(F.min("row").alias("v"), F.count("*").alias("c")).filter("c > 1")
        edges = join_counted(sig, met, ["sig"], "c", n_sigs or 0, "inner").filter("row <> v").select(F.col("row").alias("u"), "v")
        comp = connected(edges)

        cand = stored(_sized(stored(comp.withColumnRenamed("node", "row").join(reps, "row"), "met")), "cand")
        wide = cand.filter("nb > 1")
        if wide.limit(1).count():
            narrow = _sized(_narrowed(docs, wide, n, num, den))
            cand = stored(cand.filter("nb = 1").unionByName(narrow.select(*cand.columns)), "cand")
        sets = _sets(docs, cand.select(*key, "row", "m", "nb", "doc_id", F.col("component").alias("comp")), n)
        sets = sets.withColumn("b", F.pmod(F.xxhash64("row"), F.col("nb")).cast("long"))
        sets = sets.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)))
        sets = sets.select("comp", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "row", "m", "elements")
        sets = sets.repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q", "row")
        found = stored(mapped(sets, _verify(num, den), "row long, links long, label long"), "found")

        links = found.groupBy("row").agg(F.sum("links").alias("links"), F.min("label").alias("label"))
        split = cand.filter("nb > 1").select("row")
        if split.limit(1).count():
            across = connected(found.join(split, "row", "left_semi").select(F.col("row").alias("u"), F.col("label").alias("v")))
            links = links.join(across.withColumnRenamed("node", "row"), "row", "left").select("row", "links", F.coalesce("component", "label").alias("label"))
        links = stored(links.filter("links > 0"), "links")
        least = links.join(reps.select("row", "doc_id"), "row").groupBy("label").agg(F.min("doc_id").alias("low"))
        info = reps.join(links.join(least, "label"), "row", "left").select(*key, "m", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("low", "doc_id").alias("component_id"))
        info = stored(info, "info")
        made[:] = [x for x in made if x is not info]
    out = join_counted(t.select("doc_id", *key), info, key, "m", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), F.coalesce("component_id", "doc_id").alias("component_id"))
