"""Toxicity by a classifier chain.

The categories are those that labels tell apart, in this order: `junk` (quality 0) and `toxic`. Each has a linear model; a
later one also sees the probabilities of the categories before it, which in training are out-of-fold predictions, so that
it learns how far they can be trusted.

Features are the words, pairs of neighbouring words and four-byte runs inside words of the whole text, hashed. A hash value
counts if it goes with a category by a likelihood-ratio test that is corrected for the number of values tested, so chance
features stay out however large the sample; what passes counts without a bound on its number. The models see the presence
of these values, hashed into COLUMNS, and for each category how many of them a text has and their share of its words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.llm.common import as_bytes, claim, dropped, groups_of, mapped, pieces, release, stored
from loomgraph.llm.linear import chi2_cut, fit_blocks, predict, sigmoid

#: Labelled documents used to fit, at most.
MAX_LABELLED = 20_000
#: Hash values of each kind of feature, and columns that those that count are hashed into.
VALUES, COLUMNS = 1 << 20, 192
#: Counts travel in chunks of so many bits' hash values; values in fewer texts than SEEN are not tested.
CHUNK_BITS, SEEN = 14, 3
#: Chance that any feature counts that goes with no category.
LEVEL = 0.01
FOLDS = 5
#: The categories of the chain in their order: the label and its value that stand for them.
CATEGORIES = {"junk": ("quality", 0), "toxic": ("toxic", 1)}
#: A labelled document as it travels to the driver: labels by category, fold, how many documents are alike, and its
#: features, presence as bits. COLUMNS is a multiple of 8.
ROW = np.dtype([("y", np.int8, (len(CATEGORIES),)), ("fold", np.int8), ("n", np.int64), ("bits", np.uint8, (COLUMNS // 8,)), ("rest", np.float32, (2 * len(CATEGORIES),))])
#: Rows whose features the driver spreads out at a time.
BLOCK = 2048
#: ASCII letters in lower case; digits and bytes beyond ASCII stay; the rest separates words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))
BLANK = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _hash(h: np.ndarray) -> np.ndarray:
    return ((h * _SPREAD) >> np.uint64(44)).astype(np.int64)


def values(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash values of all features of the texts, the text that each is of, and how many words each text has. Words
    have values from 0, pairs from VALUES, runs from 2 * VALUES; runs see marks, words do not."""
    n = len(texts)
    of = np.repeat(np.arange(n), [len(t or b"") + 1 for t in texts])  # the text of each byte
    raw = b"".join((t or b"") + b" " for t in texts)
    b = np.frombuffer(raw.translate(LETTERS), np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = b != 32
    turn = np.diff(word)
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # a word's hash is the difference of running sums, with a multiplier for each place in it
    owner = of[start]
    counts = np.bincount(owner, minlength=n)
    out = []
    if len(start):
        size = stop - start
        letters = b[word[1:-1].view(bool)].astype(np.uint64) + np.uint64(1)
        at = np.cumsum(size) - size
        place = np.arange(len(letters)) - np.repeat(at, size)
        letters *= np.cumprod(np.full(int(size.max()), 0x100000001B3, np.uint64))[place]
        h = np.add.reduceat(letters, at)
        out.append((_hash(h), owner))
        same = np.flatnonzero(owner[1:] == owner[:-1])
        out.append((VALUES + _hash(h[same] * np.uint64(31) + h[same + 1]), owner[same]))
    r = np.frombuffer(raw.lower().translate(BLANK), np.uint8).astype(np.uint64)
    if len(r) > 3:
        inside = r != 32
        inside = np.flatnonzero(inside[:-3] & inside[1:-2] & inside[2:-1] & inside[3:])
        four = r[inside] | r[inside + 1] << np.uint64(8) | r[inside + 2] << np.uint64(16) | r[inside + 3] << np.uint64(24)
        out.append((2 * VALUES + _hash(four + np.uint64(1)), of[inside]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    return np.concatenate([v for v, _ in out]), np.concatenate([o for _, o in out]), counts


@dataclass
class Chain:
    """What counts: `columns` has for each hash value its column, or -1, and `kinds` the categories it goes with, as bits;
    and one model a category."""

    columns: np.ndarray = field(default_factory=lambda: np.full(3 * VALUES, -1, np.int16))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(3 * VALUES, np.uint8))
    models: list[np.ndarray] = field(default_factory=list)

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """Presence of each column; for each category the logarithm of how many of its values a text has, and their share
        of its words."""
        k = len(CATEGORIES)
        x = np.zeros((len(texts), COLUMNS + 2 * k))
        v, owner, words = values(texts)
        at = np.flatnonzero(self.columns[v] >= 0)
        v, owner = v[at], owner[at]
        x[owner, self.columns[v]] = 1
        for j in range(k):
            n = np.bincount(owner[(self.kinds[v] >> j & 1) > 0], minlength=len(texts))
            x[:, COLUMNS + 2 * j] = np.log1p(n)
            x[:, COLUMNS + 2 * j + 1] = np.minimum(1.0, 10 * n / np.maximum(words, 1))
        return x

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.models)))
        for j, w in enumerate(self.models):
            out[:, j] = predict(w, np.hstack([x, out[:, :j]]))
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most about `bound` labelled documents, chosen by a hash of the id. Ids without a label of 0
    or 1, and null ids, are left out; an id with several labels has the largest."""
    y = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(_bounded(y, bound), "doc_id")


def _bounded(y: DataFrame, bound: int) -> DataFrame:
    n = y.count()
    if n > bound:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    return F.broadcast(y) if bound <= 100_000 else y


def _flags(labels: DataFrame) -> DataFrame:
    """(doc_id, y0, y1, ...): 1 or 0 by category, -1 where the label is missing; of several labels the one that stands for
    the category counts."""
    by = [F.max(F.when(F.col(c).isin(0, 1), (F.col(c) == v).cast("int"))) if c in labels.columns else F.lit(None).cast("int") for c, v in CATEGORIES.values()]
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(x, F.lit(-1)).alias(f"y{j}") for j, x in enumerate(by))).filter(" OR ".join(f"y{j} >= 0" for j in range(len(by))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each hash value in how many texts it is, by category and label."""
    claim("toxicity")
    k = len(CATEGORIES)
    total = np.zeros((2 * k, 3 * VALUES), np.int32)
    for b in (x for whole in batches for x in pieces(whole, 0)):
        v, owner, _ = values(as_bytes(b.column(0)))
        once = np.unique(owner * (3 * VALUES) + v)
        v, owner = once % (3 * VALUES), once // (3 * VALUES)
        for j in range(k):
            y = b.column(1 + j).to_numpy(zero_copy_only=False)[owner]
            for label in (0, 1):
                at, n = np.unique(v[y == label], return_counts=True)
                total[2 * j + label, at] += n.astype(np.int32)
    hit = np.flatnonzero(total.any(0))
    for part in np.split(hit, np.flatnonzero(np.diff(hit >> CHUNK_BITS)) + 1):
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array([part[0] >> CHUNK_BITS]), pa.array([(part & ((1 << CHUNK_BITS) - 1)).astype(np.uint16).tobytes()], pa.binary()), pa.array([total[:, part].tobytes()], pa.binary())], ["chunk", "places", "counts"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all tasks' counts, of hash values that are seen often enough to be tested."""
    claim("toxicity")
    k = len(_COUNTS)
    for g in groups_of(batches, ["chunk"]):
        total = np.zeros((k, 1 << CHUNK_BITS), np.int64)
        for places, counts in zip(g.column("places").to_pylist(), g.column("counts").to_pylist()):
            total[:, np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int32).reshape(k, -1)
        at = np.flatnonzero(total.sum(0) >= SEEN * len(CATEGORIES))
        yield pa.RecordBatch.from_arrays([pa.array(at + (g.column("chunk")[0].as_py() << CHUNK_BITS)), *(pa.array(total[c, at]) for c in range(k))], ["value", *_COUNTS])


_COUNTS = [f"{c}{j}" for j in range(len(CATEGORIES)) for c in ("neg", "pos")]


def _g2(a: Column, b: Column, n1: float, n0: float) -> Column:
    """Log-likelihood ratio of presence in a of n1 positive and b of n0 negative rows."""
    n, r = n1 + n0, a + b
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (part(a, r * n1 / n) + part(b, r * n0 / n) + part(n1 - a, (n - r) * n1 / n) + part(n0 - b, (n - r) * n0 / n))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Chain:
    """Fits the chain on a sample of at most about `bound` labelled documents. Without labels of a category its
    probability is next to none everywhere; without positive ones no feature counts for it."""
    k = len(CATEGORIES)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(_bounded(_flags(labels), bound), "doc_id")
    ys = [f"y{j}" for j in range(k)]
    sizes = sample.agg(*(F.count(F.when(F.col(y) == v, 1)).alias(f"{y}_{v}") for y in ys for v in (0, 1))).first()
    chain = Chain()
    chunks = mapped(sample.select("text", *ys), _counts, "chunk long, places binary, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    counts = stored(mapped(chunks, _totals, "value long, " + ", ".join(f"{c} long" for c in _COUNTS)), "counts")
    tested = counts.count()
    cut = chi2_cut(LEVEL / max(1, k * tested))
    goes = [F.when((F.col(f"pos{j}") * sizes[f"y{j}_0"] > F.col(f"neg{j}") * sizes[f"y{j}_1"]) & (_g2(F.col(f"pos{j}"), F.col(f"neg{j}"), float(sizes[f"y{j}_1"]), float(sizes[f"y{j}_0"])) > cut), 1 << j).otherwise(0) if sizes[f"y{j}_1"] and sizes[f"y{j}_0"] else F.lit(0) for j in range(k)]
    got = counts.select("value", sum(goes).cast("int").alias("kinds")).filter("kinds > 0").toArrow()  # at most a row a hash value
    dropped(counts)
    v = got["value"].to_numpy()
    chain.kinds[v] = got["kinds"].to_numpy()
    chain.columns[v] = _hash(v.astype(np.uint64) + np.uint64(7)) % COLUMNS
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # documents without any feature that counts are alike: they are only counted
        claim("toxicity")
        chain, blank = shared.value, Counter()
        for b in (x for whole in batches for x in pieces(whole, 0)):
            x = chain.features(as_bytes(b.column(0)))
            y = np.stack([b.column(1 + j).to_numpy(zero_copy_only=False) for j in range(k + 1)], 1)
            hit = x.any(1)
            blank.update(map(tuple, y[~hit].tolist()))
            yield _packed(y[hit], 1, x[hit])
        if blank:
            yield _packed(np.array(list(blank)), list(blank.values()), np.zeros((len(blank), COLUMNS + 2 * k)))

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    got = mapped(sample.select("text", *ys, fold), rows, "rows binary").toArrow()
    got = np.frombuffer(b"".join(x.as_buffer() for x in got["rows"]), ROW)
    before = np.zeros((len(got), 0), np.float32)
    for j in range(k):
        y, fold = got["y"][:, j], got["fold"]

        def model(at: np.ndarray) -> np.ndarray:
            return fit_blocks(lambda s: _spread(got, before, at[s]), COLUMNS + 2 * k + before.shape[1] + 1, y[at], got["n"][at], l2=0.05, size=BLOCK)

        def probability(w: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.concatenate([np.empty(0), *(sigmoid(_spread(got, before, at[low : low + BLOCK]) @ w) for low in range(0, len(at), BLOCK))])

        use = y >= 0
        chain.models.append(model(np.flatnonzero(use)) if use.any() else np.append(np.zeros(COLUMNS + 2 * k + j), -20.0))
        oof = probability(chain.models[-1], np.arange(len(got)))
        for f in range(FOLDS):
            rest, out = np.flatnonzero(use & (fold != f)), np.flatnonzero(fold == f)
            if len(rest) and len(out):
                oof[out] = probability(model(rest), out)
        before = np.hstack([before, oof[:, None].astype(np.float32)])
    del got, before
    release()  # the driver's memory
    return chain


def _packed(y: np.ndarray, n: int | list[int], x: np.ndarray) -> pa.RecordBatch:
    """One row with all of ROW: the labels and the fold in y, how many are alike, the features."""
    out = np.zeros(len(y), ROW)
    out["y"], out["fold"], out["n"] = y[:, :-1], y[:, -1], n
    out["bits"], out["rest"] = np.packbits(x[:, :COLUMNS] > 0, axis=1), x[:, COLUMNS:]
    return pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["rows"])


def _spread(rows: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The features of rows[at], the probabilities of the categories before, and ones."""
    r, n = rows[at], rows["rest"].shape[1]
    x = np.ones((len(at), COLUMNS + n + before.shape[1] + 1))
    x[:, :COLUMNS] = np.unpackbits(r["bits"], axis=1)
    x[:, COLUMNS : COLUMNS + n] = r["rest"]
    x[:, COLUMNS + n : -1] = before[at]
    return x


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_junk and p_toxic (double) added; its own columns of these names are replaced. A null or empty text has no
    features, and the scores that go with none; texts however long are read whole; an empty table gives none."""
    own = [f"p_{c}" for c in CATEGORIES]
    docs = docs.drop(*own)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        chain = shared.value
        for b in (x for whole in batches for x in pieces(whole, at)):
            p = chain.scores(chain.features(as_bytes(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(p[:, j])) for j in range(p.shape[1]))], [*b.schema.names, *own])

    return mapped(docs, run, StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in own)]))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, bound: int = MAX_LABELLED) -> DataFrame:
    """docs with the chain's probabilities and `toxic` (boolean, p_toxic > cut, so a tie is not). docs needs doc_id and text,
    labels doc_id, toxic and quality, of which either may be missing; other columns pass through, and a column called toxic
    is replaced. Repeated rows are scored each."""
    return score(docs.drop("toxic"), fit(docs, labels, bound)).withColumn("toxic", F.col("p_toxic") > cut)
