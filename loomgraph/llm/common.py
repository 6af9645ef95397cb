"""What the operators of this subpackage share: stored intermediate tables, joins that survive a hot key,
connected components, and reading texts as bytes inside Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast up to this many rows, and bytes of strings and the like; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A key that holds at least this share of the rows is joined apart from the rest, so at most this many keys are hot.
HOT_SHARE = 256


#: Bytes of an Arrow batch, at most, unless a single row is larger; and of the texts that an operator works on at once.
BATCH_BYTES, PIECE_BYTES = 4 << 20, 256 << 10

_OWNER: list = [None, None]


def claim(owner: str, clear: Callable[[], object] = lambda: None) -> None:
    """Called by an operator in a Python worker before it works: what another operator remembers there is let go, so that
    a worker that serves several operators in turn holds the memory of one."""
    if _OWNER[0] not in (None, owner):
        _OWNER[1]()
        release()
    _OWNER[:] = owner, clear


@lru_cache(1)
def _trim() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # a C library without it keeps its heap
        return lambda n: None


def release() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run) in batches of at most BATCH_BYTES (set in the session, where it allows more); a worker gives
    memory back after each task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None) or ""
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def pieces(batch: pa.RecordBatch, at: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts (column `at`) hold about `size` bytes, or one row if that alone is larger."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n + 16)
    low = 0
    while low < len(n):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield batch.slice(low, high - low)
        low = high


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, one is made on a single machine, as in
    tests; on a cluster that is an error, as a folder of one machine would lose the rows of the others."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="loom_shared_")
        spark.conf.set("spark.checkpoint.dir", d)
        atexit.register(shutil.rmtree, d[7:], ignore_errors=True)
    return d.rstrip("/")


def stored(df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    for made in _SCRATCH:
        made.append(out)
    return out


_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that are stored meanwhile; those still in the list at the end are deleted."""
    made: list[DataFrame] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)
        dropped(*made)


def dropped(*dfs: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in dfs:
        path = getattr(df, "_loom_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough, and what its columns of open width hold is too; else as
    it is."""
    if rows > BROADCAST_ROWS:
        return df
    open_ = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    if rows > 10_000 and open_:
        size = df.agg(F.sum(sum(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in open_))).first()[0]
        if (size or 0) > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, how: str = "left") -> DataFrame:
    """left join right, where right has one row a key and in column `rows` how many rows of left have that key.

    `total` is at least the number of rows of left. Keys with over total / HOT_SHARE rows (fewer than HOT_SHARE keys can have so many) join by broadcast, the others by
    shuffle, so no task gets a hot key's rows."""
    bound = max(1000, total // HOT_SHARE)
    hot = right.filter(F.col(rows) > bound)
    cold = right.filter(F.col(rows) <= bound)
    hot_keys = F.broadcast(hot.select(*keys))
    a = left.join(F.broadcast(hot), keys, "inner")
    b = left.join(hot_keys, keys, "left_anti").join(cold, keys, how)
    return a.unionByName(b)


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of edges(u, v), two long columns without nulls: rows (node, component), the component being
    its smallest node. Alternates large-star and small-star (O(log n) rounds); each round is a stored table."""
    e = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    n, check = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        big = join_counted(both, low, ["u"], "c", 2 * n, "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        little = join_counted(big, low, ["u"], "c", 2 * n, "inner").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = little.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = stored(links, "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(e)
        e = new
        if (now[0], now[1]) == (n, check):
            break
        n, check = now
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def as_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return col.to_pylist()


_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_LETTER = np.random.default_rng(0x10F3).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


_POWERS = _powers(256)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and how many words each text has. Words are runs of
    other characters than ASCII white space, with A-Z lowered; a null text has none."""
    raw = b" ".join(t or b"" for t in texts)
    ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.empty(0, np.int64)
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = b != 32
    turn = np.diff(word)
    start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    size = stop - start
    counts = np.diff(np.searchsorted(start, np.append(0, ends)))
    if not len(start):
        return np.empty(0, np.uint64), counts
    letters = b[word[1:-1].view(bool)]
    at = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(at, size)
    longest = int(size.max())
    h = _LETTER[letters]
    h *= (_POWERS if longest <= len(_POWERS) else _powers(longest))[place]
    return mix(np.add.reduceat(h, at) ^ size.astype(np.uint64)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream of batches that is sorted by `keys` (longs); holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([b.column(x).to_numpy(zero_copy_only=False) for x in keys])
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        at = [0, *cuts.tolist(), len(k)]
        for i, j in zip(at, at[1:]):
            now = tuple(k[i])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest index that each row reaches."""
    n = len(linked)
    lab = np.arange(n)
    rows = np.flatnonzero(linked.any(1))
    if not len(rows):
        return lab
    sub = linked[np.ix_(rows, rows)]
    own = np.arange(len(rows))
    while True:
        new = np.minimum(own, np.where(sub, own[None, :], len(rows)).min(1))
        new = new[new]
        if (new == own).all():
            break
        own = new
    lab[rows] = rows[own]
    return lab
