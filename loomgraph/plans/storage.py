"""Tables written between the rounds of an iterative plan, so that lineage stays short and survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many counted rows.
BROADCAST_ROWS = 500_000


def shared_dir(spark) -> str:
    """The folder that all executors share. Where spark.checkpoint.dir is unset, one is made on a single machine, as in
    tests; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="loom_shared_")
        spark.conf.set("spark.checkpoint.dir", d)
        atexit.register(shutil.rmtree, d[7:], ignore_errors=True)
    return d.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def dropped(*dfs: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in dfs:
        path = getattr(df, "_loom_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def measured_broadcasts(spark) -> None:
    """From now on the session's joins broadcast a side without a hint by its measured bytes alone. The planner's guess is
    the size of the compressed file, and some megabytes of repeated values can be gigabytes of rows on the driver."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its counted rows are few, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
