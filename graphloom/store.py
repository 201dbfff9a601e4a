"""Intermediate tables of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Without either, a temporary folder of this machine
    where all tasks run on it; on a cluster that would be another folder on each machine, so it is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


@contextmanager
def stored_result(spark: SparkSession):
    """For a query whose result is stored: it leaves no shuffle files behind, and Python workers get its rows in
    batches of some megabytes, however long the rows are."""
    now = {_CLEANUP: "true", _BATCH: "8m"}
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _file(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, written in one step."""
    fs, p = _file(spark, path)
    fs.create(p, True).close()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with wildcards."""
    fs, p = _file(spark, pattern)
    return [str(f.getPath()) for f in fs.globStatus(p) or []]


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """df as a written table: its lineage is cut, and it survives lost executors. Without a place of its own, it is
    deleted when the driver's JVM ends, as results that are handed out read it until then."""
    spark = df.sparkSession
    path = at or f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    with stored_result(spark):
        df.write.mode("overwrite").parquet(path)
    if at is None:
        fs, p = _file(spark, path)
        fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(stored: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of a few numbers a row, to be sent to all executors if it has at most so many rows; beyond
    that it is joined by a shuffle."""
    return F.broadcast(stored) if stored.limit(rows + 1).count() <= rows else stored


def stored_with(df: DataFrame, **figures) -> tuple[DataFrame, dict]:
    """stored(), and aggregates of its rows, taken while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in figures.items()]))
    return out, seen.get
