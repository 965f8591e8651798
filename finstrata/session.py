"""Session helpers: table reading, checkpoints and size-guarded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it has at most this many rows ...
BROADCAST_ROWS = 200_000
#: ... and the plan's own estimate of it is at most this many bytes.
BROADCAST_BYTES = 64 << 20


def local_session(name: str = "finstrata", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FINSTRATA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Tables of fewer estimated bytes are not spread.
SPREAD_BYTES = 1 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with fewer splits than the cluster has cores, dealt out to all of them; others as they are.

    The operators here spend far more on a row than a shuffle of it costs.  Filters and column choices still reach the
    scan.  A large table has more splits than cores, so nothing is shuffled there.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(scan) < SPREAD_BYTES or scan._jdf.rdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``, spread over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder in the shared place of ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own where none is set (tests); on a cluster that is an error, as a folder of
    one machine would lose parts of the tables.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="finstrata-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


#: The cut tables of each open ``cut_tables`` block.
_OPEN: list[list[str]] = []


@contextmanager
def cut_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``cut`` writes inside the block at its end; results must be written or collected by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            p, fs = _path(spark, path)
            fs.delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written once as a table in the shared checkpoint folder and read from there.

    A lost executor then costs no recomputation.  Unlike a checkpoint of rows the table is compressed, and later steps
    read only the columns they need.  It is deleted when its ``cut_tables`` block or the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven small: estimated bytes and counted rows are both within the bounds."""
    return plan_bytes(df) <= size and df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` within the bounds, else ``df`` itself, which Spark then joins by shuffle."""
    return F.broadcast(df) if small(df, rows, size) else df
