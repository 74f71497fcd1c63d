"""What the operators of this folder share: shared storage, text columns, reading tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where it is unset (tests, one machine) a new one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="sonolith-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sonolith/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    files: at most so many, for tables known to be small; their tasks' partitions are put together.
    """
    path = fresh_path(df.sparkSession, name)
    df = df if files is None else df.coalesce(files)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts: a batch is held by the JVM and by its worker, several times over while it grows.
BATCH_ROWS = 1000


def small_batches(df: DataFrame, size: int | None = None) -> DataFrame:
    """The same table; its session hands workers batches of BATCH_ROWS rows at most from now on.

    size: and, unless the session says otherwise, that end with the row that reaches so many bytes.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    if size is not None and conf.get(by_size := "spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set(by_size, str(size))
    return df


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work of a task; what it has freed goes back to the system at its end, as its worker stays for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return run


#: Rows that the Parquet reader decodes at once: a column of texts is one array, which grows by doubling and so makes the heap grow.
READ_ROWS = 256


@contextmanager
def settings(spark: SparkSession, most: dict[str, int]) -> Iterator[None]:
    """Jobs in here run with these settings, or lower ones that the session has; afterwards the session is as before."""
    before = {name: spark.conf.get(name, None) for name in most}
    for name, value in most.items():
        had = int(spark.conf.get(name))
        spark.conf.set(name, str(value if had <= 0 else min(value, had)))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """Parquet that is read in here is decoded READ_ROWS rows at a time at most."""
    with settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}):
        yield


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
