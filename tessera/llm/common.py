"""Shared plumbing of the training-data operators: table access, cut points in the shared folder, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table of a data directory (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master (one machine, as in tests) uses a folder below the warehouse; any other
    master is refused, as a default folder there would be each machine's own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def materialize(df: DataFrame, label: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    The table survives lost executors, unlike a local checkpoint.  It is removed by ``discard``, or when the driver's
    JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    files, jvm_path = _file_system(spark, path)
    files.deleteOnExit(jvm_path)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing unread depends on any more."""
    for df in tables:
        files, jvm_path = _file_system(df.sparkSession, df._written_to)
        files.delete(jvm_path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose Python workers find this package where the driver has it.

    That is enough where driver and executors see the same installation; a cluster ships it with --py-files as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    settings = df.sparkSession.sparkContext.environment
    held = settings.get("PYTHONPATH", "").split(os.pathsep)
    if root not in held:
        settings["PYTHONPATH"] = os.pathsep.join([root, *filter(None, held)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        free_memory()

    return df.mapInArrow(run, schema)


def free_memory() -> None:
    """Gives what a finished task has freed back to the system, as workers live on beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def slices_by_bytes(lengths: "np.ndarray", limit: int) -> Iterator[tuple[int, int]]:  # noqa: F821
    """Row ranges of at most ``limit`` bytes each; a longer single row forms a range of its own."""
    first, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


def unique_docs(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns: extra columns, whatever their names, never clash with what an operator adds."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])
