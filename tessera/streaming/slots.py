"""Incremental mode (an extension): slots of arriving files as event-time windows, and idempotent slot upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.tabular import upsert
from tessera.storage import Store


def arriving(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(samples: DataFrame, cadence: str, watermark: str | None = "1 hour") -> DataFrame:
    """Count and sum per group and fixed-cadence slot; with a watermark later rows are dropped and slots are closed."""
    rows = samples.withWatermark("time", watermark) if watermark else samples
    out = rows.groupBy("grp", F.window("time", cadence).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("grp", F.col("w.start").alias("start"), "n", "total")


def first_of_each(samples: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Rejects repeated (group, time) within the watermark."""
    return samples.withWatermark("time", watermark).dropDuplicatesWithinWatermark(["grp", "time"])


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The table that upsert_stream keeps: of each bucket the version of the last micro-batch that touched it."""
    paths = _versions(Store(spark), table, before)
    if not paths:
        return None
    return spark.read.option("basePath", table).parquet(*[f"{table}/epoch={e}/bucket={b}" for b, e in sorted(paths.items())]).drop("epoch")


def _versions(store: Store, table: str, before: int | None = None) -> dict[int, int]:
    """Newest finished epoch of each bucket."""
    found: dict[int, int] = {}
    for epoch in sorted(int(f.split("=")[1]) for f in store.folders(table) if f.startswith("epoch=")):
        if (before is None or epoch < before) and store.exists(f"{table}/epoch={epoch}/_SUCCESS"):
            found |= {int(b.split("=")[1]): epoch for b in store.folders(f"{table}/epoch={epoch}") if b.startswith("bucket=")}
    return found


def upsert_stream(rows: DataFrame, table: str, keys: list[str], checkpoint: str, on_batch: Callable[[int, int], None] | None = None, buckets: int = 64) -> StreamingQuery:
    """Upserts each micro-batch into a Parquet table by key; a repeated batch gives the same table.

    Rows lie in buckets by a hash of their key.  A micro-batch writes new versions of the buckets that it touches, and
    only those; versions that are out of date go once it is done.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        store = Store(spark)
        incoming = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        stored = current(spark, table, epoch)
        if stored is not None:
            touched = incoming.select("bucket").distinct()
            incoming = upsert(stored.join(touched, "bucket", "left_semi").select(*incoming.columns), incoming, keys)
        incoming.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{table}/epoch={epoch}")
        newest = _versions(store, table)
        for old in {e for e in (int(f.split("=")[1]) for f in store.folders(table) if f.startswith("epoch="))}:
            for bucket in store.folders(f"{table}/epoch={old}"):
                if bucket.startswith("bucket=") and newest.get(int(bucket.split("=")[1]), old) > old:
                    store.delete(f"{table}/epoch={old}/{bucket}")
        if on_batch:
            on_batch(epoch, current(spark, table).count())

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
