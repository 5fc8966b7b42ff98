"""Chunk-grid reports and scrubbing over a listing of chunk files."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import chunk_indices


def with_indices(files: DataFrame) -> DataFrame:
    """Files that are chunks, with their indices."""
    return files.withColumn("indices", chunk_indices(F.col("path"))).where(F.size("indices") > 0)


def expected_counts(shape: Sequence[int], chunks: Sequence[int]) -> list[int]:
    if len(shape) != len(chunks) or any(c <= 0 for c in chunks):
        raise ValueError(f"shape {shape} and chunks {chunks} don't fit")
    return [math.ceil(s / c) for s, c in zip(shape, chunks, strict=True)]


def extra_chunks(files: DataFrame, shape: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """Chunks of another rank or outside of the grid."""
    counts = expected_counts(shape, chunks)
    outside = F.size("indices") != len(counts)
    for k, n in enumerate(counts):
        outside = outside | F.coalesce(F.get("indices", F.lit(k)) >= n, F.lit(False))
    return with_indices(files).where(outside)


def dimension_report(files: DataFrame, dims: Sequence[str], shape: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """Per dimension: expected chunks, largest index (-1 for none), missing indices.  Missing is marginal: an index is
    missing where no chunk at all has it."""
    spark, counts = files.sparkSession, expected_counts(shape, chunks)
    grid = spark.createDataFrame(list(zip(range(len(dims)), dims, counts, strict=True)), "pos int, dim string, expected long")
    found = with_indices(files).where(F.size("indices") == len(dims)).select(F.posexplode("indices").alias("pos", "i")).distinct()
    seen = found.groupBy("pos").agg(F.max("i").alias("max_index"))
    wanted = grid.where("expected > 0").select("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("expected") - 1)).alias("i"))
    missing = wanted.join(found, ["pos", "i"], "left_anti").groupBy("pos").agg(F.array_sort(F.collect_list("i")).alias("missing"))
    return grid.join(seen, "pos", "left").join(missing, "pos", "left").select("dim", "expected", F.coalesce("max_index", F.lit(-1)).alias("max_index"), F.coalesce("missing", F.array().cast("array<bigint>")).alias("missing"))


def missing_chunks(files: DataFrame, shape: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """Cells of the full grid without a chunk (a stricter check than the marginal one).

    Cells are numbered and their indices follow from the number, so the grid is made in as many tasks as it needs.
    """
    counts = expected_counts(shape, chunks)
    steps = [math.prod(counts[k + 1 :]) for k in range(len(counts))]
    cell = [F.expr(f"id div {max(1, n)}") % c if c else F.lit(0) for n, c in zip(steps, counts, strict=True)]
    wanted = files.sparkSession.range(math.prod(counts)).select(F.array(*cell).cast("array<bigint>").alias("indices"))
    return wanted.join(with_indices(files), "indices", "left_anti")


def budgeted(files: DataFrame, max_chunks: int | None = None) -> tuple[DataFrame, bool]:
    """At most max_chunks chunks, and whether there are more."""
    found = with_indices(files)
    if max_chunks is None:
        return found, False
    return found.limit(max_chunks), found.limit(max_chunks + 1).count() > max_chunks


def scrub_plan(files: DataFrame, records: DataFrame, shape: Sequence[int], chunks: Sequence[int], include_orphans: bool = False) -> DataFrame:
    """Extra chunks that a record names (``recorded``), and with include_orphans those that none does (``orphan``)."""
    extras = extra_chunks(files, shape, chunks).select("path")
    keys = records.select(F.col("key").alias("path")).distinct()
    plan = extras.join(keys, "path", "left_semi").withColumn("kind", F.lit("recorded"))
    return plan.unionByName(extras.join(keys, "path", "left_anti").withColumn("kind", F.lit("orphan"))) if include_orphans else plan


def contract_drift(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Fields (grp, array, field, value) that differ between a declared and a stored layout; a longer stored time axis
    is no drift."""
    both = declared.withColumnRenamed("value", "declared").join(stored.withColumnRenamed("value", "stored"), ["grp", "array", "field"], "full_outer")
    longer = (F.col("field") == "time_length") & (F.try_to_number("stored", F.lit("999999999999")) >= F.try_to_number("declared", F.lit("999999999999")))
    return both.where(~F.col("declared").eqNullSafe(F.col("stored")) & ~F.coalesce(longer, F.lit(False)))


def time_dim_conflicts(arrays: DataFrame, declared: str) -> DataFrame:
    """Arrays (grp, array, dims) whose time dimension isn't the declared one, or that have two."""
    names = F.filter("dims", lambda d: d.isin("time", "timestamp"))
    return arrays.withColumn("time_dims", names).where((F.size("time_dims") > 1) | ((F.size("time_dims") == 1) & (F.get("time_dims", F.lit(0)) != declared)))
