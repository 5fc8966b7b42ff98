"""Cube tables: append with overlap rejection, keyed region writes, static tables, archives and Parquet consolidation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import model
from tessera.functions.scalars import identity_hash
from tessera.operators.tabular import upsert
from tessera.plans.resume import refuse_overlap
from tessera.storage import Store


#: Slots made from one row.
SLOT_RUN = 1 << 16


class SchemaDriftError(ValueError):
    """Stored and declared layouts differ."""


def exists(spark: SparkSession, path: str) -> bool:
    return Store(spark).exists(path)


def schema_hash(df: DataFrame) -> str:
    """Sixteen hex digits of a layout; for audit only."""
    return identity_hash([(f.name, f.dataType.simpleString()) for f in df.schema.fields])[:16]


def append(df: DataFrame, path: str, chunk: int, resume: bool = True, slot: str = "slot") -> None:
    """Appends slots (grp, time, slot, ...) to a cube partitioned by group and chunk of slots.

    Columns are frozen by the first write.  With resume, times that are stored already are refused.
    """
    spark = df.sparkSession
    if exists(spark, path):
        stored = spark.read.parquet(path)
        if sorted(stored.columns) != sorted([*df.columns, "chunk"]):
            raise SchemaDriftError(f"columns {sorted(df.columns)} are not {sorted(stored.columns)}")
        if resume:
            refuse_overlap(stored.select("grp", "time"), df)
    df.withColumn("chunk", F.floor(F.col(slot) / chunk)).repartition("grp", "chunk").write.mode("append").partitionBy("grp", "chunk").parquet(path)


def replace_partitions(rows: DataFrame, path: str) -> None:
    """Puts rows (grp, chunk, ...) in the place of the partitions they belong to; they may be read from the same table."""
    spark, staged = rows.sparkSession, f"{path}._staged"
    rows.repartition("grp", "chunk").write.mode("overwrite").partitionBy("grp", "chunk").parquet(staged)
    spark.read.schema(rows.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grp", "chunk").parquet(path)
    Store(spark).delete(staged)


def write_regions(df: DataFrame, path: str, keys: Sequence[str], chunk: int, slot: str = "slot") -> None:
    """Overwrites cells by key (grp, slot, ...): only the partitions that hold incoming cells are rewritten."""
    spark = df.sparkSession
    incoming = df.withColumn("chunk", F.floor(F.col(slot) / chunk))
    if exists(spark, path):
        touched = incoming.select("grp", "chunk").distinct()
        stored = spark.read.parquet(path).join(touched, ["grp", "chunk"], "left_semi").select(*incoming.columns)
        incoming = upsert(stored, incoming, list(keys))
    replace_partitions(incoming, path)


def delete_slots(spark: SparkSession, path: str, doomed: DataFrame, chunk: int) -> int:
    """Removes slots (grp, slot) from a cube; returns how many partitions are gone as a whole.

    Partitions that keep other slots are rewritten, empty ones are deleted.
    """
    doomed = doomed.select("grp", "slot").distinct()
    touched = doomed.select("grp", F.floor(F.col("slot") / chunk).alias("chunk")).distinct()
    stored = spark.read.parquet(path)
    touched = touched.join(stored.select("grp", "chunk").distinct(), ["grp", "chunk"], "left_semi")
    kept = stored.join(touched, ["grp", "chunk"], "left_semi").join(doomed, ["grp", "slot"], "left_anti").select(*stored.columns)
    gone = [(r["grp"], r["chunk"]) for r in touched.join(kept.select("grp", "chunk").distinct(), ["grp", "chunk"], "left_anti").toLocalIterator()]
    if not kept.isEmpty():
        replace_partitions(kept, path)
    for grp, part in gone:
        Store(spark).delete(f"{path}/grp={quote(grp, safe=' ')}/chunk={part}")
    return len(gone)


def write_static(df: DataFrame, path: str) -> bool:
    """Write-once table: the first write stores it, a later equal one is skipped, a different one is refused."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
        return True
    stored = spark.read.parquet(path)
    if sorted(stored.columns) != sorted(df.columns) or not df.select(*stored.columns).exceptAll(stored).isEmpty() or not stored.exceptAll(df.select(*stored.columns)).isEmpty():
        raise SchemaDriftError(f"{path} is stored with other values")
    return False


def preallocate(spark: SparkSession, axes: DataFrame) -> DataFrame:
    """Every slot of every group's full extent, state unknown."""
    runs = axes.where("size > 0").select("grp", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SLOT_RUN).cast("long"))).alias("first"))
    runs = runs.repartition("grp", "first")  # a long axis is made by many tasks, a run at a time
    return runs.select("grp", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + SLOT_RUN, F.col("size")) - 1)).alias("slot"), F.lit(0).cast("tinyint").alias("state"))


def write_parts(df: DataFrame, path: str) -> None:
    """Tabular output: part files in a directory per group."""
    df.write.mode("append").partitionBy("grp").parquet(path)


def consolidate(spark: SparkSession, root: str, output: str, codec: str = "zstd", target_bytes: int = 1 << 30) -> int:
    """Part files of one level (subdirectories stay out) as few files of about target_bytes; returns their number."""
    rows = spark.read.option("recursiveFileLookup", "false").option("pathGlobFilter", "*.parquet").parquet(root)
    size = sum(n for _, n in Store(spark).files(root, recursive=False))
    n = max(1, -(-size // target_bytes))
    rows.coalesce(n).write.mode("overwrite").option("compression", codec).parquet(output)
    return n


def save_snapshot(current: DataFrame, path: str, completed_before: float) -> None:
    """Projected state with its cut-off; the finished table takes the old one's place."""
    current.withColumn("completed_before", F.lit(completed_before)).write.mode("overwrite").parquet(f"{path}._new")
    Store(current.sparkSession).replace(f"{path}._new", path)


def create_archive(cube: DataFrame, path: str, *, groups: Sequence[str] = (), variables: Sequence[str] = (), start: str | None = None, end: str | None = None, codec: str = "zstd", allow_nan: bool = True, control: dict[str, DataFrame] | None = None) -> dict:
    """Cube rows of some groups, variables and times as one directory of Parquet with a manifest; returns the manifest.

    start and end are inclusive.  The control tables (spans, runs) travel along as JSON lines.
    """
    rows = cube
    if groups:
        rows = rows.where(F.col("grp").isin(*groups))
    if start:
        rows = rows.where(F.col("time") >= F.to_timestamp(F.lit(start)))
    if end:
        rows = rows.where(F.col("time") <= F.to_timestamp(F.lit(end)))
    if variables:
        rows = rows.select(*[c for c in rows.columns if c in ("grp", "slot", "time", "y", "x", "iy", "ix")], *variables)
    numbers = [c for c, t in rows.dtypes if t in ("double", "float")]
    if not allow_nan and numbers:
        test = F.lit(False)
        for c in numbers:
            test = test | F.isnan(c)
        if not rows.where(test).isEmpty():
            raise ValueError("the cube holds NaN")
    rows.write.mode("overwrite").option("compression", codec).partitionBy("grp").parquet(f"{path}/data")
    for name, frame in (control or {}).items():
        frame.write.mode("overwrite").json(f"{path}/control/{name}")
    facts = archive_facts(rows.sparkSession, path)
    rows.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return facts


def archive_facts(spark: SparkSession, path: str) -> dict:
    """Rows, groups, columns, first and last time, and an order-free digest of what an archive holds."""
    data = spark.read.parquet(f"{path}/data")
    columns = sorted(data.columns)
    row = data.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("grp")).alias("groups"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.min("time").cast("string").alias("first"), F.max("time").cast("string").alias("last")).head()
    return {"rows": row["n"], "groups": row["groups"], "columns": columns, "first": row["first"], "last": row["last"], "digest": hashlib.sha256(row["sum"].encode()).hexdigest()}


def archive_info(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))


def validate_archive(spark: SparkSession, path: str, quick: bool = False) -> bool:
    """quick: the manifest can be read; otherwise the data give the manifest's digest."""
    stated = archive_info(spark, path)
    return "digest" in stated if quick else stated == archive_facts(spark, path)


def restore_archive(spark: SparkSession, path: str, target: str, chunk: int, overwrite: bool = False) -> int:
    """Writes an archive's rows as a cube; an existing one is only replaced on demand.  Returns the rows."""
    if exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    data = spark.read.parquet(f"{path}/data")
    data.withColumn("chunk", F.floor(F.col("slot") / chunk)).write.mode("overwrite").partitionBy("grp", "chunk").parquet(target)
    return data.count()


def serialise_control(spans: DataFrame, runs: DataFrame, group: str | None = None) -> dict[str, DataFrame]:
    """Spans (of one group) and the runs they refer to; all runs where there are no spans."""
    kept = spans.where(F.col("grp") == group) if group else spans
    return {"spans": kept, "runs": runs if kept.isEmpty() else runs.join(kept, "run_id", "left_semi")}


def restore_control(spark: SparkSession, archive: str) -> tuple[DataFrame, DataFrame]:
    """Events and runs that give an archive's spans and runs again: an upsert of each span, by run and key.

    Spans of a run that the archive doesn't hold come with a complete run of that name.
    """
    spans = spark.read.schema(model.SPANS).json(f"{archive}/control/spans")
    runs = spark.read.schema(model.RUNS).json(f"{archive}/control/runs")
    order = F.row_number().over(Window.partitionBy("product", "run_id").orderBy("key")) - 1
    record = F.to_json(F.struct(*[F.col(c) for c in spans.columns if c not in ("product", "meta")], F.lit(model.SCHEMA_VERSION).alias("schema_version")))
    events = spans.select("product", "run_id", F.lit(0).alias("part"), order.cast("int").alias("idx"), F.sha2(F.concat_ws(":", "run_id", "key"), 256).alias("event_id"), F.lit("span_restored").alias("event_type"), "timestamp", record.alias("record"), "meta")
    known = runs.select("product", "run_id")
    lost = spans.join(known, ["product", "run_id"], "left_anti").groupBy("product", "run_id").agg(F.max("timestamp").alias("completed_at")).withColumns({"status": F.lit("complete"), "updated_at": F.col("completed_at")})
    return events, runs.unionByName(lost, allowMissingColumns=True)


def catalogue_entries(name: str, description: str, uri: str, groups: Sequence[str], driver: str = "parquet", options: dict | None = None, about: Callable[[str], dict | None] | None = None) -> dict:
    """A data catalogue: one source per group; secrets stay ${ENV} placeholders.

    about gives what to add to a group's source; a group for which it gives None is hidden.
    """
    notes = {g: about(g) if about else {} for g in groups}
    groups = [g for g in groups if notes[g] is not None]
    source = lambda g: {"driver": driver, "description": f"{description} ({g})", "args": {"urlpath": f"{uri.rstrip('/')}/{g}"} | ({"storage_options": options} if options else {})}
    return {"metadata": {"name": name, "description": description, "version": 1}, "sources": {g.replace("/", "_"): source(g) | notes[g] for g in sorted(groups)}}
