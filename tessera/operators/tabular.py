"""Deduplication, batches, metric merges and other relational helpers of the ingest path."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deduplicate(rows: DataFrame, keys: Sequence[str], values: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: given aggregates, or for every other column the least value (any value would do; this one is
    the same in every run)."""
    others = values or {c: F.min(c) for c in rows.columns if c not in keys}
    return rows.groupBy(*keys).agg(*[v.alias(n) for n, v in others.items()]) if others else rows.select(*keys).distinct()


def dedup_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, unique and duplicate rows and the duplicates' share; zeros for an empty table."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_rows"))
    duplicates = F.col("total_rows") - F.col("unique_rows")
    return counted.select("total_rows", "unique_rows", duplicates.alias("duplicate_rows"), F.when(F.col("total_rows") > 0, F.round(duplicates / F.col("total_rows"), 6)).otherwise(F.lit(0.0)).alias("duplicate_ratio"))


def check_columns(rows: DataFrame, expected: Sequence[str]) -> bool:
    """Whether the ordered column list is the expected one."""
    return list(rows.columns) == list(expected)


#: Rows per part of a global order at the mean, parts at most, and sampled rows a part from which the cuts are taken.
PART_ROWS, MOST_PARTS, SAMPLED = 500_000, 4096, 20


def _place(value: Column, cuts: list) -> Column:
    """How many of the ascending cuts are at most the value, found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    at_most = lambda among: F.size(F.filter(among, lambda c: c <= value))
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    full = F.greatest(at_most(F.array(*[F.lit(b[0]) for b in blocks])) - 1, F.lit(0))  # the last block that begins at or below it
    return full * step + at_most(F.get(F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks]), full))


def running_total(rows: DataFrame, value: Column, order: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in the order of one unique column (nulls first).

    Two levels, so that no task holds all rows: cuts from a bounded hash sample deal the rows to parts, the parts'
    sums are accumulated on their own, and a window adds up within each part.
    """
    n = rows.count()
    parts = max(1, min(MOST_PARTS, n // PART_ROWS + 1))
    keep = max(1, n // (parts * SAMPLED))
    sample = [] if parts == 1 else sorted(r[0] for r in rows.where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order), F.lit(keep)) == 0)).select(order).collect())
    cuts = [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []
    part = _place(F.col(order), cuts)
    dealt = rows.withColumn("_part", F.coalesce(part, F.lit(0))).withColumn("_value", value)
    sums = dealt.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # at most MOST_PARTS rows
    within = Window.partitionBy("_part").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum("_value").over(within), F.lit(0))
    return dealt.join(F.broadcast(before), "_part").withColumn(out, total).drop("_part", "_value", "_before")


def batches(items: DataFrame, size: int, order: str, prefix: str = "") -> DataFrame:
    """Numbers items in order into batches of at most ``size``; ids are {prefix}batch_0000 and so on."""
    numbered = running_total(items, F.lit(1).cast("long"), order, "_n")
    text = F.floor(F.col("_n") / size).cast("string")
    return numbered.withColumn("batch_id", F.concat(F.lit(f"{prefix}batch_"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))).drop("_n")


def batch_summary(batched: DataFrame, uri: str, size: str) -> DataFrame:
    """Per batch: items, bytes, the digest of its sorted uris and a preview of the first 100."""
    sorted_uris = F.array_sort(F.collect_list(uri))
    return batched.groupBy("batch_id").agg(F.count("*").alias("items"), F.sum(size).alias("bytes"), F.sha2(F.array_join(sorted_uris, "\n").cast("binary"), 256).alias("sha256"), F.slice(sorted_uris, 1, 100).alias("preview"))


def merge_metrics(metrics: DataFrame) -> DataFrame:
    """Run metrics from batch metrics (batch, ok, key, kind, number, items, text), successful batches only.

    Numbers and booleans are summed, lists concatenated in batch order, other values are the first batch's.
    """
    good = metrics.where("ok")
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == "list", F.struct("batch", "items"))))
    return good.groupBy("key").agg(
        F.sum(F.when(F.col("kind") == "number", F.col("number"))).alias("number"), F.flatten(F.transform(ordered, lambda x: x["items"])).alias("items"), F.min_by("text", "batch").alias("text")
    )


def normalise_metrics(metrics: DataFrame, reserved: Sequence[str]) -> DataFrame:
    """Without null and reserved keys."""
    return metrics.where(F.col("key").isNotNull() & ~F.col("key").isin(*reserved))


def run_summary(batch_rows: DataFrame, workers: int) -> DataFrame:
    """Batches in all and failed, files, bytes, rows, seconds, and CPU use over the workers' time."""
    out = batch_rows.agg(F.count("*").alias("batches_total"), F.sum((~F.col("ok")).cast("long")).alias("batches_failed"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.sum("cpu_s").alias("cpu_s"), F.max("end_s").alias("e"), F.min("start_s").alias("s"))
    processing = F.col("e") - F.col("s")
    return out.select("batches_total", "batches_failed", "files", "bytes", "rows", processing.alias("processing_s"), F.when(processing > 0, F.round(F.col("cpu_s") / (processing * workers), 6)).otherwise(F.lit(0.0)).alias("cpu_utilisation"), F.lit(workers).alias("workers"))


def first_present(*columns: str) -> Column:
    """The first value that is there, in order of precedence."""
    return F.coalesce(*[F.col(c) for c in columns])


def build_coverage(slots: DataFrame, aligned: str = "aligned") -> DataFrame:
    """Per group: arrays, inclusive slot ranges, whether all parts were aligned, and lexicographic time bounds.

    slots: grp, array, slot, time_text, aligned.
    """
    from tessera.operators.intervals import islands

    runs = islands(slots).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    facts = slots.groupBy("grp").agg(F.array_sort(F.collect_set("array")).alias("arrays"), F.bool_and(aligned).alias("aligned"), F.min("time_text").alias("time_min"), F.max("time_text").alias("time_max"))
    return facts.join(runs, "grp")


def explode_regions(intents: DataFrame) -> DataFrame:
    """Write intents (grp, array, slot, y0, payload array of rows of values) as cells (grp, array, slot, y, x, value)."""
    rows = intents.select("grp", "array", "slot", "y0", F.posexplode("payload").alias("dy", "line"))
    return rows.select("grp", "array", "slot", (F.col("y0") + F.col("dy")).alias("y"), F.posexplode("line").alias("x", "value"))


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows with the incoming ones in place of those with the same keys."""
    return current.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def resolve_slots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Slot of each incoming time of a group: the existing slot of an equal time, else the next free ones in time order.

    New times are counted in parts of a group (days of a timestamp, as many units of a number), and the parts before are
    added up, so no task holds all new times of a group.
    """
    length = existing.groupBy("grp").agg((F.max("slot") + 1).alias("length"))
    asked = incoming.select("grp", "time").where("time is not null").distinct()
    known = asked.join(existing.select("grp", "time", "slot"), ["grp", "time"])
    new = asked.join(existing, ["grp", "time"], "left_anti").withColumn("_part", F.floor(F.col("time").cast("double") / 86400))
    sizes = new.groupBy("grp", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = new.withColumn("_nth", F.row_number().over(Window.partitionBy("grp", "_part").orderBy("time")) - 1)
    placed = new.join(sizes.select("grp", "_part", before.alias("_before")), ["grp", "_part"]).join(length, "grp", "left")
    return known.unionByName(placed.select("grp", "time", (F.coalesce("length", F.lit(0)) + F.col("_before") + F.col("_nth")).cast("long").alias("slot")))
