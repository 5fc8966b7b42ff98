"""Deletes what spans have stored, and records it."""

from __future__ import annotations

import time
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.claims import Claims
from tessera.operators import state_log
from tessera.sinks import cube

if TYPE_CHECKING:
    from tessera.ingest import Product


def span_slots(spans: DataFrame) -> DataFrame:
    """Slots (grp, slot) of the spans' inclusive ranges."""
    ranges = spans.select("grp", F.explode("ranges").alias("r")).where("r.end >= r.start")
    return ranges.select("grp", F.explode(F.sequence("r.start", "r.end")).alias("slot")).distinct()


def execute(spark: SparkSession, product: Product, records: DataFrame, run_id: str, chunk: int, storage: bool = True, log: bool = True, dry_run: bool = True) -> dict:
    """Deletes the records' slots from the cube and marks the records as replaced, under a maintenance lease.

    Slots that another active span holds too stay.  Storage comes first; its failure is reported and the records are
    marked all the same, so that nothing counts as stored that may be gone.  A dry run only counts.
    """
    plan = state_log.deletion_plan(records).head().asDict()
    if dry_run or not plan["n"]:
        return plan | {"dry_run": dry_run, "deleted": 0, "storage_errors": []}
    started, errors, gone = time.time(), [], 0
    with Claims(spark, f"{product.root}/_control/claims").held(product.name, "maintenance", "delete", run_id):
        product.put_run(spark, run_id, "running", started)
        try:
            marked = state_log.replaced_events(records, records.select("key"), run_id, started)
            staged = f"{product.root}/_control/staging/{run_id}"
            marked.write.mode("overwrite").parquet(staged)
            if storage and cube.exists(spark, product.data):
                others = product.state(spark).where("type = 'span' and status = 'active'").join(records.select("product", "key"), ["product", "key"], "left_anti")
                doomed = span_slots(records).join(span_slots(others), ["grp", "slot"], "left_anti")
                try:
                    gone = cube.delete_slots(spark, product.data, doomed, chunk)
                except Exception as problem:  # noqa: BLE001
                    errors.append(str(problem)[:500])
            if log:
                spark.read.schema(marked.schema).parquet(staged).write.mode("append").parquet(f"{product.root}/_control/events")
            product.store(spark).delete(staged)
            product.put_run(spark, run_id, "complete", started)
        except Exception as problem:
            product.put_run(spark, run_id, "failed", started, error=str(problem)[:500])
            raise
    return plan | {"dry_run": False, "deleted": plan["n"], "partitions_gone": gone, "storage_errors": errors}
