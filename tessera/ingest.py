"""One ingest run: discover, filter to a slot range, build, check, write, and record it all in the event log."""

from __future__ import annotations

import json
import socket
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model, plugins
from tessera.claims import Claims
from tessera.deletion import span_slots
from tessera.functions import timeslots
from tessera.metrics import emit
from tessera.operators import state_log, tabular
from tessera.operators.intervals import islands
from tessera.plans import resume
from tessera.sinks import cube
from tessera.sources import chunked
from tessera.storage import Store


@dataclass
class Product:
    """A dataset with its event log: <root>/data, <root>/_control/events and <root>/_control/runs."""

    name: str
    root: str

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    def events(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "events", model.EVENTS)

    def runs(self, spark: SparkSession) -> DataFrame:
        """The last state of each run."""
        rows = self._table(spark, "runs", model.RUNS)
        return state_log.latest_per_key(rows, ["product", "run_id"], ["updated_at"]).select(*rows.columns)

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/_control/{name}"
        return spark.read.schema(schema).parquet(path) if cube.exists(spark, path) else spark.createDataFrame([], schema)

    def append_events(self, spark: SparkSession, run_id: str, records: list[tuple[str, dict, dict]], part: int = 0) -> None:
        now = time.time()
        rows = [(self.name, run_id, part, i, uuid.uuid4().hex, kind, now, json.dumps({"schema_version": model.SCHEMA_VERSION, "timestamp": now, "run_id": run_id} | record), json.dumps(meta, sort_keys=True)) for i, (kind, record, meta) in enumerate(records)]
        if rows:
            spark.createDataFrame(rows, model.EVENTS).coalesce(1).write.mode("append").parquet(f"{self.root}/_control/events")

    def put_run(self, spark: SparkSession, run_id: str, status: str, started: float, **more) -> None:
        now = time.time()
        row = {"product": self.name, "run_id": run_id, "status": status, "started_at": started, "updated_at": now, "completed_at": now if status in model.TERMINAL else None, "events": None, "parts": None, "error": None, "run_stale_threshold_s": 3600, "slot_range": None, "slot_group": None} | more
        spark.createDataFrame([tuple(row.values())], model.RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/_control/runs")

    def store(self, spark: SparkSession) -> Store:
        return Store(spark)

    def snapshot(self, spark: SparkSession) -> tuple[DataFrame, float] | tuple[None, None]:
        """The stored projection and its cut-off, if there is one."""
        path = f"{self.root}/_control/snapshot"
        if not cube.exists(spark, path):
            return None, None
        rows = spark.read.parquet(path)
        cut = rows.agg(F.max("completed_before")).head()[0]
        return (rows, cut) if cut is not None else (None, None)

    def save_snapshot(self, spark: SparkSession) -> float:
        """Stores the projection of all runs that are complete now."""
        cut = self.runs(spark).where("status = 'complete'").agg(F.max("completed_at")).head()[0] or 0.0
        cube.save_snapshot(self.state(spark), f"{self.root}/_control/snapshot", cut)
        return cut

    def state(self, spark: SparkSession) -> DataFrame:
        """Current records: the snapshot, if there is one, and the runs completed since."""
        return state_log.project(self.events(spark), self.runs(spark), *self.snapshot(spark))

    def restore_control(self, spark: SparkSession, archive: str) -> None:
        """Appends an archive's spans and runs to the log."""
        events, runs = cube.restore_control(spark, archive)
        for name, rows in (("events", events), ("runs", runs)):
            rows.write.mode("append").parquet(f"{self.root}/_control/{name}")

    def abandon(self, spark: SparkSession, run_id: str, reason: str) -> bool:
        """Ends an open run without touching data; False where it is over already."""
        found = self.runs(spark).where(F.col("run_id") == run_id).head()
        if found is None:
            raise KeyError(run_id)
        if found["status"] in model.TERMINAL:
            return False
        self.put_run(spark, run_id, "abandoned", found["started_at"], error=reason)
        return True

    def abandon_stale(self, spark: SparkSession, reason: str, now: float, dry_run: bool = True) -> list[str]:
        found = [r["run_id"] for r in state_log.stale_runs(self.runs(spark), now).select("run_id").toLocalIterator()]  # open runs
        return found if dry_run else [r for r in found if self.abandon(spark, r, reason)]


def new_run_id(plugin: str) -> str:
    return f"{plugin}-{socket.gethostname()}-{uuid.uuid4().hex[:12]}"


def _batches(items: DataFrame, size: int) -> DataFrame:
    """Items in batches in the order of their first column; one batch where no size is given."""
    return tabular.batches(items, size, items.columns[0]) if size else items.withColumn("batch_id", F.lit("batch_0000"))


def _slotted(rows: DataFrame, axes: DataFrame | None, group: str | None) -> DataFrame:
    """Built rows with their slots; those without one, or of another group than the wanted one, are left out."""
    rows = (timeslots.assign_slots(rows, axes) if axes is not None else rows).where("slot is not null")
    return rows.where(F.col("grp") == group) if group is not None else rows


class _Builder:
    """Builds batches into a staging table, several by one job, as a job for each mostly waits for planning and commit.

    The plugin's build is called for each batch, with the items of that batch only, and the plans that have the same
    columns are written by one job; a build that treats each item by itself (``per_item``) is called once for all.  Where
    such a job fails, each of its batches is written on its own, so that only those that fail themselves are lost.
    """

    def __init__(self, spark: SparkSession, plugin, hooks: plugins.Hooks, store: Store, batched: DataFrame, target: str, group: str | None, keep_going: bool):
        self.plugin, self.hooks, self.store, self.batched, self.target, self.group, self.keep_going = plugin, hooks, store, batched, target, group, keep_going
        self.axes = timeslots.index_axes(spark, hooks.axes) if hooks.axes and not hooks.write_intents else None

    def _plan(self, batches: list[str]) -> DataFrame:
        """What the items of batches are built into: the plugin's rows, or its write intents as cells."""
        mine = self.batched.where(F.col("batch_id").isin(batches)).drop("batch_id", "item_bytes")
        return tabular.explode_regions(self.hooks.write_intents(mine)) if self.hooks.write_intents else self.plugin.build(mine)

    def _add(self, batch: str, alike: dict[tuple | None, dict[str, DataFrame | None]]) -> None:
        """Prepares a batch and adds it to those that one job can write with it."""
        if self.hooks.prepare_batch:
            self.hooks.prepare_batch(batch)
        plan = None if self.hooks.per_item else self._plan([batch])
        alike.setdefault(None if plan is None else tuple(plan.dtypes), {})[batch] = plan

    def _write(self, plans: dict[str, DataFrame | None]) -> None:
        """Writes batches by one job; nothing is left of a job that fails."""
        path = f"{self.target}/batch={next(iter(plans))}"
        try:
            parts = [self._plan(list(plans))] if self.hooks.per_item else list(plans.values())
            while len(parts) > 1:  # in pairs, as a chain would be as deep as there are plans
                parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
            _slotted(parts[0], self.axes, self.group).write.parquet(path)
        except Exception:
            self.store.delete(path)
            raise

    def _error(self, step: Callable, *args) -> str | None:
        """The text of a step's failure, with keep_going; else it is raised."""
        try:
            step(*args)
            return None
        except Exception as problem:
            if not self.keep_going:
                raise
            return str(problem)[:500]

    def build(self, batches: list[str]) -> list[tuple[str, str | None, float, float]]:
        """Of each batch its name, its error if it failed, and when its job's work began and ended."""
        begun, errors, alike = time.time(), {}, {}
        with ExitStack() as cleanup:
            for batch in batches:
                if self.hooks.cleanup_batch:
                    cleanup.callback(self.hooks.cleanup_batch, batch)
                errors[batch] = self._error(self._add, batch, alike)
            for together in alike.values():
                try:
                    self._write(together)
                except Exception:
                    errors |= {batch: self._error(self._write, {batch: plan}) for batch, plan in together.items()}
        ended = time.time()
        return [(batch, errors[batch], begun, ended) for batch in batches]


def _write(spark: SparkSession, product: Product, hooks: plugins.Hooks, staged: DataFrame, chunk: int, force: bool, output: str, recorded: DataFrame) -> None:
    """Brings staged rows to the product: as a cube, as part files, as an archive, or as arrays."""
    if hooks.write_intents:
        for grp in [r["grp"] for r in staged.select("grp").distinct().collect()]:  # a row for each group
            for name, spec in hooks.array_schema.items():
                cells = staged.where((F.col("grp") == grp) & (F.col("array") == name)).select(F.col("slot").alias(spec.dims[0]), *[F.col(c).alias(d) for c, d in zip(("y", "x"), spec.dims[1:], strict=False)], "value")
                chunked.write_array(cells, f"{product.root}/arrays/{grp}/{name}", spec.dims, spec.shape, spec.chunks, dtype=spec.dtype, attrs=spec.attrs, update=True)
    elif output == "archive":
        cube.create_archive(staged, f"{product.root}/archive")
    elif output == "parquet":
        cube.write_parts(staged, product.data)
    else:
        keys, leftover = [c for c in ("grp", "slot", "y", "x") if c in staged.columns], False
        if cube.exists(spark, product.data) and not force:
            # Stored slots that no span records are left from a run that broke off; they are written again.
            stored = spark.read.parquet(product.data).select("grp", "time", "slot")
            resume.refuse_overlap(stored.join(recorded, ["grp", "slot"], "left_semi"), staged)
            leftover = not stored.join(staged.select("grp", "slot"), ["grp", "slot"], "left_semi").isEmpty()
        if force or leftover:
            cube.write_regions(staged, product.data, keys, chunk)
        else:
            cube.append(staged, product.data, chunk, resume=False)


def run(spark: SparkSession, plugin, product: Product, source: str, *, chunk: int = 100, slots: tuple[int, int] | None = None, group: str | None = None, run_id: str | None = None, resume_existing: bool = False, force: bool = False, batch_items: int = 0, workers: int = 1, keep_going: bool = False, output: str = "cube", job_batches: int = plugins.JOB_BATCHES) -> dict:
    """Runs a plugin.  Its build gives (grp, time, variables); slots follow from its axes.

    With slots only items whose coordinate lies in the range are built.  Times that a span records already are refused;
    with force the spans they belong to are replaced once the new ones are complete.

    The decision to run is made under a lease and a run holds one for its slots, so of two that start at once one is
    refused.  Items are built in batches, up to ``job_batches`` of them by one job and ``workers`` jobs at a time, into a
    staging table that everything after reads: what is recorded is what is written.  The batches of a job are prepared
    before it and cleaned up after it; where a prepared batch holds much, give a smaller ``job_batches`` (1: each on its
    own).  With keep_going a failed batch is recorded and left out; else it fails the run.
    """
    hooks, run_id, started = plugins.hooks_of(plugin), run_id or new_run_id(getattr(plugin, "name", "plugin")), time.time()
    claims = Claims(spark, f"{product.root}/_control/claims")
    ranged = {"slot_range": list(slots) if slots else None, "slot_group": group}
    with claims.held(product.name, "decision", "all", run_id):
        decision = resume.resume_decision(product.runs(spark), product.state(spark), started, slots=slots, group=group, force=force, resume=resume_existing)
        product.put_run(spark, run_id, "running", started, **ranged)
    staging = f"{product.root}/_control/staging/{run_id}"
    try:
        with claims.held(product.name, "slots", f"{group}/{slots}", run_id):
            return _run(spark, plugin, product, source, hooks, run_id, started, decision, staging, ranged, chunk, slots, group, force, batch_items, workers, keep_going, output, job_batches)
    except Exception as problem:
        product.put_run(spark, run_id, "failed", started, error=str(problem)[:500])
        if hooks.on_failure:
            hooks.on_failure(problem)
        raise
    finally:
        product.store(spark).delete(staging)


def _run(spark, plugin, product, source, hooks, run_id, started, decision, staging, ranged, chunk, slots, group, force, batch_items, workers, keep_going, output, job_batches) -> dict:
    if hooks.on_start:
        hooks.on_start()
    if hooks.prepare_tables:
        hooks.prepare_tables(spark)
    items = plugin.discover(spark, source)
    if hooks.keep:
        items = items.where(hooks.keep(items))
    if slots and hooks.coordinate and hooks.axes:
        axis = next(iter(hooks.axes.values())) if group is None else hooks.axes[group]
        items = items.where(timeslots.in_slot_range(timeslots.slot_of(hooks.coordinate(items), axis), *slots))
    sized = items.withColumn("item_bytes", hooks.item_size(items) if hooks.item_size else F.lit(0).cast("long"))
    sized = sized.withColumn("grp", F.explode(hooks.groups(items))) if hooks.groups else sized
    _batches(sized, batch_items).write.partitionBy("batch_id").parquet(f"{staging}/items")
    batched = spark.read.parquet(f"{staging}/items") if cube.exists(spark, f"{staging}/items") else None
    per_batch = {r["batch_id"]: r for r in batched.groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("item_bytes").alias("bytes")).collect()}  # a row for each batch

    builder = _Builder(spark, plugin, hooks, product.store(spark), batched, f"{staging}/rows", group, keep_going)
    names, each = sorted(per_batch), max(1, job_batches)
    with ThreadPoolExecutor(max(1, workers)) as pool:
        jobs = list(pool.map(builder.build, [names[k : k + each] for k in range(0, len(names), each)]))
    done = [
        {"batch": batch, "ok": error is None, "error": error, "files": per_batch[batch]["files"], "bytes": per_batch[batch]["bytes"] or 0, "cpu_s": (ended - begun) / len(job), "start_s": begun, "end_s": ended}
        for job in jobs
        for batch, error, begun, ended in job
    ]
    failed = [d for d in done if not d["ok"]]
    if done and len(failed) == len(done):
        raise RuntimeError(f"all batches failed: {failed[0]['error']}")
    meta = hooks.slice_meta | {"plugin": getattr(plugin, "name", "plugin")}
    records = [("batch_failed", {"key": f"{run_id}/{d['batch']}", "type": "batch", "status": "failed", "batch_id": d["batch"]}, meta | {"error": d["error"]}) for d in failed]
    rows, groups = 0, []
    if done:
        staged = spark.read.parquet(f"{staging}/rows").drop("batch")
        recorded = span_slots(product.state(spark).where("type = 'span' and status = 'active'"))
        _write(spark, product, hooks, staged, chunk, force, output, recorded)
        time_bounds = (F.min("time").cast("string"), F.max("time").cast("string")) if "time" in staged.columns else (F.lit(None).cast("string"),) * 2
        facts = staged.groupBy("grp").agg(time_bounds[0].alias("a"), time_bounds[1].alias("b"), F.count("*").alias("n"))
        spans = islands(staged).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges")).join(facts, "grp").collect()  # a row for each group
        records += [("span_recorded", {"key": f"{run_id}/{s['grp']}", "type": "span", "status": "active", "size": s["n"], "grp": s["grp"], "time_min": s["a"], "time_max": s["b"], "ranges": [{"start": r["start"], "end": r["end"]} for r in s["ranges"]], "aligned": all(r["start"] % chunk == 0 and (r["end"] + 1) % chunk == 0 for r in s["ranges"])}, meta) for s in spans]
        rows, groups = sum(s["n"] for s in spans), sorted(s["grp"] for s in spans)
        if force:
            state = product.state(spark)
            old = [k for s in spans for k in (r["key"] for r in state_log.prior_spans(state.where(F.col("grp") == s["grp"]), run_id, {}, s["a"], s["b"]).select("key").toLocalIterator())]
            if old and not spans:
                raise resume.ConflictError("nothing was written in place of the earlier spans")
            records.append((state_log.COMMITTED, {"replacing_run_id": run_id, "replaced_span_keys": old}, meta))
    product.append_events(spark, run_id, records)
    shape = "batch string, ok boolean, error string, files long, bytes long, cpu_s double, start_s double, end_s double"
    metrics = spark.createDataFrame([tuple(d.values()) for d in done], shape)
    totals = (hooks.aggregate(metrics) if hooks.aggregate else tabular.run_summary(metrics.withColumn("rows", F.lit(0).cast("long")), workers)).head()
    summary = (totals.asDict() if totals else {}) | {"rows": rows, "seconds": round(time.time() - started, 3)}
    product.put_run(spark, run_id, "complete", started, events=len(records), parts=1, **ranged)
    emit(product.store(spark), f"{product.root}/_control/metrics/{run_id}.prom", summary, {"product": product.name, "plugin": meta["plugin"], "status": "complete"})
    if hooks.on_success:
        hooks.on_success(rows)
    return {"run_id": run_id, "status": "complete", "decision": decision, "rows": rows, "groups": groups, "seconds": summary["seconds"], "summary": summary}
