"""Current state, history and queries over the append-only event log.

``events`` and ``runs`` have the schemas of ``model``.  Projection reads each record once and is one aggregation by key
(last upsert, last replacement) that combines on the map side, so a key's whole history is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import model
from tessera.functions.scalars import key_matches, meta_equals
from tessera.operators.intervals import slots_in

STARTED, COMMITTED = "run_started_with_replacement", "replacement_committed"
FIELDS = ("key", "type", "status", "size", "timestamp", "run_id", "batch_id", "grp", "time_min", "time_max", "ranges", "aligned", "state_array", "replaced_by", "replaced_at")


def decoded(events: DataFrame) -> DataFrame:
    """Events with their record as a struct; a record of another schema version is an error."""
    parsed = events.withColumn("r", F.from_json("record", model.RECORD))
    checked = F.when(F.coalesce(F.col("r.schema_version"), F.lit(model.SCHEMA_VERSION)) != model.SCHEMA_VERSION, F.raise_error(F.concat(F.lit("event schema version "), F.col("r.schema_version").cast("string"))).cast("int")).otherwise(0)
    return parsed.withColumn("part", F.col("part") + checked)


def in_replay_order(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events of complete runs with ``place``: by completion, run, part and index."""
    done = runs.where("status = 'complete'").select("product", "run_id", F.coalesce("completed_at", F.lit(0.0)).alias("completed_at"))
    return decoded(events.join(done, ["product", "run_id"])).withColumn("place", F.struct("completed_at", "run_id", "part", "idx"))


def project(events: DataFrame, runs: DataFrame, snapshot: DataFrame | None = None, completed_before: float | None = None, pattern: str | None = None) -> DataFrame:
    """Current record of each (product, key); with a pattern only of the keys that match it.

    Later upserts win.  A committed replacement marks the keys it lists that exist at that point of the replay; a later
    upsert of the key clears the mark.  With a snapshot only runs completed at or after its cut-off are replayed on it.
    """
    if snapshot is not None and completed_before is not None:
        runs = runs.where(F.col("completed_at") >= completed_before)
    replay = in_replay_order(events.where(F.col("event_type") != STARTED), runs)
    commits = F.col("event_type") == COMMITTED
    value = F.struct(*[(F.coalesce(F.col(f"r.{f}"), F.col("timestamp")) if f == "timestamp" else F.coalesce(F.col(f"r.{f}"), F.col("run_id")) if f == "run_id" else F.col(f"r.{f}")).alias(f) for f in FIELDS if f != "key"], F.col("meta").alias("meta"))
    mark = F.struct(F.col("r.replacing_run_id").alias("by"), F.coalesce("r.timestamp", "timestamp").alias("at"))
    rows = replay.select("product", F.explode(F.when(commits, F.col("r.replaced_span_keys")).otherwise(F.array("r.key"))).alias("key"), "place", F.when(~commits, value).alias("value"), F.when(commits, mark).alias("mark"))
    rows = rows.where(F.coalesce("key", F.lit("")) != "")
    if snapshot is not None:
        first = F.struct(F.lit(float("-inf")).alias("completed_at"), F.lit("").alias("run_id"), F.lit(0).alias("part"), F.lit(0).alias("idx"))
        rows = rows.unionByName(snapshot.select("product", "key", first.alias("place"), F.struct(*[F.col(f) for f in FIELDS if f != "key"], "meta").alias("value")), allowMissingColumns=True)
    if pattern is not None:
        rows = rows.where(key_matches(F.col("key"), pattern))
    at, marked = F.when(F.col("value").isNotNull(), F.col("place")), F.when(F.col("mark").isNotNull(), F.col("place"))
    last = rows.groupBy("product", "key").agg(F.max_by("value", at).alias("value"), F.max(at).alias("at"), F.max_by("mark", marked).alias("mark"), F.max(marked).alias("marked"))
    last = last.where("value is not null").withColumn("hit", F.coalesce(F.col("marked") > F.col("at"), F.lit(False)))
    chosen = {"status": F.when(F.col("hit"), "replaced").otherwise(F.col("value.status")), "replaced_by": F.when(F.col("hit"), F.col("mark.by")).otherwise(F.col("value.replaced_by")), "replaced_at": F.when(F.col("hit"), F.col("mark.at")).otherwise(F.col("value.replaced_at"))}
    return last.select("product", "key", *[chosen.get(f, F.col(f"value.{f}")).alias(f) for f in FIELDS if f != "key"], F.col("value.meta").alias("meta"))


def history(events: DataFrame) -> DataFrame:
    """Every event's record, of all runs whatever their status, several for a key."""
    rows = decoded(events).where(F.coalesce("r.key", F.lit("")) != "")
    return rows.select("product", F.col("r.key").alias("key"), *[(F.coalesce(F.col("r.timestamp"), F.col("timestamp")) if f == "timestamp" else F.coalesce(F.col("r.run_id"), F.col("run_id")) if f == "run_id" else F.col(f"r.{f}")).alias(f) for f in FIELDS if f != "key"], "meta")


def _time(text) -> Column:
    return F.try_to_timestamp(text if isinstance(text, Column) else F.lit(text))


def list_records(
    events: DataFrame, runs: DataFrame, *, pattern: str | None = None, product: str | None = None, before: float | None = None, after: float | None = None, kind: str | None = None, status: str | None = None,
    include_replaced: bool = False, meta: dict | None = None, time_min_after: str | None = None, time_max_before: str | None = None, time_overlaps: tuple[str, str] | None = None, predicate: Column | None = None, dedupe: bool = True,
    snapshot: DataFrame | None = None, completed_before: float | None = None,
) -> DataFrame:
    """Records by filters, newest first.

    With include_replaced or a status the history is searched, otherwise the current state's active records.  Records of
    type ``run`` only appear where that type is asked for.  before and after are strict; times that can't be read match
    no time filter; the overlap is closed at both ends.  Filters on what a key's events all share (product, key) come
    before the projection; the others depend on its last record.
    """
    past = include_replaced or status is not None
    if product is not None:
        events, runs = events.where(F.col("product") == product), runs.where(F.col("product") == product)
    rows = history(events) if past else project(events, runs, snapshot, completed_before, pattern)
    tests = [F.col("type") == kind if kind else F.coalesce(F.col("type") != "run", F.lit(True))]
    tests += [key_matches(F.col("key"), pattern)] if pattern and past else []
    tests += [meta_equals(F.col("meta"), k, v) for k, v in (meta or {}).items()]
    tests += [_time(F.col("time_min")) >= _time(time_min_after)] if time_min_after else []
    tests += [_time(F.col("time_max")) <= _time(time_max_before)] if time_max_before else []
    tests += [(_time(F.col("time_min")) <= _time(time_overlaps[1])) & (_time(F.col("time_max")) >= _time(time_overlaps[0]))] if time_overlaps else []
    tests += [F.col("status") == status] if status is not None else [] if include_replaced else [F.col("status") == "active"]
    tests += [F.col("timestamp") < before] if before is not None else []
    tests += [F.col("timestamp") > after] if after is not None else []
    tests += [predicate] if predicate is not None else []
    for test in tests:
        rows = rows.where(F.coalesce(test, F.lit(False)))
    return (dedupe_active(rows) if dedupe else rows).orderBy(F.desc("timestamp"), "key")


def dedupe_active(rows: DataFrame) -> DataFrame:
    """Of active spans of the same slice (product, group, time bounds) only those of the greatest run id stay.

    Other records, and spans that lack part of the slice, pass.  A slice without any run id keeps its spans.
    """
    slice_key = ["product", "grp", "time_min", "time_max"]
    concerned = (F.col("type") == "span") & (F.col("status") == "active") & F.col("grp").isNotNull() & F.col("time_min").isNotNull() & F.col("time_max").isNotNull()
    concerned = F.coalesce(concerned, F.lit(False))
    best = rows.where(concerned).groupBy(*slice_key).agg(F.max(F.coalesce("run_id", F.lit(""))).alias("best"))
    return rows.join(best, slice_key, "left").where(~concerned | (F.coalesce("run_id", F.lit("")) == F.col("best"))).select(*rows.columns)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order, without a window: one aggregation that combines on the map side."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("v"))
    return last.select(*keys, "v.*")


def coverage_summary(spans: DataFrame) -> DataFrame:
    """Per group: lexicographic time bounds, spans and slots written; the group defaults to ``unknown``."""
    grouped = spans.groupBy(F.coalesce("grp", F.lit("unknown")).alias("grp"))
    return grouped.agg(F.min("time_min").alias("time_min"), F.max("time_max").alias("time_max"), F.count("*").alias("span_count"), F.sum(F.coalesce(slots_in(F.col("ranges")), F.lit(0))).alias("timestamps_written")).orderBy("grp")


def list_runs(runs: DataFrame, status: str | None = None, non_terminal: bool = False) -> DataFrame:
    rows = runs.where(F.col("status") == status) if status else runs
    return rows.where(~F.col("status").isin(*model.TERMINAL)) if non_terminal else rows


def stale_runs(runs: DataFrame, now: float, default_threshold_s: int = 3600) -> DataFrame:
    """Runs that aren't over and whose last update is longer ago than their threshold."""
    return list_runs(runs, non_terminal=True).where(F.lit(now) - F.col("updated_at") > F.coalesce("run_stale_threshold_s", F.lit(default_threshold_s)))


def with_orphans(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds a run of status ``orphaned`` for segments (product, run_id) without a readable run."""
    lost = segments.select("product", "run_id").distinct().join(runs, ["product", "run_id"], "left_anti").withColumn("status", F.lit("orphaned"))
    return runs.unionByName(lost, allowMissingColumns=True)


def replaced_events(current: DataFrame, keys: DataFrame, run_id: str, timestamp: float) -> DataFrame:
    """Upsert events that mark the listed keys as replaced; only records active now are marked."""
    hit = current.where("status = 'active'").join(keys.select("key").distinct(), "key", "left_semi")
    record = F.to_json(F.struct("key", "type", F.lit("replaced").alias("status"), "size", F.lit(timestamp).alias("timestamp"), "run_id", "batch_id", "grp", "time_min", "time_max", "ranges", "aligned", "state_array", F.lit(run_id).alias("replaced_by"), F.lit(timestamp).alias("replaced_at"), F.lit(model.SCHEMA_VERSION).alias("schema_version")))
    idx = F.row_number().over(Window.partitionBy("product").orderBy("key")) - 1
    return hit.select("product", F.lit(run_id).alias("run_id"), F.lit(0).alias("part"), idx.cast("int").alias("idx"), F.sha2(F.concat_ws(":", F.lit(run_id), "key"), 256).alias("event_id"), F.lit("record_replaced").alias("event_type"), F.lit(timestamp).alias("timestamp"), record.alias("record"), "meta")


def prior_spans(current: DataFrame, run_id: str, slice_meta: dict, start: str, end: str) -> DataFrame:
    """Active spans of other runs with the same slice metadata that overlap the time bounds."""
    rows = current.where((F.col("type") == "span") & (F.col("status") == "active") & (F.col("run_id") != run_id))
    for key, value in slice_meta.items():
        rows = rows.where(meta_equals(F.col("meta"), key, value))
    return rows.where(F.coalesce((_time(F.col("time_min")) <= _time(end)) & (_time(F.col("time_max")) >= _time(start)), F.lit(False)))


def deletion_plan(records: DataFrame) -> DataFrame:
    """Totals of what would be deleted."""
    return records.agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.countDistinct("product").alias("products"))


def span_chunks(spans: DataFrame, time_chunk: int, other_counts: tuple[int, ...] = ()) -> DataFrame:
    """Chunk keys that the spans' inclusive ranges touch: time chunks times the chunk grid of the other dimensions."""
    touched = spans.select("grp", F.explode("ranges").alias("r")).where("r.end >= r.start")
    chunks = touched.select("grp", F.explode(F.sequence(F.floor(F.col("r.start") / time_chunk), F.floor(F.col("r.end") / time_chunk))).alias("c0")).distinct()
    names = ["c0"]
    for k, n in enumerate(other_counts, 1):
        chunks = chunks.withColumn(f"c{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        names.append(f"c{k}")
    return chunks.withColumn("key", F.concat_ws("/", F.lit("c"), *[F.col(c).cast("string") for c in names]))


def set_slot_state(state: DataFrame, ranges: DataFrame, value: int) -> DataFrame:
    """Slot states with a value set over inclusive ranges (grp, start, end)."""
    slots = ranges.where("end >= start").select("grp", F.explode(F.sequence("start", "end")).alias("slot")).distinct().withColumn("new", F.lit(value).cast("tinyint"))
    return state.join(slots, ["grp", "slot"], "full_outer").select("grp", "slot", F.coalesce("new", "state").alias("state"))
