"""Guards before a write: conflicts with other runs, overlap with what is stored, and the append cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import intervals, state_log
from tessera.operators.tabular import running_total


class ConflictError(RuntimeError):
    """A write would collide with another run or with stored data."""


def conflicting_runs(runs: DataFrame, now: float, slots: tuple[int, int] | None = None, group: str | None = None, resume: bool = False) -> DataFrame:
    """Runs that aren't over and block a new one, with the reason.

    A range run is only blocked by overlapping ranges of its group (the same range may be resumed) and by fresh runs
    without a range; a run without a range by any.
    """
    open_runs = state_log.list_runs(runs, non_terminal=True)
    reason: Column
    if slots is None:
        reason = F.lit("active run")
    else:
        ranged = F.col("slot_range").isNotNull()
        a, b = F.col("slot_range")[0], F.col("slot_range")[1]
        stale = F.lit(now) - F.col("updated_at") > F.coalesce("run_stale_threshold_s", F.lit(3600))
        elsewhere = F.lit(group is not None) & F.col("slot_group").isNotNull() & (F.col("slot_group") != F.lit(group or ""))
        same = (a == slots[0]) & (b == slots[1])
        reason = (
            F.when(~ranged & ~F.coalesce(stale, F.lit(False)), "active run without a range")
            .when(ranged & ~F.coalesce(elsewhere, F.lit(False)) & same & F.lit(not resume), "same range is active")
            .when(ranged & ~F.coalesce(elsewhere, F.lit(False)) & ~same & intervals.overlaps(a, b, F.lit(slots[0]), F.lit(slots[1])), "overlapping range is active")
        )
    return open_runs.withColumn("reason", reason).where("reason is not null").select("product", "run_id", "reason")


def overlapping_spans(spans: DataFrame, slots: tuple[int, int], group: str | None = None) -> DataFrame:
    """Active spans whose inclusive ranges share a slot with a half-open range; with a group only that group's."""
    rows = spans.where("type = 'span' and status = 'active'")
    if group is not None:
        rows = rows.where(F.col("grp").isNull() | (F.col("grp") == group))
    return rows.where(F.exists("ranges", lambda r: intervals.overlaps_inclusive(r["start"], r["end"], F.lit(slots[0]), F.lit(slots[1])))).select("key", "grp", "ranges")


def resume_decision(runs: DataFrame, spans: DataFrame, now: float, *, slots: tuple[int, int] | None = None, group: str | None = None, force: bool = False, resume: bool = False) -> str:
    """``fresh`` or ``resume``; a conflict is an error that names up to five offenders."""
    if force:
        return "fresh"
    found = conflicting_runs(runs, now, slots, group, resume).orderBy("run_id").limit(5).collect()
    if found:
        raise ConflictError("; ".join(f"{r['run_id']}: {r['reason']}" for r in found))
    if slots is not None:
        held = overlapping_spans(spans, slots, group).orderBy("key").limit(5).collect()
        if held:
            raise ConflictError("stored spans overlap: " + ", ".join(r["key"] for r in held))
    return "resume" if resume and not spans.where("type = 'span' and status = 'active'").isEmpty() else "fresh"


def overlapping_times(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("grp", "time")) -> DataFrame:
    """Incoming keys that are stored already (missing times never overlap)."""
    return incoming.select(*keys).where(F.col(keys[-1]).isNotNull()).distinct().join(existing.select(*keys), list(keys), "left_semi")


def refuse_overlap(existing: DataFrame, incoming: DataFrame) -> None:
    """An error with three samples if any incoming time is stored."""
    samples = overlapping_times(existing, incoming).orderBy("grp", "time").limit(3).collect()
    if samples:
        raise ConflictError("stored already: " + ", ".join(f"{r['grp']} {r['time']}" for r in samples))


def append_cursor(existing: DataFrame) -> DataFrame:
    """Next free slot of each group."""
    return existing.groupBy("grp").agg((F.max("slot") + 1).alias("cursor"))


def batch_starts(batches: DataFrame, order: str, count: str) -> DataFrame:
    """First slot of each batch of an append: the counts of all batches before."""
    return running_total(batches, F.col(count), order, "start")


def check_shards(stored_chunks: dict[str, int], wanted: dict[str, int]) -> None:
    """A requested shard length must be the stored one in every dimension."""
    if wrong := {d: (n, stored_chunks[d]) for d, n in sorted(wanted.items()) if d in stored_chunks and stored_chunks[d] != n}:
        raise ValueError("; ".join(f"{d}: shards of {a}, stored {b}" for d, (a, b) in wrong.items()))


def check_version(needed: str, own: str) -> None:
    """A plugin's least engine version, as dotted numbers."""
    parts = lambda v: tuple(int(x) for x in v.split(".")[:3])
    if parts(own) < parts(needed):
        raise ValueError(f"the plugin needs version {needed}, this is {own}")


def missing_groups(asked: DataFrame, declared: DataFrame) -> DataFrame:
    """Groups that are asked for but not declared."""
    return asked.select("grp").distinct().join(declared.select("grp"), "grp", "left_anti")
