"""Slot planning: what is left to do, cut into aligned ranges of a size that fits the storage chunks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import intervals


def slot_sizes(chunks: Mapping[str, Sequence[int]], explicit: int | None = None) -> dict[str, int]:
    """Slots a range per group: the least common multiple of its arrays' time chunks (or shards).

    An explicit size must be a multiple of each group's.  Groups without time-indexed arrays have none.
    """
    needed = {g: math.lcm(*c) for g, c in chunks.items() if c}
    if explicit is None:
        return needed
    if explicit <= 0:
        raise ValueError("the slot size is positive")
    if wrong := {g: n for g, n in sorted(needed.items()) if explicit % n}:
        raise ValueError("; ".join(f"group {g!r} needs a multiple of {n}" for g, n in wrong.items()))
    return dict.fromkeys(needed, explicit)


def covered_ranges(spans: DataFrame) -> DataFrame:
    """Half-open ranges of the active spans, per group."""
    return intervals.half_open(spans.where("type = 'span' and status = 'active'"))


def plan_slots(covered: DataFrame, groups: DataFrame) -> DataFrame:
    """Ranges still to be done.  groups: grp, total, size.  Returns grp, kind (planned or blocked), start, end.

    A blocked range can't be brought onto chunk boundaries; callers treat any as a refusal of the plan.
    """
    gaps = intervals.complement(intervals.merge(covered), groups.select("grp", "total"))
    parts = intervals.align(gaps.join(groups, "grp"), "size")
    planned = intervals.partition(parts.where("kind = 'aligned'"), "size").select("grp", F.lit("planned").alias("kind"), "start", "end")
    return planned.unionByName(parts.where("kind = 'blocked'").select("grp", "kind", "start", "end"))


def slot_range(job: Mapping[str, str], start: int | None = None, end: int | None = None, size: int | None = None) -> tuple[int, int] | None:
    """Slot range of this job: given bounds, else SLOT_START/SLOT_END, else JOB_INDEX times the size; none means serial."""
    if start is not None and end is not None:
        bounds = start, end
    elif "SLOT_START" in job and "SLOT_END" in job:
        bounds = int(job["SLOT_START"]), int(job["SLOT_END"])
    elif "JOB_INDEX" in job and (size or job.get("SLOT_SIZE")):
        step = int(size or job["SLOT_SIZE"])
        bounds = int(job["JOB_INDEX"]) * step, (int(job["JOB_INDEX"]) + 1) * step
    else:
        return None
    if bounds[0] < 0 or bounds[0] >= bounds[1]:
        raise ValueError(f"bad slot range {bounds}")
    return bounds


def may_run_in_parallel(axes: Mapping[str, int | None], chunks: Mapping[str, int], start: int, end: int, inspects: bool) -> list[str]:
    """Reasons against a parallel run over [start, end): a missing extent or item inspection, or misaligned bounds."""
    out = [] if inspects else ["items cannot be mapped to slots"]
    out += [f"group {g!r} has no extent" for g, n in axes.items() if n is None]
    out += [f"group {g!r}: {start}-{end} is not on chunks of {c}" for g, c in chunks.items() if start % c or (end % c and end != axes.get(g))]
    return out + [f"group {g!r} has no axis" for g in chunks if g not in axes]


def batch_size_advice(time_chunk: int) -> int:
    """Recommended batch: one time chunk, or 10 where chunks hold one slot."""
    return 10 if time_chunk == 1 else time_chunk
