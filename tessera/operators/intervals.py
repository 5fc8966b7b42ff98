"""Interval algebra on half-open integer ranges, per group, as window and generator expressions.

Tables have (group columns..., start, end).  Stored ranges are inclusive: ``half_open`` converts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def half_open(rows: DataFrame, ranges: str = "ranges", keep: Sequence[str] = ("grp",)) -> DataFrame:
    """Inclusive ranges (array of start, end) as half-open rows; malformed and inverted ones go."""
    sane = F.filter(F.col(ranges), lambda r: r["start"].isNotNull() & (r["end"] >= r["start"]))
    return rows.select(*keep, F.explode(sane).alias("r")).select(*keep, F.col("r.start").alias("start"), (F.col("r.end") + 1).alias("end"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Two half-open ranges share a slot."""
    return (a_start < b_end) & (b_start < a_end)


def overlaps_inclusive(a_start: Column, a_last: Column, b_start: Column, b_end: Column) -> Column:
    """An inclusive and a half-open range share a slot."""
    return (a_start < b_end) & (b_start <= a_last)


#: Slots a part of a group's order.  Windows run within a part, and once over the parts' results, so no task holds all
#: ranges of a group: at most this many (one for each start), or as many parts.
PART = 4096


def _reach(rows: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the greatest ``value`` of all rows of the group with a lesser start (null for none).

    rows have one row for each start of a group.
    """
    parted = rows.withColumn("_part", F.floor(F.col("start") / PART))
    tops = parted.groupBy(*group, "_part").agg(F.max(value).alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*group, "_part", earlier.alias("_before"))
    within = F.max(value).over(Window.partitionBy(*group, "_part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    both = parted.withColumn("_within", within).join(tops, [*group, "_part"])
    return both.withColumn(out, F.greatest("_within", "_before")).drop("_part", "_within", "_before")


def merge(rows: DataFrame, group: Sequence[str] = ("grp",)) -> DataFrame:
    """Union of ranges: overlapping and touching ones become one."""
    longest = rows.groupBy(*group, "start").agg(F.max("end").alias("end"))
    marked = _reach(longest, group, "end", "reach")
    fresh = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start"))
    marked = _reach(marked.withColumn("fresh", fresh), group, "fresh", "last")
    # An island is named by the start that opened it.
    return marked.groupBy(*group, F.coalesce("fresh", "last").alias("island")).agg(F.max("end").alias("end")).select(*group, F.col("island").alias("start"), "end")


def complement(covered: DataFrame, totals: DataFrame, group: Sequence[str] = ("grp",)) -> DataFrame:
    """Gaps of [0, total) that no range covers.  totals: one row per group with ``total``; ranges are clamped."""
    names = list(group)
    inside = covered.join(totals, names).select(*names, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "total").alias("end")).where("start < end")
    # A sentinel at each group's end closes the last gap; groups without ranges are one gap.
    edged = inside.union(totals.select(*names, F.col("total").alias("start"), F.col("total").alias("end"))).groupBy(*names, "start").agg(F.max("end").alias("end"))
    gaps = _reach(edged, names, "end", "gap").withColumn("gap", F.coalesce("gap", F.lit(0).cast("long")))
    return gaps.where("gap < start").select(*names, F.col("gap").alias("start"), F.col("start").alias("end"))


def partition(rows: DataFrame, size: int | str) -> DataFrame:
    """Cuts each range into pieces of at most ``size`` (a number or a column)."""
    step = F.col(size) if isinstance(size, str) else F.lit(size)
    pieces = rows.where("start < end").withColumn("piece", F.explode(F.sequence(F.col("start"), F.col("end") - 1, step.cast("long"))))
    return pieces.withColumn("end", F.least(F.col("piece") + step, F.col("end"))).withColumn("start", F.col("piece")).drop("piece")


def align(rows: DataFrame, size: int | str, total: str = "total") -> DataFrame:
    """Splits each range into the part that starts on a multiple of size (``aligned``) and what cannot (``blocked``)."""
    step = F.col(size) if isinstance(size, str) else F.lit(size)
    up = (F.ceil(F.col("start") / step) * step).cast("long")
    end = F.least(F.col("end"), F.col(total))
    both = F.array(
        F.when(up < end, F.struct(F.lit("aligned").alias("kind"), up.alias("s"), end.alias("e"))),
        F.when(up < end, F.when(up > F.col("start"), F.struct(F.lit("blocked").alias("kind"), F.col("start").alias("s"), up.alias("e")))).otherwise(F.struct(F.lit("blocked").alias("kind"), F.col("start").alias("s"), end.alias("e"))),
    )
    others = [c for c in rows.columns if c not in ("start", "end")]
    return rows.withColumn("part", F.explode(F.filter(both, lambda x: x.isNotNull()))).select(*others, F.col("part.kind").alias("kind"), F.col("part.s").alias("start"), F.col("part.e").alias("end"))


def align_outwards(rows: DataFrame, chunk: int, group: Sequence[str] = ("grp",)) -> DataFrame:
    """Ranges widened to whole chunks, each once."""
    return rows.select(*group, (F.floor(F.col("start") / chunk) * chunk).cast("long").alias("start"), (F.ceil(F.col("end") / chunk) * chunk).cast("long").alias("end")).distinct()


def chunk_ranges(rows: DataFrame, chunk: int, length: int, group: Sequence[str] = ("grp",)) -> DataFrame:
    """Inclusive ranges as the whole chunks they touch: one inclusive range per chunk, clamped to the length."""
    touched = rows.where("end >= start").select(*group, F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("end") / chunk))).alias("c")).where("c >= 0").distinct()
    out = touched.select(*group, (F.col("c") * chunk).alias("start"), F.least(F.lit(length - 1).cast("long"), (F.col("c") + 1) * chunk - 1).alias("end"))
    return out.where("end >= start")


def overlap_join(left: DataFrame, right: DataFrame, bucket: int, group: Sequence[str] = ("grp",)) -> DataFrame:
    """Pairs of half-open ranges that overlap: (group, l_id, r_id, start, end of the common part).

    Ranges are dealt to the buckets they touch, which makes the theta join an equi-join; a pair counts in the bucket
    where its common part starts.  left and right have id, start, end.
    """
    spread = lambda df, p: df.where("start < end").select(*group, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("b"))
    pairs = spread(left, "l").join(spread(right, "r"), [*group, "b"]).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    begin = F.greatest("l_start", "r_start")
    return pairs.where(F.floor(begin / bucket) == F.col("b")).select(*group, "l_id", "r_id", begin.alias("start"), F.least("l_end", "r_end").alias("end"))


def islands(rows: DataFrame, group: Sequence[str] = ("grp",), slot: str = "slot") -> DataFrame:
    """Distinct slots as inclusive runs of consecutive slots, with their lengths.

    Runs are found within parts of a group's slots, and those that touch are merged.
    """
    distinct = rows.where(F.col(slot).isNotNull()).select(*group, slot).distinct().withColumn("_part", F.floor(F.col(slot) / PART))
    lane = F.col(slot) - F.row_number().over(Window.partitionBy(*group, "_part").orderBy(slot))
    short = distinct.withColumn("lane", lane).groupBy(*group, "_part", "lane").agg(F.min(slot).alias("start"), (F.max(slot) + 1).alias("end"))
    return merge(short.select(*group, "start", "end"), group).select(*group, "start", (F.col("end") - 1).alias("end"), (F.col("end") - F.col("start")).alias("n"))


def slots_in(ranges: Column) -> Column:
    """Number of slots in an array of inclusive ranges."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"] + 1)


def misaligned(start: Column, end: Column, chunk: Column, total: Column) -> Column:
    """A range that doesn't cover whole chunks; a partial last chunk is fine where the range ends at the total."""
    return (F.pmod(start, chunk) != 0) | ((F.pmod(end, chunk) != 0) & (end != total))
