"""Regular time axes: coordinate to slot and back, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO_UTC = r"(Z|\+00:00|-00:00)$"


@dataclass(frozen=True)
class TimeAxis:
    """A fixed-cadence axis.  mode ``exact`` takes only coordinates on the grid, ``floor`` any from the epoch on."""

    epoch_s: int
    cadence_s: int
    mode: str = "floor"
    size: int | None = None
    end_s: int | None = None

    def __post_init__(self):
        if self.cadence_s <= 0 or self.mode not in ("floor", "exact"):
            raise ValueError(f"bad axis: cadence {self.cadence_s}, mode {self.mode}")

    def length(self) -> int:
        """Number of slots: the size, else what fits between epoch and end."""
        if self.size is not None:
            return self.size
        if self.end_s is not None:
            return (self.end_s - self.epoch_s) // self.cadence_s
        raise ValueError("the axis has no extent")


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970, rounded down; a timestamp without zone counts as UTC (the session's zone)."""
    return F.unix_seconds(time.cast("timestamp"))


def slot_fault(time: Column, axis: TimeAxis) -> Column:
    """Why a coordinate has no slot: ``before_epoch``, ``off_grid``, ``sub_second`` or null."""
    seconds = epoch_seconds(time) - axis.epoch_s
    fault = F.when(seconds < 0, "before_epoch")
    if axis.mode == "exact":
        fault = fault.when(F.pmod(F.unix_micros(time.cast("timestamp")), F.lit(1_000_000)) != 0, "sub_second").when(F.pmod(seconds, F.lit(axis.cadence_s)) != 0, "off_grid")
    return fault


def slot_of(time: Column, axis: TimeAxis, strict: bool = False) -> Column:
    """Slot of a coordinate; null (or with strict an error) where it has none.  There is no upper bound."""
    slot = F.floor((epoch_seconds(time) - axis.epoch_s) / axis.cadence_s).cast("long")
    fault = slot_fault(time, axis)
    bad = F.raise_error(F.concat(F.lit("no slot: "), fault)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(fault.isNotNull(), bad).otherwise(slot)


def time_of(slot: Column, axis: TimeAxis) -> Column:
    """Coordinate at which a slot starts."""
    return F.timestamp_seconds(F.lit(axis.epoch_s) + slot * F.lit(axis.cadence_s))


def index_axes(spark: SparkSession, axes: dict[str, TimeAxis]) -> DataFrame:
    """The axes of all groups as a table."""
    rows = [(g, a.epoch_s, a.cadence_s, a.mode, a.size) for g, a in axes.items()]
    return spark.createDataFrame(rows, "grp string, epoch_s long, cadence_s long, mode string, size long")


def assign_slots(rows: DataFrame, axes: DataFrame, time: str = "time", group: str = "grp") -> DataFrame:
    """Slot of each row on its group's axis (a row for each group: broadcast); unknown groups and bad times get null."""
    seconds = epoch_seconds(F.col(time)) - F.col("epoch_s")
    on_grid = (F.col("mode") != "exact") | ((F.pmod(seconds, F.col("cadence_s")) == 0) & (F.pmod(F.unix_micros(F.col(time).cast("timestamp")), F.lit(1_000_000)) == 0))
    slot = F.when((seconds >= 0) & on_grid, F.floor(seconds / F.col("cadence_s")).cast("long"))
    joined = rows.join(F.broadcast(axes.withColumnRenamed("grp", group)), group, "left")
    return joined.withColumn("slot", slot).select(*rows.columns, "slot")


def in_slot_range(slot: Column, start: int, end: int) -> Column:
    """Half-open slot predicate."""
    if start < 0 or start >= end:
        raise ValueError(f"bad slot range {start}, {end}")
    return (slot >= start) & (slot < end)


def iso_to_epoch(text: Column) -> Column:
    """Seconds of an ISO time that states UTC; null for any other text."""
    return F.when(text.rlike(ISO_UTC), F.unix_seconds(F.try_to_timestamp(text)))


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalise_iso(text: Column) -> Column:
    return epoch_to_iso(iso_to_epoch(text))


def strict_iso_fault(text: Column) -> Column:
    """Why a text is no strict UTC time: ``naive``, ``offset``, ``fraction``, ``unreadable`` or null."""
    zone = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    return (
        F.when(text.isNull() | F.try_to_timestamp(text).isNull(), "unreadable").when(zone == "", "naive").when(~text.rlike(ISO_UTC), "offset").when(text.rlike(r"\.\d{7,}"), "fraction")
    )


#: CF time units and their seconds.
CF_UNITS = {"microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}
CF_CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


def decode_cf_time(value: Column, units: str, calendar: str = "standard") -> Column:
    """Time of a number in ``<unit> since <reference>``; other calendars and units without ``since`` are errors."""
    unit, since, reference = units.partition(" since ")
    unit = unit.strip().lower()
    unit = unit if unit.endswith("s") else unit + "s"
    if not since or unit not in CF_UNITS:
        raise ValueError(f"not a CF time unit: {units!r}")
    if calendar not in CF_CALENDARS:
        raise ValueError(f"calendar not supported: {calendar!r}")
    start = F.unix_micros(F.to_timestamp(F.lit(reference.strip())))
    return F.timestamp_micros(start + F.round(value.cast("double") * F.lit(CF_UNITS[unit] * 1e6)).cast("long"))
