"""Preparing variables of a dataset: time dimension, text and time columns, layout hints, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import decode_strings
from tessera.functions.timeslots import decode_cf_time, strict_iso_fault

#: Column metadata that only describes how a source was stored.
HINTS = ("chunksizes", "preferred_chunks", "original_shape", "contiguous", "source")


def rename_time_dim(df: DataFrame, source: str = "time", target: str = "timestamp") -> DataFrame:
    """Renames the time column where it is there; otherwise nothing changes."""
    return df.withColumnRenamed(source, target) if source in df.columns and target not in df.columns else df


def drop_hints(df: DataFrame) -> DataFrame:
    """Columns without the metadata that describes the source's storage."""
    out = df
    for field in df.schema.fields:
        kept = {k: v for k, v in field.metadata.items() if k not in HINTS}
        if kept != field.metadata:
            out = out.withMetadata(field.name, kept)
    return out


def prepare(df: DataFrame, source: str = "time", target: str = "timestamp") -> DataFrame:
    return drop_hints(rename_time_dim(df, source, target))


def normalise_text(df: DataFrame, iso_columns: Sequence[str] = ()) -> DataFrame:
    """Byte columns as UTF-8 text; the named ones as timestamps, refusing what is no strict UTC time."""
    texts = {c: decode_strings(F.col(c)) for c, t in df.dtypes if t == "binary"}
    out = df.withColumns(texts) if texts else df
    for c in iso_columns:
        fault = strict_iso_fault(F.col(c))
        out = out.withColumn(c, F.when(F.col(c).isNotNull() & fault.isNotNull(), F.raise_error(F.concat(F.lit(f"{c}: "), fault)).cast("timestamp")).otherwise(F.try_to_timestamp(c)))
    return out


def decode_times(df: DataFrame, attributes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Numeric time columns decoded by their units and calendar; timestamps pass."""
    kinds = dict(df.dtypes)
    for column, attrs in attributes.items():
        if column in kinds and not kinds[column].startswith("timestamp"):
            df = df.withColumn(column, decode_cf_time(F.col(column), attrs["units"], attrs.get("calendar", "standard")))
    return df


def to_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN as null, as the engine expects it after a scan."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def to_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null as NaN, as array stores keep it."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns})


def first_last_count(rows: DataFrame, time: str = "time", pos: str = "pos") -> DataFrame:
    """First and last time in the order of ``pos`` (not the least and greatest), and their number."""
    return rows.agg(F.min_by(time, pos).alias("first"), F.max_by(time, pos).alias("last"), F.count(time).alias("n"))


def time_bounds(spans: DataFrame) -> DataFrame:
    """Earliest start and latest end of spans, as times; texts that are none don't count."""
    parsed = lambda c: F.try_to_timestamp(F.col(c))
    return spans.agg(F.min(parsed("time_min")).alias("start"), F.max(parsed("time_max")).alias("end"))


def present(slot: Column) -> Column:
    """State of a slot that holds data."""
    return F.when(slot.isNotNull(), F.lit(1)).otherwise(0).cast("tinyint")
