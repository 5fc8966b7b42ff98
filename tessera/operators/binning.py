"""Scatter aggregation of samples onto cells: latitude/longitude grids, HEALPix cells or any cell column.

Samples are (lat, lon, pos, variables); ``pos`` gives the order that first and last refer to.  NaN and null samples are
skipped.  Results are doubles; an empty cell is null (for ``any`` 0).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("mean", "min", "max", "first", "last", "median", "any")


def clean(value: Column, fill_value: float | None = None) -> Column:
    """The value as a double, null for NaN and the fill value."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.when(v == fill_value, None).otherwise(v) if fill_value is not None else v


def _finite(value: Column) -> Column:
    return F.when((value == math.inf) | (value == -math.inf), None).otherwise(value)


def aggregate_of(value: Column, method: str, pos: Column) -> Column:
    """One aggregate of a cleaned value.  min and max of infinities are empty, mean keeps them."""
    here = F.when(value.isNotNull(), pos)
    if method not in METHODS:
        raise ValueError(f"unknown aggregation {method!r}: one of {', '.join(METHODS)}")
    return {
        "mean": lambda: F.avg(value),
        "min": lambda: _finite(F.min(value)),
        "max": lambda: _finite(F.max(value)),
        "first": lambda: F.min_by(value, here),
        "last": lambda: F.max_by(value, here),
        "median": lambda: F.median(value),
        "any": lambda: F.coalesce(F.bool_or(value != 0), F.lit(False)).cast("int"),
    }[method]()


def aggregate_cells(samples: DataFrame, cell: Sequence[str], methods: dict[str, tuple[str, str]], pos: str = "pos", fill_value: float | None = None) -> DataFrame:
    """Aggregates of all variables in one pass.  methods: output column -> (variable, method)."""
    return samples.groupBy(*cell).agg(*[aggregate_of(clean(F.col(v), fill_value), m, F.col(pos)).alias(out) for out, (v, m) in methods.items()])


@dataclass(frozen=True)
class Grid:
    """Cell centres from the lower bounds in steps of ``spacing``, the last one at or beyond the upper bounds.

    Cells reach half a spacing around their centre, so the outer ones reach beyond the bounds.
    """

    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    spacing: float

    def count(self, low: float, high: float) -> int:
        return math.ceil(round((high + self.spacing - low) / self.spacing, 9))

    @property
    def n_lat(self) -> int:
        return self.count(self.lat_min, self.lat_max)

    @property
    def n_lon(self) -> int:
        return self.count(self.lon_min, self.lon_max)


def extent_of(samples: DataFrame, spacing: float, lat: str = "lat", lon: str = "lon") -> Grid:
    """A grid from the rounded-out extent of the samples (one row comes to the driver)."""
    y, x = clean(F.col(lat)), clean(F.col(lon))
    row = samples.where(y.isNotNull() & x.isNotNull()).agg(F.floor(F.min(y)).alias("a"), F.ceil(F.max(y)).alias("b"), F.floor(F.min(x)).alias("c"), F.ceil(F.max(x)).alias("d")).head()
    if row["a"] is None:
        raise ValueError("no sample has finite coordinates")
    return Grid(float(row["a"]), float(row["b"]), float(row["c"]), float(row["d"]), spacing)


def to_grid(samples: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds iy and ix; samples without coordinates or outside of all cells go."""
    index = lambda c, low: F.floor((clean(F.col(c)) - F.lit(low - grid.spacing / 2)) / F.lit(grid.spacing)).cast("long")
    placed = samples.withColumn("iy", index(lat, grid.lat_min)).withColumn("ix", index(lon, grid.lon_min))
    return placed.where((F.col("iy") >= 0) & (F.col("iy") < grid.n_lat) & (F.col("ix") >= 0) & (F.col("ix") < grid.n_lon))


def every_cell(spark, grid: Grid) -> DataFrame:
    """All cells with their centres, generated where they are used."""
    n = grid.n_lat * grid.n_lon
    cells = spark.range(n).select((F.col("id") / grid.n_lon).cast("long").alias("iy"), (F.col("id") % grid.n_lon).alias("ix"))
    return cells.withColumn("lat_c", F.lit(grid.lat_min) + F.col("iy") * F.lit(grid.spacing)).withColumn("lon_c", F.lit(grid.lon_min) + F.col("ix") * F.lit(grid.spacing))


def bin_to_grid(samples: DataFrame, grid: Grid, methods: dict[str, tuple[str, str]], dense: bool = False, fill_value: float | None = None) -> DataFrame:
    """Variables on the grid; dense adds the empty cells (null, and 0 for ``any``)."""
    binned = aggregate_cells(to_grid(samples, grid), ["iy", "ix"], methods, fill_value=fill_value)
    if not dense:
        return binned
    full = every_cell(samples.sparkSession, grid).join(binned, ["iy", "ix"], "left")
    return full.withColumns({out: F.coalesce(F.col(out), F.lit(0)) for out, (_, m) in methods.items() if m == "any"})


def grid_stats(field: DataFrame, variable: str) -> DataFrame:
    """Filled and total cells of a dense field, and the share in percent."""
    return field.agg(F.count(variable).alias("n_valid_cells"), F.count("*").alias("n_cells"), F.round(F.lit(100.0) * F.count(variable) / F.count("*"), 6).alias("fill_percentage"))


def bin_to_cells(samples: DataFrame, targets: DataFrame, cell: str, methods: dict[str, tuple[str, str]]) -> DataFrame:
    """Onto a given axis of cells: samples elsewhere go, cells without samples stay empty."""
    binned = aggregate_cells(samples, [cell], methods)
    joined = targets.select(cell).distinct().join(binned, cell, "left")
    return joined.withColumns({out: F.coalesce(F.col(out), F.lit(0)) for out, (_, m) in methods.items() if m == "any"})


def rectangular_mesh(lats: DataFrame, lons: DataFrame, data: DataFrame) -> DataFrame:
    """Samples of a rectangular mesh: lats (y, lat), lons (x, lon), data (y, x, ...).

    The values bring the coordinates they need, so the mesh itself is never built.
    """
    return data.join(lats, "y").join(lons, "x")
