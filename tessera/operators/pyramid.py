"""Multi-resolution layers: block means over (time, y, x) with partial edge blocks trimmed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.binning import clean


def factor_of(resolution: float, step: float) -> int:
    """Cells of the base grid a block: rounded to even at ties, at least 1."""
    return max(1, round(resolution / step))


def mean_step(axis: DataFrame, coordinate: str) -> float:
    """Mean distance of neighbouring coordinates: the extent over their number less one."""
    row = axis.agg(F.min(coordinate).alias("a"), F.max(coordinate).alias("b"), F.countDistinct(coordinate).alias("n")).head()
    if row["n"] < 2:
        raise ValueError("an axis of fewer than two coordinates has no step")
    return float(row["b"] - row["a"]) / (row["n"] - 1)


def coarsen(cube: DataFrame, variables: Sequence[str], fy: int, fx: int, n_y: int, n_x: int, keys: Sequence[str] = ("time",), y: str = "iy", x: str = "ix", coordinates: Sequence[str] = ()) -> DataFrame:
    """Block means (NaN and null skipped) over fy x fx cells; rows and columns beyond the last full block are trimmed.

    Coordinates are averaged too.  One aggregation whatever the number of variables.
    """
    if fy < 1 or fx < 1:
        raise ValueError("factors are at least 1")
    inside = cube.where((F.col(y) < n_y // fy * fy) & (F.col(x) < n_x // fx * fx))
    by, bx = F.floor(F.col(y) / fy).cast("long").alias("by"), F.floor(F.col(x) / fx).cast("long").alias("bx")
    return inside.groupBy(*keys, by, bx).agg(*[F.avg(clean(F.col(v))).alias(v) for v in [*variables, *coordinates]])


def layers(cube: DataFrame, variables: Sequence[str], resolutions: Sequence[float], step: float, n_y: int, n_x: int, keys: Sequence[str] = ("time",)) -> dict[float, DataFrame]:
    """A layer for each resolution, all from the base grid."""
    return {r: coarsen(cube, variables, factor_of(r, step), factor_of(r, step), n_y, n_x, keys) for r in resolutions}
