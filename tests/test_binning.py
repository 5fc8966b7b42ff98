import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import binning, healpix, pyramid
from tessera.operators.binning import Grid

SCHEMA = "lat double, lon double, pos long, v double"


def cells(df, *names):
    return {(r["iy"], r["ix"]): tuple(r[n] for n in names) for r in df.collect()}


def test_mean_of_two_samples_in_one_cell(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0, 2.0), (0.2, 0.2, 1, 4.0)], SCHEMA)
    out = binning.bin_to_grid(df, binning.extent_of(df, 1.0), {"m": ("v", "mean")}, dense=True)
    assert [r["m"] for r in out.collect() if r["m"] is not None] == [3.0]


def test_bounds_have_a_centre_at_the_upper_bound_and_drop_what_lies_outside(spark):
    grid = Grid(0.0, 5.0, 0.0, 5.0, 1.0)
    assert (grid.n_lat, grid.n_lon) == (6, 6)
    df = spark.createDataFrame([(2.0, 2.0, 0, 1.0), (50.0, 50.0, 1, 1.0), (-0.5, 5.4, 2, 9.0), (float("nan"), 1.0, 3, 1.0), (None, 1.0, 4, 1.0)], SCHEMA)
    assert cells(binning.bin_to_grid(df, grid, {"m": ("v", "mean")}), "m") == {(2, 2): (1.0,), (0, 5): (9.0,)}


def test_methods_skip_nan_and_treat_infinities(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([(0.0, 0.0, 3, 5.0), (0.0, 0.0, 1, nan), (0.0, 0.0, 2, 1.0), (0.0, 0.0, 4, None), (1.0, 1.0, 5, inf), (1.0, 0.0, 6, nan)], SCHEMA)
    methods = {m: ("v", m) for m in binning.METHODS}
    out = cells(binning.bin_to_grid(df, Grid(0.0, 1.0, 0.0, 1.0, 1.0), methods, dense=True), *binning.METHODS)
    assert out[0, 0] == (3.0, 1.0, 5.0, 1.0, 5.0, 3.0, 1)
    assert out[1, 1] == (inf, None, None, inf, inf, inf, 1)  # min and max of infinities are empty, the mean is not
    assert out[1, 0] == (None,) * 6 + (0,) and out[0, 1] == (None,) * 6 + (0,)
    with pytest.raises(ValueError):
        binning.aggregate_of(F.col("v"), "mode", F.col("pos"))


def test_stats_fill_value_and_targets(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1, -9.0), (1.0, 1.0, 2, 4.0)], SCHEMA)
    dense = binning.bin_to_grid(df, Grid(0.0, 1.0, 0.0, 1.0, 1.0), {"m": ("v", "mean")}, dense=True, fill_value=-9.0)
    assert binning.grid_stats(dense, "m").head().asDict() == {"n_valid_cells": 1, "n_cells": 4, "fill_percentage": 25.0}
    targets = spark.createDataFrame([(1,), (5,), (5,)], "cell long")
    got = binning.bin_to_cells(df.withColumn("cell", F.col("pos")), targets, "cell", {"m": ("v", "mean"), "a": ("v", "any")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, -9.0, 1), (5, None, 0)]


def centre(depth, cell):
    """Centre of a nested cell (lon, lat in degrees), by the published inverse."""
    nside = 1 << depth
    face, rest = divmod(cell, nside * nside)
    x = sum((rest >> 2 * k & 1) << k for k in range(depth))
    y = sum((rest >> 2 * k + 1 & 1) << k for k in range(depth))
    ring = (face // 4 + 2) * nside - x - y - 1
    shift = [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7][face]
    if ring < nside:
        n, z, odd = ring, 1 - ring * ring / (3 * nside * nside), 0
    elif ring > 3 * nside:
        n = 4 * nside - ring
        z, odd = -1 + n * n / (3 * nside * nside), 0
    else:
        n, z, odd = nside, (2 * nside - ring) * 2 / (3 * nside), (ring - nside) & 1
    step = (shift * n + x - y + 1 + odd) // 2
    step = (step - 1) % (4 * n) + 1
    return math.degrees((step - (odd + 1) * 0.5) * math.pi / (2 * n)), math.degrees(math.asin(z))


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_every_cell_holds_its_centre(spark, depth):
    n = 12 * 4**depth
    rows = [(*centre(depth, c), c) for c in range(n)]
    df = spark.createDataFrame(rows, "lon double, lat double, c long")
    assert df.where(healpix.nested_cell(F.col("lon"), F.col("lat"), depth) != F.col("c")).count() == 0


def test_healpix_fixture_and_box(spark):
    df = spark.createDataFrame([(5.0, 10.0, 0, 1.0), (5.0, 10.0, 1, 2.0), (30.0, -20.0, 2, 1.0), (None, 1.0, 3, 1.0)], SCHEMA)
    got = healpix.with_cells(df, 4)
    out = binning.aggregate_cells(got, ["cell"], {"a": ("v", "any")}).collect()
    assert len(out) == 2 and sum(r["a"] for r in out) == 2 and all(0 <= r["cell"] < 12 * 4**4 for r in out)
    box = [r["cell"] for r in healpix.cells_in_box(spark, 0.0, 0.0, 10.0, 10.0, 3).collect()]
    assert box == sorted(set(box)) and box
    assert abs(spark.range(1).select(healpix.authalic_latitude(F.lit(45.0)).alias("x")).head()["x"] - 44.8717) < 1e-3
    with pytest.raises(ValueError):
        healpix.nested_cell(F.lit(0.0), F.lit(0.0), 30)


def test_pyramid_rounds_to_even_trims_and_skips_missing(spark):
    assert pyramid.factor_of(2.5, 1.0) == 2 and pyramid.factor_of(0.1, 1.0) == 1 and pyramid.factor_of(3.5, 1.0) == 4
    rows = [(0, y, x, math.nan if (y, x) == (0, 0) else float(y * 10 + x)) for y in range(5) for x in range(5)]
    cube = spark.createDataFrame(rows, "time int, iy int, ix int, v double")
    out = {(r["by"], r["bx"]): r["v"] for r in pyramid.coarsen(cube, ["v"], 2, 2, 5, 5).collect()}
    want = {(b, c): np.nanmean([v for _, y, x, v in rows if y // 2 == b and x // 2 == c]) for b in range(2) for c in range(2)}
    assert out == pytest.approx(want)
    assert pyramid.mean_step(cube, "iy") == 1.0


def test_rectangular_mesh_uses_the_documented_mesh(spark):
    lats, lons = spark.createDataFrame([(0, 10.0), (1, 20.0)], "y long, lat double"), spark.createDataFrame([(0, 1.0), (1, 2.0)], "x long, lon double")
    data = spark.createDataFrame([(y, x, float(2 * y + x)) for y in range(2) for x in range(2)], "y long, x long, v double")
    assert sorted((r["lat"], r["lon"], r["v"]) for r in binning.rectangular_mesh(lats, lons, data).collect()) == [(10.0, 1.0, 0.0), (10.0, 2.0, 1.0), (20.0, 1.0, 2.0), (20.0, 2.0, 3.0)]
