import pytest
from pyspark.sql import functions as F

from tessera.functions import variables
from tessera.plans import resume


def test_names_hints_and_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0, float("nan"))], "time int, a double, b double").withMetadata("a", {"units": "K", "chunksizes": 3})
    out = variables.prepare(df)
    assert out.columns == ["timestamp", "a", "b"] and out.schema["a"].metadata == {"units": "K"}
    assert variables.rename_time_dim(out).columns == out.columns
    assert variables.to_missing(df, ["b"]).head()["b"] is None
    assert variables.to_nan(variables.to_missing(df, ["b"]), ["b"]).where(F.isnan("b")).count() == 1


def test_text_and_times(spark):
    df = spark.createDataFrame([(b"2024-01-01T00:00:00Z\x00", 1.5, 2)], "t binary, d double, pos int")
    out = variables.decode_times(variables.normalise_text(df, ["t"]), {"d": {"units": "hours since 2024-01-01"}, "absent": {"units": "x"}})
    row = out.select(F.unix_seconds("t").alias("t"), F.unix_seconds("d").alias("d")).head()
    assert (row["t"], row["d"]) == (1704067200, 1704067200 + 5400)
    with pytest.raises(Exception, match="naive"):
        variables.normalise_text(spark.createDataFrame([("2024-01-01T00:00:00",)], "t string"), ["t"]).collect()


def test_first_and_last_by_position(spark):
    rows = spark.createDataFrame([(5, 2), (1, 9), (9, 4)], "time int, pos int")
    assert tuple(variables.first_last_count(rows).head()) == (5, 1, 3)
    spans = spark.createDataFrame([("2024-01-02T00:00:00", "nonsense"), ("2024-01-01T00:00:00", "2024-01-05T00:00:00")], "time_min string, time_max string")
    assert [str(x) for x in variables.time_bounds(spans).head()] == ["2024-01-01 00:00:00", "2024-01-05 00:00:00"]


def test_gates(spark):
    resume.check_shards({"t": 100}, {"t": 100, "x": 5})
    resume.check_version("1.2.0", "1.10.0")
    with pytest.raises(ValueError):
        resume.check_shards({"t": 100}, {"t": 50})
    with pytest.raises(ValueError):
        resume.check_version("2.0.0", "1.10.0")
    asked, declared = spark.createDataFrame([("a",), ("b",)], "grp string"), spark.createDataFrame([("a",)], "grp string")
    assert [r["grp"] for r in resume.missing_groups(asked, declared).collect()] == ["b"]
