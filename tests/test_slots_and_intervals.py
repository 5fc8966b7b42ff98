import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars, timeslots
from tessera.functions.timeslots import TimeAxis
from tessera.operators import intervals
from tessera.plans import planner


def ranges(spark, rows):
    return spark.createDataFrame([("g", a, b) for a, b in rows], "grp string, start long, end long")


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names or ("start", "end")) for r in df.collect())


def test_slots_floor_exact_and_without_upper_bound(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    times = [t - dt.timedelta(seconds=1), t, t + dt.timedelta(seconds=450), t + dt.timedelta(seconds=300, microseconds=5), t + dt.timedelta(days=900)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(times)] + [(9, None)], "i int, t timestamp")
    floor, exact = TimeAxis(1704067200, 300, size=12), TimeAxis(1704067200, 300, "exact", size=12)
    got = {r["i"]: (r["f"], r["e"], r["why"]) for r in df.select("i", timeslots.slot_of(F.col("t"), floor).alias("f"), timeslots.slot_of(F.col("t"), exact).alias("e"), timeslots.slot_fault(F.col("t"), exact).alias("why")).collect()}
    assert got == {0: (None, None, "before_epoch"), 1: (0, 0, None), 2: (1, None, "off_grid"), 3: (1, None, "sub_second"), 4: (259200, 259200, None), 9: (None, None, None)}
    with pytest.raises(Exception, match="before_epoch"):
        df.where("i = 0").select(timeslots.slot_of(F.col("t"), floor, strict=True)).collect()
    assert floor.length() == 12 and TimeAxis(0, 10, end_s=95).length() == 9
    with pytest.raises(ValueError):
        TimeAxis(0, 10).length()


def test_cf_time_and_iso(spark):
    df = spark.createDataFrame([(0.5, "2024-01-01T00:00:00Z"), (-1.0, "2024-01-01T00:00:00"), (None, "nonsense")], "v double, s string")
    rows = df.select(F.unix_seconds(timeslots.decode_cf_time(F.col("v"), "days since 2000-01-01")).alias("d"), timeslots.iso_to_epoch(F.col("s")).alias("e"), timeslots.strict_iso_fault(F.col("s")).alias("why")).collect()
    assert [r["d"] for r in rows] == [946684800 + 43200, 946684800 - 86400, None]
    assert [r["e"] for r in rows] == [1704067200, None, None] and [r["why"] for r in rows] == [None, "naive", "unreadable"]
    for units, calendar in (("days", "standard"), ("days since 2000-01-01", "noleap")):
        with pytest.raises(ValueError):
            timeslots.decode_cf_time(F.col("v"), units, calendar)


def test_merge_touching_complement_and_clamp(spark):
    merged = intervals.merge(ranges(spark, [(0, 5), (5, 8), (20, 30), (22, 25), (29, 40)]))
    assert pairs(merged) == [(0, 8), (20, 40)]
    totals = spark.createDataFrame([("g", 50), ("empty", 7)], "grp string, total long")
    assert pairs(intervals.complement(merged, totals), "grp", "start", "end") == [("empty", 0, 7), ("g", 8, 20), ("g", 40, 50)]
    assert pairs(intervals.complement(ranges(spark, [(-5, 3), (45, 90)]), totals.where("grp = 'g'"))) == [(3, 45)]


@pytest.mark.parametrize(("given", "total", "aligned", "blocked"), [((73, 1000), 1000, [(100, 1000)], [(73, 100)]), ((950, 1000), 1000, [], [(950, 1000)]), ((0, 250), 1000, [(0, 250)], [])])
def test_alignment_literals(spark, given, total, aligned, blocked):
    rows = intervals.align(ranges(spark, [given]).withColumn("total", F.lit(total)), 100)
    assert pairs(rows.where("kind = 'aligned'")) == aligned and pairs(rows.where("kind = 'blocked'")) == blocked


def test_inclusive_and_half_open_overlap(spark):
    cases = [((0, 9), (10, 20), False), ((0, 10), (10, 20), True), ((10, 20), (0, 10), False), ((9, 20), (0, 10), True)]
    for (a, b), (c, d), want in cases:
        assert spark.range(1).select(intervals.overlaps_inclusive(*[F.lit(x) for x in (a, b, c, d)]).alias("x")).head()["x"] is want


def test_overlap_join_finds_each_pair_once_across_buckets(spark):
    left = spark.createDataFrame([("g", 1, 0, 100), ("g", 2, 50, 60)], "grp string, id long, start long, end long")
    right = spark.createDataFrame([("g", 7, 10, 95), ("g", 8, 60, 61)], "grp string, id long, start long, end long")
    assert pairs(intervals.overlap_join(left, right, 16), "l_id", "r_id", "start", "end") == [(1, 7, 10, 95), (1, 8, 60, 61), (2, 7, 50, 60)]


def test_islands_ranges_and_chunks(spark):
    slots = spark.createDataFrame([("g", s) for s in (1, 2, 2, 3, 7, None)], "grp string, slot long")
    assert pairs(intervals.islands(slots), "start", "end", "n") == [(1, 3, 3), (7, 7, 1)]
    assert pairs(intervals.chunk_ranges(ranges(spark, [(5, 12), (30, 29), (38, 39)]), 10, 40)) == [(0, 9), (10, 19), (30, 39)]
    stored = spark.createDataFrame([("g", [(0, 4), (9, 2), (7, 7)])], "grp string, ranges array<struct<start:bigint,end:bigint>>")
    assert pairs(intervals.half_open(stored)) == [(0, 5), (7, 8)]
    assert stored.select(intervals.slots_in(F.col("ranges")).alias("n")).head()["n"] == 5 - 6 + 1


def test_slot_sizes_and_plan(spark):
    assert planner.slot_sizes({"a": [100, 50], "b": [50], "c": []}) == {"a": 100, "b": 50}
    with pytest.raises(ValueError, match="'a' needs a multiple of 100"):
        planner.slot_sizes({"a": [100], "b": [50]}, 150)
    groups = spark.createDataFrame([("g", 40, 10), ("h", 15, 10)], "grp string, total long, size long")
    plan = planner.plan_slots(ranges(spark, [(10, 20), (35, 36)]), groups)
    assert pairs(plan, "grp", "kind", "start", "end") == [("g", "blocked", 36, 40), ("g", "planned", 0, 10), ("g", "planned", 20, 30), ("g", "planned", 30, 35), ("h", "planned", 0, 10), ("h", "planned", 10, 15)]
    assert planner.slot_range({"JOB_INDEX": "3", "SLOT_SIZE": "10"}) == (30, 40) and planner.slot_range({"JOB_INDEX": "3"}) is None
    assert planner.batch_size_advice(1) == 10 and planner.batch_size_advice(24) == 24
    assert planner.may_run_in_parallel({"a": 100}, {"a": 10}, 20, 100, True) == [] and planner.may_run_in_parallel({"a": 105}, {"a": 10}, 0, 105, True) == []


def test_scalars(spark):
    keys = spark.createDataFrame([("F024/a.b",), ("F024/aXb",), (None,)], "k string")
    assert [r["m"] for r in keys.select(scalars.key_matches(F.col("k"), "F*/a.b").alias("m")).collect()] == [True, True, False]  # a dot is a regular expression
    assert [r["m"] for r in keys.select(scalars.key_matches(F.col("k"), "a[").alias("m")).collect()] == [False] * 3
    meta = spark.createDataFrame([('{"a": 1}',), ('{"a": "1"}',), ('{"a": {"y": 2, "x": 1}}',), ("not json",)], "m string")
    assert [r["e"] for r in meta.select(scalars.meta_equals(F.col("m"), "a", 1).alias("e")).collect()] == [True, False, False, False]
    assert [r["e"] for r in meta.select(scalars.meta_equals(F.col("m"), "a", {"x": 1, "y": 2}).alias("e")).collect()] == [False, False, True, False]
    run_id = scalars.run_id_of_range("base", 10, 20, "a/b c")
    assert run_id == "base__group=a%2Fb%20c__slot=10-20" and scalars.parse_run_range(run_id) == (10, 20, "a/b c") and scalars.parse_run_range("x") is None
    row = spark.createDataFrame([(run_id,)], "r string").select(scalars.run_range(F.col("r")).alias("x")).head()["x"]
    assert (row["start"], row["end"], row["grp"]) == (10, 20, "a/b c")
    assert scalars.coerce_option("yes", bool) is True and scalars.coerce_option("[1]", list) == [1] and scalars.coerce_option("none", int) is None
    assert scalars.parse_uri("s3://b//x//y/") == {"scheme": "s3", "bucket": "b", "path": "/x/y", "remote": True}
    assert scalars.split_codecs(["numcodecs.delta", "bytes", {"name": "zstd", "configuration": {"level": 3}}])[1]["name"] == "bytes"
    assert scalars.compare_codecs(["bytes"], ["bytes", "zstd"]) == ["1 codecs declared, 2 stored"]
    assert scalars.label_value([1] * 6) == "" and scalars.label_value({"a": 1}) == "" and len(scalars.label_value("x" * 200)) == 128
