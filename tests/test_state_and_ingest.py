import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli, ingest, model, plugins
from tessera.claims import ClaimConflictError, Claims
from tessera.functions.timeslots import TimeAxis
from tessera.operators import state_log, tabular
from tessera.plans import resume
from tessera.sinks import cube
from tessera.sources import chunked, files
from tessera.validators import chunks, conventions, parquet_files


def log(spark, events, runs):
    rows = [("p", run, 0, i, str(i), kind, float(t), json.dumps({"schema_version": 1, "timestamp": t} | record), json.dumps(record.get("meta", {}))) for i, (run, t, kind, record) in enumerate(events)]
    states = [("p", run, status, 0.0, float(done or 0), done, None, None, None, 100, slots, group) for run, status, done, slots, group in runs]
    return spark.createDataFrame(rows, model.EVENTS), spark.createDataFrame(states, model.RUNS)


def span(key, **more):
    return {"key": key, "type": "span", "status": "active", "grp": "F024", "time_min": "2024-01-01", "time_max": "2024-01-02", "ranges": [{"start": 0, "end": 1}]} | more


def test_replacement_only_touches_keys_that_exist_at_that_point(spark):
    events, runs = log(spark, [("a", 2, "span", span("A")), ("b", 3, state_log.STARTED, {}), ("b", 4, "span", span("B")), ("b", 5, state_log.COMMITTED, {"replacing_run_id": "b", "replaced_span_keys": ["A", "C"], "timestamp": 5.0}), ("c", 6, "span", span("C"))], [("a", "complete", 2.0, None, None), ("b", "complete", 5.0, None, None), ("c", "complete", 6.0, None, None)])
    got = {r["key"]: (r["status"], r["replaced_by"], r["replaced_at"]) for r in state_log.project(events, runs).collect()}
    assert got == {"A": ("replaced", "b", 5.0), "B": ("active", None, None), "C": ("active", None, None)}


def test_incomplete_runs_only_show_in_history(spark):
    events, runs = log(spark, [("a", 2, "span", span("A")), ("x", 3, "span", span("A", size=7)), ("a", 4, "run", span("R", type="run"))], [("a", "complete", 2.0, None, None), ("x", "running", None, None, None)])
    now = state_log.list_records(events, runs)
    assert [(r["key"], r["size"]) for r in now.collect()] == [("A", None)]
    assert state_log.list_records(events, runs, include_replaced=True, dedupe=False).count() == 2
    assert state_log.list_records(events, runs, kind="run").count() == 1
    assert state_log.list_records(events, runs, before=2.0).count() == 0 and state_log.list_records(events, runs, after=1.9).count() == 1
    assert state_log.list_records(events, runs, time_min_after="nonsense").count() == 0


def test_duplicate_active_spans_keep_the_greatest_run(spark):
    events, runs = log(spark, [("run-aaa", 1, "span", span("1")), ("run-zzz", 2, "span", span("2")), ("run-zzz", 3, "span", span("3", grp="F048"))], [("run-aaa", "complete", 1.0, None, None), ("run-zzz", "complete", 2.0, None, None)])
    assert sorted(r["key"] for r in state_log.list_records(events, runs).collect()) == ["2", "3"]
    nameless = state_log.project(events, runs).withColumn("run_id", F.lit(None).cast("string"))
    assert state_log.dedupe_active(nameless).count() == 3  # without run ids nothing is dropped


def test_summary_stale_orphans_and_marking(spark):
    events, runs = log(spark, [("a", 1, "span", span("1", ranges=[{"start": 0, "end": 9}])), ("a", 2, "span", span("2", grp=None))], [("a", "complete", 2.0, None, None), ("b", "running", 5.0, None, None)])
    state = state_log.project(events, runs)
    assert [tuple(r) for r in state_log.coverage_summary(state).collect()] == [("F024", "2024-01-01", "2024-01-02", 1, 10), ("unknown", "2024-01-01", "2024-01-02", 1, 2)]
    assert [r["run_id"] for r in state_log.stale_runs(runs, 200.0).collect()] == ["b"] and state_log.stale_runs(runs, 50.0).count() == 0
    lost = state_log.with_orphans(runs, spark.createDataFrame([("p", "zz")], "product string, run_id string"))
    assert state_log.list_runs(lost, non_terminal=True).where("status = 'orphaned'").count() == 1
    marked = state_log.replaced_events(state, spark.createDataFrame([("1",), ("9",)], "key string"), "m", 9.0)
    after = state_log.project(events.unionByName(marked), runs.unionByName(log(spark, [], [("m", "complete", 9.0, None, None)])[1]))
    assert {r["key"]: r["status"] for r in after.collect()} == {"1": "replaced", "2": "active"}


@pytest.mark.parametrize(("asked", "group", "again", "blocked"), [((0, 10), None, False, True), ((0, 10), None, True, False), ((5, 15), None, True, True), ((10, 20), None, False, False), ((0, 10), "other", False, False), (None, None, False, True)])
def test_run_conflicts(spark, asked, group, again, blocked):
    _, runs = log(spark, [], [("r", "running", 1.0, [0, 10], "mine")])
    assert (resume.conflicting_runs(runs, 2.0, asked, group, again).count() > 0) is blocked


def test_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in tabular.deduplicate(rows, ["k"]).collect()) == [(1, "a"), (2, "c")]
    assert tabular.dedup_stats(rows.where("false"), ["k"]).head().asDict() == {"total_rows": 0, "unique_rows": 0, "duplicate_rows": 0, "duplicate_ratio": 0.0}
    many = spark.range(1000).withColumn("n", F.lit(2))
    old, tabular.PART_ROWS = tabular.PART_ROWS, 100
    try:
        got = tabular.running_total(many, F.col("n"), "id", "t").orderBy("id").collect()
    finally:
        tabular.PART_ROWS = old
    assert [r["t"] for r in got] == [2 * i for i in range(1000)]


def test_cube_append_regions_static_archive(spark, tmp_path):
    at = str(tmp_path / "cube")
    rows = lambda slots, v: spark.createDataFrame([("g", s, f"2024-01-01 00:{s:02d}:00", 0, 0, v) for s in slots], "grp string, slot long, time string, y int, x int, v double").withColumn("time", F.to_timestamp("time"))
    cube.append(rows(range(4), 1.0), at, 2)
    cube.append(rows(range(4, 6), 1.0), at, 2)
    with pytest.raises(resume.ConflictError, match="stored already"):
        cube.append(rows(range(5, 8), 1.0), at, 2)
    with pytest.raises(cube.SchemaDriftError):
        cube.append(rows(range(8, 9), 1.0).withColumn("more", F.lit(1)), at, 2)
    cube.write_regions(rows([1], 5.0), at, ["grp", "slot", "y", "x"], 2)
    assert sorted((r["slot"], r["v"]) for r in spark.read.parquet(at).collect()) == [(0, 1.0), (1, 5.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 1.0)]
    static = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "x int, lat double")
    assert cube.write_static(static, f"{at}-static") and not cube.write_static(static, f"{at}-static")
    with pytest.raises(cube.SchemaDriftError):
        cube.write_static(static.withColumn("lat", F.lit(3.0)), f"{at}-static")
    facts = cube.create_archive(spark.read.parquet(at), f"{at}-archive", variables=["v"], end="2024-01-01 00:03:00")
    assert facts["rows"] == 4 and cube.validate_archive(spark, f"{at}-archive") and cube.archive_info(spark, f"{at}-archive") == facts
    assert cube.restore_archive(spark, f"{at}-archive", f"{at}-back", 2) == 4
    with pytest.raises(FileExistsError):
        cube.restore_archive(spark, f"{at}-archive", f"{at}-back", 2)


def test_chunked_arrays_round_trip_and_reports(spark, tmp_path):
    path = str(tmp_path / "store/g/v")
    values = np.arange(35, dtype=float).reshape(7, 5)
    rows = spark.createDataFrame([(t, x, float(values[t, x])) for t in range(7) for x in range(5) if (t, x) != (3, 3)], "time long, x long, value double")
    assert chunked.write_array(rows, path, ["time", "x"], [7, 5], [3, 2]) == 9
    got = {(r["time"], r["x"]): r["value"] for r in chunked.read_array(spark, path).collect()}
    assert len(got) == 35 and got[3, 3] is None and all(got[k] == values[k] for k in got if k != (3, 3))
    assert chunked.read_array(spark, path, (2, 4)).count() == 10
    assert chunked.read_array(spark, path, bounds={"time": [2, 5], "x": [1, 3]}).count() == 6
    update = spark.createDataFrame([(3, 3, 9.0), (8, 0, 7.0)], "time long, x long, value double")
    assert chunked.write_array(update, f"{path}2", ["time", "x"], [7, 5], [3, 2]) == 2
    assert chunked.write_array(update, path, ["time", "x"], [9, 5], [3, 2], update=True) == 2 and chunked.array_meta(path)["shape"] == [9, 5]
    again = {(r["time"], r["x"]): r["value"] for r in chunked.read_array(spark, path).collect()}
    assert again[3, 3] == 9.0 and again[8, 0] == 7.0 and all(again[k] == values[k] for k in got if k != (3, 3))
    with pytest.raises(ValueError, match="another layout"):
        chunked.create_array(path, ["time", "x"], [9, 6], [3, 2])
    (tmp_path / "store/g/v/zarr.json").write_text((tmp_path / "store/g/v/zarr.json").read_text().replace("[9, 5]", "[7, 5]"))
    listing = files.listing(spark, path)
    assert [(r["dim"], r["expected"], r["max_index"], r["missing"]) for r in chunks.dimension_report(listing, ["time", "x"], [7, 5], [3, 2]).orderBy("dim").collect()] == [("time", 3, 2, []), ("x", 3, 2, [])]
    os.remove(f"{path}/c/0/1")  # a hole that no single dimension shows
    listing = files.listing(spark, path)
    assert all(not r["missing"] for r in chunks.dimension_report(listing, ["time", "x"], [7, 5], [3, 2]).collect())
    assert [list(r["indices"]) for r in chunks.missing_chunks(listing, [7, 5], [3, 2]).collect()] == [[0, 1]]
    assert chunks.extra_chunks(listing, [6, 5], [3, 2]).count() == 3 and chunks.budgeted(listing, 3)[1]
    assert chunked.inner_chunk(1000) == 250 and chunked.inner_chunk(7) == 1
    assert chunked.discover_groups(str(tmp_path / "store")) == []


def test_sharded_and_transposed_arrays_are_read(spark, tmp_path):
    import zstandard

    values, folder = np.arange(48, dtype=np.float32).reshape(8, 6), tmp_path / "v"
    inner = [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 1}}]
    shard = {"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3], "codecs": inner, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}}
    meta = {"zarr_format": 3, "node_type": "array", "shape": [8, 6], "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 6]}}, "fill_value": "NaN", "codecs": [shard], "dimension_names": ["time", "x"]}
    for i in range(2):
        body, index = b"", []
        for a in range(2):
            for b in range(2):
                if (i, a, b) == (1, 1, 0):
                    index += [2**64 - 1, 2**64 - 1]  # an inner chunk that isn't stored
                    continue
                block = values[4 * i + 2 * a : 4 * i + 2 * a + 2, 3 * b : 3 * b + 3]
                raw = zstandard.ZstdCompressor().compress(np.ascontiguousarray(block.T).tobytes())
                index += [len(body), len(raw)]
                body += raw
        (folder / "c" / str(i)).mkdir(parents=True)
        (folder / "c" / str(i) / "0").write_bytes(body + np.array(index, "<u8").tobytes() + b"crc!")
    (folder / "zarr.json").write_text(json.dumps(meta))
    got = {(r["time"], r["x"]): r["value"] for r in chunked.read_array(spark, f"file://{folder}").collect()}
    assert got == {(t, x): values[t, x] for t in range(8) for x in range(6) if not (t >= 6 and x < 3)}
    assert chunked.array_meta(str(folder))["shards"] == [4, 6] and chunked.read_array(spark, str(folder), bounds={"time": [3, 5], "x": [4, 6]}).count() == 4


def test_conventions_report(spark):
    attributes = [(None, "Conventions", "CF-1.8"), (None, "title", "t"), ("time", "units", "days since 2000-01-01"), ("time", "calendar", "standard"), ("time", "axis", "T"), ("lat", "units", "degrees_north"), ("lon", "units", "degrees_east"), ("v", "units", "K"), ("v", "long_name", "v"), ("v", "coordinates", "lat nowhere"), ("lat", "bounds", "lat_b")]
    variables = [("time", True, ["time"], [3], False), ("lat", True, ["lat"], [4], False), ("lon", True, ["lon"], [5], False), ("v", False, ["time", "lat", "lon"], [3, 4, 5], False), ("lat_b", False, ["lat"], [4], True)]
    values = [("lat", 0, 1.0), ("lat", 1, 3.0), ("lat", 2, 2.0)]
    found = conventions.report(spark.createDataFrame(attributes, "var string, attr string, value string"), spark.createDataFrame(variables, "var string, is_coord boolean, dims array<string>, shape array<bigint>, internal boolean"), spark.createDataFrame(values, "var string, pos int, value double"))
    assert sorted((r["code"], r["location"]) for r in found.collect()) == [("CF003", "/"), ("CF012", "v"), ("CF013", "lat_b"), ("CF015", "lat")]
    assert conventions.exit_code(found) == 1 and conventions.exit_code(found.where("severity <> 'error'"), strict=True) == 2


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.parquet").write_bytes(b"PAR1")
    (tmp_path / "a/y.parquet").write_bytes(b"PAR1" + b"0" * 8 + b"PARX")
    (tmp_path / "b.dat").write_bytes(files.HDF5_MAGIC + b"rest")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme", "x")
        z.writestr("d/data.h5", "inner")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    assert {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in parquet_files.bad_files(spark, str(tmp_path)).collect()} == {"x.parquet": "short", "y.parquet": "tail"}
    assert [r["name"] for r in files.discover(spark, str(tmp_path), exclude=["bad*"]).collect()] == ["b.dat", "z.zip"]
    members = {r["path"].rsplit("/", 1)[-1]: (r["member"], r["error"] is None) for r in files.archive_members(spark, str(tmp_path)).collect()}
    assert members == {"z.zip": ("d/data.h5", True), "bad.zip": (None, False)}
    (tmp_path / "f.csv").write_text("# comment\nday,time,frp\n2024-07-01,10:11:12,3.5\n")
    row = files.detections(spark, str(tmp_path / "f.csv")).head()
    assert str(row["timestamp"]) == "2024-07-01 10:11:12" and row["source_product"] == "f.csv" and row["frp"] == 3.5


def test_torn_tail_of_a_segment(spark, tmp_path):
    folder = tmp_path / "prod/runs/r1"
    folder.mkdir(parents=True)
    line = json.dumps({"event_id": "1", "event_type": "span", "timestamp": 1.0, "record": "{}", "meta": "{}"})
    (folder / "events-00000.jsonl").write_text(line + "\n" + line[: len(line) // 2])
    assert files.event_segments(spark, str(tmp_path)).count() == 1
    (folder / "events-00000.jsonl").write_text(line[:20] + "\n" + line + "\n")
    with pytest.raises(Exception, match="unreadable event"):
        files.event_segments(spark, str(tmp_path)).collect()


def test_claims(spark, tmp_path):
    claims = Claims(spark, str(tmp_path / "claims"), threshold_s=10)
    path = claims.acquire("p", "group", "g", "me", now=0.0)
    with pytest.raises(ClaimConflictError):
        claims.acquire("p", "group", "g", "you", now=100.0)
    assert claims.list(now=5.0)[0]["stale"] is False and claims.clear_stale(now=50.0) == [path] and os.path.exists(path)
    claims.clear_stale(now=50.0, dry_run=False)
    assert claims.list() == []


def test_ingest_end_to_end_with_replacement_and_commands(spark, tmp_path, capsys):
    @plugins.register("demo")
    class Demo:
        axes = {"g": TimeAxis(1704067200, 60, size=100)}

        def discover(self, spark, source):
            return spark.createDataFrame([(i,) for i in range(*map(int, source.split("-")))], "i int")

        def build(self, items):
            return items.select(F.lit("g").alias("grp"), F.timestamp_seconds(F.col("i") * 60 + 1704067200).alias("time"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("i").cast("double").alias("v"))

    product = ingest.Product("demo", str(tmp_path / "demo"))
    first = ingest.run(spark, Demo(), product, "0-10", chunk=10)
    assert (first["rows"], first["decision"]) == (10, "fresh")
    with pytest.raises(resume.ConflictError):
        ingest.run(spark, Demo(), product, "5-12", chunk=10)
    again = ingest.run(spark, Demo(), product, "0-10", chunk=10, force=True)
    state = {r["key"]: r["status"] for r in product.state(spark).collect()}
    assert state == {f"{first['run_id']}/g": "replaced", f"{again['run_id']}/g": "active"}
    assert spark.read.parquet(product.data).count() == 10
    assert cli.main(["slots", product.root, "--total", "30", "--size", "10", "--groups", "g"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == [{"grp": "g", "kind": "planned", "start": 10, "end": 20}, {"grp": "g", "kind": "planned", "start": 20, "end": 30}]
    assert cli.main(["chunks-list", product.root]) == 0 and again["run_id"] in capsys.readouterr().out
    assert cli.main(["snapshot", product.root]) == 0 and cli.main(["plugins-list"]) == 0
    assert "demo" in capsys.readouterr().out


def test_streaming_slots(spark, tmp_path):
    from tessera.streaming import slots

    rows = spark.createDataFrame([("g", "2024-01-01 00:10:00", 1.0), ("g", "2024-01-01 00:50:00", 2.0), ("g", "2024-01-01 01:10:00", 4.0)], "grp string, time string, value double").withColumn("time", F.to_timestamp("time"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = slots.windowed(slots.arriving(spark, str(tmp_path / "in"), "grp string, time timestamp, value double"), "1 hour")
    q = stream.writeStream.format("memory").queryName("slots").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.table("slots").collect()) == [(1, 4.0), (2, 3.0)]
    q = slots.upsert_stream(slots.arriving(spark, str(tmp_path / "in"), "grp string, time timestamp, value double"), str(tmp_path / "t"), ["grp", "time"], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert slots.current(spark, str(tmp_path / "t")).count() == 3
    rows.where("value = 2").withColumn("value", F.lit(9.0)).write.mode("append").parquet(str(tmp_path / "in"))
    counts = []
    q = slots.upsert_stream(slots.arriving(spark, str(tmp_path / "in"), "grp string, time timestamp, value double"), str(tmp_path / "t"), ["grp", "time"], str(tmp_path / "cp"), lambda epoch, n: counts.append((epoch, n)))
    q.awaitTermination(60)
    assert sorted(r["value"] for r in slots.current(spark, str(tmp_path / "t")).collect()) == [1.0, 4.0, 9.0] and counts == [(1, 3)]
    assert len(list((tmp_path / "t").glob("epoch=*/bucket=*"))) == len({p.name for p in (tmp_path / "t").glob("epoch=*/bucket=*")})
