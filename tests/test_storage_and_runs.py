"""Stores, tables, leases, deletion, and interval algebra over wide ranges, against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import cli, ingest, metrics, plugins, sql
from tessera.claims import ClaimConflictError, Claims
from tessera.functions import scalars
from tessera.functions.timeslots import TimeAxis
from tessera.operators import intervals, tabular
from tessera.plans import resume
from tessera.sources import chunked
from tessera.storage import Store, arrow_file


def test_merge_gaps_and_islands_of_wide_ranges_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for grp, n, top in (("hot", 3000, 60_000), ("few", 5, 20_000), ("dense", 400, 300)):
        rows += [(grp, a, a + rng.randrange(0, 30)) for a in (rng.randrange(top) for _ in range(n))]
    rows += [("long", 0, 50_000), ("long", 49_999, 50_001), ("long", 50_001, 50_010), ("long", 70_000, 70_000)]
    df = spark.createDataFrame(rows, "grp string, start long, end long")

    def merged(grp):
        out = []
        for a, b in sorted((a, b) for g, a, b in rows if g == grp):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(grp, a, b) for a, b in out]

    groups = sorted({r[0] for r in rows})
    assert sorted(tuple(r) for r in intervals.merge(df).collect()) == sorted(x for g in groups for x in merged(g))
    totals = spark.createDataFrame([(g, 65_000) for g in [*groups, "none"]], "grp string, total long")
    gaps = []
    for g in [*groups, "none"]:
        covered, at = {s for _, a, b in merged(g) for s in range(a, b)}, None
        for s in range(65_001):
            if s < 65_000 and s not in covered:
                at = s if at is None else at
            elif at is not None:
                gaps.append((g, at, s))
                at = None
    assert sorted(tuple(r) for r in intervals.complement(df, totals).collect()) == sorted(gaps)
    slots = df.where("start < end").select("grp", F.explode(F.sequence("start", F.col("end") - 1)).alias("slot"))
    want = sorted((g, a, b - 1, b - a) for g in groups for _, a, b in merged(g) if a < b)
    assert sorted(tuple(r) for r in intervals.islands(slots).collect()) == want


def test_places_among_cuts():
    from bisect import bisect_right

    from tessera.session import local_session

    spark = local_session()
    for n in (1, 2, 3, 17, 100):
        cuts = list(range(10, 10 + 3 * n, 3))
        got = spark.range(0, 20 + 3 * n).select("id", tabular._place(F.col("id"), cuts).alias("p")).collect()
        assert all(r["p"] == bisect_right(cuts, r["id"]) for r in got)


def test_new_slots_are_counted_over_parts_of_a_group(spark):
    old = spark.createDataFrame([("g", 5, 0), ("g", 90_000, 1)], "grp string, time long, slot long")
    new = spark.createDataFrame([("g", t) for t in (90_000, 86_399, 86_400, 200_000, 7, 7)] + [("h", 3), ("h", None)], "grp string, time long")
    got = sorted((r["grp"], r["time"], r["slot"]) for r in tabular.resolve_slots(old, new).collect())
    assert got == [("g", 7, 2), ("g", 86_399, 3), ("g", 86_400, 4), ("g", 90_000, 1), ("g", 200_000, 5), ("h", 3, 0)]


def test_store(spark, tmp_path):
    store, root = Store(spark), str(tmp_path / "s")
    store.write(f"{root}/a/x.bin", b"\x00\xffabc")
    assert store.read(f"{root}/a/x.bin") == b"\x00\xffabc" and store.exists(root) and not store.exists(f"{root}/b")
    with pytest.raises(FileExistsError):
        store.write(f"{root}/a/x.bin", b"other", overwrite=False)
    store.copy(f"{root}/a/x.bin", f"{root}/b/y.bin")
    assert sorted(store.files(root)) == [("a/x.bin", 5), ("b/y.bin", 5)] and store.folders(root) == ["a", "b"]
    store.write(f"{root}/new", b"n")
    store.replace(f"{root}/new", f"{root}/a/x.bin")
    assert store.read(f"{root}/a/x.bin") == b"n" and list(store.files(f"{root}/nowhere")) == []
    store.preflight(f"{root}/target")
    assert arrow_file("file:///x/y")[1] == arrow_file("/x/y")[1] == "/x/y"


def test_sql_helpers_refuse_what_could_end_a_statement():
    assert sql.quote_name("db.table_1") == "`db`.`table_1`" and sql.quote_text("it's") == "'it\\'s'"
    for bad in ("a b", "a;b", "a.`b`", ""):
        with pytest.raises(ValueError):
            sql.quote_name(bad)
    for bad in ("k int; drop table x", "k int -- x", "k /* x"):
        with pytest.raises(ValueError):
            sql.check_fragment(bad)


def test_codecs_labels_and_metrics():
    assert [len(x) if isinstance(x, list) else x["name"] for x in scalars.split_codecs(["transpose", "bytes", "zstd", "crc32c"])] == [1, "bytes", 2]
    for bad in (["bytes", "nonsense"], ["bytes", "vlen-utf8"]):
        with pytest.raises(ValueError):
            scalars.split_codecs(bad)
    assert scalars.label_value(["a" * 64, "b"]) == "a" * 64 + ",b" and scalars.label_value(["a" * 65]) == "" and scalars.label_value("x" * 200) == "x" * 128
    assert metrics.label_name(" 9 lives-") == "_9_lives" and metrics.label_name("--") == "label"
    assert metrics.exposition({"n": 2, "x": float("nan"), "ok": True, "s": "t"}, {"a": 'q"'}).splitlines()[1::2] == ['tessera_run_n{a="q\\""} 2', 'tessera_run_ok{a="q\\""} 1']
    assert chunked.crc32c(b"123456789") == 0xE3069283


class Minutes:
    name = "minutes"
    axes = {"g": TimeAxis(1704067200, 60, size=1000)}

    def discover(self, spark, source):
        return spark.createDataFrame([(i,) for i in range(*map(int, source.split("-")))], "i int")

    def build(self, items):
        return items.select(F.lit("g").alias("grp"), F.timestamp_seconds(F.col("i") * 60 + 1704067200).alias("time"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.rand().alias("v"))


def slots_of(spark, product):
    return sorted(r["slot"] for r in spark.read.parquet(product.data).collect())


def test_a_run_that_broke_off_can_be_repeated(spark, tmp_path, monkeypatch):
    product = ingest.Product("demo", str(tmp_path / "demo"))
    real = ingest.Product.append_events

    def breaks(self, *a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(ingest.Product, "append_events", breaks)
    with pytest.raises(KeyboardInterrupt):
        ingest.run(spark, Minutes(), product, "0-20", chunk=10)
    monkeypatch.setattr(ingest.Product, "append_events", real)
    assert slots_of(spark, product) == list(range(20)) and product.state(spark).isEmpty()
    open_runs = [r["run_id"] for r in product.runs(spark).collect()]
    with pytest.raises(resume.ConflictError):  # the run counts as active until it is given up
        ingest.run(spark, Minutes(), product, "0-20", chunk=10)
    assert product.abandon(spark, open_runs[0], "broke off")
    ingest.run(spark, Minutes(), product, "0-20", chunk=10)
    assert slots_of(spark, product) == list(range(20))
    with pytest.raises(resume.ConflictError, match="stored already"):
        ingest.run(spark, Minutes(), product, "15-25", chunk=10)
    assert Claims(spark, f"{product.root}/_control/claims").list() == []


def test_races_are_refused(spark, tmp_path):
    product = ingest.Product("demo", str(tmp_path / "demo"))
    claims = Claims(spark, f"{product.root}/_control/claims")
    with claims.held("demo", "decision", "all", "other"), pytest.raises(ClaimConflictError):
        ingest.run(spark, Minutes(), product, "0-5")
    assert product.runs(spark).isEmpty()


def test_snapshot_deletion_and_restoration_by_commands(spark, tmp_path, capsys):
    product = ingest.Product("demo", str(tmp_path / "demo"))
    first = ingest.run(spark, Minutes(), product, "0-25", chunk=10)
    shown = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert cli.main(["snapshot", product.root]) == 0
    second = ingest.run(spark, Minutes(), product, "30-40", chunk=10)
    assert product.snapshot(spark)[1] is not None and {r["run_id"] for r in product.state(spark).collect()} == {first["run_id"], second["run_id"]}
    capsys.readouterr()
    assert cli.main(["chunks-delete", product.root, "--pattern", f"{first['run_id']}/*", "--chunk", "10"]) == 0
    assert shown()["deleted"] == 0 and len(slots_of(spark, product)) == 35
    assert cli.main(["archive-create", product.root, f"{product.root}-a"]) == 0
    assert cli.main(["chunks-delete", product.root, "--pattern", f"{first['run_id']}/*", "--chunk", "10", "--yes"]) == 0
    assert shown()["deleted"] == 1 and slots_of(spark, product) == list(range(30, 40))
    assert [p for p in Store(spark).folders(f"{product.data}/grp=g")] == ["chunk=3"]
    assert {r["run_id"]: r["status"] for r in product.state(spark).collect()} == {first["run_id"]: "replaced", second["run_id"]: "active"}
    assert cli.main(["archive-restore", f"{product.root}-a", f"{product.root}-back", "--chunk", "10"]) == 0
    back = ingest.Product("demo", f"{product.root}-back")
    assert len(slots_of(spark, back)) == 35 and {r["status"] for r in back.state(spark).collect()} == {"active"}


def test_batches_hooks_and_options(spark, tmp_path):
    from dataclasses import dataclass

    class Batched(Minutes):
        @dataclass
        class Options:
            top: int = 3

        def prepare_batch(self, batch):
            seen.append(("prepare", batch))

        def cleanup_batch(self, batch):
            seen.append(("cleanup", batch))

        def aggregate(self, batches):
            return batches.agg(F.count("*").alias("mine"))

        def prepare_tables(self, spark):
            spark.range(1).createOrReplaceTempView("prepared")

    seen, product = [], ingest.Product("demo", str(tmp_path / "demo"))
    plugin = plugins.configure(Batched, {"top": "4", "batch_items": "8", "workers": "2", "x_try": "1"})
    assert plugin.options.top == 4 and plugin.engine.batch_items == 8 and plugin.experimental == {"x_try": "1"}
    ended = ingest.run(spark, plugin, product, "0-20", **vars(plugin.engine))
    assert ended["summary"]["mine"] == 3 and ended["rows"] == 20 and sorted(seen) == sorted((k, f"batch_{i:04d}") for k in ("prepare", "cleanup") for i in range(3))
    text = Store(spark).read(f"{product.root}/_control/metrics/{ended['run_id']}.prom").decode()
    assert "tessera_run_rows{" in text and spark.table("prepared").count() == 1
    with pytest.raises(ValueError, match="unknown options: typo"):
        plugins.configure(Batched, {"typo": "1"})


def test_many_batches_are_built_by_few_jobs_and_fail_one_by_one(spark, tmp_path):
    def ran(name, per_item, build, source="0-120", **more):
        calls, held, plugin, product = [], [], Minutes(), ingest.Product("demo", str(tmp_path / name))
        plugin.per_item, plugin.prepare_batch, plugin.cleanup_batch = per_item, held.append, held.remove
        plugin.build = lambda items: calls.append(1) or build(items)
        first = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
        ended = ingest.run(spark, plugin, product, source, batch_items=2, workers=2, **more)
        assert not held
        failed = {r["batch_id"] for r in product.events(spark).where("event_type = 'batch_failed'").select(F.get_json_object("record", "$.batch_id").alias("batch_id")).collect()}
        return slots_of(spark, product), failed, len(calls), max(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - first, ended["summary"]

    every, whole = list(range(120)), Minutes().build
    slots, failed, calls, jobs, summary = ran("each", False, whole)
    assert sorted(slots) == every and not failed and calls == 60 and jobs < 60 and summary["batches_total"] == 60
    slots, failed, calls, jobs, summary = ran("items", True, whole)
    assert sorted(slots) == every and not failed and calls == 1 and jobs < 60 and summary["batches_total"] == 60
    # A build over a batch sees the items of that batch only.
    slots, *_ = ran("least", False, lambda items: whole(items).groupBy("grp").agg(F.min("time").alias("time"), F.min("v").alias("v")))
    assert sorted(slots) == every[::2]
    # Batch 7 fails where its rows are made, not where its plan is.
    broken = lambda items: whole(items).withColumn("v", F.when(F.unix_seconds("time") % 7200 == 14 * 60, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v")))
    for per_item in (False, True):
        slots, failed, *_ = ran(f"broken{per_item}", per_item, broken, "0-20", keep_going=True)
        assert sorted(slots) == [s for s in every[:20] if s not in (14, 15)] and failed == {"batch_0007"}
        with pytest.raises(Exception, match="broken"):
            ran(f"stopped{per_item}", per_item, broken, "0-20")


def test_batches_that_cant_be_prepared_are_left_out_of_the_jobs(spark, tmp_path):
    def prepare(batch):
        if int(batch[-4:]) % 3 == 1:
            raise RuntimeError(f"no {batch}")

    plugin, cleaned, product = Minutes(), [], ingest.Product("demo", str(tmp_path / "demo"))
    plugin.per_item, plugin.prepare_batch, plugin.cleanup_batch = True, prepare, cleaned.append
    first = max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)
    ended = ingest.run(spark, plugin, product, "0-120", batch_items=2, keep_going=True)
    assert max(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - first < 40
    failed = product.events(spark).where("event_type = 'batch_failed'").select(F.get_json_object("record", "$.batch_id").alias("b"), F.get_json_object("meta", "$.error").alias("e")).collect()
    assert {(r["b"], r["e"]) for r in failed} == {(f"batch_{i:04d}", f"no batch_{i:04d}") for i in range(1, 60, 3)}
    assert slots_of(spark, product) == [s for s in range(120) if s // 2 % 3 != 1]
    assert ended["summary"]["batches_failed"] == 20 and sorted(cleaned) == [f"batch_{i:04d}" for i in range(60)]
