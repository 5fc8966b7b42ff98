"""The registered queries of scalar, planning and metadata rules, each with the SQL that gives the same rows.

Rules that run on the driver are applied to the rows of a small table; the SQL states what must come out.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import plugins
from tessera.catalogue import EPOCH, LOG_SQL, SAMPLES_SQL, _log, _samples, _table, query
from tessera.functions import scalars, timeslots, variables
from tessera.functions.timeslots import TimeAxis
from tessera.operators import intervals, state_log, tabular
from tessera.plans import planner, resume
from tessera.validators import chunks, conventions


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, int]]:
    return sorted((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in _table(spark, sf_dir, "nation").collect())


def _fault(run) -> str:
    """What a refusal says, or nothing."""
    try:
        run()
    except (ValueError, resume.ConflictError) as problem:
        return str(problem)
    return ""


# --- metadata and keys ----------------------------------------------------------------------------------------------


@query("select n_name as name, case n_regionkey when 0 then n_name || ',' || n_nationkey when 1 then '' when 2 then repeat('x', 64) when 3 then '' else left(repeat(n_name, 40), 128) end as label from nation")
def label_values(spark, sf_dir):
    """Short lists joined, long ones and those with long items empty, texts cut."""
    made = lambda k, n, r: ([n, k], [n] * 6, ["x" * 64], ["x" * 65], n * 40)[r]
    return spark.createDataFrame([(n, scalars.label_value(made(k, n, r))) for k, n, r in _nations(spark, sf_dir)], "name string, label string")


@query("select c_custkey, left(repeat(c_name, 9), 128) as label from customer")
def label_texts(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", scalars.label_text(F.repeat("c_name", 9)).alias("label"))


@query("select n_nationkey as k, sha256('{\"axis\":[' || n_nationkey || ',' || n_regionkey || '],\"name\":\"' || n_name || '\"}') as hash from nation")
def identity_hashes(spark, sf_dir):
    """The order of keys doesn't matter."""
    return spark.createDataFrame([(k, scalars.identity_hash({"name": n, "axis": [k, r]})) for k, n, r in _nations(spark, sf_dir)], "k int, hash string")


@query("select n_nationkey as k, '[' || least(n_nationkey, n_regionkey) || ', ' || greatest(n_nationkey, n_regionkey) || ']' as text from nation where n_nationkey <> n_regionkey union all select n_nationkey, '[' || n_nationkey || ']' from nation where n_nationkey = n_regionkey")
def canonical_values(spark, sf_dir):
    return spark.createDataFrame([(k, json.dumps(scalars.canonical_value({k, r}))) for k, _, r in _nations(spark, sf_dir)], "k int, text string")


@query("select n_name as k, case when n_nationkey % 2 = 0 then n_nationkey::varchar else '\"x' || n_nationkey || '\"' end as value from nation")
def meta_filters(spark, sf_dir):
    """key=value pairs; a value that is JSON is taken as such."""
    found = scalars.parse_meta_filters([f"{n}={k}" if k % 2 == 0 else f"{n}=x{k}" for k, n, _ in _nations(spark, sf_dir)])
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in found.items()], "k string, value string")


@query("select n_nationkey as k, '2024-01-' || lpad((n_nationkey + 1)::varchar, 2, '0') as first, '2024-02-01' as last, false as refused from nation where n_regionkey <> 0 union all select n_nationkey, null, null, true from nation where n_regionkey = 0")
def time_ranges(spark, sf_dir):
    def row(k: int, region: int) -> tuple:
        text = f"2024-01-{k + 1:02d}" + (":2024-02-01" if region else ":2024-2-1")
        return (k, None, None, True) if _fault(lambda: scalars.parse_time_range(text)) else (k, *scalars.parse_time_range(text), False)

    return spark.createDataFrame([row(k, r) for k, _, r in _nations(spark, sf_dir)], "k int, first string, last string, refused boolean")


@query("select n_nationkey as k, case n_regionkey when 0 then 's3a' when 1 then 'file' when 2 then 'hdfs' else 'file' end as scheme, case n_regionkey when 0 then 'bucket' when 2 then 'host:8020' end as bucket, case n_regionkey when 3 then 'C:/data/' || n_nationkey else '/p/' || n_nationkey end as path, n_regionkey in (0, 2) as remote, '' as fault from nation where n_regionkey < 4 union all select n_nationkey, null, null, null, null, 'query or fragment in ''s3a://bucket/p?x=' || n_nationkey || '''' from nation where n_regionkey = 4")
def uris(spark, sf_dir):
    def row(k: int, region: int) -> tuple:
        text = (f"s3a://bucket//p/{k}/", f"/p//{k}", f"hdfs://host:8020/p/{k}", f"C:\\data\\{k}", f"s3a://bucket/p?x={k}")[region]
        fault = _fault(lambda: scalars.parse_uri(text))
        u = dict.fromkeys(("scheme", "bucket", "path", "remote")) if fault else scalars.parse_uri(text)
        return (k, u["scheme"], u["bucket"], u["path"], u["remote"], fault)

    return spark.createDataFrame([row(k, r) for k, _, r in _nations(spark, sf_dir)], "k int, scheme string, bucket string, path string, remote boolean, fault string")


@query("select n_nationkey as k, case when n_regionkey = 0 then 'key ${MISSING}' else 'key secret-' || n_regionkey end as text from nation")
def placeholders(spark, sf_dir):
    """Placeholders of known variables are filled in, in nested values too; others stay."""
    env = {f"R{r}": f"secret-{r}" for r in range(5)}
    rows = [(k, scalars.substitute_env({"a": ["key ${R%d}" % r if r else "key ${MISSING}"]}, env)["a"][0]) for k, _, r in _nations(spark, sf_dir)]
    return spark.createDataFrame(rows, "k int, text string")


@query("select n_nationkey as k, case n_regionkey when 0 then '1|bytes|2' when 1 then '0|bytes|1' when 2 then '0|sharding_indexed|0' when 3 then 'unknown codec ''nonsense''' else 'more than one codec turns the array to bytes' end as found from nation")
def codec_split(spark, sf_dir):
    pipelines = (["transpose", "bytes", "zstd", "crc32c"], ["bytes", {"name": "gzip", "configuration": {"level": 1}}], [{"name": "sharding_indexed"}], ["bytes", "nonsense"], ["bytes", "vlen-utf8"])

    def shown(region: int) -> str:
        if fault := _fault(lambda: scalars.split_codecs(pipelines[region])):
            return fault
        filters, serializer, compressors = scalars.split_codecs(pipelines[region])
        return f"{len(filters)}|{serializer['name']}|{len(compressors)}"

    return spark.createDataFrame([(k, shown(r)) for k, _, r in _nations(spark, sf_dir)], "k int, found string")


@query("select n_nationkey as k, case when n_nationkey % 5 = 0 then 0 else 1 end + case when n_regionkey = 3 then 1 else 0 end as differences from nation")
def codec_compare(spark, sf_dir):
    """Levels of compression compared; region 3 has a codec more."""
    declared = lambda k: ["bytes", {"name": "zstd", "configuration": {"level": k % 5, "checksum": False}}]
    stored = lambda r: [{"name": "bytes"}, {"configuration": {"checksum": False, "level": 0}, "name": "zstd"}, *(["crc32c"] if r == 3 else [])]
    return spark.createDataFrame([(k, len(scalars.compare_codecs(declared(k), stored(r)))) for k, _, r in _nations(spark, sf_dir)], "k int, differences int")


@query("select a.n_nationkey as a, b.n_nationkey as b, (a.n_nationkey % 5 = b.n_nationkey % 5) as same from nation a cross join nation b")
def missing_equal(spark, sf_dir):
    """Null equals null, NaN equals NaN, and neither a number."""
    value = lambda c: F.when(F.col(c) % 5 == 0, F.lit(None).cast("double")).when(F.col(c) % 5 == 1, F.lit(float("nan"))).otherwise((F.col(c) % 5).cast("double"))
    n = _table(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a")).crossJoin(n.select(F.col("n_nationkey").alias("b")))
    return pairs.select("a", "b", scalars.missing_aware_equal(value("a"), value("b")).alias("same"))


@query("select n_nationkey as k, case n_nationkey % 5 when 0 then 'int 12' when 1 then 'bool True' when 2 then 'float 0.5' when 3 then 'NoneType None' else 'list [1, 2]' end as value from nation")
def option_values(spark, sf_dir):
    given = (("12", int), ("yes", bool), ("0.5", float), ("none", int), ("[1, 2]", list))
    rows = [(k, (lambda v: f"{type(v).__name__} {v}")(scalars.coerce_option(*given[k % 5]))) for k, _, _ in _nations(spark, sf_dir)]
    return spark.createDataFrame(rows, "k int, value string")


@query("select 'limit' as option, 'int' as type, true as required, null as preset union all select 'name', 'str', false, 'x' union all select 'ratio', 'float', false, '0.5'")
def option_schema(spark, sf_dir):
    from dataclasses import dataclass

    @dataclass
    class Options:
        limit: int
        name: str = "x"
        ratio: float = 0.5

    found = plugins.option_schema(type("Described", (), {"Options": Options}))
    return spark.createDataFrame([(k, v["type"], v["required"], None if v["default"] is None else str(v["default"])) for k, v in found.items()], "option string, type string, required boolean, preset string")


@query("select 'timestamp' as renamed, 'kept' as hint, event_id from events")
def prepared_columns(spark, sf_dir):
    """The time column renamed; column metadata that describe the source's storage dropped, others kept."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("time")).withMetadata("time", {"chunksizes": 3, "units": "s"})
    out = variables.prepare(e)
    hint = "kept" if out.schema["timestamp"].metadata == {"units": "s"} else "lost"
    return out.select(F.lit(out.columns[1]).alias("renamed"), F.lit(hint).alias("hint"), "event_id")


@query("select event_id, cast(floor(epoch_us(ts) / 1e6) as bigint) as sec, event_type as label from events")
def text_columns(spark, sf_dir):
    """Byte columns as text, strict UTC texts as times."""
    e = _table(spark, sf_dir, "events")
    rows = e.select("event_id", F.encode("event_type", "UTF-8").alias("label"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))
    return variables.normalise_text(rows, ["stamp"]).select("event_id", F.unix_seconds("stamp").alias("sec"), "label")


@query("select event_id, case when event_id % 3 = 0 then null else value end as v from events")
def missing_values(spark, sf_dir):
    """NaN to null, to NaN, and back."""
    e = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return variables.to_missing(variables.to_nan(variables.to_missing(e, ["v"]), ["v"]), ["v"])


@query("select event_id, cast(round(epoch_us(timestamp '2000-01-01 00:00:00') / 1e6) as bigint) + event_id * 3600 as sec from events")
def cf_decode_hours(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("time"))
    decoded = variables.decode_times(rows, {"time": {"units": "hours since 2000-01-01", "calendar": "gregorian"}})
    return decoded.select("event_id", F.unix_seconds("time").alias("sec"))


@query("select arg_min(epoch_us(ts), event_id) as first, arg_max(epoch_us(ts), event_id) as last, count(*) as n from events")
def first_last_times(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("ts").cast("timestamp").alias("time"))
    return variables.first_last_count(rows).select(F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query(f"with {LOG_SQL} select cast(epoch_us(min(time_min::timestamp)) / 1000000 as bigint) as first, cast(epoch_us(max(time_max::timestamp)) / 1000000 as bigint) as last from state")
def span_time_bounds(spark, sf_dir):
    bounds = variables.time_bounds(state_log.project(*_log(spark, sf_dir)))
    return bounds.select(F.unix_seconds("start").alias("first"), F.unix_seconds("end").alias("last"))


# --- axes, planning, guards -----------------------------------------------------------------------------------------


@query("select n_nationkey as k, case when n_nationkey % 3 = 0 then n_nationkey * 10 when n_nationkey % 3 = 1 then n_nationkey * 3600 // 600 end as size, case when n_nationkey % 3 = 2 then 'the axis has no extent' else '' end as fault from nation")
def axis_sizes(spark, sf_dir):
    """Slots of an axis: stated, from its end, or none."""
    def row(k: int) -> tuple:
        axis = (TimeAxis(EPOCH, 600, size=k * 10), TimeAxis(EPOCH, 600, end_s=EPOCH + k * 3600), TimeAxis(EPOCH, 600))[k % 3]
        fault = _fault(axis.length)
        return (k, None if fault else axis.length(), fault)

    return spark.createDataFrame([row(k) for k, _, _ in _nations(spark, sf_dir)], "k int, size long, fault string")


@query("select n_regionkey as region, cast(case n_regionkey when 0 then 12 when 1 then 24 when 2 then 7 when 3 then 30 else 1 end as bigint) as needed from nation group by n_regionkey")
def slot_sizes(spark, sf_dir):
    """Least common multiples of the time chunks of a group's arrays."""
    found = planner.slot_sizes({str(r): c for r, c in enumerate(([4, 6], [24], [7, 1], [10, 6, 15], [1]))})
    return spark.createDataFrame([(int(r), n) for r, n in found.items()], "region int, needed long")


@query("select n_nationkey as k, case n_regionkey when 0 then 3 when 1 then n_nationkey * 10 when 2 then n_nationkey * 5 else null end as first, case n_regionkey when 0 then 9 when 1 then n_nationkey * 10 + 10 when 2 then n_nationkey * 5 + 5 else null end as last, case when n_regionkey = 4 then 'bad slot range (9, 3)' else '' end as fault from nation")
def job_slots(spark, sf_dir):
    """Slots of a job: as given, from its index and size, from its environment, or none for a serial run."""
    def row(k: int, region: int) -> tuple:
        jobs = (({}, 3, 9, None), ({"JOB_INDEX": str(k)}, None, None, 10), ({"JOB_INDEX": str(k), "SLOT_SIZE": "5"}, None, None, None), ({}, None, None, None), ({"SLOT_START": "9", "SLOT_END": "3"}, None, None, None))
        fault = _fault(lambda: planner.slot_range(*jobs[region]))
        found = None if fault else planner.slot_range(*jobs[region])
        return (k, *(found or (None, None)), fault)

    return spark.createDataFrame([row(k, r) for k, _, r in _nations(spark, sf_dir)], "k int, first int, last int, fault string")


@query("select n_nationkey as k, cast(case when n_regionkey = 0 then 1 else 0 end + case when n_regionkey = 1 then 1 else 0 end + case when n_nationkey % 4 <> 0 then 1 else 0 end as int) as reasons from nation")
def parallel_gate(spark, sf_dir):
    """Reasons against a parallel run: items that can't be mapped, a missing extent, bounds off the chunks."""
    reasons = lambda k, r: planner.may_run_in_parallel({"g": None if r == 1 else 1000}, {"g": 4}, k, 400, inspects=r != 0)
    return spark.createDataFrame([(k, len(reasons(k, r))) for k, _, r in _nations(spark, sf_dir)], "k int, reasons int")


@query("select distinct 'r' || n_regionkey as grp from nation where n_regionkey > 2")
def undeclared_groups(spark, sf_dir):
    groups = _table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("grp"))
    return resume.missing_groups(groups, groups.where("grp in ('r0', 'r1', 'r2')").distinct())


@query("select n_nationkey as k, case when n_nationkey % 2 = 0 then '' else 'time: shards of ' || (n_nationkey % 3 + 2) || ', stored 1' end as fault from nation")
def shard_shapes(spark, sf_dir):
    rows = [(k, _fault(lambda k=k: resume.check_shards({"time": 1, "x": 8}, {"time": 1 if k % 2 == 0 else k % 3 + 2, "x": 8}))) for k, _, _ in _nations(spark, sf_dir)]
    return spark.createDataFrame(rows, "k int, fault string")


@query("select n_nationkey as k, (1 < n_regionkey or (1 = n_regionkey and 10 < n_nationkey)) as refused from nation")
def plugin_versions(spark, sf_dir):
    """Versions are compared as numbers: 1.9 is older than 1.10."""
    return spark.createDataFrame([(k, bool(_fault(lambda k=k, r=r: resume.check_version(f"{r}.{k}.0", "1.10.0")))) for k, _, r in _nations(spark, sf_dir)], "k int, refused boolean")


@query("with r as (select event_type as grp, event_id % 100 as a, event_id % 100 + event_id % 5 - 2 as b from events) select grp, a as start, b + 1 as \"end\" from r where b >= a")
def stored_ranges(spark, sf_dir):
    """Inclusive ranges as half-open ones; inverted ones go."""
    ranges = F.array(F.struct((F.col("event_id") % 100).alias("start"), (F.col("event_id") % 100 + F.col("event_id") % 5 - 2).alias("end")), F.struct(F.lit(None).cast("long").alias("start"), F.lit(3).cast("long").alias("end")))
    return intervals.half_open(_table(spark, sf_dir, "events").select(F.col("event_type").alias("grp"), ranges.alias("ranges")))


@query(f"with {LOG_SQL}, cov as (select grp, a as start, b + 1 as \"end\" from state where status = 'active') select grp, start, \"end\" from cov")
def planned_coverage(spark, sf_dir):
    """Half-open ranges of the active spans."""
    return planner.covered_ranges(state_log.project(*_log(spark, sf_dir)))


@query(f"with {SAMPLES_SQL} select pos, (lat > 0) as kept from samples where lat > 0")
def item_predicate(spark, sf_dir):
    """A plugin's own predicate on its items."""
    hooks = plugins.hooks_of(type("Keeps", (), {"keep": staticmethod(lambda items: items["lat"] > 0)})())
    rows = _samples(spark, sf_dir)
    return rows.where(hooks.keep(rows)).select("pos", F.lit(True).alias("kept"))


@query("select 'plugin' || n_nationkey as name from nation")
def plugin_registry(spark, sf_dir):
    """Plugins by name, the last of a name; what lacks a method is refused."""
    kind = {"discover": lambda self, spark, source: None, "build": lambda self, items: items}
    held = dict(plugins._REGISTRY)
    try:
        for k, _, _ in _nations(spark, sf_dir):
            for _ in range(2):
                plugins.register(f"plugin{k}")(type(f"P{k}", (), dict(kind)))
        try:
            plugins.register("bad")(type("Bad", (), {}))
        except TypeError:
            names = [n for n in plugins.discover_entry_points() if n.startswith("plugin") and plugins.get(n).name == n]
    finally:
        plugins._REGISTRY.clear()
        plugins._REGISTRY.update(held)
    return spark.createDataFrame([(n,) for n in names], "name string")


# --- records and layouts --------------------------------------------------------------------------------------------


@query(f"with {LOG_SQL} select key, 'record_replaced' as event_type, 'm' as by from state where status = 'active' and grp = 'view'")
def marking_events(spark, sf_dir):
    """Events that mark the listed records as replaced; only active ones are marked."""
    state = state_log.project(*_log(spark, sf_dir))
    marked = state_log.replaced_events(state, state.where("grp = 'view'").select("key"), "m", 1.0)
    return marked.select(F.get_json_object("record", "$.key").alias("key"), "event_type", F.get_json_object("record", "$.replaced_by").alias("by"))


@query(f"with {LOG_SQL} select key from state where status = 'active' and run_id <> 'run-0001' and plugin = 'p2' and time_min::timestamp <= timestamp '2024-01-20' and time_max::timestamp >= timestamp '2024-01-10'")
def replacement_candidates(spark, sf_dir):
    """Active spans of other runs with the same metadata in the time range."""
    state = state_log.project(*_log(spark, sf_dir))
    return state_log.prior_spans(state, "run-0001", {"plugin": "p2"}, "2024-01-10", "2024-01-20").select("key")


@query("select n_name as array, case when n_nationkey % 4 = 1 then n_nationkey::varchar end as declared, case when n_nationkey % 4 = 1 then (n_nationkey + 1)::varchar end as stored from nation where n_nationkey % 4 = 1 union all select n_name, n_nationkey::varchar, null from nation where n_nationkey % 4 = 3")
def layout_drift(spark, sf_dir):
    """Fields that differ; a longer stored time axis is none."""
    n = _table(spark, sf_dir, "nation")
    field = F.when(F.col("n_nationkey") % 4 == 2, "time_length").otherwise("chunk")
    base = n.select(F.lit("g").alias("grp"), F.col("n_name").alias("array"), field.alias("field"), F.col("n_nationkey").alias("k"))
    declared = base.select("grp", "array", "field", F.col("k").cast("string").alias("value"))
    stored = base.where("k % 4 <> 3").select("grp", "array", "field", F.when(F.col("k") % 4 == 0, F.col("k")).otherwise(F.col("k") + 1).cast("string").alias("value"))
    return chunks.contract_drift(declared, stored).select("array", "declared", "stored")


@query("select n_name as array from nation where n_regionkey in (1, 3)")
def time_dimension_conflicts(spark, sf_dir):
    """Arrays with another time dimension than the declared one, or with two."""
    dims = F.when(F.col("n_regionkey") == 1, F.array(F.lit("timestamp"), F.lit("x"))).when(F.col("n_regionkey") == 3, F.array(F.lit("time"), F.lit("timestamp"))).otherwise(F.array(F.lit("time"), F.lit("y")))
    arrays = _table(spark, sf_dir, "nation").select(F.lit("g").alias("grp"), F.col("n_name").alias("array"), dims.alias("dims"))
    return chunks.time_dim_conflicts(arrays, "time").select("array")


@query("select event_type as key, count(*) as n from events where event_type not in ('click', 'view') group by event_type")
def metric_names(spark, sf_dir):
    """Metrics without null and reserved names."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).union(spark.createDataFrame([(None,)], "key string"))
    return tabular.normalise_metrics(rows, ["click", "view"]).groupBy("key").agg(F.count("*").alias("n"))


@query("select case n_regionkey when 0 then 'error' when 1 then 'warning' else 'info' end as severity, count(*) as n from nation group by 1")
def finding_summary(spark, sf_dir):
    severity = F.when(F.col("n_regionkey") == 0, "error").when(F.col("n_regionkey") == 1, "warning").otherwise("info")
    return conventions.summary(_table(spark, sf_dir, "nation").select(severity.alias("severity")))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from events")
def iso_normalised(spark, sf_dir):
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+00:00").otherwise("Z"))
    return _table(spark, sf_dir, "events").select("event_id", timeslots.normalise_iso(text).alias("iso"))


@query("select event_id % 20 as slot, max(event_type) as v, 1 as state from events group by 1")
def slot_presence(spark, sf_dir):
    """State of the slots that hold data."""
    rows = _table(spark, sf_dir, "events").groupBy((F.col("event_id") % 20).alias("slot")).agg(F.max("event_type").alias("v"))
    return rows.withColumn("state", variables.present(F.col("slot")).cast("int"))
