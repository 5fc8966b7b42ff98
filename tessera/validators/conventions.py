"""Metadata convention checks (CF001 to CF015) as queries over metadata tables.

attributes: var (null: global), attr, value (text).  variables: var, is_coord, dims array<string>, shape array<bigint>,
internal.  values: var, pos, value (double) of the one-dimensional coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Attributes that name other variables, and units that tell a latitude or longitude.
REFERENCES = ("coordinates", "bounds", "grid_mapping", "ancillary_variables")
LAT_UNITS = ("degrees_north", "degree_north", "degree_n", "degrees_n", "degreen", "degreesn")
LON_UNITS = ("degrees_east", "degree_east", "degree_e", "degrees_e", "degreee", "degreese")
VERSION, TIME_UNITS, NAME = r"CF-\d+\.\d+", r"^\s*\S+\s+since\s+\S+", r"^[A-Za-z][A-Za-z0-9_]*$"
SEVERITY = {"CF001": "error", "CF002": "warning", "CF003": "warning", "CF004": "error", "CF005": "error", "CF006": "warning", "CF007": "info", "CF008": "warning", "CF009": "warning", "CF010": "error", "CF011": "warning", "CF012": "error", "CF013": "error", "CF014": "warning", "CF015": "warning"}


def by_variable(attributes: DataFrame, variables: DataFrame) -> DataFrame:
    """Variables with their attributes as a map."""
    maps = attributes.where("var is not null").groupBy("var").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("attrs"))
    return variables.join(maps, "var", "left").withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def is_time() -> Column:
    return F.col("is_coord") & (F.coalesce(_attr("standard_name") == "time", F.lit(False)) | F.coalesce(_attr("axis") == "T", F.lit(False)) | F.coalesce(_attr("units").contains("since"), F.lit(False)))


def _is_geo(axis: str, units: tuple[str, ...], name: str) -> Column:
    return F.col("is_coord") & (F.coalesce(_attr("standard_name") == name, F.lit(False)) | F.coalesce(_attr("axis") == axis, F.lit(False)) | F.coalesce(F.lower(_attr("units")).isin(*units), F.lit(False)))


def monotonic_faults(values: DataFrame) -> DataFrame:
    """Coordinates whose values (var, pos, value) neither rise nor fall throughout."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy("var").orderBy("pos"))
    steps = values.withColumn("step", step).where("step is not null").groupBy("var").agg(F.bool_and(F.col("step") > 0).alias("up"), F.bool_and(F.col("step") < 0).alias("down"))
    return steps.where("not up and not down").select("var")


def report(attributes: DataFrame, variables: DataFrame, values: DataFrame) -> DataFrame:
    """Findings: code, severity, location, detail.  Fifteen small queries over metadata, one union."""
    spark = attributes.sparkSession
    every = by_variable(attributes, variables)
    data = every.where("not is_coord and not coalesce(internal, false)")
    known = variables.select(F.col("var").alias("ref"))
    once = spark.range(1)
    general = attributes.where("var is null")

    def lacks(code: str, found: DataFrame, where: str) -> DataFrame:
        return once.join(found.limit(1).select(F.lit(1).alias("hit")), how="left_anti", on=F.lit(True)).select(F.lit(code).alias("code"), F.lit(where).alias("location"), F.lit("").alias("detail"))

    def each(code: str, rows: DataFrame, detail: Column | None = None) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), F.col("var").alias("location"), (detail if detail is not None else F.lit("")).alias("detail"))

    times = every.where(is_time())
    targets = every.where(_attr("grid_mapping").isNotNull()).select(F.explode(F.split(_attr("grid_mapping"), r"\s+")).alias("var"))
    references = every.where("not coalesce(internal, false)").select("var", F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), _attr(a).alias("value")) for a in REFERENCES])).alias("r")).where("r.value is not null and trim(r.value) <> ''")
    named = references.select("var", F.col("r.attr").alias("attr"), F.explode(F.split(F.trim("r.value"), r"\s+")).alias("ref"))
    bounds = every.select(_attr("bounds").alias("var")).where("var is not null").distinct().join(variables.select("var", "shape"), "var")
    wanted = spark.createDataFrame([(a,) for a in ("institution", "source", "history")], "attr string")
    findings = [
        lacks("CF001", general.where((F.col("attr") == "Conventions") & F.col("value").rlike(VERSION)), "/"),
        lacks("CF002", general.where("attr = 'title' and trim(value) <> ''"), "/"),
        wanted.join(general.where("coalesce(value, '') <> ''"), "attr", "left_anti").groupBy().agg(F.array_join(F.array_sort(F.collect_list("attr")), ", ").alias("detail")).where("detail <> ''").select(F.lit("CF003").alias("code"), F.lit("/").alias("location"), "detail"),
        lacks("CF004", times, "/"),
        each("CF005", times.where(~F.coalesce(_attr("units"), F.lit("")).rlike(TIME_UNITS)), F.coalesce(_attr("units"), F.lit(""))),
        each("CF006", times.where(_attr("calendar").isNull())),
        each("CF007", times.where(~F.coalesce(_attr("axis") == "T", F.lit(False)))),
        lacks("CF008", every.where(_is_geo("Y", LAT_UNITS, "latitude")), "/"),
        lacks("CF009", every.where(_is_geo("X", LON_UNITS, "longitude")), "/"),
        each("CF010", data.where(_attr("units").isNull()).join(targets, "var", "left_anti")),
        each("CF011", data.where(_attr("long_name").isNull() & _attr("standard_name").isNull())),
        each("CF012", named.join(known, "ref", "left_anti"), F.concat_ws(":", "attr", "ref")),
        each("CF013", bounds.where((F.size("shape") != 2) | (F.element_at("shape", -1) != 2))),
        each("CF014", every.where(~F.coalesce(F.col("internal"), F.lit(False)) & ~F.col("var").rlike(NAME))),
        each("CF015", monotonic_faults(values)),
    ]
    out = findings[0]
    for rows in findings[1:]:
        out = out.unionByName(rows)
    severities = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return out.withColumn("severity", severities[F.col("code")]).select("code", "severity", "location", "detail")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def exit_code(findings: DataFrame, strict: bool = False) -> int:
    """1 with errors, 2 with strict and anything milder, else 0."""
    counts = {r["severity"]: r["n"] for r in summary(findings).collect()}
    return 1 if counts.get("error") else 2 if strict and counts else 0
