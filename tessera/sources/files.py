"""File discovery, archives, CSV members and event-log segments."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.scalars import glob_to_regex
from tessera.storage import arrow_file

HDF5_MAGIC = bytes([0x89]) + b"HDF\r\n\x1a\n"


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, name, suffix, length, modificationTime of the files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), "length", "modificationTime")


def matches_any(patterns: Sequence[str], root: str) -> Column:
    """Glob match of the name, the path below root or the whole path."""
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    tests = [c.rlike(glob_to_regex(p)) for p in patterns for c in (F.col("name"), below, F.col("path"))]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def ends_of(files: DataFrame, head: int, tail: int = 0) -> DataFrame:
    """The first and last bytes of each file (path, ...); nothing else of a file is read."""
    shape = files.select("path").schema.add("head", "binary").add("tail", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for path in batch.column(0).to_pylist():
                fs, target = arrow_file(path)
                with fs.open_input_file(target) as f:
                    heads.append(f.read(head))
                    f.seek(max(0, f.size() - tail))
                    tails.append(f.read(tail))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], ["path", "head", "tail"])

    return files.select("path").mapInArrow(run, shape)


def discover(spark: SparkSession, root: str, suffixes: Sequence[str] = (".zip", ".h5", ".nc"), include: Sequence[str] = (), exclude: Sequence[str] = (), recursive: bool = True, sniff: bool = True) -> DataFrame:
    """Input files in the order of their names: by suffix, further globs or the magic bytes; exclusions come first.

    Only files that nothing else selects are sniffed, and only their first bytes are read.
    """
    files = listing(spark, root, recursive)
    files = files.where(~matches_any(exclude, root)) if exclude else files
    wanted = F.col("suffix").isin(*suffixes) | (matches_any(include, root) if include else F.lit(False))
    found = files.where(wanted)
    if sniff:
        others = files.where(~wanted)
        found = found.unionByName(others.join(ends_of(others, len(HDF5_MAGIC)).where(F.col("head") == F.lit(HDF5_MAGIC)).select("path"), "path", "left_semi"))
    return found.select("path", "name", "suffix", "length", "modificationTime").dropDuplicates(["path"]).orderBy("name", "path")


def archive_members(spark: SparkSession, root: str, pattern: str = "*.zip", member: str = r"\.h5$|hdf5") -> DataFrame:
    """The wanted member of each archive: the first that ends in .h5, else the first named like it.  One task reads an
    archive; archives that can't be read give a row with an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = data = error = None
                fs, target = arrow_file(path)
                try:
                    with fs.open_input_file(target) as file, zipfile.ZipFile(file) as archive:  # only the directory and the member are read
                        names = [n for n in archive.namelist() if re.search(member, n, re.I)]
                        name = next((n for n in names if n.lower().endswith(".h5")), names[0] if names else None)
                        data = archive.read(name) if name else None
                        error = None if name else "no such member"
                except (zipfile.BadZipFile, OSError, pa.ArrowInvalid) as problem:
                    error = str(problem)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name], pa.string()), pa.array([data], pa.binary()), pa.array([error], pa.string())], ["path", "member", "content", "error"])

    return listing(spark, root).where(F.col("name").rlike(glob_to_regex(pattern))).select("path").mapInArrow(run, "path string, member string, content binary, error string")


def detections(spark: SparkSession, path: str, day: str = "day", time: str = "time") -> DataFrame:
    """Point detections from CSV with # comments: day and time become a UTC timestamp, the file's name is kept."""
    rows = spark.read.option("header", "true").option("comment", "#").option("inferSchema", "true").csv(path)
    stamp = F.to_timestamp(F.concat_ws("T", F.col(day).cast("string"), F.date_format(F.col(time), "HH:mm:ss") if dict(rows.dtypes)[time] == "timestamp" else F.col(time).cast("string")))
    return rows.withColumn("timestamp", stamp).withColumn("source_product", F.element_at(F.split(F.input_file_name(), "/"), -1)).drop(day, time)


def catalogue_groups(spark: SparkSession, root: str, control: str = "_control") -> DataFrame:
    """Directories that hold Parquet files, without the control directory."""
    files = listing(spark, root).where("suffix = '.parquet'")
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).where(~F.col("folder").contains(f"/{control}")).distinct().orderBy("folder")


def path_stats(files: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Bytes and number of files, without paths that contain an excluded text."""
    for part in exclude:
        files = files.where(~F.col("path").contains(part))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def event_segments(spark: SparkSession, root: str) -> DataFrame:
    """Events of JSON-lines segments <root>/<product>/runs/<run_id>/events-<part>.jsonl.

    A last line cut short (no newline) of a run's last segment is dropped where it can't be read; any other unreadable
    line is an error.  Whole segments are read, since only their end tells a cut line.
    """
    text = spark.read.text(f"{root}/*/runs/*/events-*.jsonl", wholetext=True).withColumn("path", F.input_file_name())
    parts = text.select("value", F.regexp_extract("path", r"/([^/]+)/runs/[^/]+/[^/]+$", 1).alias("product"), F.regexp_extract("path", r"/runs/([^/]+)/[^/]+$", 1).alias("run_id"), F.regexp_extract("path", r"events-(\d+)\.jsonl$", 1).cast("int").alias("part"))
    last = parts.groupBy("product", "run_id").agg(F.max("part").alias("last_part"))
    lines = parts.join(last, ["product", "run_id"]).select("product", "run_id", "part", "last_part", F.col("value").endswith("\n").alias("whole"), F.size(F.split("value", "\n")).alias("n"), F.posexplode(F.split("value", "\n")).alias("idx", "line"))
    schema = "event_id string, event_type string, timestamp double, record string, meta string"
    read = lines.where("trim(line) <> ''").withColumn("e", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    bad = F.try_parse_json("line").isNull()
    torn = bad & ~F.col("whole") & (F.col("idx") == F.col("n") - 1) & (F.col("part") == F.col("last_part"))
    kept = read.where(~torn).withColumn("idx", F.when(bad, F.raise_error(F.concat(F.lit("unreadable event in run "), "run_id")).cast("int")).otherwise(F.col("idx")))
    return kept.select("product", "run_id", "part", "idx", "e.event_id", "e.event_type", "e.timestamp", "e.record", "e.meta")


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """Runs from <root>/<product>/runs/<run_id>/run.json."""
    return spark.read.schema(model.RUNS).option("multiLine", "true").json(f"{root}/*/runs/*/run.json")


def remote_settings(spark: SparkSession, options: dict[str, str]) -> None:
    """Object-store settings for the session's readers and writers."""
    for key, value in options.items():
        spark.conf.set(f"spark.hadoop.fs.s3a.{key}" if not key.startswith("spark.") else key, value)
