"""Every registered core query against its SQL in DuckDB on the smallest tables."""

import glob
import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import catalogue, cli


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def value(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(v)
        return None if v is None or (not isinstance(v, (str, tuple)) and pd.isna(v)) else v

    return sorted((tuple(value(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    ours, theirs = catalogue.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_entry_works_and_the_subpackage_is_optional(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["grp", "slot"]
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def same_rows(spark, folder, tables, *names):
    """Whether queries give the rows of their SQL over tables written to a folder, as multisets."""
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for table, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    for name in names:
        catalogue.queries()[name](spark, str(folder)).write.parquet(f"{folder}/out/{name}")
        con.sql(f"create table theirs_{name} as {catalogue.oracle_sql()[name]}")
        columns = ", ".join(f'"{c}"' for c in con.sql(f"select * from theirs_{name} limit 0").columns)
        ours, theirs = f"select {columns} from '{folder}/out/{name}/*.parquet'", f"select {columns} from theirs_{name}"
        assert con.sql(f"select count(*) from theirs_{name}").fetchall() == con.sql(f"select count(*) from ({ours})").fetchall()
        assert not con.sql(f"{ours} except all {theirs} limit 5").fetchall()
    return True


def test_more_batches_than_four_digits_are_numbered_as_in_sql(spark, tmp_path):
    assert same_rows(spark, tmp_path, {"events": spark.range(64 * 10_012 + 3).withColumnRenamed("id", "event_id")}, "batch_assign")
    # The operator's own ids stay whole, so that no two batches share one.
    from tessera.operators import tabular

    assert tabular.batches(spark.range(10_003), 1, "id").select("batch_id").distinct().count() == 10_003


def test_digests_of_more_batches_than_four_digits_are_those_of_sql(spark, tmp_path):
    assert same_rows(spark, tmp_path, {"events": spark.range(500 * 10_002 + 3).select(F.col("id").alias("event_id"), F.lit(1.0).alias("value"))}, "batch_digest")


#: Users of up to five digits; from 10000 on the SQL gives several users one run id.
USERS = [*range(12), *range(1000, 1004), *range(9_990, 10_045), 20_001, 20_002, 99_995]


def logged(spark):
    rows = spark.range(600).withColumn("users", F.array(*[F.lit(u).cast("long") for u in USERS]))
    return rows.selectExpr("id as event_id", "timestamp_seconds(1704067200 + id * 997) as ts", "users[id % size(users)] as user_id", "element_at(array('click', 'view', 'error'), cast(id % 3 as int) + 1) as event_type", "double(id) as value")


def test_all_runs_are_listed_where_ids_of_sql_are_cut(spark, tmp_path):
    assert same_rows(spark, tmp_path, {"events": logged(spark)}, "command_runs_list")


def test_all_of_more_than_a_million_runs_are_listed(spark, tmp_path):
    rows = spark.range(1_000_003).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id) as ts", "id as user_id", "'view' as event_type", "double(id) as value")
    assert same_rows(spark, tmp_path, {"events": rows}, "command_runs_list")


def test_a_listing_of_runs_is_whole_unless_a_limit_is_given(spark, tmp_path, capsys):
    root, ids = f"{tmp_path}/demo", [f"run-{i:04d}" for i in range(1_234)]
    spark.createDataFrame([("demo", i, "complete", 1.0) for i in ids], "product string, run_id string, status string, updated_at double").write.parquet(f"{root}/_control/runs")
    for options, expected in (((), ids), (("--limit", "3"), ids[:3])):
        assert cli.main(["runs-list", root, *options]) == 0
        assert [r["run_id"] for r in json.loads(capsys.readouterr().out.strip().splitlines()[-1])] == expected
    assert cli.main(["runs-list", root, "--output", f"{tmp_path}/listed"]) == 0
    assert sorted(r["run_id"] for r in spark.read.parquet(f"{tmp_path}/listed").collect()) == ids


def test_all_stale_runs_are_named_where_ids_of_sql_are_cut(spark, tmp_path):
    assert same_rows(spark, tmp_path, {"events": logged(spark)}, "command_runs_abandon")


def test_open_runs_of_even_users_are_given_up_where_ids_of_sql_are_cut(spark, tmp_path):
    assert same_rows(spark, tmp_path, {"events": logged(spark)}, "runs_abandoned")
