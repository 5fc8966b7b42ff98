"""Managed tables by SQL: quoting, creation, truncation, and recreation where the columns differ."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: What a fragment of SQL from outside must not hold.
REFUSED = (";", "--", "/*", "*/")


def quote_name(name: str) -> str:
    """A dotted identifier in back-quotes; anything but letters, digits and underscores is refused."""
    parts = name.split(".")
    if not all(NAME.fullmatch(p) for p in parts):
        raise ValueError(f"bad identifier {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def quote_text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def check_fragment(text: str) -> str:
    """The fragment, if it can't end the statement that it is put into."""
    if found := [t for t in REFUSED if t in text]:
        raise ValueError(f"{found[0]!r} is not allowed in {text!r}")
    return text


def ensure_table(spark: SparkSession, table: str, columns: str) -> bool:
    """Creates a Parquet table unless it is there; whether it was created."""
    if spark.catalog.tableExists(table):
        return False
    spark.sql(f"create table {quote_name(table)} ({check_fragment(columns)}) using parquet")
    return True


def truncate_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"truncate table {quote_name(table)}")


def ensure_table_schema(spark: SparkSession, table: str, columns: str, expected: Sequence[str] | None = None) -> bool:
    """Drops and creates a table whose ordered columns aren't the expected ones; whether it was created."""
    names = list(expected) if expected else list(spark.createDataFrame([], columns).columns)
    if spark.catalog.tableExists(table) and spark.table(table).columns != names:
        spark.sql(f"drop table {quote_name(table)}")
    return ensure_table(spark, table, columns)
