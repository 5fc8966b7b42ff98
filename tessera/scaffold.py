"""A new plugin project to start from."""

from __future__ import annotations

import re
from pathlib import Path

PROJECT = """[project]
name = "{package}"
version = "0.1.0"
dependencies = ["pyspark"]

[project.entry-points."tessera.ingestors"]
{name} = "{package}.plugin:{cls}"

[build-system]
requires = ["setuptools"]
build-backend = "setuptools.build_meta"
"""

HEAD = '''"""The {name} plugin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import plugins
from tessera.functions.timeslots import TimeAxis


@plugins.register("{name}")
class {cls}:
    @dataclass
    class Options:
        pattern: str = "*"

    options = Options()
    axes = {{"all": TimeAxis(0, 3600)}}

    def discover(self, spark: SparkSession, source: str) -> DataFrame:
        """Items: one row for each file or record."""
        return spark.read.option("pathGlobFilter", self.options.pattern).parquet(source)
'''

BODY = {
    "cube": '''
    def build(self, items: DataFrame) -> DataFrame:
        """Rows (grp, time, variables) of some items."""
        return items.select(F.lit("all").alias("grp"), "time", *[c for c in items.columns if c != "time"])
''',
    "arrays": '''
    array_schema = {"field": plugins.ArraySpec(("slot", "y", "x"), (1000, 8, 8), (100, 8, 8))}

    def build(self, items: DataFrame) -> DataFrame:
        raise NotImplementedError("this plugin writes arrays directly")

    def write_intents(self, items: DataFrame) -> DataFrame:
        """Items as (grp, array, slot, y0, payload): rows of values from line y0 on."""
        return items.select(F.lit("all").alias("grp"), F.lit("field").alias("array"), "slot", F.lit(0).cast("long").alias("y0"), "payload")
''',
}

TEST = '''from {package}.plugin import {cls}

from tessera.plugins import Ingestor


def test_the_plugin_has_what_the_engine_needs():
    assert isinstance({cls}(), Ingestor)
'''


def create_plugin(name: str, folder: str, kind: str = "cube") -> list[str]:
    """Writes a project for a plugin of a kind; returns its files.  An existing project is never written over."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"a plugin's name has lower-case letters, digits and underscores: {name!r}")
    if kind not in BODY:
        raise ValueError(f"kinds are {', '.join(sorted(BODY))}")
    root, package = Path(folder) / f"tessera-{name.replace('_', '-')}", f"tessera_{name}"
    if root.exists():
        raise FileExistsError(str(root))
    names = {"name": name, "package": package, "cls": "".join(p.capitalize() for p in name.split("_"))}
    files = {"pyproject.toml": PROJECT.format(**names), f"{package}/__init__.py": "", f"{package}/plugin.py": HEAD.format(**names) + BODY[kind], f"tests/test_{name}.py": TEST.format(**names)}
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return sorted(files)
