"""Commands: python -m tessera.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time


from pyspark.sql import functions as F

from tessera import deletion, ingest, plugins, scaffold
from tessera.claims import Claims
from tessera.functions.scalars import parse_meta_filters
from tessera.operators import pyramid, state_log
from tessera.plans import planner
from tessera.session import local_session
from tessera.sinks import cube
from tessera.sources import chunked, files
from tessera.validators import chunks, conventions, parquet_files


def _show(rows, form: str) -> None:
    items = [r.asDict(recursive=True) for r in rows] if rows and not isinstance(rows, (dict, list)) or (isinstance(rows, list) and rows and hasattr(rows[0], "asDict")) else rows
    if form == "csv" and isinstance(items, list) and items:
        print(",".join(items[0]))
        for item in items:
            print(",".join(json.dumps(v, default=str) if isinstance(v, (list, dict)) else str(v) for v in item.values()))
    else:
        print(json.dumps(items, default=str, indent=None if form == "json" else 2))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--format", choices=("table", "json", "csv"), default="json")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> None:
        p = sub.add_parser(name)
        for names, options in arguments:
            p.add_argument(*names.split(), **options)

    product, yes = ("root", {}), {"action": "store_true"}
    command("ingest", ("plugin", {}), ("source", {}), product, ("--option", {"action": "append", "default": []}), ("--slot-start", {"type": int}), ("--slot-end", {"type": int}), ("--group", {}), ("--resume", yes), ("--force", yes), ("--chunk", {"type": int, "default": 100}))
    command("slots", product, ("--total", {"type": int, "required": True}), ("--size", {"type": int, "required": True}), ("--groups", {"nargs": "+", "required": True}), ("--limit", {"type": int, "default": 10000}))
    command("validate", ("array", {}))
    command("multires", ("cube", {}), ("output", {}), ("--variables", {"nargs": "+", "required": True}), ("--factor", {"type": int, "default": 2}))
    command("preallocate", ("output", {}), ("--size", {"type": int, "required": True}), ("--groups", {"nargs": "+", "required": True}))
    command("parquet-validate", product)
    command("parquet-consolidate", product, ("output", {}), ("--codec", {"default": "zstd"}))
    command("chunks-list", product, ("--pattern", {}), ("--type", {}), ("--status", {}), ("--meta", {"action": "append", "default": []}), ("--before", {"type": float}), ("--after", {"type": float}), ("--time-range", {"nargs": 2}), ("--include-replaced", yes), ("--limit", {"type": int, "default": 100}))
    command("chunks-delete", product, ("--pattern", {"required": True}), ("--chunk", {"type": int, "default": 100}), ("--yes", yes))
    command("chunks-delete-span", product, ("--run-id", {"required": True}), ("--group", {}), ("--chunk", {"type": int, "default": 100}), ("--yes", yes))
    command("runs-list", product, ("--status", {}), ("--limit", {"type": int}), ("--output", {}))
    command("runs-abandon", product, ("--run-id", {}), ("--all-stale", yes), ("--reason", {"default": "abandoned by command"}), ("--yes", yes))
    command("claims-list", product)
    command("claims-clear", product, ("--yes", yes))
    command("snapshot", product)
    command("snapshot-status", product)
    command("archive-create", product, ("archive", {}), ("--groups", {"nargs": "*", "default": []}), ("--variables", {"nargs": "*", "default": []}), ("--start", {}), ("--end", {}), ("--codec", {"default": "zstd"}))
    command("archive-restore", ("archive", {}), ("target", {}), ("--chunk", {"type": int, "default": 100}), ("--overwrite", yes))
    command("archive-info", ("archive", {}))
    command("archive-list", ("archive", {}))
    command("archive-validate", ("archive", {}), ("--quick", yes))
    command("advise-batch-size", ("array", {}))
    command("advise-compliance", ("attributes", {}), ("variables", {}), ("values", {}), ("--strict", yes))
    command("catalog", product, ("--name", {"default": "catalogue"}))
    command("plugins-list")
    command("plugins-describe", ("plugin", {}))
    command("plugins-explain", ("plugin", {}), ("option", {}))
    command("plugins-create", ("name", {}), ("folder", {}), ("--kind", {"choices": sorted(scaffold.BODY), "default": "cube"}))
    command("completion")
    return top


def completion() -> str:
    """A script for bash that completes commands and their options."""
    commands = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices
    cases = "\n".join(f'    {name}) words="{" ".join(sorted(o for a in p._actions for o in a.option_strings))}" ;;' for name, p in sorted(commands.items()))
    return f"""_tessera() {{
  local words="{' '.join(sorted(commands))}"
  case "${{COMP_WORDS[1]}}" in
{cases}
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -F _tessera tessera"""


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "completion":
        print(completion())
        return 0
    if a.command == "plugins-create":
        _show(scaffold.create_plugin(a.name, a.folder, a.kind), a.format)
        return 0
    if a.command.startswith("plugins-"):
        names = plugins.discover_entry_points()
        found = names if a.command == "plugins-list" else plugins.option_schema(plugins.get(a.plugin))
        _show(found if a.command != "plugins-explain" else found[a.option], a.format)
        return 0
    if a.command.startswith("claims-"):
        claims = Claims(local_session(), f"{a.root}/_control/claims")
        _show(claims.list() if a.command == "claims-list" else claims.clear_stale(dry_run=not a.yes), a.format)
        return 0
    if a.command == "advise-batch-size":
        _show({"batch_size": planner.batch_size_advice(chunked.array_meta(a.array)["chunks"][0])}, a.format)
        return 0
    spark = local_session()
    product = ingest.Product(a.root.rstrip("/").rsplit("/", 1)[-1], a.root.rstrip("/")) if "root" in a else None
    if a.command == "ingest":
        plugins.discover_entry_points()
        plugin = plugins.configure(plugins.get(a.plugin), {"chunk": a.chunk} | dict(o.split("=", 1) for o in a.option))
        slots = (a.slot_start, a.slot_end) if a.slot_start is not None and a.slot_end is not None else None
        _show(ingest.run(spark, plugin, product, a.source, slots=slots, group=a.group, resume_existing=a.resume, force=a.force, **vars(plugin.engine)), a.format)
    elif a.command == "slots":
        groups = spark.createDataFrame([(g, a.total, a.size) for g in a.groups], "grp string, total long, size long")
        plan = planner.plan_slots(planner.covered_ranges(product.state(spark)), groups)
        _show(plan.orderBy("grp", "start").limit(a.limit).collect(), a.format)
        return 0 if plan.where("kind = 'blocked'").isEmpty() else 1
    elif a.command == "validate":
        meta = chunked.array_meta(a.array)
        listing = files.listing(spark, a.array)
        dims = chunks.dimension_report(listing, meta["dims"], meta["shape"], meta["chunks"]).collect()
        extra = [r["path"] for r in chunks.extra_chunks(listing, meta["shape"], meta["chunks"]).select("path").limit(100).collect()]
        _show({"dimensions": [r.asDict() for r in dims], "extra": extra}, a.format)
        return 1 if extra or any(r["missing"] for r in dims) else 0
    elif a.command == "multires":
        rows = spark.read.parquet(a.cube)
        ends = rows.agg((F.max("iy") + 1).alias("y"), (F.max("ix") + 1).alias("x")).head()
        pyramid.coarsen(rows, a.variables, a.factor, a.factor, ends["y"], ends["x"], keys=["grp", "slot", "time"]).write.mode("overwrite").parquet(a.output)
    elif a.command == "preallocate":
        axes = spark.createDataFrame([(g, a.size) for g in a.groups], "grp string, size long")
        cube.preallocate(spark, axes).write.partitionBy("grp").parquet(a.output)
    elif a.command == "parquet-validate":
        report = parquet_files.validate(spark, a.root)
        _show(report, a.format)
        return 1 if report["bad"] else 0
    elif a.command == "parquet-consolidate":
        _show({"files": cube.consolidate(spark, a.root, a.output, a.codec)}, a.format)
    elif a.command == "chunks-list":
        rows = state_log.list_records(product.events(spark), product.runs(spark), **dict(zip(("snapshot", "completed_before"), product.snapshot(spark), strict=True)), pattern=a.pattern, kind=a.type, status=a.status, meta=parse_meta_filters(a.meta), before=a.before, after=a.after, time_overlaps=tuple(a.time_range) if a.time_range else None, include_replaced=a.include_replaced)
        _show(rows.limit(a.limit).collect(), a.format)
    elif a.command in ("chunks-delete", "chunks-delete-span"):
        rows = state_log.list_records(product.events(spark), product.runs(spark), pattern=getattr(a, "pattern", None), dedupe=False)
        if a.command == "chunks-delete-span":
            rows = rows.where(F.col("run_id") == a.run_id)
            rows = rows.where(F.col("grp") == a.group) if a.group else rows
        counted = {"chunks": state_log.span_chunks(rows, a.chunk).count()} if a.command == "chunks-delete-span" else {}
        _show(deletion.execute(spark, product, rows, ingest.new_run_id("maintenance"), a.chunk, dry_run=not a.yes) | counted, a.format)
    elif a.command == "runs-list":
        rows = state_log.list_runs(product.runs(spark), a.status).orderBy("run_id")
        rows = rows if a.limit is None else rows.limit(a.limit)
        if a.output:  # a table of any size, instead of lines
            rows.write.parquet(a.output)
        _show({"output": a.output} if a.output else rows.collect(), a.format)
    elif a.command == "runs-abandon":
        _show(product.abandon_stale(spark, a.reason, time.time(), dry_run=not a.yes) if a.all_stale else {"abandoned": product.abandon(spark, a.run_id, a.reason)}, a.format)
    elif a.command == "snapshot":
        _show({"completed_before": product.save_snapshot(spark)}, a.format)
    elif a.command == "snapshot-status":
        row = spark.read.parquet(f"{product.root}/_control/snapshot").agg(F.count("*").alias("records"), F.max("completed_before").alias("completed_before")).head()
        _show(row.asDict() | {"age_s": round(time.time() - (row["completed_before"] or 0), 1)}, a.format)
    elif a.command == "archive-create":
        control = cube.serialise_control(product.state(spark), product.runs(spark))
        _show(cube.create_archive(spark.read.parquet(product.data), a.archive, groups=a.groups, variables=a.variables, start=a.start, end=a.end, codec=a.codec, control=control), a.format)
    elif a.command == "archive-restore":
        rows = cube.restore_archive(spark, a.archive, f"{a.target}/data", a.chunk, a.overwrite)
        if cube.exists(spark, f"{a.archive}/control/spans"):
            ingest.Product(a.target.rstrip("/").rsplit("/", 1)[-1], a.target.rstrip("/")).restore_control(spark, a.archive)
        _show({"rows": rows}, a.format)
    elif a.command in ("archive-info", "archive-list"):
        info = cube.archive_info(spark, a.archive)
        _show(info if a.command == "archive-info" else info["groups"], a.format)
    elif a.command == "archive-validate":
        good = cube.validate_archive(spark, a.archive, a.quick)
        _show({"valid": good}, a.format)
        return 0 if good else 1
    elif a.command == "advise-compliance":
        found = conventions.report(*[spark.read.parquet(p) for p in (a.attributes, a.variables, a.values)])
        _show(found.orderBy("code", "location").limit(1000).collect(), a.format)
        return conventions.exit_code(found, a.strict)
    elif a.command == "catalog":
        groups = [r["folder"].rsplit("/", 1)[-1] for r in files.catalogue_groups(spark, a.root).collect()]
        _show(cube.catalogue_entries(a.name, product.name, product.root, groups), a.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
