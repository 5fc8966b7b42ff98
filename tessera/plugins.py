"""User hooks: named ingestors with a source, a per-row coordinate and a DataFrame-to-DataFrame build step."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Callable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession

from tessera.functions.scalars import coerce_option
from tessera.functions.timeslots import TimeAxis


@runtime_checkable
class Ingestor(Protocol):
    """What a plugin must have.  Items and outputs are DataFrames, so Spark plans across the hooks."""

    def discover(self, spark: SparkSession, source: str) -> DataFrame: ...

    def build(self, items: DataFrame) -> DataFrame: ...


@dataclasses.dataclass(frozen=True)
class ArraySpec:
    """Declared layout of an array that is written directly: the first dimension is the slot."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str = "float64"
    attrs: dict[str, Any] = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Hooks:
    """Optional parts of a plugin, taken from its attributes; all have a neutral default."""

    axes: dict[str, TimeAxis] = dataclasses.field(default_factory=dict)
    coordinate: Callable[[DataFrame], Column] | None = None
    keep: Callable[[DataFrame], Column] | None = None
    slice_meta: dict[str, Any] = dataclasses.field(default_factory=dict)
    #: Groups of each item (an array); items are then built once for each, with the group in ``grp``.
    groups: Callable[[DataFrame], Column] | None = None
    #: Bytes of each item, for the batches' metrics.
    item_size: Callable[[DataFrame], Column] | None = None
    #: Before and after each batch, also a failed one, with the batch's id; the batches of a job are all prepared before it.
    prepare_batch: Callable[[str], None] | None = None
    cleanup_batch: Callable[[str], None] | None = None
    #: Whether the build treats each item by itself, so that one call may build the items of several batches.
    per_item: bool = False
    #: Run metrics from the batches' metrics; by default sums, lists in order and first values.
    aggregate: Callable[[DataFrame], DataFrame] | None = None
    #: Tables and views that the build needs.
    prepare_tables: Callable[[SparkSession], None] | None = None
    #: Direct arrays: the declared layout by name, and items as write intents (grp, array, slot, y0, payload).
    array_schema: dict[str, ArraySpec] = dataclasses.field(default_factory=dict)
    write_intents: Callable[[DataFrame], DataFrame] | None = None
    #: What the data catalogue says of a group; None hides it.
    catalog_info: Callable[[str], dict | None] | None = None
    on_start: Callable[[], None] | None = None
    on_success: Callable[[int], None] | None = None
    on_failure: Callable[[Exception], None] | None = None


#: Batches that one job builds at most.
JOB_BATCHES = 64


@dataclasses.dataclass
class Engine:
    """Options of a run that belong to the engine."""

    chunk: int = 100
    batch_items: int = 0
    workers: int = 1
    keep_going: bool = False
    output: str = "cube"
    job_batches: int = JOB_BATCHES


_REGISTRY: dict[str, type] = {}


def register(name: str) -> Callable[[type], type]:
    """Class decorator; a repeated name replaces the earlier plugin."""

    def add(cls: type) -> type:
        if not all(callable(getattr(cls, m, None)) for m in ("discover", "build")):
            raise TypeError(f"{cls.__name__} lacks discover or build")
        cls.name = name
        _REGISTRY[name] = cls
        return cls

    return add


def discover_entry_points(group: str = "tessera.ingestors") -> list[str]:
    """Loads installed plugins and names all that are registered."""
    from importlib.metadata import entry_points

    for point in entry_points(group=group):
        _REGISTRY.setdefault(point.name, point.load())
    return sorted(_REGISTRY)


def get(name: str) -> type:
    if name not in _REGISTRY:
        raise KeyError(f"no plugin {name!r}; there are {', '.join(sorted(_REGISTRY)) or 'none'}")
    return _REGISTRY[name]


def hooks_of(plugin: Any) -> Hooks:
    return Hooks(**{f.name: getattr(plugin, f.name) for f in dataclasses.fields(Hooks) if getattr(plugin, f.name, None) is not None})


def option_schema(cls: type) -> dict[str, dict]:
    """Options of a plugin's ``Options`` dataclass: type, default, required."""
    options = getattr(cls, "Options", None)
    if options is None:
        return {}
    hints = typing.get_type_hints(options)
    missing = dataclasses.MISSING
    return {f.name: {"type": getattr(hints[f.name], "__name__", str(hints[f.name])), "required": f.default is missing and f.default_factory is missing, "default": None if f.default is missing else f.default} for f in dataclasses.fields(options)}


def _coerced(hints: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    return {k: coerce_option(v, hints[k]) if isinstance(v, str) else v for k, v in given.items()}


def split_tiers(cls: type, given: dict[str, Any]) -> tuple[Engine, dict[str, Any], dict[str, Any]]:
    """Options by who takes them: the engine, the plugin, and experimental ones (x_); any other key is refused."""
    hints = typing.get_type_hints(getattr(cls, "Options", None) or Engine)
    engine = typing.get_type_hints(Engine)
    own = set(hints) if getattr(cls, "Options", None) else set()
    unknown = sorted(k for k in given if k not in own and k not in engine and not k.startswith("x_"))
    if unknown:
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    mine = {k: v for k, v in given.items() if k in own}
    return Engine(**_coerced(engine, {k: v for k, v in given.items() if k in engine and k not in own})), mine, {k: v for k, v in given.items() if k.startswith("x_")}


def configure(cls: type, given: dict[str, Any]) -> Any:
    """The plugin with its options coerced, the engine's in ``engine`` and experimental ones in ``experimental``."""
    plugin = cls()
    plugin.engine, mine, plugin.experimental = split_tiers(cls, given)
    if getattr(cls, "Options", None):
        plugin.options = cls.Options(**_coerced(typing.get_type_hints(cls.Options), mine))
    return plugin
