"""Run metrics in the text format that monitoring systems scrape."""

from __future__ import annotations

import re

from tessera.functions.scalars import label_value
from tessera.storage import Store

PREFIX = "tessera_run"


def label_name(key: str) -> str:
    """Letters, digits and underscores, at most 64, not beginning with a digit."""
    safe = re.sub(r"[^A-Za-z0-9_]", "_", key.strip()).strip("_") or "label"
    return (safe if safe[0].isalpha() else f"_{safe}")[:64]


def exposition(summary: dict, labels: dict) -> str:
    """One gauge for each number of a run's summary, with the labels; booleans count 0 or 1, other values are left out."""
    quoted = lambda v: label_value(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    shown = ",".join(f'{label_name(k)}="{quoted(v)}"' for k, v in sorted(labels.items()))
    lines = []
    for key, value in sorted(summary.items()):
        if isinstance(value, (int, float)) and value == value:
            name = f"{PREFIX}_{label_name(key)}"
            lines += [f"# TYPE {name} gauge", f"{name}{{{shown}}} {float(value):g}"]
    return "\n".join([*lines, ""])


def emit(store: Store, path: str, summary: dict, labels: dict) -> None:
    """Writes the metrics where a collector finds them; a failure to do so doesn't fail a run."""
    try:
        store.write(path, exposition(summary, labels).encode())
    except Exception as problem:  # noqa: BLE001
        print(f"metrics not written: {problem}")
