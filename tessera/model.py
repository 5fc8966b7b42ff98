"""Schemas of the engine's tables."""

from __future__ import annotations

#: Irregular samples: ``pos`` is the explicit input order that first and last refer to.
SAMPLES = "lat double, lon double, pos long"
RUNS = "product string, run_id string, status string, started_at double, updated_at double, completed_at double, events int, parts int, error string, run_stale_threshold_s int, slot_range array<bigint>, slot_group string"
EVENTS = "product string, run_id string, part int, idx int, event_id string, event_type string, timestamp double, record string, meta string"
RANGES = "array<struct<start:bigint,end:bigint>>"
RECORD = f"key string, type string, status string, size bigint, timestamp double, run_id string, batch_id string, grp string, time_min string, time_max string, ranges {RANGES}, aligned boolean, state_array string, replaced_by string, replaced_at double, replacing_run_id string, replaced_span_keys array<string>, schema_version int"
#: A projected record.
SPANS = f"product string, key string, type string, status string, size bigint, timestamp double, run_id string, batch_id string, grp string, time_min string, time_max string, ranges {RANGES}, aligned boolean, state_array string, replaced_by string, replaced_at double, meta string"
SLOT_STATE = "grp string, slot long, state tinyint"
INDEX_AXES = "grp string, epoch_s long, cadence_s long, mode string, size long"

#: States of a slot, and statuses after which a run never changes.
UNKNOWN, PRESENT, DELETED, FAILED_BATCH = 0, 1, 2, 3
TERMINAL = ("complete", "failed", "abandoned")
#: Version of the event records that can be read.
SCHEMA_VERSION = 1
