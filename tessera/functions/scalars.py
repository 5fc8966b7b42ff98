"""Scalar functions on keys, metadata, durations, paths and codec descriptions."""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_matches(key: Column, pattern: str) -> Column:
    """Anchored glob with * and ?; other characters are used as a regular expression.  A bad pattern matches nothing."""
    regex = "^" + pattern.replace("*", ".*").replace("?", ".") + "$"
    try:
        re.compile(regex)
    except re.error:
        return F.lit(False)
    return F.coalesce(key.rlike(regex), F.lit(False))


def glob_to_regex(pattern: str) -> str:
    """File-name glob (*, ?, [...]) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes, hours with minutes, or days with hours."""
    s = F.floor(seconds).cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d "), F.floor(s % 86400 / 3600).cast("string"), F.lit("h")))
    )


def domain_hash(identifier: Column) -> Column:
    return F.sha2(identifier.cast("binary"), 256)


def label_text(value: Column) -> Column:
    """A metric label: null is empty, longer texts are cut at 128 characters."""
    return F.coalesce(F.substring(value.cast("string"), 1, 128), F.lit(""))


#: A list with a longer item is no label.
LABEL_ITEM = 64


def label_value(value) -> str:
    """Driver-side label: long lists, lists of long items and mappings are empty."""
    if value is None or isinstance(value, dict):
        return ""
    if isinstance(value, (list, tuple, set)):
        items = [str(v) for v in value]
        return "" if len(items) > 5 or any(len(v) > LABEL_ITEM for v in items) else ",".join(items)
    return str(value)[:128]


def meta_equals(meta: Column, key: str, value) -> Column:
    """Whether a JSON object has exactly this value at a key; types matter (1 is not "1")."""
    wanted = json.dumps(value, sort_keys=True, separators=(",", ":"))
    found = F.to_json(F.try_variant_get(F.try_parse_json(meta), f"$['{key}']", "variant"))
    return F.coalesce(found == F.lit(wanted), F.lit(False))


def chunk_indices(path: Column) -> Column:
    """Indices in a chunk key .../c/i/j/k; empty where the path is no chunk."""
    tail = F.regexp_extract(path, r"/c/(\d+(?:/\d+)*)$", 1)
    return F.when(tail == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(tail, "/"), lambda x: x.cast("long")))


def run_id_of_range(base: str, start: int, end: int, group: str | None = None) -> str:
    """Run id of one slot range (and group) of a parallel run."""
    return base + (f"__group={quote(group, safe='')}" if group is not None else "") + f"__slot={start}-{end}"


def run_range(run_id: Column) -> Column:
    """(start, end, group) that a run id states; nulls where it states none."""
    bounds = lambda k: F.when(F.regexp_extract(run_id, r"__slot=(\d+)-(\d+)$", k) != "", F.regexp_extract(run_id, r"__slot=(\d+)-(\d+)$", k).cast("long"))
    group = F.regexp_extract(run_id, r"__group=([^_]*(?:_(?!_slot=)[^_]*)*)__slot=", 1)
    return F.struct(bounds(1).alias("start"), bounds(2).alias("end"), F.when(group != "", F.url_decode(F.replace(group, F.lit("+"), F.lit("%2B")))).alias("grp"))


def parse_run_range(run_id: str) -> tuple[int, int, str | None] | None:
    """Driver-side inverse of run_id_of_range; never raises."""
    m = re.search(r"(?:__group=(?P<g>.*?))?__slot=(\d+)-(\d+)$", run_id or "")
    return (int(m[2]), int(m[3]), unquote(m["g"]) if m["g"] is not None else None) if m else None


def canonical_value(value):
    """Sets, tuples and lists as sorted lists where they can be sorted."""
    if isinstance(value, (set, frozenset, tuple, list)):
        try:
            return sorted(value)
        except TypeError:
            return list(value)
    return value


def identity_hash(model) -> str:
    """SHA-256 of the canonical JSON of an index model."""
    return hashlib.sha256(json.dumps(model, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def parse_meta_filters(values: list[str]) -> dict:
    """k=v pairs; v may be JSON."""
    out = {}
    for item in values:
        key, eq, text = item.partition("=")
        if not eq or not key:
            raise ValueError(f"not key=value: {item!r}")
        try:
            out[key] = json.loads(text)
        except ValueError:
            out[key] = text
    return out


def parse_time_range(value: str) -> tuple[str, str]:
    """START:END of dates."""
    start, colon, end = value.partition(":")
    if not colon or not all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) for x in (start, end)):
        raise ValueError(f"not START:END of dates: {value!r}")
    return start, end


def coerce_option(text: str, kind: type):
    """An option given as text, as its annotated type."""
    if text is None or text.lower() in ("none", "null"):
        return None
    if kind is bool:
        if text.lower() in ("1", "true", "yes", "on"):
            return True
        if text.lower() in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"not a truth value: {text!r}")
    if kind in (int, float, str):
        return kind(text)
    return json.loads(text)


def parse_uri(target: str) -> dict:
    """Scheme, bucket and normalised path of a target; local paths have the scheme ``file``."""
    if re.match(r"^[A-Za-z]:[\\/]", target):
        return {"scheme": "file", "bucket": None, "path": target.replace("\\", "/"), "remote": False}
    parts = urlsplit(target)
    if parts.query or parts.fragment:
        raise ValueError(f"query or fragment in {target!r}")
    scheme = parts.scheme or "file"
    remote = scheme not in ("file", "")
    if remote and not parts.netloc:
        raise ValueError(f"no bucket in {target!r}")
    path = re.sub(r"/+", "/", parts.path) or "/"
    return {"scheme": scheme, "bucket": parts.netloc or None, "path": path.rstrip("/") or "/", "remote": remote}


def substitute_env(value, env: dict[str, str]):
    """${VAR} in texts, lists and mappings."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: substitute_env(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute_env(v, env) for v in value]
    return value


def normalise_codec(entry) -> dict:
    """A codec description with sorted keys and a configuration."""
    if isinstance(entry, str):
        entry = {"name": entry}
    config = entry.get("configuration") or {}
    return {"configuration": dict(sorted(config.items())), "name": entry["name"]}


#: Codecs that turn arrays to bytes, that compress bytes, and that change arrays.
SERIALIZERS = ("bytes", "sharding_indexed", "vlen-utf8", "vlen-bytes", "numcodecs.pcodec", "numcodecs.zfpy")
COMPRESSORS = ("blosc", "crc32c", "gzip", "zstd", "numcodecs.blosc", "numcodecs.bz2", "numcodecs.crc32", "numcodecs.crc32c", "numcodecs.gzip", "numcodecs.lz4", "numcodecs.lzma", "numcodecs.shuffle", "numcodecs.zlib", "numcodecs.zstd")
FILTERS = ("transpose", "numcodecs.astype", "numcodecs.bitround", "numcodecs.delta", "numcodecs.fixedscaleoffset", "numcodecs.packbits", "numcodecs.quantize")


def split_codecs(codecs: list) -> tuple[list, dict | None, list]:
    """Filters, serializer, compressors of a flat list; an unknown codec and a second serializer are errors."""
    found: dict[str, list] = {"filter": [], "serializer": [], "compressor": []}
    for entry in map(normalise_codec, codecs):
        kind = next((k for k, names in (("serializer", SERIALIZERS), ("compressor", COMPRESSORS), ("filter", FILTERS)) if entry["name"] in names), None)
        if kind is None:
            raise ValueError(f"unknown codec {entry['name']!r}")
        found[kind].append(entry)
    if len(found["serializer"]) > 1:
        raise ValueError("more than one codec turns the array to bytes")
    return found["filter"], next(iter(found["serializer"]), None), found["compressor"]


def compare_codecs(declared: list, stored: list) -> list[str]:
    """Differences between two codec pipelines, position by position."""
    a, b = [normalise_codec(x) for x in declared], [normalise_codec(x) for x in stored]
    out = [f"codec {i}: {x} is not {y}" for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y]
    return out + ([f"{len(a)} codecs declared, {len(b)} stored"] if len(a) != len(b) else [])


def missing_aware_equal(a: Column, b: Column) -> Column:
    """Null equals null, and NaN equals NaN."""
    return a.eqNullSafe(b)


def all_fill(data: Column, fill: Column) -> Column:
    return F.forall(data, lambda x: x.eqNullSafe(fill))


def decode_strings(column: Column) -> Column:
    """UTF-8 bytes as text, without trailing NULs; invalid bytes are an error."""
    return F.regexp_replace(F.validate_utf8(column.cast("string")), "\\x00+$", "")
