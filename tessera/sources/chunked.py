"""Chunked array stores (Zarr v3 layout): metadata, a Python data source that reads arrays as tidy rows, and a writer.

Supported: regular chunk grids, plain or sharded, ``bytes`` with transposition and with no, gzip or zstd compression, chunk
keys c/i/j/k.  Stores are on any file system that Arrow opens.
"""

from __future__ import annotations

import gzip
import json
import math
from collections.abc import Iterator, Mapping, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.scalars import normalise_codec, split_codecs
from tessera.storage import arrow_file

#: Prefixes of chunk keys that are listed on the driver at most before the tasks go on, and tasks at most.
LISTED, TASKS = 256, 4096
ABSENT = 2**64 - 1


def _read(path: str) -> bytes | None:
    """The bytes of a file, or None where there is none."""
    fs, target = arrow_file(path)
    try:
        with fs.open_input_stream(target) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def _children(path: str, recursive: bool = False) -> list:
    from pyarrow.fs import FileSelector

    fs, target = arrow_file(path)
    return fs.get_file_info(FileSelector(target, allow_not_found=True, recursive=recursive))


def array_meta(path: str) -> dict:
    """Shape, chunks, dtype, fill value, dimension names, attributes and codecs of one array."""
    stored = _read(f"{path}/zarr.json")
    raw = json.loads(stored) if stored is not None else {}
    if raw.get("node_type") != "array":
        raise ValueError(f"{path} is no array")
    chunks = raw["chunk_grid"]["configuration"]["chunk_shape"]
    names = raw.get("dimension_names") or [f"dim_{k}" for k in range(len(raw["shape"]))]
    _, serializer, _ = split_codecs(raw.get("codecs", []))
    sharded = serializer is not None and serializer["name"] == "sharding_indexed"
    inner = serializer["configuration"]["chunk_shape"] if sharded else chunks
    return {"shape": raw["shape"], "chunks": chunks, "inner_chunks": inner, "shards": chunks if sharded else None, "dtype": raw["data_type"], "fill": raw.get("fill_value", 0), "dims": names, "attrs": raw.get("attributes", {}), "codecs": raw.get("codecs", [])}


def group_exists(path: str) -> bool:
    """Whether a path is a group of arrays."""
    stored = _read(f"{path}/zarr.json")
    return stored is not None and json.loads(stored).get("node_type") == "group"


def discover_groups(root: str, depth: int = 5, control: str = "_control") -> list[str]:
    """Paths of the groups below root, not entering arrays, chunk or control directories."""
    from pyarrow.fs import FileType

    found, open_paths = [], [("", 0)]
    while open_paths:
        path, level = open_paths.pop()
        stored = _read(f"{root}/{path}/zarr.json" if path else f"{root}/zarr.json")
        if stored is not None:
            if json.loads(stored).get("node_type") == "array":
                continue
            if path:
                found.append(path)
        if level < depth:
            folders = [i.base_name for i in _children(f"{root}/{path}" if path else root) if i.type == FileType.Directory]
            open_paths += [(f"{path}/{d}".lstrip("/"), level + 1) for d in folders if d not in ("c", control)]
    return sorted(found)


def inner_chunk(size: int) -> int:
    """Largest divisor of a length that is at most a quarter of it, at least 1."""
    return next((d for d in range(max(1, size // 4), 0, -1) if size % d == 0), 1)


def _decode(raw: bytes, codecs: list, shape: Sequence[int], dtype: str) -> np.ndarray:
    """One chunk that isn't sharded."""
    filters, serializer, compressors = split_codecs(codecs)
    for codec in reversed(compressors):
        if codec["name"] == "gzip":
            raw = gzip.decompress(raw)
        elif codec["name"] == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif codec["name"] == "crc32c":
            raw = raw[:-4]
        else:
            raise ValueError(f"codec {codec['name']} is not supported")
    big = serializer is not None and serializer["configuration"].get("endian") == "big"
    order = np.arange(len(shape))
    for codec in filters:
        if codec["name"] != "transpose":
            raise ValueError(f"codec {codec['name']} is not supported")
        order = order[list(codec["configuration"]["order"])]
    stored = np.frombuffer(raw, np.dtype(dtype).newbyteorder(">" if big else "<")).reshape([shape[k] for k in order])
    return stored.transpose(np.argsort(order))


def _blocks(raw: bytes, meta: Mapping) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """First element (within the stored chunk) and values of each block: the chunk, or the stored inner chunks of a shard."""
    if meta["shards"] is None:
        yield (0,) * len(meta["shape"]), _decode(raw, meta["codecs"], meta["chunks"], meta["dtype"])
        return
    config = split_codecs(meta["codecs"])[1]["configuration"]
    counts = [s // c for s, c in zip(meta["chunks"], meta["inner_chunks"], strict=True)]
    tail = sum(4 for c in map(normalise_codec, config.get("index_codecs", [])) if c["name"] == "crc32c")
    size = 16 * math.prod(counts)
    start = 0 if config.get("index_location", "end") == "start" else len(raw) - size - tail
    index = np.frombuffer(raw[start : start + size], "<u8").reshape(-1, 2)
    for k, (offset, length) in enumerate(index.tolist()):
        if offset != ABSENT:
            place = np.unravel_index(k, counts)
            yield tuple(int(i) * c for i, c in zip(place, meta["inner_chunks"], strict=True)), _decode(raw[offset : offset + length], config["codecs"], meta["inner_chunks"], meta["dtype"])


class _Prefixes(InputPartition):
    def __init__(self, prefixes: list[tuple[int, ...]]):
        super().__init__(prefixes)
        self.prefixes = prefixes


class ChunkedReader(DataSourceReader):
    """Stored chunks only, found by listing: the driver lists the first levels of the keys, the tasks the rest."""

    def __init__(self, path: str, bounds: Mapping[str, Sequence[int]]):
        self.path, self.meta = path, array_meta(path)
        self.bounds = [tuple(bounds.get(d, (0, n))) for d, n in zip(self.meta["dims"], self.meta["shape"], strict=True)]

    def _meets(self, index: Sequence[int]) -> bool:
        """A chunk, or the beginning of its key, can hold wanted elements."""
        return all(i * c < high and (i + 1) * c > low for i, c, (low, high) in zip(index, self.meta["chunks"], self.bounds, strict=False))

    def partitions(self) -> list[InputPartition]:
        rank, prefixes = len(self.meta["shape"]), [()]
        for _ in range(rank - 1):
            if len(prefixes) >= LISTED:
                break
            folders = [(p, i.base_name) for p in prefixes for i in _children("/".join([self.path, "c", *map(str, p)]))]
            prefixes = sorted((*p, int(name)) for p, name in folders if name.isdigit() and self._meets((*p, int(name))))
        a_task = max(1, -(-len(prefixes) // TASKS))
        return [_Prefixes(prefixes[k : k + a_task]) for k in range(0, len(prefixes), a_task)] or [_Prefixes([])]

    def _chunks(self, prefix: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        rank = len(self.meta["shape"])
        if not rank:
            yield ()
            return
        for entry in _children("/".join([self.path, "c", *map(str, prefix)]), recursive=True) if len(prefix) < rank else []:
            names = entry.path.split("/")[-(rank - len(prefix)) :]
            if all(n.isdigit() for n in names) and entry.is_file and self._meets(index := (*prefix, *map(int, names))):
                yield index

    def read(self, partition: _Prefixes) -> Iterator[pa.RecordBatch]:
        meta, names = self.meta, [*self.meta["dims"], "value"]
        for index in (i for p in partition.prefixes for i in self._chunks(p)):
            raw = _read("/".join([self.path, "c", *map(str, index)]))
            if raw is None:
                continue  # a chunk that isn't stored holds fill values only
            for inside, block in _blocks(raw, meta):
                first = [i * c + o for i, c, o in zip(index, meta["chunks"], inside, strict=True)]
                low = [max(0, a - f) for f, (a, _) in zip(first, self.bounds, strict=True)]
                high = [min(n, b - f, s - f) for n, f, s, (_, b) in zip(block.shape, first, meta["shape"], self.bounds, strict=True)]
                if any(a >= b for a, b in zip(low, high, strict=True)):
                    continue
                block = block[tuple(slice(a, b) for a, b in zip(low, high, strict=True))]
                places = [p.ravel() + f + a for p, f, a in zip(np.indices(block.shape), first, low, strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.array(p.astype(np.int64)) for p in places], pa.array(block.ravel().astype(float), from_pandas=True)], names)


class ChunkedSource(DataSource):
    """``spark.read.format("chunked").load(array path)``: a row for each stored element; NaN is null.

    The option bounds, a JSON object of dimension: [first, end], restricts the elements and with them the chunks opened.
    """

    @classmethod
    def name(cls) -> str:
        return "chunked"

    def schema(self) -> str:
        return ", ".join(f"`{d}` long" for d in array_meta(self.options["path"])["dims"]) + ", value double"

    def reader(self, schema) -> ChunkedReader:
        return ChunkedReader(self.options["path"], json.loads(self.options.get("bounds", "{}")))


def read_array(spark: SparkSession, path: str, slots: tuple[int, int] | None = None, bounds: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """The stored elements, within bounds of the dimensions; slots bound the first one."""
    spark.dataSource.register(ChunkedSource)
    wanted = dict(bounds or {}) | ({array_meta(path)["dims"][0]: list(slots)} if slots else {})
    return spark.read.format("chunked").option("bounds", json.dumps(wanted)).load(path)


def crc32c(data: bytes) -> int:
    """The checksum of shard indices (reflected Castagnoli polynomial), for short inputs."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def create_array(path: str, dims: Sequence[str], shape: Sequence[int], chunks: Sequence[int], dtype: str = "float64", compress: bool = True, attrs: dict | None = None, inner: Sequence[int] | None = None) -> dict:
    """Writes an array's metadata, or makes a stored array longer in its first dimension; any other change is an error.

    With ``inner`` the chunks are shards of inner chunks, which must divide them.
    """
    little = {"name": "bytes", "configuration": {"endian": "little"}}
    codecs = [little] + ([{"name": "zstd", "configuration": {"level": 3, "checksum": False}}] if compress else [])
    if inner is not None:
        if any(c % i for c, i in zip(chunks, inner, strict=True)):
            raise ValueError(f"shards {list(chunks)} don't hold whole chunks {list(inner)}")
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(inner), "codecs": codecs, "index_codecs": [little, {"name": "crc32c"}], "index_location": "end"}}]
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": codecs, "attributes": attrs or {}, "dimension_names": list(dims)}
    if (stored := _read(f"{path}/zarr.json")) is not None:
        old = json.loads(stored)
        if [old[k] for k in ("chunk_grid", "data_type", "dimension_names", "codecs")] != [meta[k] for k in ("chunk_grid", "data_type", "dimension_names", "codecs")] or old["shape"][1:] != meta["shape"][1:]:
            raise ValueError(f"{path} is stored with another layout")
        meta = old | {"shape": [max(old["shape"][0], shape[0]), *shape[1:]]}
    _put(f"{path}/zarr.json", json.dumps(meta).encode())
    return meta


def _put(path: str, raw: bytes) -> None:
    """A file written under a temporary name that is then given its own, so a repeated task does no harm."""
    fs, target = arrow_file(path)
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    part = f"{target}.tmp-{uuid4().hex}"
    with fs.open_output_stream(part) as stream:
        stream.write(raw)
    fs.move(part, target)


def _encode(block: np.ndarray, dtype: str, compress: bool, inner: Sequence[int] | None) -> bytes:
    """A chunk's bytes, or a shard of inner chunks with their index; inner chunks of fill values only are left out."""
    if inner is not None:
        counts = [n // i for n, i in zip(block.shape, inner, strict=True)]
        body, index = [], np.full((math.prod(counts), 2), ABSENT, "<u8")
        for k in range(len(index)):
            at = tuple(slice(p * i, (p + 1) * i) for p, i in zip(np.unravel_index(k, counts), inner, strict=True))
            if not np.isnan(block[at]).all():
                raw = _encode(block[at], dtype, compress, None)
                index[k] = sum(map(len, body)), len(raw)
                body.append(raw)
        return b"".join([*body, index.tobytes(), crc32c(index.tobytes()).to_bytes(4, "little")])
    raw = np.ascontiguousarray(block.astype(np.dtype(dtype).newbyteorder("<"))).tobytes()
    if compress:
        import zstandard

        raw = zstandard.ZstdCompressor(level=3).compress(raw)
    return raw


def write_array(rows: DataFrame, path: str, dims: Sequence[str], shape: Sequence[int], chunks: Sequence[int], value: str = "value", dtype: str = "float64", compress: bool = True, attrs: dict | None = None, update: bool = False, inner: Sequence[int] | None = None) -> int:
    """Writes tidy rows as one array; absent elements are NaN, or with update stay as they are stored.

    A chunk (with ``inner``, a shard) is written by one task.  Returns the number of chunks.
    """
    meta = create_array(path, dims, shape, chunks, dtype, compress, attrs, inner)
    layout = {"shape": meta["shape"], "chunks": list(chunks), "inner_chunks": list(inner or chunks), "shards": list(chunks) if inner else None, "dtype": dtype, "codecs": meta["codecs"]}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        file = "/".join([path, "c", *[str(k.as_py()) for k in key]])
        block, stored = np.full(chunks, np.nan), _read(file) if update else None
        for first, part in _blocks(stored, layout) if stored is not None else ():
            block[tuple(slice(f, f + n) for f, n in zip(first, part.shape, strict=True))] = part
        at = tuple(np.asarray(table.column(d)) - k.as_py() * c for d, k, c in zip(dims, key, chunks, strict=True))
        block[at] = table.column(value).to_numpy()
        raw = _encode(block, dtype, compress, inner)
        _put(file, raw)
        return pa.table({"bytes": pa.array([len(raw)], pa.int64())})

    keyed = rows.select(*dims, value, *[F.floor(F.col(d) / c).cast("long").alias(f"_c{k}") for k, (d, c) in enumerate(zip(dims, chunks, strict=True))])
    return keyed.groupBy(*[f"_c{k}" for k in range(len(dims))]).applyInArrow(run, "bytes long").count()
