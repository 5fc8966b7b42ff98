"""Token-id shards compressed by a Re-Pair grammar, with random access to documents.

File format: Parquet tables that Spark writes (so that the commit protocol covers lost tasks, on any file system), one
row per shard.  A shard covers consecutive documents in ascending doc_id order:

    part, shard       the shard's place: part of the doc_id range, number within the part
    first_start       ids before the shard within its part
    n_ids             ids in the shard, each document's end id included
    alphabet          ids are below this; rule k replaces its pair by the symbol alphabet + k
    n_rules, rules    the pairs, two symbols a rule; a rule only names earlier symbols
    reach, expansions how many ids the symbol of each rule stands for, in ``reach`` bits
    n_symbols, symbols  the replaced sequence
    width             bits of a symbol in ``rules`` and ``symbols``, least significant bit first
    doc_ids, doc_ids_null, doc_sizes    int64 ids (and a flag byte each), uint32 id counts of the documents

Rules are made until no pair of symbols occurs twice in the shard.  They are made in rounds: each takes all pairs that
repeat, from the most frequent on, except where a more frequent pair overlaps.

To read document d, take the running sum of its symbols' expansions, find the first symbol that reaches into it and
expand from there; nothing else is decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, materialize, unique_docs
from tessera.llm.pretokens import chunks, library_memo

END_ID = 0
#: A shard is closed at so many ids; a longer document still forms one shard.
SHARD_IDS = 1 << 20
#: Bytes of text that are split at a time.
SPLIT_BYTES = 8 << 20
#: A pair gets a rule if it occurs so often.
LEAST = 2
FILE = "part int, shard int, first_start long, n_ids long, alphabet long, n_rules long, rules binary, reach int, expansions binary, width int, n_symbols long, symbols binary, doc_ids binary, doc_ids_null binary, doc_sizes binary"


def _sorted_pairs(left: np.ndarray, right: np.ndarray, places: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (left << 32 | right) in order, how often each occurs, and all places by pair and place.

    places come ascending; all symbols are below ``symbols``.
    """
    bits, place_bits = np.uint64(max(1, (symbols - 1).bit_length())), np.uint64(int(places[-1]).bit_length())
    keys = left.astype(np.uint64)
    if 2 * int(bits) + int(place_bits) <= 64:  # one sort of numbers that hold both
        keys <<= bits
        keys |= right
        keys <<= place_bits
        keys |= places.view(np.uint64)
        keys.sort()
        starts = np.flatnonzero((keys[1:] ^ keys[:-1]) >= np.uint64(1) << place_bits) + 1
        first = keys[np.append(0, starts)] >> place_bits
        pairs = first >> bits << np.uint64(32) | first & ((np.uint64(1) << bits) - np.uint64(1))
        keys &= (np.uint64(1) << place_bits) - np.uint64(1)
        places = keys.view(np.int64)
    else:
        keys = keys << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        pairs = keys[np.append(0, starts)]
    return pairs, np.diff(np.append(0, starts), append=len(keys)), places


class _Sequence:
    """The symbols end to end, and the places whose pair may repeat.

    A pair of symbols that exist already never becomes more frequent; so beside the pairs that repeat, only those with a
    new symbol are looked at again.
    """

    def __init__(self, ids: np.ndarray):
        self.symbols = np.array(ids, np.uint32)
        self.open = np.arange(max(0, len(ids) - 1))

    def round(self, first_symbol: int, least: int) -> np.ndarray:
        """Replaces pairs that occur often enough, the more frequent first; returns those that got a symbol."""
        if not len(self.open):
            return np.zeros(0, np.uint64)
        none = len(self.symbols) + 1
        pairs, times, places = _sorted_pairs(self.symbols.take(self.open), self.symbols[1:].take(self.open), self.open, first_symbol)
        frequent = np.flatnonzero(times >= least)
        order = frequent[np.sort((none - times[frequent]) << 32 | np.arange(len(frequent))) & 0xFFFFFFFF]  # ties by pair
        rank_of = np.full(len(pairs), none, np.int32)
        rank_of[order] = np.arange(len(order))
        rank = np.full(none + 1, none, np.int32)  # each place between its neighbours: place p at p + 1
        mine = rank[1:-1]
        mine[places] = np.repeat(rank_of, times)
        taken = self._winners(rank, none)
        ranks = mine.take(taken)
        accepted = np.bincount(ranks, minlength=len(order)) >= least
        if not accepted.any():
            # What overlaps kept every pair below: the most frequent pair that can be replaced often enough goes alone.
            at = np.flatnonzero(mine < none)
            for k in range(len(order)):
                alone = self._every_second(at[mine[at] == k])
                if len(alone) >= least:
                    taken, ranks = alone, np.full(len(alone), k)
                    accepted[k] = True
                    break
        if not accepted.any():
            self.open = self.open[:0]
            return np.zeros(0, np.uint64)
        keep = accepted.take(ranks)
        self._replace(taken.compress(keep), (first_symbol + np.cumsum(accepted) - 1).take(ranks.compress(keep)), rank[:-1] < none)
        return pairs[order[accepted]]

    def _runs(self, places: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of neighbouring places of one rank begin, and their lengths: longer than 1 where a symbol repeats."""
        fresh = np.concatenate([[True], (places[:-1] + 1 != places[1:]) | (ranks[1:] != ranks[:-1])])[: len(places)]
        begins = np.flatnonzero(fresh)
        return begins, np.diff(begins, append=len(places))

    def _winners(self, rank: np.ndarray, none: int) -> np.ndarray:
        """Places that win over the pairs on both sides.

        Of a run of places of one rank that wins, every second one is taken.
        """
        before, mine, after = rank[:-2], rank[1:-1], rank[2:]
        won = (mine < before) & (mine < after)
        equal = (rank[1:] == rank[:-1]) & (rank[1:] < none)
        if equal.any():
            tied = np.flatnonzero(equal[1:] | equal[:-1])
            ranks = mine[tied]
            begins, sizes = self._runs(tied, ranks)
            wins = (ranks[begins] < before[tied[begins]]) & (ranks[begins] < after[tied[begins + sizes - 1]])
            begins, halves = begins[wins], (sizes[wins] + 1) // 2
            won[tied[np.repeat(begins, halves) + 2 * (np.arange(halves.sum()) - np.repeat(np.cumsum(halves) - halves, halves))]] = True
        return np.flatnonzero(won)

    def _every_second(self, places: np.ndarray) -> np.ndarray:
        begins, sizes = self._runs(places, np.zeros(len(places)))
        return places[(np.arange(len(places)) - np.repeat(begins, sizes)) % 2 == 0]

    def _replace(self, places: np.ndarray, symbols: np.ndarray, look: np.ndarray) -> None:
        """look: the places to look at again (place p at p + 1); those beside a new symbol join them."""
        self.symbols[places] = symbols
        look[places] = True
        look[places + 1] = True
        alive = np.ones(len(self.symbols), bool)
        alive[places + 1] = False
        # A mask copies run by run, which is fast where few symbols go; else their places are faster.
        left = alive if 16 * len(places) < len(alive) else np.flatnonzero(alive)
        self.symbols = self.symbols[left]
        self.open = np.flatnonzero(look[1:][left][:-1])


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rules (pairs), expansion length of each rule's symbol, the replaced sequence, and the alphabet's size.

    In the end no pair occurs ``least`` times without overlapping itself.
    """
    rules, expansions = [], np.zeros(0, np.int64)
    alphabet = int(ids.max(initial=0)) + 1
    if alphabet + len(ids) > 1 << 32:
        raise ValueError("ids and rules must fit 32 bits")
    sequence = _Sequence(ids)
    while len(pairs := sequence.round(alphabet + len(expansions), least)):
        sides = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)
        expansions = np.concatenate([expansions, _lengths(sides, expansions, alphabet).sum(1)])
        rules.append(sides)
    return np.concatenate([np.zeros((0, 2), np.int64), *rules]).astype(np.uint32), expansions, sequence.symbols, alphabet


def _lengths(symbols: np.ndarray, expansions: np.ndarray, alphabet: int) -> np.ndarray:
    """How many ids each symbol (int64) stands for."""
    rules = np.minimum((symbols - alphabet).view(np.uint64), np.uint64(len(expansions)))  # ids wrap round and get the last place
    return np.append(expansions, 1).take(rules.view(np.int64))


def expand(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, alphabet: int) -> np.ndarray:
    """The ids of a sequence of symbols: each rule's symbol is taken apart at its place until only ids are left."""
    symbols, left, right = symbols.astype(np.int64), rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
    sizes, skip = _lengths(symbols, expansions, alphabet), _lengths(left, expansions, alphabet)
    out, places = np.empty(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
    out[places] = symbols
    at = np.flatnonzero(symbols >= alphabet)
    rule, places = symbols.take(at) - alphabet, places.take(at)
    while len(rule):
        first, second, beyond = left.take(rule), right.take(rule), places + skip.take(rule)
        out[places], out[beyond] = first, second
        a, b = np.flatnonzero(first >= alphabet), np.flatnonzero(second >= alphabet)
        rule, places = np.append(first.take(a), second.take(b)) - alphabet, np.append(places.take(a), beyond.take(b))
    return out


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """width (at most 32) bits each, groups of 8 values in ``width`` bytes."""
    padded = np.zeros(-(-len(values) // 8) * 8, np.uint64)
    padded[: len(values)] = values
    groups, out = padded.reshape(-1, 8), np.zeros((len(padded) // 8, width + 8), np.uint8)
    for k in range(8):
        shifted = groups[:, k] << np.uint64(k * width % 8)
        for b in range((width + k * width % 8 + 7) // 8):
            out[:, k * width // 8 + b] |= (shifted >> np.uint64(8 * b)).astype(np.uint8)
    return out[:, :width].tobytes()


def unpack_bits(raw: bytes, width: int, n: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).reshape(-1, width)
    data = np.concatenate([data, np.zeros((len(data), 8), np.uint8)], 1)
    out = np.empty((len(data), 8), np.uint64)
    for k in range(8):
        value, at, shift = np.zeros(len(data), np.uint64), k * width // 8, k * width % 8
        for b in range((width + shift + 7) // 8):
            value |= data[:, at + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, k] = value >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n].astype(np.uint32)


def grammar(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules, expansion lengths and alphabet of a shard row."""
    rules = unpack_bits(shard["rules"], shard["width"], 2 * shard["n_rules"]).reshape(-1, 2)
    expansions = unpack_bits(shard["expansions"], shard["reach"], shard["n_rules"]).astype(np.int64)
    return unpack_bits(shard["symbols"], shard["width"], shard["n_symbols"]), rules, expansions, shard["alphabet"]


def read_document(shard: dict, index: int) -> np.ndarray:
    """Random access: the ids (with the end id) of one document of a shard row, expanding only the symbols that cover it."""
    sizes = np.frombuffer(shard["doc_sizes"], np.uint32).astype(np.int64)
    first = int(sizes[:index].sum())
    symbols, rules, expansions, alphabet = grammar(shard)
    ends = np.cumsum(_lengths(symbols.astype(np.int64), expansions, alphabet))
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, first + sizes[index])
    skipped = first - (int(ends[a - 1]) if a else 0)
    return expand(symbols[a : b + 1], rules, expansions, alphabet)[skipped : skipped + sizes[index]]


def write_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all documents and write the shard table; returns it, read back.

    docs needs ``doc_id`` and ``text``; other columns are ignored.  Documents are dealt by ranges of doc_id (null ids
    first) and sorted within a task.  A null or empty text is the end id alone; rows that share a doc_id, or have none,
    stand one after the other and may be dealt to several tasks.  Ids and rules together must fit 32 bits, or a ValueError is
    raised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, memo, end = TaskContext.get().partitionId(), library_memo(path), np.array([END_ID], "<u4").tobytes()
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        shard = first = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, first
            ids = np.frombuffer(b"".join(held), np.uint32)
            rules, expansions, sequence, alphabet = compress(ids)
            width, reach = (alphabet + len(rules)).bit_length(), max(1, int(expansions.max(initial=0)).bit_length())
            row = {"part": part, "shard": shard, "first_start": first, "n_ids": len(ids), "alphabet": alphabet, "n_rules": len(rules), "rules": pack_bits(rules.reshape(-1), width), "reach": reach, "expansions": pack_bits(expansions, reach)}
            row |= {"width": width, "n_symbols": len(sequence), "symbols": pack_bits(sequence, width)}
            row |= {"doc_ids": np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes(), "doc_ids_null": bytes(d is None for d in doc_ids), "doc_sizes": np.array(sizes, np.uint32).tobytes()}
            shard, first = shard + 1, first + len(ids)
            held.clear(), doc_ids.clear(), sizes.clear()
            kinds = {c: pa.int32() for c in ("part", "shard", "width", "reach")} | {c: pa.int64() for c in ("first_start", "n_ids", "alphabet", "n_rules", "n_symbols")}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))

        total = 0
        for batch in batches:
            for chunk in chunks(batch.column(1), SPLIT_BYTES):
                at, raw = chunk.gather(memo.values(chunk.words))
                for k, doc_id in enumerate(batch.column(0).slice(chunk.rows.start, len(chunk.rows)).to_pylist()):
                    held += [bytes(raw[at[k] : at[k + 1]]), end]
                    doc_ids.append(doc_id)
                    sizes.append(int(at[k + 1] - at[k]) // 4 + 1)
                    total += sizes[-1]
                    if total >= shard_ids:
                        yield close()
                        total = 0
        if doc_ids:
            yield close()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A hot doc_id, null included, is split by its texts, and equal rows by where they were read.
    keyed = unique_docs(docs, "doc_id", "text").withColumns({"hash": F.xxhash64("text"), "read": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(parts, "doc_id", "hash", "read").sortWithinPartitions("doc_id", "hash", "read").select("doc_id", "text")
    return materialize(map_arrow(ordered, run, FILE), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode whole shards: one row per document with its place in the global order of ids, its length and checksum."""
    spark = shards.sparkSession
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per part of the range
    before, rows = 0, []
    for r in sums:
        rows.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(rows, "part int, part_start long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["doc_sizes"], np.uint32).astype(np.int64)
                ids = memoryview(expand(*grammar(row)).view(np.uint8))
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[4 * (b - n) : 4 * b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["doc_ids_null"], np.uint8) > 0)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(row["part_start"] + row["first_start"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(shards.join(starts, "part"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents as Re-Pair shards and return, from the files, each document's place, length and checksum."""
    return read_shards(write_shards(docs, path))
