"""Packing of tokenised documents by cutting-stock column generation.

1. Every document is cut into full sequences and one remainder shorter than a sequence.  Full sequences need no packing.
2. The histogram of remainder lengths (classes of ``WIDTH`` tokens, rounded up) is a cutting-stock instance: stock of one
   sequence, demand per class.  A linear program over cutting patterns is solved by column generation on the driver: a
   knapsack by dynamic programming prices new patterns by the duals, until no pattern (or only a negligible gain) is
   left.  The instance has at most 1024 / WIDTH classes whatever the size of the corpus.
3. The rounded-down pattern counts are kept; what is left over is filled greedily.
4. Within each class the remainders are ranked (per-task counts and their running sums, so no class is sorted as a
   whole), and the rank says which sequence of which pattern holds the remainder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import map_arrow, materialize, unique_docs
from tessera.llm.pretokens import chunks, library_memo

SEQUENCE = 1024
#: Lengths within so many tokens share a class of the histogram.
WIDTH = 8
END_ID = 0
#: The linear program ends when the knapsack finds no pattern worth more than 1 plus this; by Farley's bound the plan is
#: then within that share of the optimum.
TOLERANCE = 3e-3
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long, class int"


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of class sizes 1..len(values) of the highest value within the capacity."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for room in range(1, capacity + 1):
        k = min(room, len(values))
        worth = values[:k] + best[room - 1 :: -1][:k] if k else values[:0]
        i = int(np.argmax(worth))
        if worth[i] > best[room - 1] + 1e-12:
            best[room], choice[room] = worth[i], i + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(values), int), capacity
    while room > 0:
        if choice[room]:
            counts[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def greedy_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing on the histogram: fills a pattern from the longest class down, uses it as often as it lasts."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        room, counts = capacity, np.zeros(len(left), int)
        while room:
            open_classes = np.flatnonzero(left[:room] > counts[:room])
            if not len(open_classes):
                break
            c = open_classes[-1]
            take = int(min(room // (c + 1), left[c] - counts[c]))
            counts[c] += take
            room -= take * (c + 1)
        used = np.flatnonzero(counts)
        times = int((left[used] // counts[used]).min())
        left -= counts * times
        out.append((counts, times))
    return out


def solve_cutting_stock(demand: np.ndarray, capacity: int, tolerance: float = TOLERANCE) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used; together they offer at least one place for every unit of demand.

    demand[i]: pieces of size i + 1.  Revised simplex over the patterns: the basis starts with the patterns of one size
    only, the knapsack finds the entering one.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    m, want = len(sizes), demand[sizes - 1].astype(float)
    patterns = [np.bincount([i], minlength=m) * (capacity // s) for i, s in enumerate(sizes)]
    inverse = np.diag([1 / (capacity // s) for s in sizes])
    amounts = inverse @ want
    for _ in range(60 * m):
        duals = np.maximum(inverse.sum(axis=0), 0)  # every pattern costs one sequence
        values = np.zeros(sizes[-1])
        values[sizes - 1] = duals
        worth, counts = best_pattern(values, capacity)
        if worth <= 1 + tolerance:
            break
        entering = counts[sizes - 1]
        direction = inverse @ entering
        steps = np.full(m, np.inf)
        steps[direction > 1e-9] = amounts[direction > 1e-9] / direction[direction > 1e-9]
        leaving = int(np.argmin(steps))
        if not np.isfinite(steps[leaving]):
            break
        amounts = np.maximum(amounts - direction * steps[leaving], 0)
        amounts[leaving] = steps[leaving]
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        patterns[leaving] = entering
    out, left = [], demand.astype(np.int64).copy()
    for counts, times in zip(patterns, np.floor(amounts + 1e-6).astype(int).tolist(), strict=True):
        full = np.zeros(len(demand), int)
        full[sizes - 1] = counts
        if times:
            out.append((full, times))
            left -= full * times
    return out + greedy_patterns(np.maximum(left, 0), capacity)


def tokenised_pieces(docs: DataFrame, path: str, sequence: int, width: int) -> DataFrame:
    """Pieces of every document: full sequences (class 0) and the remainder with its class, numbered by task and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, memo, seen = TaskContext.get().partitionId(), library_memo(path), np.zeros(sequence // width + 2, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column(0)
            for chunk in chunks(batch.column(1)):
                at, raw = chunk.gather(memo.values(chunk.words))
                doc_ids = ids_of.slice(chunk.rows.start, len(chunk.rows)).to_pylist()
                rows: list[tuple] = []
                for k, doc_id in enumerate(doc_ids):
                    data, total = raw[at[k] : at[k + 1]], int(at[k + 1] - at[k]) // 4 + 1
                    for start in range(0, total, sequence):
                        length = min(sequence, total - start)
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        if start + length == total:
                            crc = zlib.crc32(end, crc)
                        kind = 0 if length == sequence else -(-length // width)
                        rows.append((doc_id, start, length, crc, total, task, int(seen[kind]), kind))
                        seen[kind] += 1
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", "class"]
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_arrow(unique_docs(docs, "doc_id", "text"), run, PIECES)


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE, width: int = WIDTH) -> DataFrame:
    """Pack the token ids of all documents into sequences.

    docs needs ``doc_id`` and ``text``; other columns are ignored.  A null or empty text is the end id alone.  Repeated
    rows are packed once each.  Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    (distinct, not gapless), offset.  No rows give no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenised_pieces(docs, path, sequence, width), "pieces")
    # One row per class and task: the histogram, and how many of the class the tasks before hold.
    by_task = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_task.select("class", "task", before.alias("before"))
    histogram = {r["class"]: r["n"] for r in by_task.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most sequence / width + 1 rows
    demand = np.array([histogram.get(c, 0) for c in range(1, -(-sequence // width) + 1)])
    plan = solve_cutting_stock(demand, sequence // width)
    # Places of a class, in runs: each pattern with the class offers counts * times places one after the other.
    first, runs, given = histogram.get(0, 0), [], np.zeros(len(demand), np.int64)
    for counts, times in plan:
        for c in np.flatnonzero(counts).tolist():
            runs.append((c + 1, int(given[c]), int(given[c] + counts[c] * times), int(counts[c]), int(first)))
            given[c] += counts[c] * times
        first += times
    runs.append((0, 0, int(histogram.get(0, 0)), 1, 0))
    places = spark.createDataFrame(runs, "class int, low long, high long, per long, first long")
    # A row for each class and task: no broadcast by hint, as tasks grow with the corpus.
    ranked = pieces.join(offsets, ["class", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(places), ["class"]).where("rank >= low and rank < high")
    placed = placed.withColumn("sequence_id", F.expr("first + (rank - low) div per"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "task", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
