"""Exact top-k search as a Voronoi kNN join by integer inner product.

Pivots cut the space into cells.  Data and queries go to the cell of their nearest pivot, and each cell is summed up by
its count and its radius about the pivot.  Queries of a cell form blocks.  A first pass searches each query's own cell,
which gives a score that k vectors surely reach.  For x within R of pivot p, a query's score with x is at most
q.p + |q| R; a second pass sends a cell's data only to the query blocks where this bound reaches the score found.
Blocks of queries and of data are bounded; a block of queries keeps one running list of its best for up to ``CHUNK``
blocks of data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, map_arrow, materialize
from tessera.llm.vectors import binary_rows, finite_rows, matrix_of

SCALE, TOP, EVERY = 64.0, 20, 20
#: Vectors a cell, at the mean; at most so many pivots.  Vectors and queries a block.
PER_CELL, MOST_PIVOTS = 4096, 4096
BLOCK, QUERY_BLOCK = 2048, 1024
#: Blocks of data that one running list of a block of queries takes in, at the mean.
CHUNK = 64
LONGEST = 2**63 - 1


def extent(vectors: DataFrame) -> tuple[int, int, str]:
    """The longest vector's length, the number of rows, and the smallest type that holds every floor(SCALE * component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).cast(pa.large_list(pa.float64()))
            dim = int(np.diff(np.asarray(column.offsets)).max(initial=0)) if len(column) else 0
            _, x = finite_rows(column, dim)
            yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([len(batch)]), pa.array([float(np.abs(np.floor(SCALE * x)).max(initial=0))])], ["dim", "n", "top"])

    row = map_arrow(vectors.select("embedding"), run, "dim long, n long, top double").agg(F.max("dim").alias("dim"), F.sum("n").alias("n"), F.max("top").alias("top")).head()
    top = row["top"] or 0.0
    # Beyond 32 bits, doubles hold these whole numbers exactly, however large.
    return max(1, row["dim"] or 1), row["n"] or 0, next((kind for kind, most in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if top < most), "<f8")


def quantised(vectors: DataFrame, dim: int, kind: str) -> DataFrame:
    """vec_id and floor(SCALE * component) (packed), for vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = finite_rows(batch.column(1), dim)
            good_ids = batch.column(0).take(pa.array(good))
            yield pa.RecordBatch.from_arrays([good_ids, binary_rows(np.floor(SCALE * x).astype(kind)) if len(good) else pa.array([], pa.binary())], ["vec_id", "ints"])

    return map_arrow(vectors.where("vec_id is not null").select("vec_id", "embedding"), run, "vec_id long, ints binary")


def to_cells(points: DataFrame, pivots: np.ndarray, kind: str) -> DataFrame:
    """Nearest pivot (ties to the first) and distance to it of each vector."""
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots**2).sum(1)
        for batch in batches:
            x = matrix_of(batch.column(1), kind, dim).astype(float)
            gaps = square[None, :] - 2 * x @ pivots.T
            cell = gaps.argmin(1) if len(x) else np.zeros(0, int)
            gap = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(gap)], ["vec_id", "ints", "cell", "gap"])

    return map_arrow(points, run, "vec_id long, ints binary, cell int, gap double")


def reachable(queries: np.ndarray, floors: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Cells in which any of the queries can have a score of at least its floor, by the cells' summaries only."""
    longest = np.sqrt((queries**2).sum(1))[:, None]
    middle = queries @ pivots.T
    slack = longest * radius[None, :]
    rounding = 1e-9 * (longest * np.sqrt((pivots**2).sum(1))[None, :] + slack) + 1e-6
    return np.flatnonzero((middle + slack + rounding >= floors[:, None]).any(0))


def packed(rows: DataFrame, name: str, dim: int, kind: str) -> DataFrame:
    """One row for each (cell, block): its vec_ids, vectors and floors, packed.  Blocks are bounded, whatever the cell's size."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        ids, floors = (np.concatenate([np.asarray(b.column(c)) for b in found]) for c in ("vec_id", "floor"))
        x = np.concatenate([matrix_of(b.column("ints"), kind, dim) for b in found])
        order = np.argsort(ids, kind="stable")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([np.ascontiguousarray(v[order]).tobytes()]) for v in (ids.astype("<i8"), x, floors.astype("<f8"))]], ["cell", "block", f"{name}_ids", f"{name}_ints", f"{name}_floors"])

    return rows.select("cell", "block", "vec_id", "ints", "floor").groupBy("cell", "block").applyInArrow(run, f"cell int, block int, {name}_ids binary, {name}_ints binary, {name}_floors binary")


def in_blocks(rows: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """Deals each cell's rows by a hash of vec_id into blocks of about ``size`` rows."""
    sizes = rows.sparkSession.createDataFrame([(c, max(1, -(-n // size))) for c, n in counts.items()], "cell int, blocks int")  # a row for each pivot
    return rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))


def inner_products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; one beyond a 64-bit integer counts as the nearest of those."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(data.astype(float)).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(float) @ data.astype(float).T).astype(np.int64)
    if most < 2**62 and queries.dtype.kind == data.dtype.kind == "i":
        return queries.astype(np.int64) @ data.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(queries) @ whole(data).T, -LONGEST, LONGEST).astype(np.int64)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best ids (ascending order within equal scores) and scores, not below its floor, among a block sorted by id."""
    scores = inner_products(queries, data)
    for q, own in enumerate(query_ids.tolist()):
        row, keep = scores[q], min(len(ids), k + 1)  # one more: the query itself may be among them
        floor = max(np.partition(row, len(ids) - keep)[len(ids) - keep], floors[q])
        at = np.flatnonzero(row >= floor)
        at = at[ids[at] != own]
        at = at[np.argsort(-row[at], kind="stable")][:k]
        yield own, ids[at], row[at]


def searched(met: DataFrame, dim: int, kind: str, k: int) -> DataFrame:
    """The best (query_id, vec_id, score) of each (grp, block, chunk) of met, whose rows pair a query block with a data block."""
    parts = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), 24)
    met = met.withColumn("chunk", F.pmod(F.xxhash64("cell", "data_block"), F.greatest(F.lit(1), F.ceil(F.col("met_blocks") / CHUNK))))
    met = met.repartition(parts, "grp", "block", "chunk").sortWithinPartitions("grp", "block", "chunk")
    shape = "query_id long, ids array<long>, scores array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([b[0] for b in best.values()], pa.list_(pa.int64())), pa.array([b[1] for b in best.values()], pa.list_(pa.int64()))], ["query_id", "ids", "scores"])

        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                if key != (key := (row["grp"], row["block"], row["chunk"])) and best:
                    yield given()
                    best = {}
                mine, theirs, floors = (np.frombuffer(row[c], t) for c, t in (("query_ids", "<i8"), ("data_ids", "<i8"), ("query_floors", "<f8")))
                held = np.array([best[q][1][-1] if len(best.get(q, ((), ()))[1]) == k else -np.inf for q in mine.tolist()])
                x, y = (np.frombuffer(row[c], kind).reshape(-1, dim) for c in ("query_ints", "data_ints"))
                for q, ids, scores in best_of_block(x, mine, y, theirs, k, np.maximum(floors, held)):
                    if q in best:
                        ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                        order = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[order], scores[order]
                    best[q] = ids, scores
        if best:
            yield given()

    found = map_arrow(met.select("grp", "block", "chunk", "query_ids", "query_ints", "query_floors", "data_ids", "data_ints"), run, shape)
    return found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """Every query's k best other rows.

    vectors needs ``vec_id`` and ``embedding``; other columns are ignored.  Queries are the rows whose vec_id is a
    multiple of ``every``; candidates all rows but those with the query's own vec_id.  Vectors that are null, empty or
    hold null or non-finite components, and rows without a vec_id, take no part.  Rows that share a vec_id count once
    (the first in the order of their bytes).  Shorter vectors count as filled up with zeros.  Ties go to the smaller
    vec_id; fewer than k candidates give fewer rows.  Components may be of any finite size; a score beyond a 64-bit
    integer counts as the nearest of those.  Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    dim, n, kind = extent(vectors)
    points = materialize(quantised(vectors, dim, kind).groupBy("vec_id").agg(F.min("ints").alias("ints")), "points")
    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(MOST_PIVOTS, round(n / PER_CELL)))).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = np.stack([np.frombuffer(r["ints"], kind) for r in chosen]).astype(float)
    cells = materialize(to_cells(points, pivots, kind), "cells")
    asked = cells.where(F.col("vec_id") % every == 0)
    data = {r["cell"]: (r["n"], r["radius"]) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}  # a row for each pivot
    groups = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    everything = F.lit(float("-inf"))
    blocks = materialize(packed(in_blocks(cells.withColumn("floor", everything), {c: v[0] for c, v in data.items()}, BLOCK), "data", dim, kind).withColumnRenamed("block", "data_block"), "data")
    dealt = in_blocks(asked, groups, QUERY_BLOCK)
    asking = packed(dealt.withColumn("floor", everything), "query", dim, kind).withColumnRenamed("cell", "grp")
    sizes = spark.createDataFrame([(c, max(1, -(-v[0] // BLOCK))) for c, v in data.items()], "cell int, met_blocks int")  # a row for each pivot
    own = materialize(searched(asking.join(blocks.join(F.broadcast(sizes), "cell"), asking.grp == F.col("cell")), dim, kind, k), "own")
    floors = own.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sort_array(F.collect_list("score"), False)[k - 1].cast("double")).alias("reached"))  # k for each chunk of the cell
    asking = packed(dealt.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("reached", everything)), "query", dim, kind).withColumnRenamed("cell", "grp")
    asking = materialize(asking, "asking")
    known = sorted(data)
    centres, radius = pivots[known], np.array([data[c][1] for c in known])

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = reachable(np.frombuffer(row["query_ints"], kind).reshape(-1, dim).astype(float), np.frombuffer(row["query_floors"]), centres, radius)
                found = [known[c] for c in found.tolist() if known[c] != row["grp"]]
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(found), pa.int32()), pa.array([row["block"]] * len(found), pa.int32()), pa.array(found, pa.int32())], ["grp", "block", "cell"])

    needed = map_arrow(asking.select("grp", "block", "query_ints", "query_floors"), needs, "grp int, block int, cell int").join(F.broadcast(sizes), "cell")
    needed = materialize(needed, "needed")
    total = needed.groupBy("grp", "block").agg(F.sum("met_blocks").alias("met_blocks"))
    far = materialize(searched(needed.drop("met_blocks").join(blocks, "cell").join(total, ["grp", "block"]).join(asking, ["grp", "block"]), dim, kind, k), "far")
    discard(points, cells, blocks, asking, needed)
    ranked = own.unionAll(far).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The same rows in DuckDB: every query against every row.
ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s as (
  select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.e, d.e) as bigint) as score
  from v q join v d on q.vec_id % 20 = 0 and d.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
