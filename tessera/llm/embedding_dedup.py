"""Exact cosine threshold pairs of embeddings by dual traversal of cover trees.

Equal vectors are one node from the start.  The others go to the nearest of a bounded set of centres, and each centre's
vectors to a block, or to several where they are too many.  A block's cover tree has nested levels of centres with
halving radii; every node knows the radius that covers all below it.  Neighbouring centres form groups, and two groups
meet in one task if any two of their centres are near enough for a link, so that a block is sent once for a group and not
once for a block.  Two blocks are compared from the roots down: a pair of nodes is dropped when their centres are farther
apart than both radii and the threshold distance allow, and only what is left at the lowest level is compared by the
exact cosine.  A task gives each vector's number of links and a spanning forest of the links, so its output is bounded by
its vectors, while no link is lost.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_arrow, materialize
from tessera.llm.components import connected_components
from tessera.llm.vectors import binary_rows, finite_rows, matrix_of

THRESHOLD = 0.95
#: Vectors a cell at the mean, centres at most, vectors a block, cells (and blocks of a cell) a group.
PER_CELL, MOST_CENTRES, BLOCK, GROUP = 1024, 4096, 2048, 4
#: The lowest level has about this radius.
FINEST = 0.05
#: A distance sqrt(2 - 2 cosine) of double precision can be off by the root of a rounding error, about 2e-8.
SLACK = 1e-7


class CoverTree:
    """Levels of nested centres.  levels[k]: point of each node, its parent's place in the level above, covering radius.

    owner: place in the lowest level of the node that holds each point.
    """

    def __init__(self, units: np.ndarray):
        far = np.sqrt(np.maximum(2 - 2 * units @ units.T, 0))
        self.levels, nodes, reach = [], np.zeros(1, int), float(far[0].max(initial=0))
        chain = [(nodes, np.zeros(1, int))]
        while reach > FINEST and len(nodes) < len(units):
            reach /= 2
            covered = (far[nodes] <= reach).any(0)
            new = []
            for p in np.flatnonzero(~covered).tolist():
                if not covered[p]:
                    new.append(p)
                    covered |= far[p] <= reach
            parents = np.concatenate([np.arange(len(nodes)), far[new][:, nodes].argmin(1) if new else np.zeros(0, int)])
            nodes = np.concatenate([nodes, np.array(new, int)])
            chain.append((nodes, parents))
        owner = self.owner = far[:, nodes].argmin(1)
        # Covering radii from the lowest level up: the farthest point below each node.
        for nodes, parents in reversed(chain):
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, owner, far[np.arange(len(units)), nodes[owner]])
            self.levels.insert(0, (nodes, parents, radius))
            owner = parents[owner]


def linked_pairs(a: np.ndarray, tree_a: CoverTree, b: np.ndarray, tree_b: CoverTree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) whose cosine reaches the threshold; both traversed level by level at once."""
    reach = np.sqrt(2 - 2 * threshold) + SLACK
    unit_a, unit_b = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (a, b))
    depth = max(len(tree_a.levels), len(tree_b.levels))
    open_pairs, rows, cols = np.ones((1, 1), bool), np.zeros(1, int), np.zeros(1, int)
    for k in range(depth):
        (nodes_a, up_a, r_a), (nodes_b, up_b, r_b) = (t.levels[min(k, len(t.levels) - 1)] for t in (tree_a, tree_b))
        # A tree that has no further level stays where it is.
        at_a = up_a if k < len(tree_a.levels) else np.arange(len(nodes_a))
        at_b = up_b if k < len(tree_b.levels) else np.arange(len(nodes_b))
        spot_a, spot_b = np.full(at_a.max() + 1, -1), np.full(at_b.max() + 1, -1)
        spot_a[rows[rows <= at_a.max()]] = np.flatnonzero(rows <= at_a.max())
        spot_b[cols[cols <= at_b.max()]] = np.flatnonzero(cols <= at_b.max())
        live_a, live_b = np.flatnonzero(spot_a[at_a] >= 0), np.flatnonzero(spot_b[at_b] >= 0)
        gaps = np.sqrt(np.maximum(2 - 2 * unit_a[nodes_a[live_a]] @ unit_b[nodes_b[live_b]].T, 0))
        near = open_pairs[spot_a[at_a[live_a]]][:, spot_b[at_b[live_b]]] & (gaps <= r_a[live_a][:, None] + r_b[live_b][None, :] + reach)
        keep_a, keep_b = near.any(1), near.any(0)
        rows, cols, open_pairs = live_a[keep_a], live_b[keep_b], near[keep_a][:, keep_b]
        if not len(rows):
            return np.zeros(0, int), np.zeros(0, int)
    # Points below the node pairs that are left.
    spot_a, spot_b = np.full(tree_a.owner.max() + 1, -1), np.full(tree_b.owner.max() + 1, -1)
    spot_a[rows], spot_b[cols] = np.arange(len(rows)), np.arange(len(cols))
    points_a, points_b = np.flatnonzero(spot_a[tree_a.owner] >= 0), np.flatnonzero(spot_b[tree_b.owner] >= 0)
    out_i, out_j = [], []
    for s in range(0, len(points_a), 512):
        part = points_a[s : s + 512]
        allowed = open_pairs[spot_a[tree_a.owner[part]]][:, spot_b[tree_b.owner[points_b]]]
        cosine = (a[part] @ b[points_b].T) / (np.sqrt((a[part] ** 2).sum(1))[:, None] * np.sqrt((b[points_b] ** 2).sum(1))[None, :])
        i, j = np.nonzero(allowed & (cosine >= threshold))
        out_i.append(part[i])
        out_j.append(points_b[j])
    return np.concatenate(out_i), np.concatenate(out_j)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i])."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            above[p] = q
            out.append((x, y))
    return out


def neighbours(centres: np.ndarray) -> np.ndarray:
    """A group for each centre: one that is free yet, with the nearest other free ones."""
    group, k = np.full(len(centres), -1), 0
    for c in range(len(centres)):
        if group[c] < 0:
            group[c] = k
            free = np.flatnonzero(group < 0)
            group[free[np.argsort(-(centres[free] @ centres[c]), kind="stable")[: GROUP - 1]]] = k
            k += 1
    return group


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links of every vector with the others by cosine.

    vectors needs ``vec_id`` and ``embedding``; other columns are ignored.  Null, empty and zero vectors, and those with
    null or non-finite components, link with nothing, nor do rows without a vec_id.  Shorter vectors count as filled up
    with zeros.  Rows that share a vec_id are one vector (the first in the order of their bytes) and all have its result.
    Returns one row per row: vec_id, n_links, component_id, kept.
    """
    spark = vectors.sparkSession
    given = vectors.select("vec_id", "embedding")
    dim = max(1, given.agg(F.max(F.size("embedding"))).head()[0] or 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = finite_rows(batch.column(1), dim)
            some = (x * x).sum(1) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good[some])), binary_rows(x[some] + 0.0) if some.any() else pa.array([], pa.binary())], ["vec_id", "x"])

    points = map_arrow(given.where("vec_id is not null"), read, "vec_id long, x binary").groupBy("vec_id").agg(F.min("x").alias("x"))
    points = materialize(points, "points")
    nodes = materialize(points.groupBy("x").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).select("node", "copies", "x"), "nodes")
    n = nodes.count()
    ids = given.select("vec_id")
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    centres = np.stack([np.frombuffer(r["x"]) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(max(1, min(MOST_CENTRES, round(n / PER_CELL)))).collect()])
    centres = centres / np.sqrt((centres**2).sum(1, keepdims=True))
    group = neighbours(centres)

    def to_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(2), float, dim)
            dots = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ centres.T
            cell = dots.argmax(1) if len(x) else np.zeros(0, int)
            gap = np.sqrt(np.maximum(2 - 2 * dots.max(1, initial=-1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(gap)], ["node", "copies", "x", "cell", "gap"])

    celled = materialize(map_arrow(nodes, to_cell, "node long, copies long, x binary, cell int, gap double"), "cells")
    summary = sorted((r["cell"], r["n"], r["radius"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect())  # a row for each centre
    used, radius = np.array([r[0] for r in summary]), np.array([r[2] for r in summary])
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    sizes = spark.createDataFrame([(c, int(group[c]), -(-m // BLOCK)) for c, m, _ in summary], "cell int, grp int, blocks int")

    def near_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                gaps = np.sqrt(np.maximum(2 - 2 * centres[used] @ centres[c], 0))
                others = np.unique(group[used[gaps <= radius + radius[np.searchsorted(used, c)] + reach]])
                others = others[others >= group[c]]
                yield pa.RecordBatch.from_arrays([pa.array([int(group[c])] * len(others), pa.int32()), pa.array(others, pa.int32())], ["grp_a", "grp_b"])

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        own = np.concatenate([np.asarray(b.column("node")) for b in found]).astype("<i8")
        copies = np.concatenate([np.asarray(b.column("copies")) for b in found]).astype("<i8")
        x = np.concatenate([matrix_of(b.column("x"), float, dim) for b in found])
        order = np.argsort(own)
        x = x[order]
        tree = CoverTree(x / np.sqrt((x * x).sum(1, keepdims=True)))
        body = pickle.dumps((own[order], copies[order], x.astype(np.float32) if (x.astype(np.float32) == x).all() else x, tree.levels, tree.owner), protocol=5)
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([body], pa.binary())], ["grp", "cell", "block", "body"])

    dealt = celled.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("grp", "cell", "block", "node", "copies", "x")
    blocks = materialize(dealt.groupBy("grp", "cell", "block").applyInArrow(pack, "grp int, cell int, block int, body binary"), "blocks")
    placed = blocks.select(F.struct("grp", F.floor(F.col("block") / GROUP).alias("part")).alias("at"), F.struct("cell", "block").alias("id"), "body")
    places = placed.select("at").distinct()
    near = map_arrow(sizes.select("cell"), near_groups, "grp_a int, grp_b int").distinct()
    tasks = near.join(places.withColumnRenamed("at", "a"), F.col("a.grp") == F.col("grp_a")).join(places.withColumnRenamed("at", "b"), F.col("b.grp") == F.col("grp_b")).where("a <= b").select("a", "b")
    tasks = materialize(tasks, "tasks")
    sides = tasks.join(placed.withColumnRenamed("at", "a"), "a").select("a", "b", F.lit(0).alias("side"), "id", "body")
    sides = sides.union(tasks.where("a <> b").join(placed.withColumnRenamed("at", "b"), "b").select("a", "b", F.lit(1).alias("side"), "id", "body"))
    sides = sides.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 24), "a", "b")

    def opened(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, CoverTree]:
        own, copies, x, levels, owner = pickle.loads(body)
        tree = CoverTree.__new__(CoverTree)
        tree.levels, tree.owner = levels, owner
        return own, copies, x.astype(float), tree

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most GROUP squared blocks a side."""
        rows = sorted(((r["side"], tuple(r["id"].values()), r["body"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        held = [(side, *opened(body)) for side, _, body in rows]
        alone = not any(side for side, *_ in held)
        counts, links = [np.zeros(len(h[1]), np.int64) for h in held], []
        for p, (side_a, own_a, copies_a, a, tree_a) in enumerate(held):
            for q, (side_b, own_b, copies_b, b, tree_b) in enumerate(held[p:], p):
                if not alone and side_a == side_b:
                    continue
                i, j = linked_pairs(a, tree_a, b, tree_b, threshold)
                if p == q:
                    i, j = i[i != j], j[i != j]
                counts[p] += np.bincount(i, copies_b[j], len(own_a)).astype(np.int64)
                if p != q:
                    counts[q] += np.bincount(j, copies_a[i], len(own_b)).astype(np.int64)
                links += forest(own_a[i], own_b[j])
        for (_, own, *_), count in zip(held, counts, strict=True):
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.nulls(len(at), pa.int64()), pa.array(count[at])], ["a", "b", "n"])
        tree = forest(np.array([t[0] for t in links], np.int64), np.array([t[1] for t in links], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in tree], pa.int64()), pa.array([t[1] for t in tree], pa.int64()), pa.array([0] * len(tree), pa.int64())], ["a", "b", "n"])

    found = materialize(sides.groupBy("a", "b").applyInArrow(compare, "a long, b long, n long"), "links")
    discard(celled, blocks, tasks)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    groups = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    rated = nodes.select("node", "copies", "x").join(counts, "node", "left").join(groups, "node", "left")
    rated = rated.select("x", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = points.join(rated, "x").select("vec_id", "n_links", "component_id")
    out = ids.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same rows in DuckDB: every pair of vectors, and a recursive closure of the links.
ORACLE_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
n as (select vec_id, e, sqrt(list_inner_product(e, e)) as size from v where list_inner_product(e, e) > 0),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach(id, c) as (select vec_id, vec_id from embeddings union select l.a, r.c from reach r join l on l.b = r.id),
counts as (select a, count(*) as n from l group by a)
select r.id as vec_id, coalesce(any_value(counts.n), 0) as n_links, min(r.c) as component_id, r.id = min(r.c) as kept
from reach r left join counts on counts.a = r.id group by r.id
"""
