"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles over all documents, as shares of the documents, by a count-min sketch of fixed
   size.  A shingle's weight is tf * (1 + ln(1 / share) / ln(1 / RARE)), the share being at least RARE: the weight
   depends on shares only, so a text means the same in a small and in a large corpus.
2. Each text: the weights of its five-word shingles, and from them ``BANDS`` x ``ROWS`` consistent weighted samples.
   Two texts share a sample with the probability of their weighted Jaccard similarity.
3. Equal texts are one class from the start.  The samples are banded; texts that share a band are candidates.
4. Within a bucket, candidates aren't paired with each other but with leaders.  The first leader is the member whose
   bands are the most popular, which in a family of copies is what they have in common; then each bucket has
   ``LEADERS`` - 1 others, with which only members of another first leader are compared.  Pairs whose samples agree too
   rarely to reach the threshold are ruled out; the others are verified by the weighted Jaccard similarity of whole texts.
5. Leaders only save work.  What they leave apart in a bucket is compared too: all pairs of a small bucket, and in larger
   ones those that share a shingle of their prefixes, without which no pair can reach the threshold.
6. Classes are the connected components of verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, map_arrow, materialize, slices_by_bytes
from tessera.llm.components import connected_components
from tessera.llm.pretokens import string_buffers
from tessera.llm.shingles import mix, shingle_counts

THRESHOLD = 0.8
#: With these a pair at the threshold shares a band with probability 0.9996, one at 0.4 with 0.19, one at 0.2 with 0.006.
BANDS, ROWS = 20, 5
SAMPLES = BANDS * ROWS
#: A pair at the threshold agrees in fewer of its samples with probability 1.5e-7 (binomial).
LEAST_AGREEMENT = 58
#: Leaders of a bucket: the most popular member, then this many less one by independent orders.
LEADERS = 5
#: Members that leaders left apart are paired directly in buckets up to this size, and by their prefixes in larger ones.
SMALL_BUCKET = 32
#: For rounding, in bounds.
SLACK = 1e-6
#: Shingles that fewer than this share of the documents have weigh alike.
RARE = 1 / 256
#: The sketch: independent rows of cells, sent about in blocks.
SKETCH_ROWS, CELL_BITS, BLOCKS = 2, 18, 64
CELLS = 1 << CELL_BITS
CHUNK_BYTES = 1 << 20


def _uniforms(bits: np.ndarray, shift: int, width: int) -> np.ndarray:
    """The middles of 2**width steps of (0, 1), by the bits from shift on."""
    out = (bits >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-width)
    return out


def _minus_log(x: np.ndarray) -> np.ndarray:
    np.log(x, out=x)
    return np.negative(x, out=x)


def _draws(hashes: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c (Gamma(2, 1)) and beta (uniform) of improved consistent weighted sampling, for each hash and salt."""
    one = hashes[..., None] ^ salts
    one *= np.uint64(0xBF58476D1CE4E5B9)
    one ^= one >> np.uint64(32)
    one *= np.uint64(0x94D049BB133111EB)
    two = one ^ one >> np.uint64(29)
    two *= np.uint64(0xD6E8FEB86659FD93)
    two ^= two >> np.uint64(32)
    # A sum of two exponentials is Gamma(2, 1); 23 bits keep the middles of steps exact in 32-bit floats.
    c, r = _uniforms(one, 41, 23), _uniforms(two, 44, 20)
    c *= _uniforms(one, 18, 23)
    r *= _uniforms(two, 24, 20)
    c, r = _minus_log(c), _minus_log(r)
    return np.maximum(r, np.float32(1e-3), out=r), np.log(c, out=c), _uniforms(two, 1, 23)


def weighted_samples(owners: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES values of each of n texts: 16 bits of a hash of the pair of shingle and step with the least ln a.

    ln a = ln c - r * (floor(ln w / r + beta) - beta + 1), drawn by the whole hash of the shingle and the sample's number.
    """
    salts = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least, found = np.full((n, SAMPLES), np.inf, np.float32), np.zeros((n, SAMPLES), np.uint64)
    log_w = np.log(weights).astype(np.float32)
    for a in range(0, len(owners), 1 << 10):
        r, log_c, beta = _draws(hashes[a : a + (1 << 10)], salts)
        value = log_w[a : a + (1 << 10), None] / r
        value += beta
        np.floor(value, out=value)
        value -= beta
        value += np.float32(1)
        value *= r
        np.subtract(log_c, value, out=value)
        who = owners[a : a + (1 << 10)]
        at = np.flatnonzero(np.diff(who, prepend=-1))
        lows = np.minimum.reduceat(value, at, axis=0)
        for low, first, last in zip(lows, at.tolist(), [*at[1:].tolist(), len(who)], strict=True):
            k = np.flatnonzero(low < least[who[first]])
            row = first + value[first:last, k].argmin(0)
            least[who[first], k] = low[k]
            step = np.floor(log_w[a + row] / r[row, k] + beta[row, k]).astype(np.int64).view(np.uint64)
            found[who[first], k] = mix(hashes[a + row] ^ mix(step + np.uint64(1)))
    return (found >> np.uint64(48)).astype(np.uint16)


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, list[str], memoryview, np.ndarray]]:
    offsets, data = string_buffers(column)
    view = memoryview(data)
    for first, last in slices_by_bytes(np.diff(offsets), CHUNK_BYTES):
        yield first, last, [str(view[offsets[i] : offsets[i + 1]], "utf-8") for i in range(first, last)], view, offsets


class Weights:
    """Weight of a shingle by the share of documents that have it, from the sketch of document frequencies.

    cells: SKETCH_ROWS x CELLS sums of the document frequencies of the shingles of a cell; n: documents with a word.
    From each sum the mean load of its row is taken, and the least of the rows counts.  With m distinct shingles a
    document at the mean, a share is off by more than m / CELLS only where a shingle meets a frequent one in every row:
    with f shingles of a share above m / CELLS, for (f / CELLS) ** SKETCH_ROWS of all shingles.
    """

    def __init__(self, cells: np.ndarray, n: int):
        share = (cells - cells.sum(1, keepdims=True) / CELLS) / max(n, 1)
        self.table = (1 + np.log(np.clip(share, RARE, 1)) / np.log(RARE)).astype(np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return np.max([row[c] for row, c in zip(self.table, cells_of(hashes), strict=True)], axis=0)


def cells_of(hashes: np.ndarray) -> list[np.ndarray]:
    """A shingle's cell in each row of the sketch: separate bits of its hash."""
    return [(hashes >> np.uint64(64 - (k + 1) * CELL_BITS) & np.uint64(CELLS - 1)).astype(np.int64) for k in range(SKETCH_ROWS)]


def document_frequencies(texts: DataFrame) -> Weights:
    """The sketch over all texts, by two levels of sums; it has SKETCH_ROWS x CELLS numbers, whatever the corpus."""
    width, shape = SKETCH_ROWS * CELLS // BLOCKS, "block int, part int, n long, counts binary"

    def record(sums: dict[tuple[int, int], tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([c.tobytes() for _, c in sums.values()], pa.binary())], ["block", "part", "n", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros((SKETCH_ROWS, CELLS), np.int64), 0
        for batch in batches:
            for _, _, run, _, _ in text_runs(batch.column(0)):
                owners, hashes, _ = shingle_counts(run)
                n += len(np.unique(owners))
                for row, cells in zip(total, cells_of(hashes), strict=True):
                    row += np.bincount(cells, minlength=CELLS)
        if n:
            yield record({(k, TaskContext.get().partitionId() % 32): (n, part) for k, part in enumerate(total.reshape(BLOCKS, width).astype(np.uint32))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        kind = np.uint32
        for batch in batches:
            for block, _, n, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kind = np.uint32 if len(counts) == 4 * width else np.int64
                held = sums.get((block, 0), (0, 0))
                sums[block, 0] = held[0] + n, held[1] + np.frombuffer(counts, kind).astype(np.int64)
        yield record(sums)

    halfway = map_arrow(map_arrow(texts, count, shape).repartition(BLOCKS // 2, "block", "part"), add, shape)
    rows = map_arrow(halfway.repartition(BLOCKS // 4, "block"), add, shape).collect()  # BLOCKS rows
    cells = np.zeros((BLOCKS, width), np.int64)
    for r in rows:
        cells[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return Weights(cells.reshape(SKETCH_ROWS, CELLS), rows[0]["n"] if rows else 0)


def signatures(rows: DataFrame, weights) -> DataFrame:
    """doc_id, digest and samples (null where the text has no word) of each row (doc_id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts, _, _ in text_runs(batch.column(2)):
                owners, hashes, times = shingle_counts(texts)
                samples = weighted_samples(owners, hashes, times * weights.value.of(hashes), len(texts))
                has = np.bincount(owners, minlength=len(texts)) > 0
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).slice(first, last - first).columns, pa.array([s.tobytes() if ok else None for s, ok in zip(samples, has, strict=True)], pa.binary())], ["doc_id", "digest", "samples"])

    return map_arrow(rows.select("doc_id", "digest", "text"), run, "doc_id long, digest binary, samples binary")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of largest weights of two sorted sparse vectors."""
    (keys_a, w_a), (keys_b, w_b) = a, b
    at = np.minimum(np.searchsorted(keys_a, keys_b), max(0, len(keys_a) - 1))
    both = keys_a[at] == keys_b if len(keys_a) else np.zeros(len(keys_b), bool)
    shared = float(np.minimum(w_a[at[both]], w_b[both]).sum()) if both.any() else 0.0
    whole = float(w_a.sum() + w_b.sum()) - shared
    return shared / whole if whole else 0.0


def _agreeing(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose samples agree often enough for the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SAMPLES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((left == right).sum(1) >= LEAST_AGREEMENT, pa.bool_()))

    sides = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = sides.join(samples.toDF("a", "samples_a"), "a").join(samples.toDF("b", "samples_b"), "b")
    return map_arrow(sides.select("a", "b", "samples_a", "samples_b"), run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Pairs (a, b) whose whole texts reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def vector(doc: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if doc not in known:
                if len(known) >= 256:
                    known.clear()
                _, hashes, times = shingle_counts([text])
                known[doc] = hashes, times * weights.value.of(hashes).astype(np.float64)
            return known[doc]

        for batch in batches:
            rows = [(a, b) for a, b, s, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) if weighted_jaccard(vector(a, s), vector(b, t)) >= THRESHOLD]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    sides = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return map_arrow(sides.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def bucket_members(reps: DataFrame) -> DataFrame:
    """Representatives that share a bucket: rep, their shared buckets, and how popular those are in all."""
    bucket = lambda k: F.xxhash64(F.substring("samples", k * ROWS * 2 + 1, ROWS * 2), F.lit(k))
    exploded = reps.select("rep", F.explode(F.array(*[bucket(k) for k in range(BANDS)])).alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return exploded.join(shared, "bucket").groupBy("rep").agg(F.sum("n").alias("popular"), F.collect_list("bucket").alias("buckets"))  # at most BANDS buckets


def candidates(members: DataFrame, orders: list) -> DataFrame:
    """Pairs (a, b) of a member and its bucket's leaders, one leader for each order; only of different labels."""
    rows = members.select(F.explode("buckets").alias("bucket"), "rep", "label", "popular")
    rows = rows.select("bucket", "rep", "label", *[o.alias(f"o{k}") for k, o in enumerate(orders)])
    leaders = rows.groupBy("bucket").agg(*[F.min(F.struct(f"o{k}", "rep", "label")).alias(f"l{k}") for k in range(len(orders))])
    leaders = leaders.select("bucket", F.explode(F.array_distinct(F.array(*[F.struct(f"l{k}.rep", f"l{k}.label") for k in range(len(orders))]))).alias("leader"))
    met = rows.select("bucket", "rep", "label").join(leaders, "bucket").where("rep <> leader.rep and label <> leader.label")
    return met.select(F.col("rep").alias("a"), F.col("leader.rep").alias("b"))


def _prefixes(texts: DataFrame, weights, rarity) -> DataFrame:
    """The prefix of each text (rep, label, text): its rarest shingles, up to where less than the threshold's share is left.

    rest is the weight from that shingle on, total that of the text.  The first shingle two texts share, in this order,
    is in both prefixes if they reach the threshold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, _, run, _, _ in text_runs(batch.column(2)):
                owners, hashes, times = shingle_counts(run)
                order = np.lexsort((hashes, -rarity.value.of(hashes), owners))
                owners, hashes = owners[order], hashes[order]
                weighed = times[order] * weights.value.of(hashes).astype(np.float64)
                total = np.bincount(owners, weighed, minlength=len(run))
                before = np.cumsum(weighed) - weighed
                begins = np.flatnonzero(np.diff(owners, prepend=-1))
                rest = total[owners] - (before - np.repeat(before[begins], np.diff(begins, append=len(owners))))
                at = np.flatnonzero(rest >= (THRESHOLD - SLACK) * total[owners])
                who = owners[at] + first
                yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(reps[who]), pa.array(labels[who]), pa.array(rest[at].astype(np.float32)), pa.array(total[owners[at]].astype(np.float32))], ["hash", "rep", "label", "rest", "total"])

    return map_arrow(texts.select("rep", "label", "text"), run, "hash long, rep long, label long, rest float, total float")


def left_apart(members: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Distinct pairs (a, b) of different labels that share a bucket and can reach the threshold; none is left out.

    A pair's overlap is at most what either has from their first common shingle on, which rules out those that mostly
    share a passage of a crowd.
    """
    rows = members.select(F.explode("buckets").alias("bucket"), "rep", "label")
    mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low < high").select("bucket", "n")
    rows = materialize(rows.join(mixed, "bucket"), "apart")
    small = rows.where(F.col("n") <= SMALL_BUCKET)
    pairs = small.alias("l").join(small.alias("r"), F.expr("l.bucket = r.bucket and l.rep < r.rep and l.label <> r.label")).selectExpr("l.rep as a", "r.rep as b")
    crowd = materialize(rows.where(F.col("n") > SMALL_BUCKET).select("rep", "label").distinct().join(texts.toDF("rep", "text"), "rep"), "crowd")
    rarity = members.sparkSession.sparkContext.broadcast(document_frequencies(crowd.select("text")))
    prefixes = materialize(_prefixes(crowd, weights, rarity), "prefixes")
    reach = f"least(l.rest, r.rest) * {1 + THRESHOLD} >= {THRESHOLD - 2 * SLACK} * (l.total + r.total)"
    met = prefixes.alias("l").join(prefixes.alias("r"), F.expr(f"l.hash = r.hash and l.rep < r.rep and l.label <> r.label and {reach}")).selectExpr("l.rep as a", "r.rep as b")
    out = materialize(pairs.union(met).distinct(), "left")
    discard(rows, crowd, prefixes)
    return out


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, and the class_id of the digests of texts that have a doc_id."""
    spark = docs.sparkSession
    given = docs.select("doc_id", F.when(F.length("text") > 0, F.unhex(F.md5("text"))).alias("digest"), "text")
    weights = spark.sparkContext.broadcast(document_frequencies(given.select("text")))
    rows = materialize(signatures(given, weights), "signatures")
    first = rows.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("samples").alias("samples"))
    first = materialize(first, "representatives")
    samples = first.where("samples is not null").groupBy("rep").agg(F.max_by("samples", "digest").alias("samples"))
    members = materialize(bucket_members(samples), "members")
    samples = materialize(samples.join(members.select("rep"), "rep", "left_semi"), "samples")
    # The same join at every size, so that figures of a small corpus tell those of a large one.
    texts = materialize(given.where("doc_id is not null").join(members.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", "digest").alias("text")), "texts")

    def links(pairs: DataFrame) -> DataFrame:
        close = materialize(_agreeing(pairs, samples), "pairs")
        found = materialize(_verified(close, texts, weights), "links")
        discard(close)
        return found

    # First the leader that the others have most in common with, then several others for what it didn't take in, then
    # all that both left apart.
    found = links(candidates(members.withColumn("label", F.col("rep")), [-F.col("popular")]))
    for orders in ([F.xxhash64("bucket", "rep", F.lit(k)) for k in range(1, LEADERS)], None):
        grouped = materialize(connected_components(found).toDF("rep", "label"), "found")
        labelled = members.join(grouped, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        pairs = candidates(labelled, orders) if orders else left_apart(labelled, texts, weights)
        more = links(pairs)
        if not orders:
            discard(pairs)
        discard(grouped)
        both = materialize(found.union(more), "links")
        discard(found, more)
        found = both
    classes = connected_components(found).toDF("rep", "component")
    owned = materialize(first.select("digest", "rep").join(classes, "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_id")), "classes")
    discard(first, members, samples, texts, found)
    return rows.select("doc_id", "digest"), owned


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """Class of every document.

    docs needs ``doc_id`` and ``text``; other columns are ignored.  Returns one row per input row: doc_id, class_id (the
    smallest doc_id of its class) and kept (whether it is that document; of repeated rows of it, all are).  Equal texts
    are one class.  Null and empty texts stand alone (class_id = doc_id).  A row without a doc_id has the class of its
    text where a row with a doc_id has that text, and else a null class_id; it is kept in the latter case only.  A text
    without any word is only like equal texts; one of fewer than five words is one shingle.  Rows that share a doc_id
    have the class of their own text; where several such texts are the first of their class, they are compared by the
    one with the greatest digest.  No rows give no rows.
    """
    rows, owned = _classes(docs)
    out = rows.join(owned, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of near duplicates, that with the smallest doc_id; all columns stay, whatever their names.

    Of the rows of a class that share this doc_id, one of those with the greatest digest of the text stays.  Rows
    without a doc_id go if a row with one has their text, and else one of each text stays.  Null and empty texts are no
    duplicates of one another and all stay.
    """
    rows, owned = _classes(docs)
    placed = rows.where("digest is not null").join(owned, "digest", "left")
    stay = placed.where("doc_id is null and class_id is null").select("doc_id", "digest")
    firsts = placed.where("doc_id = class_id").groupBy("doc_id", "class_id").agg(F.max("digest").alias("digest")).select("doc_id", "digest")
    stay = materialize(firsts.union(stay).groupBy("doc_id", "digest").agg(F.lit(True).alias("stay")), "kept")
    times = rows.where("digest is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(times.join(stay, [times.doc_id.eqNullSafe(stay.doc_id), times.digest == stay.digest], "left_semi").select("doc_id", "digest"), "repeated")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.when(F.length("text") > 0, F.unhex(F.md5("text"))).alias("key"))
    same = lambda t: keyed.id.eqNullSafe(t.doc_id) & (keyed.key == t.digest)
    kept = keyed.join(stay, same(stay), "left_semi").unionAll(keyed.where("key is null"))
    if not repeated.isEmpty():
        once = kept.join(repeated, kept.id.eqNullSafe(repeated.doc_id) & (kept.key == repeated.digest), "left_semi").groupBy("id", "key").agg(F.any_value("row").alias("row")).select("row", "id", "key")
        kept = kept.join(repeated, kept.id.eqNullSafe(repeated.doc_id) & (kept.key == repeated.digest), "left_anti").unionAll(once)
    return kept.select("row.*")
