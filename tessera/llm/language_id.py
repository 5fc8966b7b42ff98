"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of bits; one binary classifier per bit, linear in hashed n-gram frequencies, gives a
margin.  A text's language is the codeword with the least weighted logistic loss against the margins; each bit weighs
as much as its classifier is right on the training rows.  Two codewords nearly as close flag the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import map_arrow, slices_by_bytes, unique_docs
from tessera.llm.pretokens import LETTER, class_table, string_buffers

UNKNOWN = "und"
FEATURES = 1 << 13
#: The classifiers are fitted on so many labelled texts a language at most, and so many in all (one each, where there are
#: more languages): a bounded sample of the distinct rows in the order of a hash of doc_id and text.  Whole texts count, but
#: only their features leave the executors: at most FEATURES values a text.  Everything else covers all rows.
SAMPLE_PER_LANGUAGE, SAMPLE_IN_ALL = 400, 4000
ROUNDS, RATE, SHRINK = 60, 2.0, 1e-4
#: A score below this is flagged as ambiguous.
AMBIGUOUS = 0.02
CHUNK_BYTES = 1 << 20


def codewords(k: int) -> np.ndarray:
    """k rows of +-1.  Up to 6 languages: every way to split them in two.  More: the best of random codes by distance."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        splits = np.arange(1, 1 << (k - 1))
        return np.where(splits[None, :] >> np.maximum(np.arange(k) - 1, 0)[:, None] & (np.arange(k) > 0)[:, None], 1.0, -1.0)
    draw, best, best_distance = np.random.default_rng(k), None, -1.0
    for _ in range(100):
        code = draw.choice([-1.0, 1.0], (k, int(10 * np.ceil(np.log2(k)))))
        distance = (code.shape[1] - (code @ code.T - 2 * code.shape[1] * np.eye(k)).max()) / 2
        if distance > best_distance and (np.abs(code.sum(0)) < k).all():
            best, best_distance = code, distance
    return best


def frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashed n-gram features (square roots of relative frequencies, n = 1, 2, 3), and which texts have a letter.

    Whole texts count, in lower case; anything that is no letter is one kind of gap.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("  ".join(["", *lowered, ""]).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts)) + 2
    owner = np.concatenate([[0, 0], np.repeat(np.arange(len(texts)), sizes)])[: len(points)]
    letter = class_table()[points] == LETTER
    char = np.where(letter, points, np.uint32(32))
    counts = np.bincount(owner[letter], minlength=len(texts))
    out = np.zeros((len(texts), FEATURES), np.float32)
    if not len(points):
        return out, counts > 0
    one = char * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (char[1:] * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
    three = two[:-1] * np.uint32(0x27D4EB2F) ^ (char[2:] * np.uint32(0xC2B2AE3D))
    owner_of_two = np.where(letter[:-1], owner[:-1], owner[1:])
    for keys, use, own in ((one, letter, owner), (two, letter[:-1] | letter[1:], owner_of_two), (three, letter[1:-1], owner[1:-1])):
        mixed = keys[use]
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        cells = own[use] * FEATURES + (mixed >> np.uint32(19)).astype(np.int64)
        hits = np.bincount(cells, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES)
        out += np.sqrt(hits / np.maximum(hits.sum(1, keepdims=True), 1)).astype(np.float32)
    return out, counts > 0


class Model:
    """langs, their codewords, the bits' weights, and the linear classifiers."""

    def __init__(self, langs: list[str], code: np.ndarray, bit_weights: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.code, self.bit_weights, self.weights, self.bias = langs, code, bit_weights, weights, bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1: by how much the best codeword's loss is below the second's) of each text."""
        features, lettered = frequencies(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins = features @ self.weights + self.bias
        losses = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.bit_weights
        best = losses.argmin(1)
        ordered = np.sort(losses, 1)
        second = ordered[:, 1] if len(self.langs) > 1 else ordered[:, 0] + 1
        score = np.where(lettered, (second - ordered[:, 0]) / np.maximum(second, 1e-12), 0.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.clip(score, 0, 1)


def fit(texts: list[str], langs: list[str]) -> Model:
    """The model of labelled texts."""
    return fit_features(np.concatenate([frequencies(texts[i : i + 256])[0] for i in range(0, max(1, len(texts)), 256)]), langs)


def fit_features(x: np.ndarray, langs: list[str]) -> Model:
    """Logistic classifiers for all bits at once, by accelerated gradient descent with the languages weighed alike."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if not names:
        return Model([], code, np.ones(1), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32))
    kind = np.array([names.index(v) for v in langs])
    target = code[kind].astype(np.float32)
    weigh = (1 / np.bincount(kind)[kind] / len(names)).astype(np.float32)[:, None]
    w = look = np.zeros((FEATURES, code.shape[1]), np.float32)
    b = look_b = np.zeros(code.shape[1], np.float32)
    for k in range(ROUNDS):
        margin = np.clip(x @ look + look_b, -30, 30)
        pull = weigh * target / (1 + np.exp(target * margin))
        new, new_b = look + RATE * (x.T @ pull - SHRINK * look), look_b + RATE * pull.sum(0)
        look, look_b = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    right = (weigh * (np.sign(x @ w + b) == target)).sum(0)
    bits = np.maximum(right - 0.5, 1e-3)
    return Model(names, code, bits / bits.sum(), w.astype(np.float32), b.astype(np.float32))


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame) -> DataFrame:
    """The bounded sample of labelled rows that aren't held out: lang, place in the order, text.

    A language's share of the hash range holds about twice the distinct rows wanted; the first of those are taken.  Rows
    alike in doc_id and text are one, so neither null nor repeated doc_ids swell it.
    """
    labelled = unique_docs(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    labelled = labelled.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}  # a row for each language
    most = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_IN_ALL // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, (2 * most + 50) / max(1, n))) for lang, n in counts.items()], "lang string, share double")
    near = labelled.join(F.broadcast(shares), "lang").where(F.col("place") < F.col("share") * (1 << 40))
    near = near.groupBy("lang", "place").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("place")  # about 2 * most rows each
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("lang", "place", "text")


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample of rows with text and language that aren't held out."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = frequencies(batch.column(2).slice(k, 1).to_pylist())[0][0]
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).slice(k, 1).columns, pa.array([at.astype("<u2").tobytes()]), pa.array([row[at].astype("<f4").tobytes()])], ["lang", "place", "cells", "values"])

    rows = sorted(map_arrow(sample(docs), featured, "lang string, place long, cells binary, values binary").collect(), key=lambda r: (r["lang"], r["place"]))
    x = np.zeros((len(rows), FEATURES), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["values"], "<f4")
    return fit_features(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of every whole text.

    docs needs ``doc_id`` and ``text``, and ``lang`` to learn from where no model is given; other columns are ignored.
    A null text, or one without a letter, is ``und`` with score 0, as is every text where nothing could be learned.
    Repeated rows give repeated results.  Returns doc_id, held_out, lang_pred, score, ambiguous.
    """
    model = model or train(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits x features: bounded by the code's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column(1))
            view = memoryview(data)
            for first, last in slices_by_bytes(np.maximum(np.diff(offsets), CHUNK_BYTES // 256), CHUNK_BYTES):
                texts = [str(view[offsets[i] : offsets[i + 1]], "utf-8") for i in range(first, last)]
                langs, scores = shipped.value.predict(texts)
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array((scores < AMBIGUOUS).tolist())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    given = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return map_arrow(given, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified; rejected are those without a letter.

    Ambiguous ones are flagged by ``identify`` but kept, so that no clean document goes.  All columns stay as they are;
    ``lang`` is filled with the prediction where it is null.
    """
    model = train(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots can't pass through a map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = string_buffers(batch.column(text))
            view = memoryview(data)
            for first, last in slices_by_bytes(np.maximum(np.diff(offsets), CHUNK_BYTES // 256), CHUNK_BYTES):
                langs, _ = shipped.value.predict([str(view[offsets[i] : offsets[i + 1]], "utf-8") for i in range(first, last)])
                rows = batch.slice(first, last - first)
                filled = [a if a is not None else p for a, p in zip(rows.column(lang).to_pylist(), langs, strict=True)]
                rows = rows.set_column(lang, f"c{lang}", pa.array(filled, pa.string()))
                yield rows.filter(pa.array([p != UNKNOWN for p in langs], pa.bool_()))

    return map_arrow(plain, run, plain.schema).toDF(*docs.columns)
