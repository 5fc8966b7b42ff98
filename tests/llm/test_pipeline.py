"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

import re

import numpy as np
import pytest
import regex
import test_text_operators as plain
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_dedup
from tessera.llm.common import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before the first stage and after each but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + k, t, None, "odd", 0) for k, t in enumerate([None, "", "123 !?", "token = abcdef123456 and words", "token = abcdef123456 and words"])], docs.schema)
    tables = [materialize(docs.unionByName(odd), "input")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(materialize(stage(spark, tables[-1], sf_dir), name))
        assert tables[-1].columns == docs.columns
    return tables


def texts_of(table):
    return {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}


def test_texts_without_a_letter_go(stages):
    before, after = texts_of(stages[0]), texts_of(stages[1])
    assert set(after) == {d for d, t in before.items() if t and regex.search(r"\p{L}", t)} and all(before[d] == t for d, t in after.items())
    assert stages[1].where("lang is null").count() == 0


def test_one_of_each_class_stays(stages):
    given, kept = texts_of(stages[1]), texts_of(stages[2])
    ids = sorted(given)
    sets = {d: plain.brute_shingles(given[d]) for d in ids}
    df = {}
    for s in sets.values():
        for key in s:
            df[key] = df.get(key, 0) + 1
    weigh = lambda key: 1 + np.log(max(df[key] / len(ids), near_dedup.RARE)) / np.log(near_dedup.RARE)
    sums = {d: sum(n * weigh(key) for key, n in s.items()) for d, s in sets.items()}
    above = {d: d for d in ids}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) < 0.5 * min(len(sets[a]), len(sets[b])):
                continue
            both = sum(n * weigh(key) for key, n in (sets[a] & sets[b]).items())
            if given[a] == given[b] or both / (sums[a] + sums[b] - both) >= near_dedup.THRESHOLD:
                p, q = sorted((root(a), root(b)))
                above[q] = p
    want = {d for d in ids if root(d) == d}
    assert len(want) < len(ids) and set(kept) == want and all(given[d] == t for d, t in kept.items())


def test_secrets_are_masked_and_nothing_else(stages):
    given, masked, some = texts_of(stages[2]), texts_of(stages[3]), 0
    assert set(given) == set(masked)
    for d, text in given.items():
        base = plain.base_spans(text)
        covered = np.zeros(len(text), bool)
        for a, _, b in base + plain.entropy_spans(text, base):
            covered[a:b] = True
        some += covered.any()
        assert masked[d] == re.sub("\0+", "[SECRET]", "".join("\0" if c else t for t, c in zip(text, covered, strict=True)))
    assert some and stages[3].where(F.col("n_chars") != F.length("text")).join(stages[2].where(F.col("n_chars") == F.length("text")), "doc_id", "left_semi").count() == 0


def test_every_id_is_packed_once(stages, spark, sf_dir):
    rows, by_doc, by_sequence = corpus_pipeline.STAGES[-1][1](spark, stages[3], sf_dir).collect(), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    texts = texts_of(stages[3])
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids, at = plain.reference_ids(text), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == plain.crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_columns_with_clashing_names_pass_through(spark, sf_dir):
    docs = spark.createDataFrame([(1, "the cat and the dog sat here", "en"), (1, "the cat and the dog sat here", "en"), (2, "The cat, and the dog sat here!", None), (3, "token=abcdef123456 and other words", "en"), (None, "no id at all here", "en")], "doc_id long, text string, lang string")
    names = ["source", "n_chars", "row", "id", "key", "stay", "digest", "marked", "parts", "s0", "runs", "clean", "some", "class_id", "rep", "a.b"]
    docs = docs.withColumns({n: F.lit(7).cast("long") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "clash")
        assert docs.columns == ["doc_id", "text", "lang", *names]
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"] or 0)
    assert [r["doc_id"] for r in rows] == [None, 1, 3] and rows[2]["text"] == "[SECRET] and other words" and rows[2]["n_chars"] == 24
    assert all(r[n] == 7 for r in rows for n in names if n != "n_chars")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 3
