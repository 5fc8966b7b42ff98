import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, embedding_dedup, knn_join, preference_format, queries


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def planted(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[:40] + rng.normal(size=(40, dim)).astype(np.float32) * 0.05
    x[n // 2 + 40 : n // 2 + 60] = x[5]
    x[-30:] = x[7] + rng.normal(size=(30, dim)).astype(np.float32) * 0.15
    return x


ODD = [(9001, None, 1), (9002, [float("nan")] + [0.1] * 15, 1), (9003, [0.0] * 16, 1), (9004, [None] + [0.1] * 15, 1), (9005, [float("inf")] * 16, 1), (9006, [], 1), (None, [0.5] * 16, 1)]


def test_cosine_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 50)
    x = planted(0, 600)
    df = vectors(spark, [(3 * i + 1, v.tolist(), 0) for i, v in enumerate(x)] + ODD).withColumn("node", F.lit(1))
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    y = x.astype(float)
    norm = np.sqrt((y * y).sum(1))
    near = (y @ y.T) / (norm[:, None] * norm[None, :]) >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        r = got[3 * i + 1]
        assert (r["n_links"], r["component_id"], r["kept"]) == (near[i].sum(), 3 * label[i] + 1, label[i] == i)
    assert near.sum() > 500
    for i in (9001, 9002, 9003, 9004, 9005, 9006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and not embedding_dedup.near_vectors(vectors(spark, [])).collect()
    twice = embedding_dedup.near_vectors(vectors(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [-1.0, 5.0], 0), (3, None, 0)]))
    assert sorted(tuple(r) for r in twice.collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_clustered_vectors_meet_few_groups():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    group = embedding_dedup.neighbours(centres)
    assert np.bincount(group).max() <= embedding_dedup.GROUP and len(set(group)) == 10


def test_cover_tree_levels_cover_and_nest():
    x = planted(1, 200).astype(float)
    units = x / np.sqrt((x * x).sum(1, keepdims=True))
    tree = embedding_dedup.CoverTree(units)
    place = tree.owner
    for nodes, parents, radius in reversed(tree.levels):
        gaps = np.linalg.norm(units - units[nodes[place]], axis=1)
        assert (gaps <= radius[place] + 1e-6).all()
        place = parents[place]
    for (upper, _, _), (lower, _, _) in zip(tree.levels, tree.levels[1:]):
        assert set(upper) <= set(lower)


def test_knn_equals_brute_force_with_ties_and_own_exclusion(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "PER_CELL", 60)
    monkeypatch.setattr(knn_join, "BLOCK", 50)
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", 4)
    x = planted(2, 400)
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD).withColumn("rank", F.lit(1))
    ints = np.floor(64 * x.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 400, 20):
        scores = ints @ ints[q]
        order = [j for j in np.lexsort((np.arange(400), -scores)) if j != q][:20]
        want += [(q, k + 1, int(j), int(scores[j])) for k, j in enumerate(order)]
    got = knn_join.top_k(df).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == want
    few = knn_join.top_k(vectors(spark, [(0, [1.0] * 4, 0), (1, [0.5] * 4, 0)]))
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 64 * 32 * 4)] and knn_join.top_k(vectors(spark, [])).count() == 0


def test_bounds_skip_cells_that_cannot_matter():
    pivots, radius = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]]), np.array([5.0, 5.0, 5.0])
    assert knn_join.reachable(np.array([[100.0, 5.0]]), np.array([9000.0]), pivots, radius).tolist() == [0]
    assert knn_join.reachable(np.array([[100.0, 5.0]]), np.array([900.0]), pivots, radius).tolist() == [0, 1]
    assert knn_join.reachable(np.array([[100.0, 5.0]]), np.array([-np.inf]), pivots, radius).tolist() == [0, 1, 2]


def test_knn_of_clustered_repeated_and_huge_vectors(spark, monkeypatch):
    for name, value in (("PER_CELL", 40), ("BLOCK", 20), ("QUERY_BLOCK", 3), ("CHUNK", 2)):
        monkeypatch.setattr(knn_join, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8, 6))[rng.integers(0, 8, 300)] * 3 + rng.normal(size=(300, 6)) * 0.1
    x[40:60], x[100] = x[40], [1e9, 0, 0, -1e9, 0, 0]
    x[120] = [3e38, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())], "vec_id long, embedding array<double>")
    ints = [[int(np.floor(64 * v)) for v in row] for row in x]
    most = 2**63 - 1
    want = []
    for q in range(0, 300, 20):
        scores = [max(-most, min(most, sum(a * b for a, b in zip(ints[q], r, strict=True)))) for r in ints]
        want += [(q, k + 1, j, scores[j]) for k, j in enumerate(sorted((j for j in range(300) if j != q), key=lambda j: (-scores[j], j))[:20])]
    assert sorted(tuple(r) for r in knn_join.top_k(df).collect()) == want


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(70, 71), (71, 72), (72, 70)] + [(80, 80)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 60)} == {1} and {got[i] for i in (70, 71, 72)} == {70}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


CHATS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (0, 3, "user", "bye"), (1, 1, "user", "hi"), (1, 0, "system", "be kind"), (1, 2, "assistant", "go <|away|>"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"), (4, 0, "user", None), (6, None, None, "late"), (6, 0, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "x"), (None, 0, "user", "lost"),
]


def test_preferences_render_the_common_prefix_once(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("x"))
    got = {r["pair_id"]: r for r in preference_format.format_preferences(preference_format.by_neighbours(df)).collect()}
    first = got[0]
    assert first["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n" and first["prompt_turns"] == 2
    assert first["chosen"] == "<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n"
    a, b = map(int, first["chosen_mask"].split(":"))
    assert first["chosen"][a:b] == "hello<|end|>" and first["rejected"] == "<|assistant|>\ngo <\\|away|><|end|>\n"
    assert (got[1]["chosen"], got[1]["rejected"], got[1]["prompt_turns"]) == ("", "", 2) and got[2]["complete"] is False
    assert (got[3]["prompt_turns"], got[3]["chosen_turns"], got[3]["rejected_turns"]) == (1, 1, 1) and got[3]["chosen"].endswith("late<|end|>\n") and set(got) == {0, 1, 2, 3}
    pairs = spark.createDataFrame([("p", 0, 1), ("q", 0, 2)], "pair_id string, chosen_id long, rejected_id long")
    again = {r["pair_id"]: r for r in preference_format.format_preferences(preference_format.by_pairs(df, pairs)).collect()}
    assert again["p"]["prompt"] == first["prompt"] and again["q"]["prompt"] == ""
    assert preference_format.format_preferences(preference_format.by_neighbours(df.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_pipeline_keeps_one_clean_document_of_each_group(spark, tmp_path):
    import random

    rng = random.Random(1)
    base = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120))
    copy = base()
    texts = [(0, copy), (1, copy), (2, copy + " more"), (3, base() + ' password = "hunter22hunter"'), (4, base()), (5, "12345"), (6, None), (7, "")]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
    assert seen == [[0, 1, 2, 3, 4], [0, 3, 4], [0, 3, 4]]
    assert docs.where("text like '%[SECRET]%'").count() == 1 and docs.where("text like '%hunter22%'").count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {0, 3, 4}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
