"""Sharding, vectors and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from onefold.llm import embeddings, sharding
from onefold.llm.hnsw import Graph
from onefold.llm.sharding import Shard, ShardStore


@pytest.fixture
def store(spark, tmp_path):
    return ShardStore(spark, f"file://{tmp_path}/store", target_bytes=60_000, shard_rows=50)


def batch(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.when(F.col("id") % 7 == 0, None).otherwise("x").alias("file")).repartition(2)


def test_tiers():
    shards = [Shard(f"s{i}", size, 1) for i, size in enumerate([10, 11, 12, 13, 100, 110, 120, 1000])]
    assert [[s.bytes for s in tier] for tier in sharding.tiers(shards, 1000)] == [[10, 11, 12, 13]]
    assert sharding.tiers([], 10) == []


def test_arrivals_are_merged_and_versions_stay_whole(spark, store):
    for k in range(4):
        store.append(batch(spark, k * 200, k * 200 + 200))
    before, (_, small) = store.version(), store.manifest()
    assert before == 4 and len(small) >= 16 and max(s.rows for s in small) <= 50
    after = store.compact()
    _, merged = store.manifest()
    assert after > before and len(merged) < len(small) and sum(s.rows for s in merged) == 800
    assert store.read(before).count() == 800  # an old version reads its own files
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(800))
    assert store.read().where("file is null").count() == len(range(0, 800, 7))
    assert store.vacuum() > 0 and store.read().count() == 800
    assert store.compact() == after  # nothing is left to merge


def test_a_lost_race_is_tried_again(spark, store):
    store.append(batch(spark, 0, 10))
    schema, shards = store.manifest()
    assert not store._commit(0, schema, shards)  # version 1 is taken
    assert store._commit(1, schema, shards) and store.version() == 2


def test_other_columns_and_no_rows(spark, store):
    store.append(batch(spark, 0, 10))
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    store.append(batch(spark, 0, 10).limit(0))
    assert store.read().count() == 10


def test_resharded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 5, "f"), (1, "a", 5, "f"), (2, None, 6, None), (None, "", 7, "g")], "doc_id long, text string, rows int, file string")
    found = sharding.resharded(docs, f"file://{tmp_path}/a").collect()
    assert sorted((r.doc_id or 0, r.n_chars is None, r.shard_rows > 0) for r in found) == [(0, False, True), (1, False, True), (1, False, True), (2, True, True)]
    assert sharding.resharded(docs.limit(0), f"file://{tmp_path}/b").count() == 0


def planted(n: int, dim: int = 24) -> np.ndarray:
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(n // 10, dim))
    out = rng.normal(size=(n, dim))
    some = rng.integers(0, len(centres), n // 2)
    out[: n // 2] = centres[some] + rng.normal(size=(n // 2, dim)) * rng.choice([0.05, 0.3, 0.45], (n // 2, 1))
    return out.astype(np.float32)


def test_graph_recall():
    x = planted(1500)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(unit)
    _, found = graph.search(unit, 64)
    near = np.argsort(-(unit @ unit.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(near, found, strict=True)]) > 0.9


def test_near_vectors(spark):
    x = planted(600)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(600, rows[3][1]), (601, rows[3][1]), (602, [2 * v for v in rows[4][1]]), (603, None), (604, [0.0] * 24), (605, [1.0] * 23 + [math.nan]), (606, [math.inf] + [1.0] * 23), (607, [1.0] * 23 + [None]), (608, []), (609, [1.0, 0.0]), (None, rows[3][1]), (600, rows[3][1]), (610, [v * 1e200 for v in rows[5][1]])]
    random.seed(4)
    random.shuffle(rows)
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and all(a is not None and math.isfinite(a) for a in v) and any(v)}
    ids = sorted(fine)
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in fine.items()}
    links = {i: {j for j in ids if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in ids}
    label = {i: i for i, _ in rows if i is not None}
    while True:
        new = {i: min([label[i], *(label[j] for j in links.get(i, ()))]) for i in label}
        if new == label:
            break
        label = new
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, shard string, u int").repartition(3)
    found = embeddings.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), label[r.vec_id], label[r.vec_id] == r.vec_id)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def counted(spark, x: np.ndarray, unit: np.ndarray) -> tuple[list, np.ndarray]:
    frame = spark.createDataFrame(((i, [float(v) for v in row]) for i, row in enumerate(x)), "vec_id long, embedding array<float>")
    found = sorted(embeddings.near_duplicates(frame).select("vec_id", "n_links", "component_id").collect())
    links = np.concatenate([(unit[lo : lo + 1000] @ unit.T >= 0.9).sum(1) - 1 for lo in range(0, len(x), 1000)])
    return found, links


def test_recall_of_links_of_many_vectors(spark):
    x = planted(20_000)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found, links = counted(spark, x, unit)
    got = np.array([r.n_links for r in found])
    assert (got <= links).all() and got.sum() > 0.999 * links.sum() > 0


def test_one_large_group_of_near_vectors(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=24) + rng.normal(size=(4000, 24)) * 0.05).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found, links = counted(spark, x, unit)
    assert [r.n_links for r in found] == links.tolist() and {r.component_id for r in found} == {0}


def test_pipeline_stages(spark, small):
    import corpus_pipeline
    from onefold.llm import minhash, quality, secrets, substrings
    from onefold.llm.common import table

    docs = table(spark, small, "documents")
    kept = {r.doc_id for r in quality.judge(docs, table(spark, small, "labels")).where("kept").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "minhash near-dedup", "substring dedup", "secret scan", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).toPandas(), docs.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in seen[name].values())
    assert set(seen["quality rules"]) == kept
    assert set(seen["minhash near-dedup"]) < kept
    assert set(seen["secret scan"]) == set(seen["substring dedup"]) == set(seen["minhash near-dedup"])
    first = spark.createDataFrame([(r.doc_id, r.text) for r in seen["minhash near-dedup"].values()], "doc_id long, text string")
    assert minhash.near_duplicates(first).where("doc_id <> class_id").count() == 0
    removed = {r.doc_id for r in substrings.remove_repeats(first).where("n_removed > 0").collect()}
    assert removed == {i for i, r in seen["substring dedup"].items() if r.text != seen["minhash near-dedup"][i].text}
    assert secrets.digests(spark.createDataFrame([(r.doc_id, r.text) for r in seen["secret scan"].values()], "doc_id long, text string")).where("spans <> ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["secret scan"])
    assert corpus_pipeline.run(spark, small).count() == packed.count()
