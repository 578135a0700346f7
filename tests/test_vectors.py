"""Search, reduction and learned vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curlew.operators import encode, models, vectors
from curlew.operators.behavior import filter_seen
from curlew.sources import views


def brute_force(queries, items, k):
    out = {}
    ids, matrix = np.array([i for i, _ in items]), np.array([v for _, v in items], dtype=np.float64)
    for q, v in queries:
        scores = np.round(matrix @ np.asarray(v, dtype=np.float64), 6) + 0.0
        order = np.lexsort((ids, -scores))[:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def as_lists(found):
    lists = {}
    for r in found.orderBy("request_id", "rank").collect():
        lists.setdefault(r.request_id, []).append((r.item_id, r.score))
    return lists


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around a few centres, one of which holds a third of all items; some scores tie."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    owner = np.where(np.arange(900) < 300, 0, rng.integers(1, 8, size=900))
    matrix = (centres[owner] + 0.05 * rng.normal(size=(900, 16))).astype(np.float32)
    matrix[10] = matrix[11]
    items = [(int(i), [float(x) for x in v]) for i, v in enumerate(matrix)]
    queries = [(int(i), [float(x) for x in (centres[i % 8] + 0.05 * rng.normal(size=16)).astype(np.float32)]) for i in range(120)]
    frames = (
        spark.createDataFrame(queries, "request_id bigint, qvec array<float>"),
        spark.createDataFrame(items, "item_id bigint, embedding array<float>"),
    )
    return frames, brute_force(queries, items, 20)


def close(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert [i for i, _ in a[key]] == [i for i, _ in b[key]]
        assert np.allclose([s for _, s in a[key]], [s for _, s in b[key]], atol=1e-9)


def test_broadcast_search_equals_brute_force(clustered):
    (queries, items), truth = clustered
    close(as_lists(vectors.knn(queries, items, 20)), truth)


def test_bounded_search_equals_brute_force_with_small_blocks(clustered, monkeypatch):
    (queries, items), truth = clustered
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 50)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    close(as_lists(vectors.knn(queries, items, 20, float_limit=0)), truth)


def test_blocks_do_not_change_the_broadcast_search(clustered, monkeypatch):
    (queries, items), truth = clustered
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 16)
    close(as_lists(vectors.knn(queries, items, 20)), truth)


def test_probing_all_cells_is_exact_and_recall_grows(clustered):
    (queries, items), truth = clustered
    index = vectors.build_ivf(items, 8)
    close(as_lists(vectors.knn_ivf(queries, index, 20, n_probe=8)), truth)
    recall = []
    for probes in (1, 3, 8):
        found = as_lists(vectors.knn_ivf(queries, index, 10, n_probe=probes))
        recall.append(np.mean([len({i for i, _ in found[q]} & {i for i, _ in truth[q][:10]}) / 10 for q in truth]))
    assert recall[0] <= recall[1] <= recall[2] == 1.0
    assert recall[0] > 0.5


@pytest.mark.parametrize("float_limit", [0, 10**9])
def test_tasks_hold_bounded_parts_and_emit_one_list_per_stripe(clustered, monkeypatch, float_limit):
    """Stripes and chunks smaller than the largest cell, and ties across them; a query's list leaves a stripe once, however many
    blocks and cells lie in it."""
    (queries, items), truth = clustered
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 20)
    monkeypatch.setattr(vectors, "ITEM_FLOATS", 16 * 250)
    monkeypatch.setattr(vectors, "QUERY_FLOATS", 20 * 17)
    close(as_lists(vectors.knn(queries, items, 20, float_limit)), truth)
    index = vectors.build_ivf(items, 8)
    laid = vectors._stripes(index)
    found = vectors._search_cells(vectors._requests(queries), index, 20, vectors._nearest_cells(index, 8))
    assert len(laid.cells) > 1 and sorted({c for cells in laid.cells for c in cells}) == list(range(8))
    assert found.count() <= len(truth) * len(laid.cells) * 20


def test_stripes_hold_empty_large_and_small_cells(monkeypatch):
    monkeypatch.setattr(vectors, "ITEM_FLOATS", 20)
    index = vectors.IvfIndex(np.zeros((6, 2)), np.zeros(6), np.array([0, 4, 25, 0, 7, 4]), None)
    laid = vectors._stripes(index)
    assert laid.cells == [[0, 1], [2], [2], [2, 3], [4], [5]] and laid.parts == [1, 1, 3, 1, 1, 1]
    assert all(laid.cells[s][laid.place[c]] == c for c in range(6) for s in range(laid.first[c], laid.first[c] + laid.parts[c]))


def test_more_results_than_items(clustered):
    (queries, items), _ = clustered
    few = items.where("item_id < 5")
    assert vectors.knn(queries, few, 20).groupBy("request_id").count().where("count != 5").count() == 0
    assert vectors.knn(queries, few, 20, float_limit=0).groupBy("request_id").count().where("count != 5").count() == 0


def test_fewer_distinct_vectors_than_cells(spark):
    items = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(90)], "item_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "request_id bigint, qvec array<float>")
    found = vectors.knn(queries, items, 40, float_limit=0)
    assert [r.item_id for r in found.orderBy("rank").collect()] == [i for i in range(90) if i % 3 == 2] + [i for i in range(90) if i % 3 == 1][:10]


def test_pca_keeps_zero_vectors_and_orders_variance(spark, sf):
    emb = views.emb(spark, sf).select("item_id", "embedding")
    zero = spark.createDataFrame([(-1, [0.0] * 64), (-2, [0.0] * 64)], "item_id bigint, embedding array<float>")
    reduced = vectors.pca(emb.unionByName(zero), 8)
    data = {r.item_id: np.array(r.embedding) for r in reduced.collect()}
    assert not data[-1].any() and not data[-2].any()
    matrix = np.stack([v for k, v in data.items() if k >= 0])
    variance = matrix.var(axis=0)
    assert (np.diff(variance) <= 1e-6).all() and abs(matrix.mean(axis=0)).max() < 1e-4
    alone = {r.item_id: np.array(r.embedding) for r in vectors.pca(emb, 8).collect()}
    assert all(np.allclose(alone[k], data[k], atol=1e-4) for k in alone)


def test_encoder_runs_in_batches_and_skips_absent_values(spark):
    sizes = []

    def encoder(values):
        assert len(values) <= 4
        return np.array([[len(v), 1.0] for v in values])

    rows = spark.createDataFrame([(i, "x" * i if i != 3 else None) for i in range(10)], "item_id bigint, product_description string").coalesce(1)
    out = {r.item_id: r.embedding for r in encode.encode_batches(rows, encoder, batch=4).collect()}
    assert sizes == [] and 3 not in out and out[5] == [5.0, 1.0] and len(out) == 9


def test_batch_encoder_agrees_with_token_buckets(spark, sf):
    texts = views.descriptions(spark, sf).where("item_id < 20")
    sparse = {(r.item_id, r.bucket): r.tf for r in encode.token_buckets(texts).collect()}
    for r in encode.encode_batches(texts).collect():
        counts = np.array([sparse.get((r.item_id, b), 0) for b in range(encode.TEXT_DIM)], dtype=float)
        length = np.linalg.norm(counts)
        assert np.allclose(r.embedding, counts / length if length else counts)


@pytest.fixture(scope="module")
def tastes(spark):
    """Two groups of users that each touch their own half of the catalog."""
    rng = np.random.default_rng(1)
    data = [(u, int(rng.integers(0, 20) + 20 * (u % 2))) for u in range(60) for _ in range(15)]
    return spark.createDataFrame(data, "user_id bigint, item_id bigint")


def test_retrieval_beats_chance(spark, tastes):
    users, items = models.fit_retrieval(tastes, rank=8)
    found = vectors.knn(users.select(F.col("user_id").alias("request_id"), "qvec"), items, 10)
    own_half = found.where((F.col("request_id") % 2) == F.floor(F.col("item_id") / 20)).count()
    assert own_half / found.count() > 0.9


def test_fold_in_equals_direct_solution(spark, tastes, monkeypatch):
    _, items = models.fit_retrieval(tastes, rank=6)
    vectors_of = {r.item_id: np.array(r.embedding, dtype=np.float64) for r in items.collect()}
    gram = sum(np.outer(v, v) for v in vectors_of.values())
    counts = {}
    for r in tastes.collect():
        counts.setdefault(r.user_id, {}).setdefault(r.item_id, 0)
        counts[r.user_id][r.item_id] += 1
    for part in (2048, 3):  # with parts of three items every user is cut
        monkeypatch.setattr(models, "FOLD_ROWS", part)
        for r in models.fold_in_users(items, tastes).collect():
            lhs, rhs = gram.copy(), np.zeros(6)
            for item, n in counts[r.user_id].items():
                lhs += models.ALPHA * n * np.outer(vectors_of[item], vectors_of[item])
                rhs += (1 + models.ALPHA * n) * vectors_of[item]
            lhs += models.REGULARIZATION * len(counts[r.user_id]) * np.eye(6)
            assert np.allclose(r.qvec, np.linalg.solve(lhs, rhs), atol=1e-3)


@pytest.mark.parametrize("kind", ["fm", "logistic"])
def test_ranker_learns_a_simple_rule(spark, kind):
    from curlew.operators.evaluate import auc

    rows = spark.range(2000).select(
        (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), (F.col("id") % 11 / 11.0).alias("x"),
        (((F.col("id") % 7) < 3).cast("double")).alias("label"),
    )
    model = models.fit_ranker(rows, ["a", "b"], ["x"], kind=kind, buckets=64)
    assert auc(models.predict(model, rows)).first().auc > 0.95


def test_recommendations_leave_out_seen_items(spark, sf):
    from curlew.functions.times import DAY
    from curlew.operators.behavior import active_seen
    from curlew.queries import behavior as behavior_queries
    from curlew.queries import ranking as ranking_queries

    seen = active_seen(behavior_queries.touches(spark, sf), views.AS_OF_US, DAY, behavior_queries.flushes(spark, sf))
    recs = ranking_queries.recommend_batch(spark, sf)
    assert recs.count() == filter_seen(recs, seen).count()


def test_text_vectors_are_filled_in_batches(spark):
    """Repeated ids join, null and empty texts have no tokens, and no map is searched for each of the places."""
    import hashlib
    import re

    from curlew.operators import encode

    texts = [(1, "One two, two"), (1, "three ONE"), (2, None), (3, ""), (4, "a-b \u212a \u0130x"), (None, "lost one")]
    rows = spark.createDataFrame(texts, "item_id bigint, product_description string")
    expected = {}
    for i, text in texts:
        for token in re.split(encode.SEPARATORS, (text or "").lower()):
            if token:
                key = i, int(hashlib.md5(f"{token}:bucket".encode()).hexdigest()[:8], 16) % 16
                expected[key] = expected.get(key, 0) + 1
    found = encode.token_buckets(rows, 16)
    assert {(r.item_id, r.bucket): r.tf for r in found.collect()} == expected
    sparse = encode.encode_text(rows, 16)
    dense = encode.dense_vectors(sparse, 16)
    assert "try_element_at" not in dense._jdf.queryExecution().toString()
    weights = {(r.item_id, r.bucket): r.weight for r in sparse.collect()}
    for r in dense.collect():
        assert np.allclose(r.embedding, [weights.get((r.item_id, b), 0.0) for b in range(16)])
    assert dense.count() == len({i for i, _ in expected})


def test_search_multiplies_few_pairs_in_double_precision(monkeypatch):
    """Single precision only rules pairs out: near ties, huge vectors and ones without a length come out as in double precision."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    items = rng.normal(size=(6000, 16)).astype(np.float32)
    items[3000:4000] = items[:1000] * np.float32(1 + 1e-7)
    queries = rng.normal(size=(300, 16)).astype(np.float32)
    masks = [np.packbits(rng.random(12) < 0.7).tobytes() for _ in queries]

    def search(queries, items):
        rows = lambda x: pa.array(list(x), pa.list_(pa.float32()))
        asked = pa.table({"request_id": np.arange(len(queries)), "qvec": rows(queries), "cells": pa.array(masks, pa.binary()), "floor": pa.nulls(len(queries), pa.float64())})
        held = pa.table({"item_id": np.arange(len(items)), "embedding": rows(items), "place": (np.arange(len(items)) % 12).astype(np.int32)})
        return vectors._stripe_search(10)(asked, held).to_pydict()

    exact, pairs = vectors._products, []
    monkeypatch.setattr(vectors, "_products", lambda a, b: (pairs.append(len(a)), exact(a, b))[1])
    odd = items.copy()
    odd[5, 3], odd[7], odd[9, 0] = np.nan, 3e38, np.inf
    found = [search(queries, items)]
    assert sum(pairs) < 300 * 6000 / 20
    found.append(search(queries, odd))
    monkeypatch.setattr(vectors, "SINGLE_LIMIT", 0.0)
    for one, x in zip(found, (items, odd), strict=True):
        assert one == search(queries, x)
    cells = np.stack([np.unpackbits(np.frombuffer(m, np.uint8))[:12].astype(bool) for m in masks])
    scores = np.round(queries.astype(float) @ items.astype(float).T, 6)
    scores[~cells[:, np.arange(6000) % 12]] = -np.inf
    best = [np.lexsort((np.arange(6000), -s))[:10] for s in scores]
    assert found[0]["item_id"] == list(np.concatenate(best))
