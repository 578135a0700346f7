"""Cuts found by counting, Bloom filters, replay from stored days, folded users."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curlew.operators import behavior, models, splits
from curlew.operators.selection import cut_at
from curlew.session import scratch_path
from curlew.sources import views
from curlew.sources.readers import partition_values
from curlew.sources.sinks import write_splits


@pytest.mark.parametrize("slot_rows", [5, 100, 10_000])
def test_cut_equals_sorting(spark, slot_rows):
    rng = random.Random(slot_rows)
    far = [-(2**63), 2**63 - 1, 0, 5]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(far) if rng.random() < 0.3 else rng.randrange(1000), rng.choice("ab"), i) for i in range(600)]
    df = spark.createDataFrame(rows, "a int, b bigint, c string, i int").repartition(5)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    ordered = sorted(rows, key=key)
    for position in (0, 1, 149, 300, 420, 599):
        cut = cut_at(df, ["a", "b", "c"], position, slot_rows)
        assert tuple(cut.values.values()) == ordered[position][:3]
        first = next(i for i, r in enumerate(ordered) if key(r) == key(ordered[position]))
        assert cut.equal_before == position - first
        assert df.where(cut.before()).count() == first


def test_split_neither_sorts_nor_stores_rows(spark, sf):
    rows = views.ix(spark, sf)
    out = splits.split_fraction(rows, ["day", "ts_us", "user_id", "item_id"])
    text = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Sort" not in text and "Exchange" not in text
    n = rows.count()
    assert out.where("split = 'train'").count() == int(0.7 * n)
    assert out.where("split = 'train'").agg(F.max("ts_us")).first()[0] <= out.where("split = 'valid'").agg(F.min("ts_us")).first()[0]


@pytest.mark.parametrize("frac", [0.0, 0.5, 1.0])
def test_split_of_ties_and_ends(spark, frac):
    rows = spark.createDataFrame([(1, i % 3) for i in range(10)], "k int, v int")
    out = splits.split_fraction(rows, ["k"], frac)
    assert out.where("split = 'train'").count() == int(10 * frac) and out.count() == 10
    assert splits.split_fraction(rows.limit(0), ["k"], frac).count() == 0


def test_replay_reads_only_the_sampled_days(spark, sf):
    rows = views.ix(spark, sf).withColumn("split", F.when(F.col("day") < 21, "train").otherwise("valid"))
    path = scratch_path(spark, "history")
    write_splits(rows, path)
    assert [int(d) for d in partition_values(spark, f"{path}/split=train", "day")] and partition_values(spark, f"{path}/none", "day") == []
    new = rows.limit(5)
    stored, plain = splits.replay_stored(new, path), splits.replay(new, rows)
    assert sorted(r.event_id for r in stored.where("origin <> 'new'").collect()) == sorted(r.event_id for r in plain.where("origin <> 'new'").collect())
    text = stored._jdf.queryExecution().explainString(stored._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [line for line in text.splitlines() if line.startswith("PartitionFilters")]
    assert any("split" in line and "day" in line and " IN " in line for line in filters) and all("split" in line for line in filters), filters


def test_bloom_filter_size_errors_and_merging(spark):
    size = behavior.BloomSize(100, 0.02)
    seen = spark.range(4000).selectExpr("id % 40 AS user_id", "id * 7 AS item_id")
    blooms = behavior.seen_blooms(seen, size).cache()
    assert {len(r.bloom) for r in blooms.collect()} == {size.bits // 64} and size.bits // 8 <= 120
    candidates = spark.range(40_000).selectExpr("id % 40 AS user_id", "id * 7 AS item_id")
    exact = {tuple(r) for r in behavior.filter_seen(candidates, seen).collect()}
    kept = {tuple(r) for r in behavior.filter_seen_bloom(candidates, blooms, size).collect()}
    assert kept <= exact and len(exact - kept) <= 0.03 * len(exact)
    halves = [behavior.seen_blooms(seen.where(f"item_id % 2 = {i}"), size) for i in (0, 1)]
    assert sorted(map(tuple, behavior.merge_blooms(*halves).collect())) == sorted(map(tuple, blooms.collect()))
    # unknown users and items pass; a user who has seen ten times as much has a filter of the same size
    odd = spark.createDataFrame([(999, 7), (0, None)], "user_id bigint, item_id bigint")
    assert behavior.filter_seen_bloom(odd, blooms, size).count() == 2 and behavior.filter_seen_bloom(odd, None, size).count() == 2
    much = behavior.seen_blooms(spark.range(100_000).selectExpr("1L AS user_id", "id AS item_id"), size).collect()
    assert len(much) == 1 and len(much[0].bloom) == size.bits // 64


def test_folded_users_solve_their_equations_in_any_parts(spark):
    rng = np.random.default_rng(3)
    factors = rng.normal(size=(300, 4)).astype(np.float32)
    items = spark.createDataFrame([(i, [float(x) for x in f]) for i, f in enumerate(factors)], "item_id bigint, embedding array<float>")
    # one user with a third of all rows, ids beyond 32 bits, and an item without a vector
    big = 2**40
    rows = [(big, int(i)) for i in rng.integers(0, 300, 500)] + [(int(u), int(i)) for u, i in zip(rng.integers(0, 50, 1000), rng.integers(0, 310, 1000), strict=True)]
    interactions = spark.createDataFrame(rows, "user_id bigint, item_id bigint")
    counts = {}
    for user, item in rows:
        if item < 300:
            counts.setdefault(user, {}).setdefault(item, 0)
            counts[user][item] += 1
    gram = factors.astype(float).T @ factors.astype(float)
    for fold_rows in (2, 16, 2048):
        got = {r.user_id: r.qvec for r in models.fold_in_users(items, interactions, fold_rows=fold_rows).collect()}
        assert got.keys() == counts.keys()
        for user, own in counts.items():
            y, n = factors[list(own)].astype(float), np.array(list(own.values()), float)
            left = gram + (y * (models.ALPHA * n)[:, None]).T @ y + models.REGULARIZATION * len(own) * np.eye(4)
            assert np.allclose(got[user], np.linalg.solve(left, (1 + models.ALPHA * n) @ y), atol=1e-5)


def test_parts_of_a_user_are_added_up_before_they_are_stored(spark, monkeypatch):
    stored, store = [], models.store

    def noted(df, name):
        stored.append((name, store(df, name)))
        return stored[-1][1]

    monkeypatch.setattr(models, "store", noted)
    items = spark.createDataFrame([(i, [1.0, float(i % 7)]) for i in range(256)], "item_id bigint, embedding array<float>")
    interactions = spark.createDataFrame([(1, i) for i in range(256)], "user_id bigint, item_id bigint")
    assert models.fold_in_users(items, interactions, fold_rows=2).count() == 1
    made = next(df for name, df in stored if name == "equations")
    assert made.count() <= 2 * 256 / 2 / models.FOLD_FAN  # a row for each part before
    assert made.agg(F.sum("n")).first()[0] == 256


def test_ranker_weighs_codes_and_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        a, b = rng.normal(size=3), rng.normal(size=3)
        rows.append((float(a @ b > 0), int(rng.integers(6000)), 1.0, [float(x) for x in a], [float(x) for x in b]))
    df = spark.createDataFrame(rows, "label double, code int, x double, a array<float>, b array<float>")
    model = models.fit_ranker(df, ["code"], ["x"], vectors=("a", "b"))
    # as wide as the codes there are, and one for others
    assert model.stages[-1].numFeatures > 5900 + 6
    odd = df.withColumn("code", F.lit(99_999))
    assert models.predict(model, odd).where("score IS NULL OR score < 0 OR score > 1").count() == 0
    from curlew.operators.evaluate import auc

    # what decides is a product of two vectors, which no single component tells
    assert auc(models.predict(model, df)).first().auc > 0.75


def test_ranker_in_blocks_is_the_factorisation_machine_of_spark(spark, monkeypatch):
    """Parameters and rows in many blocks give the scores of Spark's own model, which holds all of them in the driver."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    from curlew.operators import factors
    from curlew.operators.vectors import lookup_embeddings

    rng = random.Random(8)
    rows = [(float(rng.random() < 0.4), rng.randrange(700), rng.randrange(40), rng.choice([None, rng.gauss(3, 2)]), rng.choice([None, rng.randrange(60)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "label double, item int, user int, x double, idx bigint").repartition(3)
    # item 7 comes twice, others lack one or both vectors
    table = lambda ids, n: spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(n)]) for i in ids], "idx bigint, embedding array<float>")
    tables = {"a": table([*range(50), 7], 64).cache(), "b": table(range(30), 64).cache()}
    monkeypatch.setattr(factors, "ROW_BLOCK", 300)
    monkeypatch.setattr(factors, "PARAMETER_BLOCK", 400)
    monkeypatch.setattr(factors, "SMALL", 100)
    model = models.fit_ranker(df, ["item", "user"], ["x"], tables=tables, key="idx")
    new = df.withColumn("item", F.when(F.col("item") % 50 == 0, 5000).otherwise(F.col("item")))
    columns = ["item", "user", "x", "idx"]
    found = sorted(tuple(r) for r in models.predict(model, new).select(*[F.coalesce(c, F.lit(-1)) for c in columns], "score").collect())

    wide = models._dense(lookup_embeddings(df, tables, "idx"), tables)
    codes = OneHotEncoder(inputCols=["item", "user"], outputCols=["i", "u"], handleInvalid="keep", dropLast=False)
    joined = VectorAssembler(inputCols=["i", "u", "scaled", "a_dense", "b_dense"], outputCol="features")
    spark_model = Pipeline(stages=[*models._numbers(["x"]), codes, joined, FMClassifier(factorSize=8, maxIter=15, stepSize=0.05, seed=42)]).fit(wide)
    scored = models.predict(spark_model, lookup_embeddings(new, tables, "idx")).select(*[F.coalesce(c, F.lit(-1)) for c in columns], "score")
    expected = sorted(tuple(r) for r in scored.collect())
    assert len(found) == len(expected) > 900
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert np.allclose([r[4] for r in found], [r[4] for r in expected], atol=3e-6)


def test_steps_of_the_ranker_leave_no_files(spark):
    """What a step sends, and the state before it, are deleted once its outcome is stored."""
    import pathlib
    import re

    from curlew.session import allow_checkpoints

    allow_checkpoints(spark)
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folder = pathlib.Path(re.sub("^file:", "", spark.sparkContext.getCheckpointDir()))

    def shuffles():
        files = env.blockManager().diskBlockManager().getAllFiles().iterator()
        names = []
        while files.hasNext():
            names.append(files.next().getName())
        return {int(m[1]) for n in names if (m := re.match(r"shuffle_(\d+)_", n))}

    rng = random.Random(5)
    df = spark.createDataFrame([(float(rng.random() < 0.4), rng.randrange(70), rng.gauss(3, 2)) for _ in range(300)], "label double, item int, x double")
    last, stored = max(shuffles(), default=-1), set(folder.iterdir())
    model = models.fit_ranker(df, ["item"], ["x"])
    assert len([s for s in shuffles() if s > last]) < 20  # 15 steps send parameters and gradients
    assert set(folder.iterdir()) <= stored
    assert models.predict(model, df).count() == 300


def test_retrieval_with_ids_beyond_32_bits(spark):
    rng = random.Random(6)
    far = 2**40
    rows = [(far + rng.randrange(20), -far + rng.randrange(15)) for _ in range(400)] + [(None, 1), (1, None)]
    users, items = models.fit_retrieval(spark.createDataFrame(rows, "user_id bigint, item_id bigint"), rank=4, iterations=2)
    assert {r.user_id for r in users.collect()} == {u for u, i in rows if u and i} and {r.item_id for r in items.collect()} == {i for u, i in rows if u and i}


def test_search_through_very_many_cells(spark, sf):
    from curlew.operators import vectors

    rng = np.random.default_rng(9)
    points = rng.normal(size=(2500, 4))
    items = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(9999, None)], "item_id bigint, embedding array<float>")
    asked = items.where("item_id < 40").selectExpr("item_id AS request_id", "embedding AS qvec")
    index = vectors.build_ivf(items, 2000)
    found = vectors.knn_bounded(asked, index, 5)
    exact = vectors.knn(asked, items, 5)
    assert sorted(map(tuple, found.select("request_id", "rank", "item_id").collect())) == sorted(map(tuple, exact.select("request_id", "rank", "item_id").collect()))
    text = found._jdf.queryExecution().toString()
    assert len(text) < 400_000


def test_dominant_category_without_sorting(spark, sf):
    from curlew.operators.popularity import top_category

    categories = [-(2**31), -1, 0, 2**31 - 1]
    rows = [(u, i) for u in range(4) for i in range(4) for _ in range(3 if i >= u else 1)] + [(9, 0)] * 5 + [(8, None)]
    items = spark.createDataFrame(list(enumerate(categories)), "item_id bigint, category_l1 int")
    out = top_category(spark.createDataFrame(rows, "user_id bigint, item_id bigint"), items)
    assert dict(map(tuple, out.collect())) == {0: categories[0], 1: categories[1], 2: categories[2], 3: categories[3], 9: categories[0]}
    text = out._jdf.queryExecution().toString()
    assert "SortAggregate" not in text
