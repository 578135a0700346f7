"""Every request is answered, as long as it asks."""

import pytest
from pyspark.sql import functions as F

from curlew.operators.popularity import fill_lists
from curlew.operators.ranking import list_length
from curlew.operators.workflow import ITEM, fit
from curlew.plans.recommend import recommend

ITEMS = "item_id bigint, price double, category_l1 int, category_l2 int, item_gender int"


@pytest.fixture(scope="module")
def world(spark):
    items = spark.createDataFrame([(i, float(i), i % 3, i % 5, 0) for i in range(1, 61)], ITEMS)
    popular = items.selectExpr("'global' AS scope", "0L AS scope_id", "item_id", "100 - item_id AS n").unionByName(
        items.selectExpr("'cat_l1' AS scope", "CAST(category_l1 AS BIGINT) AS scope_id", "item_id", "100 - item_id AS n")
    )
    features = spark.createDataFrame([(1, 30, 1, 2), (2, 30, 1, 0), (3, None, 1, 1), (4, 40, 0, None)], "user_id bigint, age int, gender int, top_category int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id bigint, qvec array<double>")
    # only items 41 to 46 have vectors, so lists of ten are never full
    item_vectors = spark.createDataFrame([(i, [1.0 / i, i / 100.0]) for i in range(41, 47)], "item_id bigint, embedding array<double>")
    metadata = spark.createDataFrame([(1, "t", "a", "b", "U", "1", "u")], "item_id bigint, title string, category_l1 string, category_l2 string, gender string, price string, image_url string")
    return items, popular, features, vectors, item_vectors, metadata, fit([(ITEM, items)])


def _answers(spark, world, requests, seen, schema="request_id bigint, user_id bigint, device_type int, timestamp bigint, top_k int"):
    items, popular, features, vectors, item_vectors, metadata, workflow = world
    asked = spark.createDataFrame(requests, schema)
    seen = spark.createDataFrame(seen, "user_id bigint, item_id bigint")
    rows = recommend(asked, features, vectors, items, item_vectors, seen, workflow, metadata, 0, popular, k_retrieve=20, k_rank=10)
    answers = {}
    for r in rows.orderBy("request_id", "rank").collect():
        answers.setdefault(r.request_id, []).append(r)
    for own in answers.values():
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert len({r.item_id for r in own}) == len(own) and None not in {r.item_id for r in own}
    return answers


def test_every_request_gets_its_whole_list(spark, world):
    asked = [(10, 1, 0, 0, None), (11, 1, 0, 0, 3), (12, 2, 0, 0, 8), (13, 3, 0, 0, None), (14, 4, 0, 0, None), (15, 99, 0, 0, 25),
             (16, None, 0, 0, None), (17, 1, 0, 0, 0), (18, 1, 0, 0, -4), (19, 1, 0, 0, -40)]
    answers = _answers(spark, world, asked, [(2, i) for i in range(41, 47)] + [(2, 3), (2, 1), (1, 2)])
    assert {q: len(rows) for q, rows in answers.items()} == {10: 10, 11: 3, 12: 8, 13: 10, 14: 10, 15: 10, 16: 10, 18: 6}
    ids = {q: [r.item_id for r in rows] for q, rows in answers.items()}
    # own candidates first, then the user's category by popularity without what was seen
    assert {r.source for r in answers[10][:6]} == {"ranked"} and set(ids[10][:6]) == set(range(41, 47))
    assert ids[10][6:] == [5, 8, 11, 14] and {r.source for r in answers[10][6:]} == {"category"}
    assert all(r.score is None for r in answers[10][6:]) and all(r.score is not None for r in answers[10][:6])
    assert ids[11] == ids[10][:3] and ids[18] == ids[10][:6]
    # all candidates seen: the category alone, the seen item 3 left out
    assert ids[12] == [6, 9, 12, 15, 18, 21, 24, 27]
    # unknown, without age or without category: the global list
    assert ids[13] == ids[14] == ids[15] == ids[16] == list(range(1, 11)) and {r.source for r in answers[13]} == {"popular"}
    assert answers[13][0].title == "t" and answers[13][1].title == ""


def test_requests_without_top_k_column_and_who_has_seen_all(spark, world):
    seen = [(4, i) for i in range(1, 61)]
    answers = _answers(spark, world, [(1, 4, 0, 0), (2, 1, 0, 0)], seen, "request_id bigint, user_id bigint, device_type int, timestamp bigint")
    # everything popular was seen: better the same again than nothing
    assert [r.item_id for r in answers[1]] == list(range(1, 11)) and len(answers[2]) == 10


def test_fill_puts_seen_items_last(spark, world):
    short = spark.createDataFrame([(4, 2, [2, 8]), (5, None, None)], "user_id bigint, top_category int, found array<bigint>")
    seen = spark.createDataFrame([(4, 5), (4, 1), (4, 2), (4, 59), (5, 2), (5, 2)], "user_id bigint, item_id bigint")
    got = {r.user_id: [(i.item_id, i.source) for i in r.fill] for r in fill_lists(short, world[1], seen, 4).collect()}
    assert got[4] == [(11, "category"), (3, "popular"), (4, "popular"), (5, "category"), (1, "popular")]
    assert [i for i, _ in got[5]] == [1, 3, 4, 2]


def test_list_length(spark):
    rows = spark.createDataFrame([(None,), (0,), (3,), (10,), (11,), (-1,), (-10,), (-11,)], "top_k int")
    assert [r[0] for r in rows.select(list_length(F.col("top_k"), 10)).collect()] == [10, 0, 3, 10, 10, 9, 0, 0]


def test_rounds_of_factorisation_do_not_pile_up(spark):
    """Files of a shuffle stay as long as a lineage names them, so vectors must not remember the rounds before theirs."""
    from curlew.operators import models

    rows = spark.range(400).selectExpr("id % 40 AS user_id", "id * 7 % 31 AS item_id")
    shuffles = []
    for iterations in (2, 6):
        _, item_vectors = models.fit_retrieval(rows, rank=4, iterations=iterations)
        lineage = item_vectors.rdd._jrdd.rdd().toDebugString()
        assert item_vectors.count() == 31
        shuffles.append(lineage.count("ShuffledRDD"))
    assert shuffles[0] == shuffles[1]


def test_catalog_of_many_rows_is_not_broadcast(spark, tmp_path, monkeypatch):
    from curlew.operators import joins
    from curlew.operators.popularity import top_category

    spark.range(1000).selectExpr("id AS item_id", "CAST(id % 3 AS INT) AS category_l1").write.parquet(f"{tmp_path}/items")
    seen = spark.createDataFrame([(1, 1), (1, 4), (1, 2), (2, 2), (3, None)], "user_id bigint, item_id bigint")

    def result():
        top = top_category(seen, spark.read.parquet(f"{tmp_path}/items"))
        return {(r.user_id, r.top_category) for r in top.collect()}, top._jdf.queryExecution().executedPlan().toString()

    rows, plan = result()
    assert rows == {(1, 1), (2, 2)} and "BroadcastHashJoin" in plan
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 999)
    rows, plan = result()
    assert rows == {(1, 1), (2, 2)} and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
