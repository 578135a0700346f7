"""Plans and hot keys: what must hold when the data grow."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from curlew.functions.times import DAY
from curlew.operators import behavior, evaluate, history, popularity, rowindex, splits, workflow
from curlew.sources import views

QUERIES = entry.queries()


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def skewed(spark):
    """One user holds a third of all rows, and one item another third."""
    kind = F.col("id") % 3
    return spark.range(30_000).select(
        F.col("id").alias("event_id"),
        F.when(kind == 0, F.lit(7)).otherwise(F.col("id") % 500).cast("bigint").alias("user_id"),
        F.when(kind == 1, F.lit(3)).otherwise(F.col("id") % 200).cast("bigint").alias("item_id"),
        (F.col("id") * 97_000_000).alias("ts_us"),
    )


@pytest.mark.parametrize("name", ["rank_greedy", "rank_sampled", "top_n_popular", "recent_items_ranked", "recommend_batch", "knn_exact"])
def test_top_k_prunes_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize(
    "name",
    ["enrich_interactions", "filter_seen", "active_seen_set", "popularity_scopes", "negative_samples", "recommend_batch", "score_candidates",
     "asof_feature_join", "workflow_transform", "knn_exact", "unroll_candidates", "encode_text", "popular_fallback"],
)
def test_no_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["item_counts", "user_category_counts", "popularity_scopes", "recent_items", "counter_delta_metric"])
def test_aggregates_combine_before_the_shuffle(spark, sf, name):
    assert "partial_" in plan(QUERIES[name](spark, sf))


def test_projected_scan_reads_two_columns(spark, sf):
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan(QUERIES["scan_projected"](spark, sf))


def test_day_range_prunes_partitions(spark, sf):
    from curlew.session import scratch_path
    from curlew.sources.readers import read_days

    path = scratch_path(spark, "days")
    views.ix(spark, sf).write.partitionBy("day").parquet(path)
    assert "PartitionFilters: [isnotnull(day" in plan(read_days(spark, path, 3, 2))


def test_row_index_counts_every_row_once(spark, skewed):
    indexed = rowindex.with_row_index(skewed, [F.col("user_id"), F.col("event_id")], "i", total="n")
    stats = indexed.agg(F.min("i"), F.max("i"), F.count_distinct("i"), F.max("n")).first()
    assert tuple(stats) == (0, 29_999, 30_000, 30_000)
    ordered = indexed.orderBy("i").select("user_id", "event_id").collect()
    assert [tuple(r) for r in ordered] == sorted(tuple(r) for r in ordered)


def test_row_index_has_no_single_task_window_over_the_rows(spark, skewed):
    """The only unpartitioned window runs over one row per partition."""
    tree = plan(rowindex.with_row_index(skewed, [F.col("event_id")], "i")).split("(1) ")[0].splitlines()

    def depth(name):
        return [len(line) - len(line.lstrip(" +-:")) for line in tree if name in line]

    assert len(depth("Window")) == len(depth("BroadcastExchange")) == 1
    assert depth("Window")[0] > depth("BroadcastExchange")[0]
    below = [line for line in tree if len(line) - len(line.lstrip(" +-:")) > depth("Window")[0]]
    assert any("HashAggregate" in line for line in below)


def test_running_totals(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("v"))
    rows = rowindex.with_running_totals(df, [F.col("id")], {"below": "v"}).orderBy("id").collect()
    total = 0
    for r in rows:
        assert r.below == total and r.total_below == 999
        total += r.v


def test_asof_join_with_a_hot_key_equals_plain_windows(spark, skewed):
    changes = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 500).cast("bigint").alias("user_id"),
        (F.col("id") * 900_000_000 + 13).alias("datetime"), F.col("id").alias("created"), F.col("id").alias("f"),
    )
    rows = skewed.select("event_id", "user_id", "ts_us")
    ttl = 2 * DAY
    expected = (
        rows.join(changes, "user_id", "left")
        .where((F.col("datetime") <= F.col("ts_us")) & (F.col("datetime") >= F.col("ts_us") - ttl))
        .groupBy("event_id").agg(F.max_by("f", "datetime").alias("f"))
    )
    truth = {r.event_id: r.f for r in expected.collect()}
    for hot in (10_000_000, 50):
        got = history.asof_join(rows, changes, ["user_id"], "ts_us", ["f"], ttl=ttl, hot_rows=hot)
        found = {r.event_id: r.f for r in got.collect()}
        assert len(found) == 30_000
        assert {k: v for k, v in found.items() if v is not None} == truth


def test_seen_sets_of_a_hot_user_equal_a_plain_scan(spark, skewed):
    rows = [(r.user_id, r.item_id, r.ts_us) for r in skewed.collect()]
    as_of, ttl = max(t for *_, t in rows), 6 * 3_600_000_000
    expected = set()
    by_user = {}
    for u, i, t in sorted(rows, key=lambda r: r[2]):
        by_user.setdefault(u, []).append((t, i))
    for u, touches in by_user.items():
        current, last = [], None
        for t, i in touches:
            if last is not None and t - last >= ttl:
                current = []
            current.append(i)
            last = t
        if as_of - last < ttl:
            expected |= {(u, i) for i in current}
    assert {tuple(r) for r in behavior.active_seen(skewed, as_of, ttl).collect()} == expected


def test_popularity_and_vocabulary_keep_every_row_of_a_hot_key(spark, skewed):
    assert popularity.item_counts(skewed).agg(F.sum("n")).first()[0] == 30_000
    vocabulary = workflow.fit_vocabulary(skewed, ["user_id", "item_id"])
    first = {r.col: (r.value, r.n) for r in vocabulary.where("code = 3").collect()}
    assert first["user_id"][0] == 7 and first["user_id"][1] > 9_000 and first["item_id"][0] == 3


def test_split_of_equal_sort_keys_keeps_every_row(spark, skewed):
    out = splits.split_fraction(skewed.withColumn("k", F.lit(1)), ["k"])
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 21_000, "valid": 9_000}


def test_auc_matches_pair_counting(spark):
    rows = [(s / 10.0, (s * 7 + i) % 3 % 2) for i in range(40) for s in range(10)]
    scored = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert evaluate.auc(scored).first().auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-6)


def test_equal_answers_of_two_ways(spark, sf):
    def same(a, b):
        left, right = QUERIES[a](spark, sf), QUERIES[b](spark, sf).select(*QUERIES[a](spark, sf).columns)
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()

    same("filter_seen", "filter_seen_bitmap")
    same("item_counts", "popularity_incremental_merge")
    same("knn_exact", "knn_inverted_exact")
