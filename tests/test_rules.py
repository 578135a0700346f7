"""Hand-made rows for the edge rules of the data model."""

import math

import pytest
from pyspark.sql import functions as F

from curlew.functions import scalars, times
from curlew.functions.times import DAY, HOUR
from curlew.operators import behavior, history, popularity, ranking, splits, vectors, workflow
from curlew.operators.catalog import clamped_lookup, enrich_recommendations, item_feature_lookup
from curlew.operators.commands import parse_commands, parse_records, route, touches_of

ITEMS = [(1, 10), (2, 10), (3, 30), (4, 30), (5, None)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def items(spark):
    return frame(spark, ITEMS, "item_id bigint, category_l1 int")


def test_top_category_tie_takes_the_smaller(spark, items):
    ix = frame(spark, [(1, 3), (1, 4), (1, 1), (1, 2)], "user_id bigint, item_id bigint")
    assert rows(popularity.top_category(ix, items), "user_id", "top_category") == [(1, 10)]


def test_user_without_category_gets_sentinel(spark, items):
    from curlew.operators.joins import with_top_category

    ix = frame(spark, [(1, 5), (1, 99)], "user_id bigint, item_id bigint")
    users = frame(spark, [(1,)], "user_id bigint")
    assert rows(with_top_category(users, popularity.top_category(ix, items)), "user_id", "top_category") == [(1, -1)]


def test_live_category_tie_takes_the_latest(spark, items):
    touches = frame(spark, [(1, 1, 10), (1, 3, 20), (1, 2, 30), (1, 4, 40)], "user_id bigint, item_id bigint, ts_us bigint")
    assert rows(behavior.top_category_recent(touches, items, 50), "user_id", "top_category") == [(1, 30)]


def test_live_category_cutoff_is_inclusive(spark, items):
    as_of = 10 * DAY
    touches = frame(spark, [(1, 1, as_of - DAY), (2, 1, as_of - DAY - 1)], "user_id bigint, item_id bigint, ts_us bigint")
    assert rows(behavior.top_category_recent(touches, items, as_of), "user_id", "top_category") == [(1, 10)]


def test_reinteraction_counts_once_at_last_time(spark, items):
    touches = frame(spark, [(1, 1, 1), (1, 1, 2), (1, 1, 9), (1, 3, 3), (1, 4, 4)], "user_id bigint, item_id bigint, ts_us bigint")
    assert rows(behavior.recent_items(touches, 10), "item_id", "ts_us") == [(1, 9), (3, 3), (4, 4)]
    assert rows(behavior.top_category_recent(touches, items, 10), "top_category") == [(30,)]


@pytest.mark.parametrize("days, alive", [((0, 6, 12), [1, 2, 3]), ((0, 8), [2]), ((0, 7), [2]), ((0, 6), [1, 2])])
def test_sliding_ttl(spark, days, alive):
    data = [(1, i + 1, d * DAY) for i, d in enumerate(days)]
    touches = frame(spark, data, "user_id bigint, item_id bigint, ts_us bigint")
    seen = behavior.active_seen(touches, days[-1] * DAY + HOUR)
    assert rows(seen, "item_id") == [(i,) for i in alive]


def test_seen_set_is_dead_after_the_ttl(spark):
    touches = frame(spark, [(1, 1, 0)], "user_id bigint, item_id bigint, ts_us bigint")
    assert rows(behavior.active_seen(touches, 7 * DAY - 1), "item_id") == [(1,)]
    assert rows(behavior.active_seen(touches, 7 * DAY), "item_id") == []


def test_flush_empties_the_seen_set(spark):
    touches = frame(spark, [(1, 1, 1), (1, 2, 9), (2, 3, 1)], "user_id bigint, item_id bigint, ts_us bigint")
    flushes = frame(spark, [(1, 5), (2, 5)], "user_id bigint, ts_us bigint")
    assert rows(behavior.active_seen(touches, 10, flushes=flushes), "user_id", "item_id") == [(1, 2)]


def test_filter_without_seen_table_passes_all(spark):
    candidates = frame(spark, [(1, 2)], "user_id bigint, item_id bigint")
    assert behavior.filter_seen(candidates, None) is candidates
    assert behavior.filter_seen_bitmap(candidates, None) is candidates


def test_bitmap_equals_exact_filter_across_bucket_borders(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 1_000_000]
    seen = frame(spark, [(1, i) for i in ids], "user_id bigint, item_id bigint")
    candidates = frame(spark, [(u, i + d) for u in (1, 2) for i in ids for d in (0, 1, 2)], "user_id bigint, item_id bigint")
    by_bitmap = behavior.filter_seen_bitmap(candidates, behavior.seen_bitmaps(seen))
    assert rows(by_bitmap, "user_id", "item_id") == rows(behavior.filter_seen(candidates, seen), "user_id", "item_id")


def test_cold_start(spark):
    users = frame(
        spark, [(1, None, 1, 3), (2, 20, None, 3), (3, 20, 1, None), (4, None, None, None)],
        "user_id bigint, age int, gender int, top_category int",
    )
    out = rows(history.cold_start(users, 36), "user_id", "feature_user_id", "age", "gender", "top_category")
    assert out == [(1, -1, 36, -1, -1), (2, -1, 36, -1, -1), (3, 3, 20, 1, -1), (4, -1, 36, -1, -1)]


def test_default_age_is_truncated():
    assert workflow.default_age(61 / 3) == 20
    assert workflow.default_age(None) == 36


def test_mask_hides_user_fields_together_and_keeps_age(spark):
    df = spark.range(4000).select(
        F.col("id").alias("event_id"), F.lit(5).cast("bigint").alias("user_id"), F.lit(30).alias("age"), F.lit(1).alias("gender"),
        F.lit(2).alias("top_category"), F.lit(1).alias("device_type"),
    )
    masked = splits.mask(df, ["event_id"])
    hidden = masked.where(F.col("user_id") == -1)
    n = hidden.count()
    assert 120 < n < 290
    assert hidden.where((F.col("gender") == -1) & (F.col("top_category") == -1) & (F.col("age") == 30)).count() == n
    both = hidden.where(F.col("device_type") == -1).count()
    assert both < n / 2  # the device is hidden independently
    assert rows(masked, *df.columns) == rows(splits.mask(df, ["event_id"]), *df.columns)


def test_codes(spark):
    df = frame(spark, [(7,), (7,), (9,), (8,), (None,)], "value bigint")
    vocabulary = workflow.fit_vocabulary(df, ["value"])
    assert rows(vocabulary, "value", "code", "n") == [(7, 3, 2), (8, 4, 1), (9, 5, 1)]
    asked = frame(spark, [(7,), (8,), (1,), (None,)], "value bigint")
    coded = workflow.encode(asked, "value", vocabulary, name="code")
    assert {(r.value, r.code) for r in coded.collect()} == {(7, 3), (8, 4), (1, 2), (None, 1)}
    mapped = asked.withColumn("code", workflow.encode_by_map("value", {7: 3, 8: 4, 9: 5}))
    assert {tuple(r) for r in mapped.collect()} == {(7, 3), (8, 4), (1, 2), (None, 1)}


def test_masked_user_is_out_of_vocabulary(spark):
    vocabulary = workflow.fit_vocabulary(frame(spark, [(7,)], "user_id bigint"), ["user_id"])
    assert rows(workflow.encode(frame(spark, [(-1,)], "user_id bigint"), "user_id", vocabulary), "user_id") == [(2,)]


def test_decode(spark):
    vocabulary = workflow.fit_vocabulary(frame(spark, [(70,)], "item_id bigint"), ["item_id"])
    codes = frame(spark, [(1,), (3,)], "code bigint")
    assert set(rows(workflow.decode(codes, "code", vocabulary, "item_id", "raw", compat=True), "code", "raw")) == {(1, 0), (3, 70)}
    strict = workflow.decode(codes, "code", vocabulary, "item_id", "raw").where("code = 1").first()
    assert strict.raw is None


def test_item_lookup_beyond_the_catalog(spark):
    catalog = frame(spark, [(0, 1.0, 1, 1, 0), (2, 3.0, 3, None, 1)], "item_id bigint, price double, category_l1 int, category_l2 int, item_gender int")
    asked = frame(spark, [(-4,), (1,), (2,), (9,)], "item_id bigint")
    assert rows(item_feature_lookup(asked, catalog), "item_id", "price", "category_l2") == [(-4, 0.0, 0), (1, 0.0, 0), (2, 3.0, 0), (9, 0.0, 0)]
    assert rows(clamped_lookup(asked, catalog), "item_id", "price") == [(-4, 1.0), (1, 0.0), (2, 3.0), (9, 3.0)]


def test_constant_column_standardises_to_zero(spark):
    assert rows(frame(spark, [(5.0,)], "x double").select(scalars.standardize(F.col("x"), 5.0, 0.0).alias("y")), "y") == [(0.0,)]
    assert rows(frame(spark, [(5.0,)], "x double").select(scalars.standardize(F.col("x"), 4.0, None).alias("y")), "y") == [(1.0,)]


def test_age_bins(spark):
    ages = frame(spark, [(a,) for a in (17, 18, 24, 25, 65, 70)], "age int")
    got = {r.age: r.b for r in ages.select("age", scalars.bucketize(F.col("age")).alias("b")).collect()}
    assert got == {17: 0, 18: 1, 24: 1, 25: 2, 65: 5, 70: 5}


def test_time_of_day_in_utc(spark):
    df = frame(spark, [(1_700_000_000,)], "t bigint")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            row = df.select(times.hour_of_day(F.col("t")).alias("h"), times.weekday(F.col("t")).alias("w")).first()
            assert (row.h, row.w) == (22, 1)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_event_times_do_not_depend_on_the_session_zone(spark, sf):
    from curlew.sources import views

    def total():
        return views.ix(spark, sf).agg(F.sum("ts_us"), F.sum("day")).first()

    expected = total()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert total() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_epoch_of_summer_and_gap_times(spark, zone):
    wanted = {"1969-12-31 23:59:59.000001": -999_999, "2024-07-15 12:00:00": 1_721_044_800_000_000, "2024-03-10 02:30:00.5": 1_710_037_800_500_000}
    df = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", F.expr("CAST(t AS TIMESTAMP_NTZ)").alias("ts"))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r.t: r.us for r in df.select("t", times.epoch_micros("ts").alias("us")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == wanted


def test_popularity_ties_in_reverse_text_order(spark):
    counts = frame(spark, [("global", 0, 10, 5), ("global", 0, 9, 5), ("global", 0, 1, 7)], "scope string, scope_id bigint, item_id bigint, n bigint")
    top = popularity.top_n(counts, 3).orderBy("rank")
    assert [r.item_id for r in top.collect()] == [1, 9, 10]


def test_null_category_counts_globally_only(spark):
    df = frame(spark, [(1, None, 4), (1, None, 4)], "item_id bigint, category_l1 int, category_l2 int")
    assert rows(popularity.popularity(df), "scope", "scope_id", "n") == [("cat_l2", 4, 2), ("global", 0, 2)]


def test_item_outside_the_catalog_counts_globally_only(spark):
    counts = popularity.item_counts(frame(spark, [(1,), (9,), (9,)], "item_id bigint"))
    catalog = frame(spark, [(1, 3, 4)], "item_id bigint, category_l1 int, category_l2 int")
    out = popularity.popularity(counts.join(catalog, "item_id", "left"), "n")
    assert rows(out, "scope", "scope_id", "item_id", "n") == [("cat_l1", 3, 1, 1), ("cat_l2", 4, 1, 1), ("global", 0, 1, 1), ("global", 0, 9, 2)]


def test_asof_join_null_key_matches_nothing(spark):
    facts = frame(spark, [(1, None, 50), (2, 1, 50)], "id bigint, user_id bigint, t bigint")
    hist = frame(spark, [(None, 10, 1, 40), (1, 10, 1, 30)], "user_id bigint, datetime bigint, created bigint, age int")
    out = history.asof_join(facts, hist, ["user_id"], "t", ["age"])
    assert {(r.id, r.age) for r in out.collect()} == {(1, None), (2, 30)}


@pytest.mark.parametrize("n, train", [(10, 7), (3, 2), (1, 0)])
def test_positional_split(spark, n, train):
    out = splits.split_fraction(spark.range(n), ["id"])
    assert rows(out.where("split = 'train'"), "id") == [(i,) for i in range(train)]
    assert out.count() == n


def test_replay_with_one_training_day(spark):
    old = frame(spark, [(1, 0, "train"), (2, 1, "valid")], "event_id bigint, day int, split string")
    new = frame(spark, [(3, 2, "train")], "event_id bigint, day int, split string")
    out = rows(splits.replay(new, old), "event_id", "origin")
    assert out == [(1, "old_train"), (2, "old_valid"), (3, "new")]
    rolled = splits.roll_over(old, new.withColumn("split", F.lit("valid")))
    assert rows(rolled, "event_id", "split") == [(1, "train"), (2, "train"), (3, "valid")]


def test_rank_with_fewer_candidates_than_k(spark):
    c = frame(spark, [(1, 5, 0.2), (1, 6, 0.9)], "request_id bigint, item_id bigint, score double")
    assert [r.item_id for r in ranking.rank(c, 10).orderBy("rank").collect()] == [6, 5]
    assert ranking.rank(c, 10, diversity=True).count() == 2


def test_sampled_rank_prefers_high_scores(spark):
    c = spark.range(2000).select(F.col("id").alias("request_id"), F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("item_id"))
    c = c.withColumn("score", F.col("item_id") / 10.0)
    first = ranking.rank(c, 1, diversity=True).groupBy("item_id").count().collect()
    share = {r.item_id: r["count"] / 2000 for r in first}
    weights = [math.exp(20 * s / 10) for s in range(3)]
    for item in range(3):
        assert abs(share.get(item, 0) - weights[item] / sum(weights)) < 0.04


def test_log_window(spark):
    log = frame(
        spark, [(1, 7, 1, 1, "2024-01-24"), (2, 8, 2, 2, "2024-01-25"), (2, 9, 3, 3, "2024-01-31")],
        "user_id bigint, top_category int, datetime bigint, created bigint, dt string",
    )
    assert rows(history.latest_updates(log, "2024-01-31"), "user_id", "top_category") == [(2, 9)]
    assert times.date_window("2024-01-31", 7)[-1] == "2024-01-25"


def test_command_rules(spark):
    bodies = {
        '{"user_id": 5, "device_type": "1"}': ("recommend", 1),
        '{"user_id": 5, "device_type": 1.7}': ("recommend", 1),
        '{"user_id": 5, "device_type": "x"}': ("recommend", -1),
        '{"user_id": 5, "device_type": "1.0"}': ("recommend", -1),
        '{"user_id": 5, "device_type": 3}': ("recommend", -1),
        '{"user_id": 5, "device_type": null}': ("recommend", -1),
        '{"user_id": 5, "flush": true, "mark_seen": [1]}': ("flush", -1),
        '{"user_id": 5, "mark_seen": []}': ("noop", -1),
        '{"user_id": 5, "mark_seen": [4, "6"]}': ("mark_seen", -1),
    }
    raw = frame(spark, [(i, 100, b) for i, b in enumerate(bodies)], "event_id bigint, ts_us bigint, body string")
    accepted, rejected = parse_commands(raw)
    routed = route(accepted)
    assert {(r.body, (r.action, r.device_type)) for r in routed.collect()} == set(bodies.items())
    assert rejected.count() == 0
    assert rows(touches_of(routed), "item_id", "ts_us") == [(4, 100), (6, 101)]


def test_reject_reasons(spark):
    bodies = {
        "{bad": "invalid_json", "[1]": "invalid_json", '{"user_id": 1} x': "invalid_json", "": "missing_user_id",
        '{"user_id": null}': "missing_user_id", '{"user_id": "q"}': "bad_user_id", '{"user_id": 1, "top_k": null}': "bad_top_k",
        '{"user_id": 1, "mark_seen": 3}': "bad_mark_seen",
    }
    raw = frame(spark, [(b,) for b in bodies], "body string")
    assert {(r.body, r.reason) for r in parse_records(raw, "body").collect()} == set(bodies.items())


def test_old_snapshot_reads_new_column_as_null(spark):
    old = frame(spark, [(1, 20, 0, 5, 5)], "user_id bigint, age int, gender int, datetime bigint, created bigint")
    assert workflow.conform(old, workflow.USER_FEATURES).first().top_category is None


def test_missing_metadata_becomes_empty_text(spark):
    ranked = frame(spark, [(1, 9, 1)], "request_id bigint, item_id bigint, rank int")
    metadata = frame(spark, [(8, "a", "b", "c", "d", "1.00", "u")], "item_id bigint, title string, category_l1 string, category_l2 string, gender string, price string, image_url string")
    row = enrich_recommendations(ranked, metadata).first()
    assert (row.title, row.price, row.item_id) == ("", "", 9)


def test_missing_vector_is_zero(spark):
    matrix = frame(spark, [(1, [1.0, 2.0])], "idx bigint, embedding array<float>")
    out = vectors.lookup_embeddings(frame(spark, [(1,), (2,)], "idx bigint"), {"image": matrix}, dim=2)
    assert {(r.idx, tuple(r.image)) for r in out.collect()} == {(1, (1.0, 2.0)), (2, (0.0, 0.0))}


def test_asof_join_rules(spark):
    day = DAY
    rows_df = frame(spark, [(1, 1, 5 * day), (2, 1, 3 * day), (3, 1, 3 * day - 1), (4, 2, 5 * day), (5, 1, 400 * day)], "id bigint, user_id bigint, t bigint")
    hist = frame(
        spark, [(1, 3 * day, 1, 10), (1, 3 * day, 2, 11), (1, 4 * day, 1, 12)],
        "user_id bigint, datetime bigint, created bigint, age int",
    )
    for hot in (1_000_000, 1):
        out = history.asof_join(rows_df, hist, ["user_id"], "t", ["age"], hot_rows=hot)
        assert {(r.id, r.age) for r in out.collect()} == {(1, 12), (2, 11), (3, None), (4, None), (5, None)}
