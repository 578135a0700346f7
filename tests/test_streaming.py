"""Streams in several micro-batches, repeated batches and sources."""

import pytest
from pyspark.sql import functions as F

from curlew.functions.times import DAY
from curlew.operators.behavior import active_from_state, active_seen
from curlew.operators.commands import flushes_of, parse_commands, route, touches_of
from curlew.session import path_exists, scratch_path
from curlew.sources import readers, sinks, views
from curlew.streaming import streams


@pytest.fixture(scope="module")
def arrivals(spark, sf):
    """The events as files of five consecutive days each, in order of arrival."""
    folder = scratch_path(spark, "arrivals")
    events = views.table(spark, sf, "events")
    shaped = events.withColumn("_slot", F.floor((F.dayofmonth("ts") - 1) / 5))
    for slot in range(6):
        shaped.where(F.col("_slot") == slot).drop("_slot").coalesce(1).write.mode("append").parquet(folder)
    return folder


def command_stream(spark, folder):
    return views.shape_commands(readers.stream_parquet(spark, folder, "*.parquet", files_per_batch=1))


def batch_commands(spark, sf):
    return route(parse_commands(views.commands(spark, sf))[0])


def _pairs(rows):
    return sorted(tuple(r) for r in rows.select("user_id", "item_id").collect())


def test_recent_items_over_many_batches_equal_one_batch(spark, sf, arrivals):
    state = streams.recent_items_state(command_stream(spark, arrivals), scratch_path(spark, "recent"), DAY)
    # six files, and batches without data for timers
    assert state.table.manifest().applied["main"] >= 5
    routed = batch_commands(spark, sf)
    expected = active_seen(touches_of(routed), views.AS_OF_US, DAY, flushes_of(routed))
    live = active_from_state(state.touches(), state.slots(), state.flushes(), views.AS_OF_US, DAY)
    assert _pairs(live) == _pairs(expected)


def _commands(spark, folder, batch):
    """(user, time, items or None for a flush) as a file of commands."""
    rows = []
    for n, (user, ts, marked) in enumerate(batch):
        rest = '"flush": true' if marked is None else f'"mark_seen": {marked}'
        rows.append((n, ts, f'{{"user_id": {user}, {rest}}}'))
    spark.createDataFrame(rows, "event_id bigint, ts_us bigint, body string").coalesce(1).write.mode("append").parquet(folder)


def test_state_expires_while_the_stream_runs(spark, monkeypatch):
    """Many users who come once: the store holds those of the last TTL, and pauses, flushes and late commands act as in
    the batch."""
    folder, path, hour = scratch_path(spark, "in"), scratch_path(spark, "state"), 3_600_000_000
    everything = []
    for batch in range(12):
        start = batch * 12 * hour
        rows = [(100 + 10 * batch + i, start + i * hour, [i, i + 1]) for i in range(10)]
        rows += [(1, start + hour, [batch]), (1, start, [batch, 77])]  # always there, out of order inside a file
        if batch % 4 == 2:
            rows.append((2, start, [batch, 5]))  # pauses of two days
        if batch == 7:
            rows.append((1, start - hour // 2, None))  # a flush that arrives late, but within the delay
        everything += rows
        _commands(spark, folder, rows)
    reports = []
    run = streams.run_batches
    monkeypatch.setattr(streams, "run_batches", lambda *a, **k: reports.extend(run(*a, **k)))
    raw = readers.stream_parquet(spark, folder, "*.parquet", 1)
    state = streams.recent_items_state(raw, path, DAY)
    kept = [r["stateOperators"][0]["numRowsTotal"] for r in reports if r["stateOperators"]]
    assert len(kept) >= 12 and max(kept[4:]) <= max(kept[:6]) + 10, kept
    users = {r.user_id for r in state.users().collect()}
    last = max(ts + len(m or [1]) - 1 for _, ts, m in everything)
    assert users <= {u for u, ts, _ in everything if ts > last - DAY - 2 * hour} and 1 in users
    touches = spark.createDataFrame([(u, i, ts + n) for u, ts, m in everything if m is not None for n, i in enumerate(m)], "user_id bigint, item_id bigint, ts_us bigint")
    flushes = spark.createDataFrame([(u, ts) for u, ts, m in everything if m is None], "user_id bigint, ts_us bigint")
    live = active_from_state(state.touches(), state.slots(), state.flushes(), last, DAY)
    assert _pairs(live) == _pairs(active_seen(touches, last, DAY, flushes))


def test_a_very_active_user_sends_what_is_distinct(spark):
    from curlew.streaming.recent import FLUSH, TOUCH, combined

    rows = spark.range(30_000).selectExpr("1L AS user_id", "id % 5 AS item_id", "id AS ts_us", f"IF(id = 7, {FLUSH}, {TOUCH}) AS kind").coalesce(1)
    sent = combined(rows, DAY).collect()
    assert len(sent) <= 3 * 7 + 1 and (1, 0, 7, FLUSH) in {(r.user_id, r.item_id if r.kind != FLUSH else 0, r.ts_us, r.kind) for r in sent}
    assert max(r.ts_us for r in sent) == 29_999 and min(r.ts_us for r in sent) == 0


def test_live_category_over_many_batches_ends_like_one_batch(spark, sf, arrivals):
    import __spark_entry__ as entry

    path = scratch_path(spark, "live")
    streams.stream_top_category(command_stream(spark, arrivals), views.items(spark, sf), views.users(spark, sf), path)
    online = streams.online_table(spark, path)
    expected = entry.queries()["stream_top_category"](spark, sf)
    assert sorted(map(tuple, online.select("user_id", "top_category", "datetime").collect())) == sorted(
        map(tuple, expected.select("user_id", "top_category", "datetime").collect())
    )
    log = spark.read.parquet(f"{path}/log")
    assert log.count() > online.count()  # the log keeps every update
    assert log.select("dt").distinct().count() > 1


def test_a_flush_keeps_the_feature(spark, sf):
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "live")
    items = spark.createDataFrame([(1, 4)], "item_id bigint, category_l1 int")
    users = spark.createDataFrame([(9, 30, 1)], "user_id bigint, age int, gender int")
    schema = "event_id bigint, ts_us bigint, body string"
    for batch in ([(1, 10, '{"user_id": 9, "mark_seen": [1]}')], [(2, 20, '{"user_id": 9, "flush": true}')]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = readers.stream_parquet(spark, folder, "*.parquet", 1)
        streams.stream_top_category(stream, items, users, path)
    assert streams.online_table(spark, path).first().top_category == 4
    state = streams.RecentItemsState(spark, f"{path}/state")
    assert active_from_state(state.touches(), state.slots(), state.flushes(), 30).isEmpty()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_age_and_gender_come_from_the_latest_online_row(spark):
    folder, path = scratch_path(spark, "in"), scratch_path(spark, "live")
    items = spark.createDataFrame([(1, 4)], "item_id bigint, category_l1 int")
    users = spark.createDataFrame([(9, 30, 1), (8, 20, 0)], "user_id bigint, age int, gender int")
    _commands(spark, folder, [(9, 10, [1]), (7, 11, [1])])
    streams.stream_top_category(readers.stream_parquet(spark, folder, "*.parquet", 1), items, users, path)
    newer = spark.createDataFrame([(9, 31, None, 4, 12, 12)], streams.FEATURES)
    streams.online_store(spark, path).upsert(newer, 0, writer="profile")
    _commands(spark, folder, [(9, 20, [1])])
    streams.stream_top_category(readers.stream_parquet(spark, folder, "*.parquet", 1), items, users, path)
    got = {r.user_id: (r.age, r.gender, r.top_category, r.datetime) for r in streams.online_table(spark, path).collect()}
    assert got == {9: (31, None, 4, 20), 7: (None, None, 4, 11)}


def test_online_table_before_the_first_batch(spark):
    assert streams.online_table(spark, scratch_path(spark, "none")).count() == 0


def test_a_repeated_batch_replaces_itself(spark):
    path = scratch_path(spark, "sink")
    rows = spark.createDataFrame([(1, 30, 1, 2, 5 * DAY, 5 * DAY)], "user_id bigint, age int, gender int, top_category int, datetime bigint, created bigint")
    for _ in range(2):
        streams.dual_sink(rows, 3, path)
    streams.dual_sink(rows.withColumn("datetime", F.lit(6 * DAY)), 4, path)
    assert streams.online_store(spark, path).read().count() == 1
    assert spark.read.parquet(f"{path}/log").count() == 2
    assert streams.online_table(spark, path).first().datetime == 6 * DAY


def test_repeated_deliveries_are_dropped(spark, arrivals, sf):
    rows = views.shape_events(readers.stream_parquet(spark, arrivals, "*.parquet", 1)).select("event_id", "ts_us")
    once = streams.deduplicate(rows.union(rows), "event_id", "1 day").drop("event_time")
    stored = streams.run_to_files(once, scratch_path(spark, "once"))
    total = views.table(spark, sf, "events").count()
    assert stored.count() == stored.select("event_id").distinct().count() == total


def test_popularity_over_many_batches(spark, arrivals, sf):
    rows = views.shape_events(readers.stream_parquet(spark, arrivals, "*.parquet", 1)).select("item_id", "ts_us")
    counted = streams.daily_popularity(rows, scratch_path(spark, "pop"))
    assert counted.agg(F.sum("n")).first()[0] == views.table(spark, sf, "events").count()


def test_empty_input_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        readers.require_input(spark.range(0), "nothing")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_glob(spark, scratch_path(spark, "absent") + "/*.parquet")


def test_compute_or_load_computes_once(spark):
    path, calls = scratch_path(spark, "cache"), []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.compute_or_load(spark, path, compute).count() == 3
    assert calls == [1] and path_exists(spark, path)


def test_absent_images_are_tolerated(spark, tmp_path):
    (tmp_path / "item_id=5").mkdir()
    (tmp_path / "item_id=5" / "a.jpg").write_bytes(b"abc")
    keys = spark.createDataFrame([("5",), ("6",)], "item_id string")
    got = {r.item_id: r.content for r in readers.read_blobs(spark, f"file://{tmp_path}", keys, "item_id").collect()}
    assert bytes(got["5"]) == b"abc" and got["6"] is None


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k bigint, t bigint, v string")
    new = spark.createDataFrame([(1, 4, "late"), (2, 6, "new"), (3, 1, "c")], "k bigint, t bigint, v string")
    merged = sinks.upsert_latest(old, new, ["k"], ["t"])
    assert sorted(map(tuple, merged.collect())) == [(1, 5, "a"), (2, 6, "new"), (3, 1, "c")]


def test_workflow_survives_saving(spark, sf):
    from curlew.plans.preprocess import WORKFLOW, fit_workflow, merged_days
    from curlew.operators.workflow import FittedWorkflow

    rows = merged_days(views.ix(spark, sf), views.users(spark, sf), views.items(spark, sf), 21, 9)
    fitted = fit_workflow(rows, views.items(spark, sf))
    path = scratch_path(spark, "workflow")
    fitted.save(path)
    loaded = FittedWorkflow.load(spark, path, WORKFLOW)
    assert loaded.maps == fitted.maps and loaded.moments.keys() == fitted.moments.keys()
    a, b = fitted.transform(rows, ("event_id",)), loaded.transform(rows, ("event_id",))
    assert a.exceptAll(b).isEmpty()


def test_counter_metric(spark):
    samples = spark.createDataFrame(
        [(0, 1, 0, 1000.0, 10), (0, 1, 5, 4000.0, 12), (0, 2, 1, 0.0, 0), (0, 2, 9, 1000.0, 0)],
        "grp bigint, series bigint, ts_us bigint, queue_us double, success bigint",
    )
    assert streams.counter_deltas(samples, 30_000_000).first().avg_time_queue_ms == 1.0


def test_state_stores_share_one_bound(spark):
    from curlew.streaming.settings import STREAMING, settings

    name = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
    with settings(spark, STREAMING):
        assert spark.conf.get(name) == "true" and int(spark.conf.get(name.replace("boundedMemoryUsage", "maxMemoryUsageMB"))) <= 1000
    assert spark.conf.get(name, None) in (None, "false")


def test_a_touch_is_sent_once(spark):
    from curlew.streaming.recent import TOUCH, combined

    rows = spark.range(30).selectExpr("1L AS user_id", "id AS item_id", f"id * {DAY} + 5 AS ts_us", f"{TOUCH} AS kind").coalesce(1)
    sent = combined(rows, DAY).collect()
    assert sorted((r.item_id, r.ts_us, r.kind) for r in sent) == [(i, i * DAY + 5, TOUCH) for i in range(30)]


def test_users_reach_the_state_step_together(spark):
    """Rows, states and results travel in Arrow batches of many users, not a value or a call to the store at a time."""
    from curlew.streaming.recent import changes

    raw = spark.readStream.format("rate").load().selectExpr("value AS user_id", "value AS item_id", "value AS ts_us", "0 AS kind")
    plan = changes(raw, DAY, "1 hour")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "EventTimeTimeout" in plan


def test_commands_are_parsed_by_all_cores(spark, sf):
    """The events are one file of one row group, which one task reads."""
    from curlew.queries.streams import command_stream

    def task(batch, batch_id):
        tasks.append(batch.select(F.spark_partition_id().alias("task")).distinct().count())

    tasks = []
    streams.run_batches(command_stream(spark, sf).select("event_id", "body"), task, scratch_path(spark, "dealt"))
    assert tasks[0] == spark.sparkContext.defaultParallelism
