"""Streaming jobs over the event and command records; each is run to completion and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.functions.times import DAY, date_of
from curlew.operators.behavior import active_from_state
from curlew.queries.registry import query
from curlew.queries.sql_views import DAY_US, seen_sql
from curlew.session import scratch_path
from curlew.sources import readers, views
from curlew.streaming import streams


def events(spark, sf) -> DataFrame:
    return readers.stream_parquet(spark, sf, "events.parquet")


def command_stream(spark, sf) -> DataFrame:
    """The commands, dealt to all cores before they are parsed: a file of few row groups is read by as few tasks."""
    dealt = events(spark, sf).repartition(spark.sparkContext.defaultParallelism, "event_id", "ts")
    return views.shape_commands(dealt)


@query("stream_route_commands", "SELECT event_id, user_id, action, device_type FROM routed UNION ALL SELECT event_id, NULL, 'reject', -1 FROM parsed WHERE reason = 'invalid_json' "
       "UNION ALL SELECT event_id, NULL, 'reject', device_type FROM parsed WHERE reason = 'missing_user_id'")
def stream_route_commands(spark, sf):
    routed = streams.route_commands(command_stream(spark, sf)).select("event_id", "user_id", "action", "device_type")
    return streams.run_to_files(routed, scratch_path(spark, "routed"), "action")


@query("stream_recent_items", seen_sql("marked", "flushed"))
def stream_recent_items(spark, sf):
    state = streams.recent_items_state(command_stream(spark, sf), scratch_path(spark, "recent"), DAY)
    live = active_from_state(state.touches(), state.slots(), state.flushes(), views.AS_OF_US, DAY)
    return live.select("user_id", "item_id")


LIVE_SQL = f"""
SELECT user_id, category_l1 AS top_category, as_of AS datetime FROM (
  SELECT m.user_id, category_l1, as_of, count(*) AS n, max(ts_us) AS last_ts FROM (
    SELECT user_id, item_id, max(ts_us) AS ts_us FROM marked GROUP BY 1, 2) m
  JOIN (SELECT user_id, max(ts_us) AS as_of FROM marked GROUP BY 1) a USING (user_id)
  LEFT JOIN (SELECT f.user_id, max(f.ts_us) AS flush_us FROM flushed f JOIN (SELECT user_id, max(ts_us) AS as_of FROM marked GROUP BY 1) b
    USING (user_id) WHERE f.ts_us < b.as_of GROUP BY 1) f USING (user_id)
  JOIN items USING (item_id)
  WHERE ts_us >= as_of - {DAY_US} AND (flush_us IS NULL OR ts_us > flush_us) GROUP BY 1, 2, 3)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last_ts DESC) = 1"""


def run_live(spark, sf) -> str:
    path = scratch_path(spark, "live")
    streams.stream_top_category(command_stream(spark, sf), views.items(spark, sf), views.users(spark, sf), path)
    return path


@query("stream_top_category", LIVE_SQL)
def stream_top_category(spark, sf):
    return streams.online_table(spark, run_live(spark, sf)).select("user_id", "top_category", "datetime")


@query(
    "stream_dual_sink",
    f"""
SELECT l.user_id, u.age, u.gender, l.top_category, l.datetime, CAST(CAST(make_timestamp(l.datetime) AS DATE) AS VARCHAR) AS dt, store
FROM ({LIVE_SQL}) l LEFT JOIN users u USING (user_id), (VALUES ('online'), ('log')) AS s(store)""",
)
def stream_dual_sink(spark, sf):
    path = run_live(spark, sf)
    online = streams.online_table(spark, path).withColumn("dt", date_of(F.col("datetime")).cast("string"))
    log = spark.read.parquet(f"{path}/log").withColumn("dt", F.col("dt").cast("string"))
    columns = ["user_id", "age", "gender", "top_category", "datetime", "dt"]
    return online.select(*columns, F.lit("online").alias("store")).unionByName(log.select(*columns, F.lit("log").alias("store")))


@query("stream_enrich", "SELECT event_id, item_id, price, category_l1 FROM ix LEFT JOIN items USING (item_id)")
def stream_enrich(spark, sf):
    rows = views.shape_events(events(spark, sf)).select("event_id", "item_id")
    enriched = rows.join(views.items(spark, sf).select("item_id", "price", "category_l1"), "item_id", "left")
    return streams.run_to_files(enriched.select("event_id", "item_id", "price", "category_l1"), scratch_path(spark, "enriched"))


@query("stream_dedup", "SELECT event_id, user_id, ts_us FROM ix")
def stream_dedup(spark, sf):
    """Every record delivered twice, stored once."""
    rows = views.shape_events(events(spark, sf)).select("event_id", "user_id", "ts_us")
    once = streams.deduplicate(rows.union(rows), "event_id", "1 day").drop("event_time")
    return streams.run_to_files(once, scratch_path(spark, "dedup"))


SESSION_DELAY_US = 3_600_000_000


@query(
    "stream_seen_sessions",
    f"""
SELECT user_id, min(ts_us) AS start_us, max(ts_us) + {DAY_US} AS end_us, count(*) AS n FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts_us) AS sess FROM (
    SELECT user_id, ts_us, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w >= {DAY_US} THEN 1 ELSE 0 END AS brk
    FROM ix WINDOW w AS (PARTITION BY user_id ORDER BY ts_us)))
GROUP BY user_id, sess HAVING max(ts_us) + {DAY_US} <= (SELECT max(ts_us) FROM ix) // 1000 * 1000 - {SESSION_DELAY_US}""",
)
def stream_seen_sessions(spark, sf):
    rows = views.shape_events(events(spark, sf)).select("user_id", "ts_us")
    closed = streams.seen_sessions(rows, 86_400, "1 hour")
    return streams.run_to_files(closed, scratch_path(spark, "sessions"))


@query("stream_popularity", f"SELECT ts_us // {DAY_US} * {DAY_US} AS day_us, item_id, count(*) AS n FROM ix GROUP BY 1, 2")
def stream_popularity(spark, sf):
    rows = views.shape_events(events(spark, sf)).select("item_id", "ts_us")
    return streams.daily_popularity(rows, scratch_path(spark, "popularity"))


@query(
    "counter_delta_metric",
    f"""
SELECT grp, window_us, round(avg(dq / (1 + ds) / 1000.0), 6) + 0.0 AS avg_time_queue_ms FROM (
  SELECT user_id % 4 AS grp, user_id, ts_us // {DAY_US} * {DAY_US} AS window_us,
    arg_max(event_id * 1000 + value, ts_us) - arg_min(event_id * 1000 + value, ts_us) AS dq,
    arg_max(event_id, ts_us) - arg_min(event_id, ts_us) AS ds FROM ix GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def counter_delta_metric(spark, sf):
    return streams.counter_deltas(views.counters(spark, sf), DAY)
