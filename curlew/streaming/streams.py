"""Structured Streaming jobs. Behaviour per user is kept in a state store with timers and published to keyed tables that
apply each micro-batch once; counts are stored per micro-batch, so that a repeated batch replaces its own rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curlew.functions.times import DAY, date_of
from curlew.operators.behavior import WEEK_TTL, majority_category
from curlew.operators.commands import parse_records, route
from curlew.sources.keyed import KeyedTable
from curlew.sources.sinks import write_batch
from curlew.streaming.recent import STATE, changes, marks
from curlew.streaming.settings import STREAMING, settings

LATE = "1 hour"  # how much later than the newest one a command may arrive


def run_batches(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[dict]:
    """Process everything available in micro-batches and stop; the reports of the last of them."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    with settings(stream.sparkSession, STREAMING):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def run_to_files(stream: DataFrame, path: str, *partitions: str) -> DataFrame:
    """Append the stream to Parquet files until everything available is processed, and read them."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}-checkpoint").format("parquet")
    if partitions:
        writer = writer.partitionBy(*partitions)
    with settings(stream.sparkSession, STREAMING):
        query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def event_time(stream: DataFrame, delay: str) -> DataFrame:
    """Event time column and watermark."""
    return stream.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def route_commands(raw: DataFrame) -> DataFrame:
    """Parse, validate and route; rejected records stay in the stream as ``reject`` with their reason."""
    routed = route(parse_records(raw, "body"))
    return routed.withColumn("action", F.when(F.col("reason").isNotNull(), F.lit("reject")).otherwise(F.col("action")))


class RecentItemsState:
    """The published state of the users that are alive: a row per user, replaced whenever the user changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = KeyedTable(spark, path, ["user_id"], [])

    def users(self) -> DataFrame:
        stored = self.table.read()
        return self.spark.createDataFrame([], STATE) if stored is None else stored

    def touches(self) -> DataFrame:
        return self.users().select("user_id", F.inline("items"))

    def slots(self) -> DataFrame:
        return self.users().select("user_id", F.inline("slots"))

    def flushes(self) -> DataFrame:
        return self.users().select("user_id", F.explode("flushes").alias("ts_us"))


def recent_items_state(raw: DataFrame, path: str, ttl: int = WEEK_TTL, late: str = LATE) -> RecentItemsState:
    """Run the command stream into the published state. A user's set leaves it ``ttl`` after the last command."""
    state = RecentItemsState(raw.sparkSession, f"{path}/state")
    run_batches(changes(marks(raw), ttl, late), state.table.upsert, f"{path}/checkpoint", "update")
    return state


def live_categories(users: DataFrame, items: DataFrame, window: int = DAY) -> DataFrame:
    """Top category of changed users at their newest touch: of the items touched in the ``window`` before it and after the
    last flush before it."""
    as_of = F.col("newest_us")
    flushed = F.array_max(F.filter("flushes", lambda f: f < as_of))
    asked = users.where("touched").select("user_id", as_of.alias("as_of"), flushed.alias("flush_us"), F.inline("items"))
    inside = F.col("ts_us").between(F.col("as_of") - window, F.col("as_of")) & (F.col("flush_us").isNull() | (F.col("ts_us") > F.col("flush_us")))
    recent = asked.where(inside)
    # a user's newest touch is the same on all rows
    times = recent.groupBy("user_id").agg(F.max("as_of").alias("as_of"))
    return majority_category(recent.select("user_id", "item_id", "ts_us"), items).join(times, "user_id")


def online_store(spark: SparkSession, path: str) -> KeyedTable:
    """Latest feature row per user."""
    return KeyedTable(spark, f"{path}/online", ["user_id"], ["datetime", "created"])


def dual_sink(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write one batch of feature rows to the online table and to the dated log."""
    online_store(rows.sparkSession, path).upsert(rows, batch_id)
    dated = rows.withColumn("dt", date_of(F.col("datetime")).cast("string"))
    write_batch(dated, f"{path}/log", batch_id, "dt")


FEATURES = "user_id bigint, age int, gender int, top_category int, datetime bigint, created bigint"


def stream_top_category(raw: DataFrame, items: DataFrame, users: DataFrame, path: str, window: int = DAY, late: str = LATE) -> None:
    """Keep the live top category current: each micro-batch updates the users it touched and writes both feature stores.

    Age and gender come from the user's latest online row, which ``users`` fills before the first batch. A flush alone
    changes no feature.
    """
    spark = raw.sparkSession
    state, online = RecentItemsState(spark, f"{path}/state"), online_store(spark, path)
    loaded = users.select("user_id", "age", "gender")
    for name in ("top_category int", "datetime bigint", "created bigint"):
        loaded = loaded.withColumn(name.split()[0], F.lit(None).cast(name.split()[1]))
    online.upsert(loaded, 0, writer="load")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # the state's table holds what the batch is about, so the batch is computed once
        applied = state.table.upsert(batch, batch_id)
        changed = state.table.changed(applied).join(online.read().select("user_id", "age", "gender"), "user_id", "left")
        changed = changed.persist()
        try:
            live = live_categories(changed, items, window).join(changed.select("user_id", "age", "gender"), "user_id")
            rows = live.select("user_id", "age", "gender", "top_category", F.col("as_of").alias("datetime"), F.col("as_of").alias("created"))
            dual_sink(rows, batch_id, path)
        finally:
            changed.unpersist()

    run_batches(changes(marks(raw), WEEK_TTL, late), on_batch, f"{path}/checkpoint", "update")


def online_table(spark: SparkSession, path: str) -> DataFrame:
    """Latest live feature row per user; users that were only loaded have none."""
    stored = online_store(spark, path).read()
    return spark.createDataFrame([], FEATURES) if stored is None else stored.where("datetime IS NOT NULL")


def deduplicate(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Drop repeated deliveries of a record that arrive within the watermark delay."""
    return event_time(stream, delay).dropDuplicatesWithinWatermark([key])


def seen_sessions(touches: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """Seen sets as session windows; a set is emitted once the watermark passes its end.

    Started under ``STREAMING``, sessions are merged inside each task before the shuffle.
    """
    session = F.session_window("event_time", f"{ttl_seconds} seconds")
    return (
        event_time(touches, delay)
        .groupBy("user_id", session.alias("session"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "user_id", F.unix_micros("session.start").alias("start_us"), F.unix_micros("session.end").alias("end_us"), "n"
        )
    )


def daily_popularity(stream: DataFrame, path: str, late: str = "1 day") -> DataFrame:
    """Interactions per day and item, kept in a keyed table that each batch updates.

    The stream's own state holds the days that the watermark has not passed; interactions that are more than ``late`` behind the newest
    one are not counted.
    """
    counts = (
        event_time(stream, late)
        .groupBy(F.window("event_time", "1 day").alias("w"), "item_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_micros("w.start").alias("day_us"), "item_id", "n")
    )
    table = KeyedTable(stream.sparkSession, path, ["day_us", "item_id"], [])
    run_batches(counts, table.upsert, f"{path}/checkpoint", mode="update")
    stored = table.read()
    return stream.sparkSession.createDataFrame([], counts.schema) if stored is None else stored


def counter_deltas(samples: DataFrame, window_us: int) -> DataFrame:
    """Average over the series of a group of ``delta(queue) / (1 + delta(success)) / 1000`` per time window."""
    slot = (F.col("ts_us") - F.pmod("ts_us", F.lit(window_us))).alias("window_us")

    def delta(column: str):
        return F.max_by(column, "ts_us") - F.min_by(column, "ts_us")

    per_series = samples.groupBy("grp", "series", slot).agg(delta("queue_us").alias("queue"), delta("success").alias("done"))
    value = F.col("queue") / (F.lit(1) + F.col("done")) / F.lit(1000.0)
    return per_series.groupBy("grp", "window_us").agg(F.round(F.avg(value), 6).alias("avg_time_queue_ms"))


