"""Feature history: latest values, point-in-time joins, overrides and rolling logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curlew.functions.times import DAY

YEAR_TTL = 365 * DAY
# Rows of one key in one time slot that a single task takes; fuller slots are cut finer.
HOT_ROWS = 2_000_000


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` columns per key.

    A max aggregate combines on the map side, so a key with very many rows costs one row per task. Rows that tie on
    ``order`` are decided by the remaining columns, which keeps the answer repeatable.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in order + rest]).select(
        *df.columns
    )


def materialize(history: DataFrame, keys: list[str], start: int, end: int, ts: str = "datetime", created: str = "created") -> DataFrame:
    """Latest feature row per key inside the closed time window."""
    inside = history.where(F.col(ts).between(start, end))
    return latest_per_key(inside, keys, [ts, created])


def features_at(entities: DataFrame, history: DataFrame, keys: list[str], as_of: int, ttl: int = YEAR_TTL,
                ts: str = "datetime", created: str = "created") -> DataFrame:
    """Features of each entity as known at one instant; rows older than ``ttl`` do not count."""
    known = materialize(history, keys, as_of - ttl, as_of, ts, created)
    return entities.select(*keys).distinct().join(known, keys, "left")


def asof_join(rows: DataFrame, history: DataFrame, keys: list[str], at: str, features: list[str], ts: str = "datetime",
              created: str = "created", ttl: int = YEAR_TTL, bucket: int = DAY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach to every row the newest feature row of its key with ``history.ts <= rows.at``.

    Time is cut into buckets so that no key has to be processed in one task: inside a (key, bucket) the feature rows
    and the rows are merged in time order, and what was last known before the bucket comes from a table with one row
    per (key, bucket). Buckets with more than ``hot_rows`` rows are cut finer, in proportion to their size. Ties on
    time go to the newest ``created``. A null in a key matches nothing.
    """
    history = history.dropna(subset=[*keys, ts])
    rows, history = _with_buckets(rows, history, keys, at, ts, bucket, hot_rows)
    columns = [c for c in rows.columns if c != "_bucket"]
    value = F.struct(F.col(ts).alias("feature_ts"), *features)
    facts = rows.select(
        *keys, "_bucket", F.col(at).alias("_time"), F.lit(1).alias("_is_row"),
        F.lit(None).cast("bigint").alias("_created"), F.struct(*columns).alias("_row"),
    )
    changes = history.select(
        *keys, "_bucket", F.col(ts).alias("_time"), F.lit(0).alias("_is_row"),
        F.col(created).cast("bigint").alias("_created"), value.alias("_value"),
    )
    merged = facts.unionByName(changes, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_time", "_is_row", F.col("_created").asc_nulls_last())
    current = (
        merged.withColumn("_value", F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_is_row") == 1)
        .select(*keys, "_bucket", "_row", "_value")
    )
    # One row per (key, bucket) that changes a feature or needs one: bounded by the time span, not by the data.
    closing = changes.groupBy(*keys, "_bucket").agg(
        F.max(F.struct("_time", "_created", "_value")).getField("_value").alias("_closing")
    )
    needed = facts.select(*keys, "_bucket").distinct()
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        needed.join(closing, [*keys, "_bucket"], "full")
        .withColumn("_carried", F.last("_closing", ignorenulls=True).over(over_buckets))
        .select(*keys, "_bucket", "_carried")
    )
    joined = current.join(carried, [*keys, "_bucket"], "left").withColumn("_value", F.coalesce("_value", "_carried"))
    alive = F.col("_value.feature_ts") >= F.col(f"_row.{at}") - F.lit(ttl)
    return joined.select(
        *[F.col(f"_row.{c}").alias(c) for c in columns],
        *[F.when(alive, F.col(f"_value.{c}")).alias(c) for c in ["feature_ts", *features]],
    )


def _with_buckets(rows: DataFrame, history: DataFrame, keys: list[str], at: str, ts: str, bucket: int,
                  hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Add ``_bucket``, the start of the time slot of each row, to both sides.

    Slots are ``bucket`` wide, and narrower where a key has very many rows. Only those few hot slots (at most the row
    count over ``hot_rows``) are broadcast.
    """
    times = rows.select(*keys, F.col(at).alias("_time")).unionByName(history.select(*keys, F.col(ts).alias("_time")))
    slot = (F.col("_time") - F.pmod("_time", F.lit(bucket))).alias("_slot")
    hot = (
        times.groupBy(*keys, slot)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, "_slot", F.greatest(F.lit(1), F.floor(F.lit(bucket) * F.lit(hot_rows) / F.col("_n"))).cast("bigint").alias("_width"))
    )

    def add(df: DataFrame, time: str) -> DataFrame:
        start = F.col(time) - F.pmod(F.col(time), F.lit(bucket))
        inside = F.col(time) - start
        fine = start + inside - F.pmod(inside, F.col("_width"))
        slotted = df.withColumn("_slot", start).join(F.broadcast(hot), [*keys, "_slot"], "left")
        return slotted.withColumn("_bucket", F.coalesce(fine, F.col("_slot"))).drop("_slot", "_width")

    return add(rows, at), add(history, ts)


def lookup_latest(requests: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """Online lookup: latest values of the keys, unknown keys stay with nulls."""
    return requests.join(latest, keys, "left")


def override(features: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` by the newest update where there is one."""
    newest = updates.select(key, F.col(column).alias("_update"))
    return (
        features.join(newest, key, "left")
        .withColumn(column, F.coalesce(F.col("_update").cast(features.schema[column].dataType), F.col(column)))
        .drop("_update")
    )


def latest_updates(log: DataFrame, as_of_date: str, days: int = 7, key: str = "user_id") -> DataFrame:
    """Newest update per key in the dated log, reading only the partitions of the last ``days`` days."""
    return latest_per_key(last_n_days(log, as_of_date, days), [key], ["datetime", "created"])


def last_n_days(log: DataFrame, as_of_date: str, days: int = 7, column: str = "dt") -> DataFrame:
    end = F.lit(as_of_date).cast("date")
    day = F.col(column).cast("date")
    return log.where(day.between(F.date_sub(end, days - 1), end))


def snapshot(df: DataFrame, as_of: Column) -> DataFrame:
    """Stamp feature rows with the load time as both event and creation time."""
    return df.withColumn("datetime", as_of).withColumn("created", as_of)


def cold_start(users: DataFrame, default_age: int) -> DataFrame:
    """Serving defaults: without age or gender the user is anonymous; otherwise only a missing category is filled."""
    unknown = F.col("age").isNull() | F.col("gender").isNull()
    return users.withColumns(
        {
            "feature_user_id": F.when(unknown, F.lit(-1)).otherwise(F.col("user_id")),
            "age": F.when(unknown, F.lit(default_age)).otherwise(F.col("age")).cast("int"),
            "gender": F.when(unknown, F.lit(-1)).otherwise(F.col("gender")).cast("int"),
            "top_category": F.when(unknown, F.lit(-1)).otherwise(F.coalesce("top_category", F.lit(-1))).cast("int"),
        }
    )
