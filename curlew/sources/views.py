"""The engine's logical tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curlew.functions.times import DAY, HOUR, SECOND, epoch_micros, whole
from curlew.sources.readers import spread

# First day of the event table, and the instant up to which the tables are known.
ORIGIN_US = 1_704_067_200 * SECOND  # 2024-01-01 00:00 UTC
AS_OF_US = 1_706_659_200 * SECOND  # 2024-01-31 00:00 UTC
AS_OF_DATE = "2024-01-31"
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


_schemas: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its schema is read from the files once per session."""
    path = f"{sf}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def shape_events(events: DataFrame) -> DataFrame:
    """Interactions with real time of day: item from the properties, device from the event type."""
    device = (
        F.when(F.col("event_type") == "click", 0)
        .when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "purchase", 2)
        .otherwise(-1)
    )
    return (
        events.withColumn("ts_us", epoch_micros("ts"))
        .select(
            "event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), "ts_us",
            whole(F.col("ts_us"), SECOND).alias("timestamp"),
            whole(F.col("ts_us") - ORIGIN_US, DAY).cast("int").alias("day"),
            device.alias("device_type"), "event_type", "value",
        )
    )


def ix(spark: SparkSession, sf: str) -> DataFrame:
    return shape_events(table(spark, sf, "events"))


def ixl(spark: SparkSession, sf: str) -> DataFrame:
    """The larger interaction table: order lines with the ordering customer, one day per order year."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        epoch_micros("l_shipdate").alias("ts_us"), (F.year("o_orderdate") - 1995).alias("day"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        (15 + F.pmod(F.col("c_custkey") * 37, F.lit(60))).cast("int").alias("age"),
        F.pmod("c_nationkey", F.lit(2)).cast("int").alias("gender"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("p_type"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("price"),
        (position - 1).cast("int").alias("category_l1"),
        F.substring("p_brand", 7, 10).cast("int").alias("category_l2"),
        F.pmod("p_size", F.lit(3)).cast("int").alias("item_gender"),
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Raw catalog rows keyed by a text id."""
    gender = F.get(F.array(F.lit("U"), F.lit("M"), F.lit("F")), F.pmod("p_size", F.lit(3)).cast("int"))
    return table(spark, sf, "part").select(
        F.md5(F.concat(F.lit("item-"), F.col("p_partkey").cast("string"))).alias("ITEM_ID"),
        F.col("p_name").alias("PRODUCT_NAME"),
        F.concat_ws(", ", F.col("p_name"), F.lower("p_type"), F.concat(F.lit("size "), F.col("p_size"))).alias("PRODUCT_DESCRIPTION"),
        F.col("p_type").alias("CATEGORY_L1"), F.col("p_brand").alias("CATEGORY_L2"), gender.alias("GENDER"),
        (F.col("p_size") > 25).cast("string").alias("PROMOTED"),
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("PRICE"),
    )


def id_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Text id to encoded id, for the parts that were ever ordered."""
    sold = table(spark, sf, "lineitem").select("l_partkey").distinct()
    return sold.select(
        F.md5(F.concat(F.lit("item-"), F.col("l_partkey").cast("string"))).alias("item_id"), F.col("l_partkey").alias("encoded")
    )


def item_metadata(spark: SparkSession, sf: str) -> DataFrame:
    from curlew.operators.catalog import build_item_metadata

    return build_item_metadata(catalog(spark, sf), id_mapping(spark, sf), "shop-images")


def user_features(spark: SparkSession, sf: str) -> DataFrame:
    """Three dated snapshots per user; customers in debt have none, and one market segment has no gender."""
    customer = table(spark, sf, "customer").where(F.col("c_acctbal") >= 0)
    gender = F.when(F.col("c_mktsegment") != "MACHINERY", F.pmod("c_nationkey", F.lit(2))).cast("int")
    snapshot = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("snapshot")
    # The snapshots are taken on 2024-01-01, -10 and -20.
    day = F.get(F.array(F.lit(0), F.lit(9), F.lit(19)), F.col("snapshot")).cast("bigint")
    return customer.select("c_custkey", gender.alias("gender"), snapshot).select(
        F.col("c_custkey").alias("user_id"),
        (15 + F.pmod(F.col("c_custkey") * 37, F.lit(60)) + F.col("snapshot")).cast("int").alias("age"), "gender",
        (F.lit(ORIGIN_US) + day * DAY).alias("datetime"), (F.lit(ORIGIN_US) + day * DAY + HOUR).alias("created"),
    )


def behavioral_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Dated log of live categories: one row per purchase of a known item."""
    from curlew.functions.times import date_of

    bought = ix(spark, sf).where(F.col("event_type") == "purchase")
    return bought.join(items(spark, sf).select("item_id", "category_l1"), "item_id").select(
        "user_id", F.col("category_l1").alias("top_category"), F.col("ts_us").alias("datetime"),
        F.col("ts_us").alias("created"), date_of(F.col("ts_us")).cast("string").alias("dt"),
    )


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def user_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored vector also serves as the vector of the user and request with that number."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("request_id"), F.col("vec_id").alias("user_id"), F.col("embedding").alias("qvec")
    )


def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("product_description"))
    return spread(documents)


def shape_commands(events: DataFrame) -> DataFrame:
    """JSON command bodies by event type, with the device written in all the ways clients do."""
    k = F.col("item_id")
    device = (
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit(', "device_type": "1"'))
        .when(F.pmod(k, F.lit(5)) == 1, F.lit(', "device_type": 1.7'))
        .when(F.pmod(k, F.lit(5)) == 2, F.lit(', "device_type": "1.0"'))
        .when(F.pmod(k, F.lit(5)) == 3, F.format_string(', "device_type": %d', F.pmod(k, F.lit(7))))
        .otherwise(F.lit(""))
    )
    user = F.format_string('{"user_id": %d', F.col("user_id"))
    body = (
        F.when(F.col("event_type") == "click", F.concat(user, F.format_string(', "mark_seen": [%d]}', k)))
        .when(
            F.col("event_type") == "purchase",
            F.concat(user, F.format_string(', "mark_seen": [%d, %d]}', k, F.pmod(k + 1, F.lit(100)))),
        )
        .when(F.col("event_type") == "view", F.concat(user, device, F.format_string(', "timestamp": %d}', F.col("timestamp"))))
        .when(F.col("event_type") == "signup", F.concat(user, F.lit(', "flush": true}')))
        .when(F.pmod("event_id", F.lit(2)) == 0, F.lit('{"device_type": 1}'))
        .otherwise(F.lit("{not json"))
    )
    return shape_events(events).select("event_id", "ts_us", body.alias("body"))


def commands(spark: SparkSession, sf: str) -> DataFrame:
    return shape_commands(spread(table(spark, sf, "events")))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of two growing counters per series (one series per user, four groups)."""
    return ix(spark, sf).select(
        F.col("user_id").alias("series"), F.pmod("user_id", F.lit(4)).alias("grp"), "ts_us",
        (F.col("event_id") * 1000 + F.col("value")).alias("queue_us"), F.col("event_id").alias("success"),
    )
