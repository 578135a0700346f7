"""Enrichment joins and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.functions.scalars import fill_category


# Rows of ids and numbers that a broadcast may gather in the driver.
BROADCAST_ROWS = 250_000


def counted(df: DataFrame) -> DataFrame:
    """``df`` as the other side of a join: broadcast if it has few rows, else sorted and merged. Its files tell less: a compressed column
    of millions of ids passes for a few MB."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if few else df.hint("merge")


def enrich(interactions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions with user and item columns where known. Sizes decide between broadcast and shuffled joins, and the
    adaptive skew join splits a user or item that dominates the interactions."""
    return interactions.join(users, "user_id", "left").join(items, "item_id", "left")


def with_top_category(users: DataFrame, top: DataFrame) -> DataFrame:
    """Add the fitted top category; users without one get the sentinel."""
    return users.join(top, "user_id", "left").withColumn("top_category", fill_category(F.col("top_category")))


def remap_ids(rows: DataFrame, mapping: DataFrame, key: str, raw: str, code: str) -> DataFrame:
    """Inner join to an id mapping; rows without a mapped id are left out."""
    return rows.join(mapping.select(F.col(raw).alias(key), F.col(code)), key)


def mapping_report(rows: DataFrame, mapping: DataFrame, key: str, raw: str) -> DataFrame:
    """Row counts of both sides and of their match."""
    flagged = rows.join(mapping.select(F.col(raw).alias(key), F.lit(1).alias("_hit")), key, "left")
    total = mapping.agg(F.count(F.lit(1)).alias("n")).scalar()
    return flagged.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("_hit") == 1).alias("joined"),
        F.count_if(F.col("_hit").isNull()).alias("unmatched"),
    ).select("items", total.alias("mapping"), "joined", "unmatched")


def load_report(interactions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of rows, of keys and of keys that the dimension tables do not know."""
    per_pair = interactions.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    known = per_pair.join(users.select("user_id", F.lit(1).alias("_user")), "user_id", "left").join(
        items.select("item_id", F.lit(1).alias("_item")), "item_id", "left"
    )
    return known.agg(
        F.sum("n").alias("rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("item_id").alias("items"),
        F.coalesce(F.sum(F.when(F.col("_user").isNull(), F.col("n"))), F.lit(0)).alias("rows_without_user"),
        F.coalesce(F.sum(F.when(F.col("_item").isNull(), F.col("n"))), F.lit(0)).alias("rows_without_item"),
    )
