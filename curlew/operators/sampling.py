"""Hash-based samples: simulated interactions and negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curlew.functions.hashing import hash32
from curlew.operators.rowindex import with_row_index


def pick_from_top(ranked: DataFrame, k: int = 10, n: int = 2, seed: int = 42, key: str = "request_id") -> DataFrame:
    """``n`` items per request, drawn by hash from its first ``k`` recommendations."""
    order = Window.partitionBy(key).orderBy(hash32(key, "item_id", seed=seed), "item_id")
    return (
        ranked.where(F.col("rank") <= k)
        .withColumn("pick", F.row_number().over(order))
        .where(F.col("pick") <= n)
    )


def with_negatives(rows: DataFrame, items: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Enriched positive rows (``click`` 1) together with their negatives (``click`` 0), which share the user and context
    of the positive and take the item columns of the drawn item."""
    item_columns = [c for c in items.columns if c != "item_id"]
    drawn = sample_negatives(rows.drop("click", *item_columns), items, n, seed).drop("draw", "positive_item_id", "label")
    return rows.unionByName(drawn.join(items, "item_id").withColumn("click", F.lit(0)))


def sample_negatives(positives: DataFrame, items: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` items per positive row, drawn by hash from the catalog; pairs that are positive somewhere are dropped. Other
    columns of the positive stay on its negatives.

    The draw is a position in the numbered catalog, so it is found by an equi-join. The catalog is small beside the
    interactions; a position drawn from a hash spreads evenly over it.
    """
    numbered = with_row_index(items.select("item_id").distinct(), [F.col("item_id")], "_position", total="_size")
    size = numbered.agg(F.max("_size").alias("_size")).scalar()
    drawn = (
        positives.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("_position", hash32("event_id", "draw", seed=seed) % size)
        .withColumnRenamed("item_id", "positive_item_id")
    )
    negatives = drawn.join(numbered.select("item_id", "_position"), "_position").drop("_position")
    pairs = positives.select("user_id", "item_id").distinct()
    return negatives.join(pairs, ["user_id", "item_id"], "left_anti").withColumn("label", F.lit(0))
