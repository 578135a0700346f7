"""Writers for splits, dated logs, keyed tables, ranked sets, JSON and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.operators.history import latest_per_key


def gathered(df: DataFrame, *partitions: str) -> DataFrame:
    """Bring the rows of an output partition together before writing, so a task does not open a file in every one.

    Rebalancing cuts partitions that are too large, so one dominant value still spreads over many tasks.
    """
    return df.hint("rebalance", *[F.col(c) for c in partitions])


def write_splits(df: DataFrame, path: str) -> None:
    gathered(df, "split", "day").write.mode("overwrite").partitionBy("split", "day").parquet(path)


def append_dated(df: DataFrame, path: str) -> None:
    """Append a batch to the dated log; every write makes new files."""
    gathered(df, "dt").write.mode("append").partitionBy("dt").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Store one micro-batch so that writing it again replaces it instead of adding to it."""
    rows = gathered(df, *partitions) if partitions else df
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch_id")
        .parquet(path)
    )


def upsert_latest(existing: DataFrame | None, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed table after the updates: the newest row of each key wins."""
    both = updates if existing is None else existing.unionByName(updates, allowMissingColumns=True)
    return latest_per_key(both, keys, order)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def refresh_ranked_sets(popular: DataFrame, path: str) -> None:
    """Replace the popularity sets as a whole."""
    gathered(popular, "scope").write.mode("overwrite").partitionBy("scope").parquet(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.select("idx", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)
