"""Ranking and classification measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.operators.rowindex import with_running_totals


def recall_ndcg(ranked: DataFrame, truth: DataFrame, k: int = 10, key: str = "request_id") -> DataFrame:
    """Recall@k and NDCG@k with one relevant item per truth row; a truth row without a hit counts as zero."""
    hits = ranked.where(F.col("rank") <= k).select(key, "item_id", "rank")
    joined = truth.select(key, "item_id").join(hits, [key, "item_id"], "left")
    gain = F.when(F.col("rank").isNotNull(), F.lit(1.0) / F.log2(F.lit(1.0) + F.col("rank"))).otherwise(0.0)
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(gain), 6).alias("ndcg"),
    )


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve; equal scores share their average rank.

    The rows are reduced to one per distinct score first, and the counts of lower negatives come from a distributed
    running total.
    """
    positive = F.col(label) == 1
    per_score = scored.groupBy(score).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    below = with_running_totals(per_score, [F.col(score)], {"neg_below": "neg"}, totals=False)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return below.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.round(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")), 6).alias("auc"),
    )
