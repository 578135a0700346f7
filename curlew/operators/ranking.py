"""Scoring and ranking of candidate rows, one list per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curlew.functions.hashing import uniform


def logistic_dot(dot: Column) -> Column:
    """Click score from a vector product."""
    return F.round(1.0 / (1.0 + F.exp(-4.0 * dot)), 6)


def softmax_weights(candidates: DataFrame, temperature: float = 20.0, key: str = "request_id") -> DataFrame:
    """``exp(temperature * score) / sum(score)`` within each request."""
    total = F.sum("score").over(Window.partitionBy(key))
    return candidates.withColumn("weight", F.exp(F.lit(temperature) * F.col("score")) / total)


def list_length(top_k: Column, k: int) -> Column:
    """Length of a request's list: ``top_k`` of the ``k`` there are, all without one; a negative one leaves out that many
    at the end."""
    return F.when(top_k < 0, F.greatest(F.lit(0), F.lit(k) + top_k)).otherwise(F.least(F.coalesce(top_k, F.lit(k)), F.lit(k))).cast("int")


def rank(candidates: DataFrame, k: int = 100, diversity: bool = False, temperature: float = 20.0, seed: int = 42,
         key: str = "request_id", top_k: str | None = None) -> DataFrame:
    """The first ``k`` candidates of each request; ``top_k`` names a column with the request's own number, at most ``k``.

    Greedy mode orders by score. Diversity mode samples without replacement with weight ``exp(temperature * score)``
    by exponential races; dividing all weights of a request by their sum would not change the order.
    """
    if diversity:
        race = F.ln(-F.ln(uniform(key, "item_id", seed=seed))) - F.lit(temperature) * F.col("score")
        candidates = candidates.withColumn("race", F.round(race, 9))
        order = [F.col("race").asc(), F.col("item_id").asc()]
    else:
        order = [F.col("score").desc(), F.col("item_id").asc()]
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= k).drop("race")
    return ranked if top_k is None else ranked.where(F.col("rank") <= list_length(F.col(top_k), k))


def unroll(requests: DataFrame, candidates: DataFrame, key: str = "request_id") -> DataFrame:
    """Repeat each request's columns on its candidate rows."""
    return requests.join(candidates, key)

