"""Batch recommendation over a table of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.functions.scalars import FALLBACK_AGE, OOV, context_defaults
from curlew.operators.behavior import filter_seen
from curlew.operators.catalog import enrich_recommendations, item_feature_lookup
from curlew.operators.history import cold_start, lookup_latest
from curlew.operators.joins import counted
from curlew.operators.popularity import fill_lists
from curlew.operators.ranking import list_length, logistic_dot, rank
from curlew.operators.vectors import knn, lookup_embeddings
from curlew.operators.workflow import FittedWorkflow, decode, encode
from curlew.session import store

Scorer = Callable[[DataFrame], DataFrame]


def dot_scorer(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", logistic_dot(F.col("dot")))


def retrieve(user_vectors: DataFrame, item_vectors: DataFrame, seen: DataFrame | None, k: int) -> DataFrame:
    """Unseen candidates per user: ``(user_id, item_id, dot)``. Repeated requests of a user share one search."""
    queries = user_vectors.select(F.col("user_id").alias("request_id"), "qvec")
    found = knn(queries, item_vectors, k).select(
        F.col("request_id").alias("user_id"), "item_id", F.col("score").alias("dot")
    )
    return filter_seen(found, seen)


def request_features(requests: DataFrame, user_features: DataFrame, default_age: int, now: int) -> DataFrame:
    """Context defaults and user features of every request, anonymous where the user is unknown."""
    device, timestamp = context_defaults(F.col("device_type"), F.col("timestamp"), now)
    known = lookup_latest(requests.withColumns({"device_type": device, "timestamp": timestamp}), user_features, ["user_id"])
    return cold_start(known, default_age)


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """One list per user; it holds at most the retrieval depth."""
    return candidates.groupBy("user_id").agg(F.collect_list(F.struct("item_id", "dot")).alias("candidates"))


def candidate_rows(requests: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per request and candidate. A user's candidates travel as one list, so a user with very many requests only
    lengthens the request side of the join."""
    return requests.join(lists, "user_id").withColumn("c", F.explode("candidates")).select(
        *requests.columns, F.col("c.item_id").alias("item_id"), F.col("c.dot").alias("dot")
    )


def filled_rows(requests: DataFrame, lists: DataFrame, user_features: DataFrame, popular: DataFrame, seen: DataFrame | None,
                k: int, default_age: int) -> DataFrame:
    """What popularity adds to the lists that the user's own candidates leave short: ``(request_id, user_id, item_id,
    rank, source)``, ranks following the ranked ones.

    A request whose user has no vector, is unknown, or has seen all that was retrieved is filled as a whole. A user's
    list is made once, for the longest of the user's requests; each request takes its own part of it.
    """
    length = list_length(F.col("top_k"), k)
    asked = requests.select("request_id", "user_id", length.alias("_length"))
    longest = asked.groupBy("user_id").agg(F.max("_length").alias("_longest"))
    found = lists.select("user_id", F.col("candidates.item_id").alias("found"))
    short = longest.join(found, "user_id", "left").where(F.coalesce(F.size("found"), F.lit(0)) < F.col("_longest"))
    known = cold_start(lookup_latest(short.select("user_id", "found"), user_features, ["user_id"]), default_age)
    # twice as deep as the lists: whatever is taken out as found, a whole list stays
    fill = fill_lists(known, popular, seen, 2 * k).withColumn("_found", F.size("found")).drop("found")
    rows = asked.join(fill, "user_id").where(F.col("_found") < F.col("_length"))
    part = F.slice("fill", 1, F.col("_length") - F.col("_found"))
    rows = rows.select("request_id", "user_id", "_found", F.posexplode(part).alias("_pos", "_item"))
    return rows.select(
        "request_id", "user_id", "_item.item_id", (F.col("_found") + F.col("_pos") + 1).alias("rank"), F.col("_item.source").alias("source")
    )


def model_rows(rows: DataFrame, items: DataFrame, workflow: FittedWorkflow, embeddings: dict[str, DataFrame] | None = None) -> DataFrame:
    """Encoded user, item and context features of candidate rows, for a model scorer, with the items' named vectors
    (tables of ``idx`` and ``embedding``; zeros where an item has none)."""
    known = item_feature_lookup(rows, items).withColumn("click", F.lit(0)).withColumn("raw_item_id", F.col("item_id"))
    as_user = known.withColumn("raw_user_id", F.col("user_id")).withColumn("user_id", F.col("feature_user_id"))
    encoded = workflow.transform(as_user, keep=("request_id", "raw_user_id", "raw_item_id", "dot", "top_k"))
    return lookup_embeddings(encoded, embeddings or {}, "raw_item_id")


def recommend(requests: DataFrame, user_features: DataFrame, user_vectors: DataFrame, items: DataFrame, item_vectors: DataFrame,
              seen: DataFrame | None, workflow: FittedWorkflow, metadata: DataFrame, now: int, popular: DataFrame,
              scorer: Scorer | None = None, k_retrieve: int = 300, k_rank: int = 100, diversity: bool = False,
              default_age: int = FALLBACK_AGE, seed: int = 42, embeddings: dict[str, DataFrame] | None = None) -> DataFrame:
    """Ranked, displayable recommendations for every request.

    A request's list is ``k_rank`` long, or as long as its own ``top_k`` says where it has that column (0 is no list).
    ``source`` tells the user's own candidates (``ranked``) from those that ``popular``, the popularity of items by scope,
    fills up (``category``, ``popular``; without score). ``scorer`` adds ``score`` to encoded candidate rows, which also
    carry the items' ``embeddings``; without one the vector product is the score and the feature joins are not needed. Requests without a user are answered from the
    global list.
    """
    if "top_k" not in requests.columns:
        requests = requests.withColumn("top_k", F.lit(None).cast("int"))
    # nobody has the id of the anonymous user, and it joins
    requests = requests.withColumn("user_id", F.coalesce("user_id", F.lit(OOV)))
    asked = user_vectors.join(requests.select("user_id").distinct(), "user_id", "left_semi")
    in_catalog = item_vectors.join(counted(items.select("item_id")), "item_id", "left_semi")
    lists = store(candidate_lists(retrieve(asked, in_catalog, seen, k_retrieve)), "candidates")
    if scorer is None:
        scored = dot_scorer(candidate_rows(requests.select("request_id", "user_id", "top_k"), lists))
    else:
        rows = candidate_rows(request_features(requests, user_features, default_age, now), lists)
        scored = scorer(model_rows(rows, items, workflow, embeddings)).select(
            "request_id", F.col("raw_user_id").alias("user_id"), F.col("raw_item_id").alias("item_id"), "dot", "score", "top_k"
        )
    ranked = rank(scored, k_rank, diversity, seed=seed, top_k="top_k").drop("top_k")

    def coded(rows: DataFrame) -> DataFrame:
        return encode(rows, "item_id", workflow.vocabulary, workflow.small("item_id"), name="item_code")

    decoded = decode(coded(ranked).drop("item_id"), "item_code", workflow.vocabulary, "item_id", "item_id", small=workflow.small("item_id"))
    filled = coded(filled_rows(requests, lists, user_features, popular, seen, k_rank, default_age))
    both = decoded.withColumn("source", F.lit("ranked")).unionByName(filled, allowMissingColumns=True)
    return enrich_recommendations(both, metadata)
