"""Interaction counts and ranked popularity lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curlew.operators.joins import counted
from curlew.session import store

# Up to this many lists (one short array each) are broadcast.
BROADCAST_LISTS = 10_000
_CATEGORIES = 1 << 32  # categories are 32-bit numbers


def group_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def item_counts(interactions: DataFrame) -> DataFrame:
    return group_counts(interactions.where(F.col("item_id").isNotNull()), "item_id")


def merge_counts(*partials: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Fold partial count tables (for example one per day) into totals."""
    stacked = reduce(DataFrame.unionByName, partials)
    return stacked.groupBy(*keys).agg(F.sum(value).alias(value))


def popularity(enriched: DataFrame, weight: str | None = None) -> DataFrame:
    """Counts per item at three scopes: ``global``, ``cat_l1`` and ``cat_l2``.

    One pass over the facts reduces them to (item, categories) counts; only those are expanded into the scopes.
    ``weight`` names a column of counts when the input is already aggregated. Rows without a category take part in
    the global scope only.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        enriched.where(F.col("item_id").isNotNull())
        .groupBy("item_id", "category_l1", "category_l2")
        .agg(amount.alias("n"))
    )
    scopes = F.explode(
        F.array(
            F.struct(F.lit("global").alias("scope"), F.lit(0).cast("bigint").alias("scope_id")),
            F.struct(F.lit("cat_l1").alias("scope"), F.col("category_l1").cast("bigint").alias("scope_id")),
            F.struct(F.lit("cat_l2").alias("scope"), F.col("category_l2").cast("bigint").alias("scope_id")),
        )
    )
    return (
        counted.select("item_id", "n", scopes.alias("s"))
        .where(F.col("s.scope_id").isNotNull())
        .groupBy(F.col("s.scope").alias("scope"), F.col("s.scope_id").alias("scope_id"), "item_id")
        .agg(F.sum("n").alias("n"))
    )


def top_n(popular: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most popular items of every scope; equal counts in reverse lexicographic order of the id."""
    order = Window.partitionBy("scope", "scope_id").orderBy(
        F.col("n").desc(), F.col("item_id").cast("string").desc()
    )
    return popular.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_category(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """Most frequent category per user; the smaller category wins a tie; users without any category are absent."""
    per_item = group_counts(interactions, "user_id", "item_id")
    per_category = (
        per_item.join(counted(items.select("item_id", "category_l1")), "item_id")
        .where(F.col("category_l1").isNotNull())
        .groupBy("user_id", "category_l1")
        .agg(F.sum("n").alias("n"))
    )
    # Count and category in one decimal, which the hash aggregate can hold; a struct would sort the rows first.
    below = _CATEGORIES - 1 - (F.col("category_l1").cast("bigint") + F.lit(_CATEGORIES // 2))
    packed = F.col("n").cast("decimal(20, 0)") * F.lit(_CATEGORIES).cast("decimal(11, 0)") + below.cast("decimal(11, 0)")
    best = per_category.groupBy("user_id").agg(F.max(packed).alias("best"))
    category = F.lit(_CATEGORIES // 2 - 1) - (F.col("best") % F.lit(_CATEGORIES).cast("decimal(11, 0)")).cast("bigint")
    return best.select("user_id", category.cast("int").alias("top_category"))


def ranked_lists(popular: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` most popular items of each level-1 category ``(top_category, category_items)`` and over all
    ``(overall)``, in order. The lists are stored once; those of the categories are broadcast if they are few."""
    ranked = top_n(popular.where(F.col("scope").isin("global", "cat_l1")), k)
    lists = store(
        ranked.groupBy("scope", "scope_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("entries")
        ),
        "popular",
    )
    by_category = lists.where(F.col("scope") == "cat_l1").select(
        F.col("scope_id").alias("top_category"), F.col("entries.item_id").alias("category_items")
    )
    if lists.count() * k <= BROADCAST_LISTS * 10:
        by_category = F.broadcast(by_category)
    return by_category, lists.where(F.col("scope") == "global").select(F.col("entries.item_id").alias("overall"))


def popular_fallback(users: DataFrame, popular: DataFrame, k: int = 10) -> DataFrame:
    """A list of ``k`` items per user without a vector: the user's top category first, then the global list.

    The lists hold at most ``k`` items per category.
    """
    by_category, overall = ranked_lists(popular, k)
    overall = overall.select("overall").scalar()
    empty = F.array().cast("array<bigint>")
    merged = (
        users.select("user_id", F.col("top_category").cast("bigint").alias("top_category"))
        .join(by_category, "top_category", "left")
        .select(
            "user_id", F.slice(F.array_distinct(F.concat(F.coalesce("category_items", empty), F.coalesce(overall, empty))), 1, k).alias("ids")
        )
    )
    return merged.select("user_id", F.posexplode("ids").alias("pos", "item_id")).select(
        "user_id", (F.col("pos") + 1).alias("rank"), "item_id"
    )


def fill_lists(short: DataFrame, popular: DataFrame, seen: DataFrame | None, depth: int) -> DataFrame:
    """What follows a user's own candidates: ``(user_id, found, fill)`` with ``fill`` an ordered array of
    ``(item_id, source)``.

    ``short`` has ``user_id``, ``top_category`` and ``found``, the items (an array) that the user's lists hold already.
    The popular items of the user's category come first (source ``category``), then those over all (``popular``), both
    ``depth`` long and without what was found. Items the user has seen come after all others in the same order, so that
    a user who has seen everything popular still gets an answer. Of the seen table only rows that meet one of these two
    lists reach a user's group, so it is bounded by twice the depth.
    """
    by_category, overall = ranked_lists(popular, depth)
    empty = F.array().cast("array<bigint>")
    everywhere = F.coalesce(overall.select("overall").scalar(), empty)
    listed = (
        short.select("user_id", F.col("top_category").cast("bigint").alias("top_category"), F.coalesce("found", empty).alias("found"))
        .join(by_category, "top_category", "left")
        .withColumn("category_items", F.array_except(F.coalesce("category_items", empty), "found"))
        .withColumn("pool", F.array_except(F.array_union("category_items", everywhere), "found"))
    )
    if seen is None:
        ordered = listed.withColumn("ids", F.col("pool"))
    else:
        listed = store(listed.drop("top_category"), "fill")
        met = (
            seen.select("user_id", "item_id")
            .join(listed.select("user_id", "pool").hint("merge"), "user_id")  # many alike lists make small files
            .where(F.array_contains("pool", F.col("item_id")))
            .groupBy("user_id")
            .agg(F.collect_set("item_id").alias("met"))
        )
        met_items = F.coalesce("met", empty)
        ids = F.concat(F.array_except("pool", met_items), F.array_intersect("pool", met_items))
        ordered = listed.join(met, "user_id", "left").withColumn("ids", ids)
    own = F.col("category_items")
    source = F.transform(
        "ids", lambda i: F.struct(i.alias("item_id"), F.when(F.array_contains(own, i), "category").otherwise("popular").alias("source"))
    )
    return ordered.select("user_id", "found", source.alias("fill"))
