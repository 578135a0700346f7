"""Item metadata and catalog browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.functions.scalars import clamp

PAGE_SIZE = 12


def build_item_metadata(catalog: DataFrame, mapping: DataFrame, bucket: str, prefix: str = "items") -> DataFrame:
    """Metadata document per encoded item id; catalog rows without an encoded id are left out."""
    encoded = mapping.select(F.col("item_id").alias("ITEM_ID"), F.col("encoded").alias("encoded_id"))
    joined = catalog.join(encoded.hint("merge"), "ITEM_ID")  # a broadcast would gather texts in the driver
    url = F.concat(F.lit(f"https://{bucket}.s3.amazonaws.com/{prefix}/"), F.col("ITEM_ID"), F.lit(".jpg"))
    return joined.select(
        F.col("encoded_id").alias("item_id"),
        F.col("ITEM_ID").alias("item_uuid"),
        F.col("PRODUCT_NAME").cast("string").alias("title"),
        F.col("PRODUCT_DESCRIPTION").cast("string").alias("description"),
        F.col("CATEGORY_L1").cast("string").alias("category_l1"),
        F.col("CATEGORY_L2").cast("string").alias("category_l2"),
        F.col("GENDER").cast("string").alias("gender"),
        F.col("PROMOTED").cast("string").alias("promoted"),
        F.col("PRICE").cast("decimal(12,2)").alias("price"),
        url.alias("image_url"),
    )


def catalog_filter(metadata: DataFrame, category: str = "All", gender: str = "All") -> DataFrame:
    """Facet filter; ``All`` is the wildcard."""
    for column, wanted in (("category_l1", category), ("gender", gender)):
        if wanted != "All":
            metadata = metadata.where(F.col(column) == wanted)
    return metadata


def by_price(metadata: DataFrame, ascending: bool = True) -> DataFrame:
    """Sort by price with a missing price as zero; equal prices by item id."""
    price = F.coalesce("price", F.lit(0))
    return metadata.orderBy(price.asc() if ascending else price.desc(), "item_id")


def page(ordered: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page (0-based) of an ordered catalog."""
    return ordered.offset(number * size).limit(size)


def page_count(metadata: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    rows = F.count(F.lit(1))
    return metadata.agg(rows.alias("items"), F.greatest(F.lit(1), F.ceil(rows / size)).cast("bigint").alias("pages"))


# Metadata fields that default to an empty string in a response.
RESPONSE_FIELDS = ("title", "category_l1", "category_l2", "gender", "price", "image_url")


def enrich_recommendations(ranked: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach display fields; items without metadata keep their place with empty strings."""
    fields = metadata.select("item_id", *[F.col(c).cast("string").alias(c) for c in RESPONSE_FIELDS])
    return ranked.join(fields, "item_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in RESPONSE_FIELDS}
    )


# Numeric item features and their default.
ITEM_FEATURES = ("price", "category_l1", "category_l2", "item_gender")


def item_feature_lookup(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Item features by id; unknown items and missing values give zero."""
    return rows.join(items.select("item_id", *ITEM_FEATURES), "item_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ITEM_FEATURES}
    )


def clamped_lookup(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Like ``item_feature_lookup`` with ids outside the catalog range moved to its ends."""
    highest = items.agg(F.max("item_id")).scalar()
    keyed = rows.withColumn("lookup_id", clamp(F.col("item_id"), 0, highest))
    features = items.select(F.col("item_id").alias("lookup_id"), *ITEM_FEATURES)
    return keyed.join(features, "lookup_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ITEM_FEATURES}
    )


def category_profile(recommendations: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request: items per category, the dominant category (smallest name on a tie) and the top score."""
    counted = recommendations.groupBy(key, "category_l1").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best")
    )
    summary = counted.groupBy(key).agg(
        F.max("n").alias("_most"), F.max("best").alias("top_score"),
        F.min(F.struct((-F.col("n")).alias("m"), "category_l1")).getField("category_l1").alias("dominant"),
    )
    return counted.select(key, "category_l1", "n").join(summary.drop("_most"), key)
