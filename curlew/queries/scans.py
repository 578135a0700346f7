"""Scans, sinks and schema handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from curlew.operators.popularity import group_counts, item_counts, popularity
from curlew.operators.splits import split_by_day
from curlew.operators.workflow import USER_FEATURES, conform, union_evolved
from curlew.queries.registry import query
from curlew.queries.sql_views import latest
from curlew.session import scratch_path
from curlew.sources import readers, sinks, views
from curlew.sources.keyed import KeyedTable
from curlew.streaming.streams import run_to_files

TRAIN_DAYS, VALID_DAYS = 21, 9


@query("scan_day_range", "SELECT event_id, item_id, day, CASE WHEN day < 21 THEN 'train' ELSE 'valid' END AS split FROM ix")
def scan_day_range(spark, sf):
    path = scratch_path(spark, "days")
    sinks.gathered(views.ix(spark, sf), "day").write.partitionBy("day").parquet(path)
    train = readers.read_days(spark, path, 0, TRAIN_DAYS).withColumn("split", F.lit("train"))
    valid = readers.read_days(spark, path, TRAIN_DAYS, VALID_DAYS).withColumn("split", F.lit("valid"))
    return train.unionByName(valid).select("event_id", "item_id", "day", "split")


@query("scan_glob_counts", "SELECT day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM ix GROUP BY day")
def scan_glob_counts(spark, sf):
    path = scratch_path(spark, "glob")
    sinks.gathered(views.ix(spark, sf), "day").write.partitionBy("day").parquet(path)
    rows = readers.read_glob(spark, f"{path}/day=*/*.parquet")
    day = F.regexp_extract("_metadata.file_path", "/day=([0-9]+)/", 1).cast("bigint").alias("day")
    return rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "scan_projected",
    "SELECT l_partkey AS item_id, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
)
def scan_projected(spark, sf):
    lines = views.table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    return lines.groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def dated_log(spark, sf) -> str:
    path = scratch_path(spark, "updates")
    sinks.append_dated(views.behavioral_updates(spark, sf), path)
    return path


@query(
    "scan_last_n_days",
    "SELECT user_id, top_category, datetime, dt FROM behavioral_updates WHERE dt BETWEEN '2024-01-25' AND '2024-01-31'",
)
def scan_last_n_days(spark, sf):
    from curlew.operators.history import last_n_days

    log = last_n_days(spark.read.parquet(dated_log(spark, sf)), views.AS_OF_DATE, 7)
    return log.select("user_id", "top_category", "datetime", F.col("dt").cast("string").alias("dt"))


@query("scan_csv_catalog", "SELECT * FROM catalog")
def scan_csv_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    options = {"header": True, "quote": '"', "escape": '"'}
    views.catalog(spark, sf).write.options(**options).csv(path)
    return readers.read_catalog_csv(spark, path)


@query(
    "parse_json_props",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS is_valid FROM events",
)
def parse_json_props(spark, sf):
    parsed = F.from_json("props", "k BIGINT, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return (
        views.table(spark, sf, "events")
        .select("event_id", parsed.alias("p"))
        .select("event_id", F.col("p.k").alias("k"), F.col("p._corrupt").isNull().alias("is_valid"))
    )


@query(
    "scan_binary_files",
    """
SELECT k AS lang, coalesce(n_bytes, 0) AS n_bytes, n_bytes IS NOT NULL AS present
FROM (SELECT DISTINCT lang AS k FROM documents UNION SELECT r_name FROM region)
LEFT JOIN (SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY lang) ON k = lang""",
)
def scan_binary_files(spark, sf):
    path = scratch_path(spark, "blobs")
    documents = views.table(spark, sf, "documents")
    sinks.gathered(documents.select("text", "lang"), "lang").write.partitionBy("lang").text(path)
    keys = documents.select("lang").union(views.table(spark, sf, "region").select("r_name"))
    blobs = readers.read_blobs(spark, path, keys, "lang")
    return blobs.groupBy("lang").agg(
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.max("n_bytes").isNotNull().alias("present")
    )


@query("sink_parquet_roundtrip", "SELECT event_id, user_id, day, CASE WHEN day < 21 THEN 'train' ELSE 'valid' END AS split FROM ix")
def sink_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "splits")
    sinks.write_splits(split_by_day(views.ix(spark, sf), TRAIN_DAYS, VALID_DAYS), path)
    return spark.read.parquet(path).select("event_id", "user_id", "day", "split")


@query(
    "sink_dated_append",
    """SELECT CAST(CAST(make_timestamp(ts_us) AS DATE) AS VARCHAR) AS dt, event_type, count(*) AS n, max(ts_us) AS last_us
FROM ix GROUP BY 1, 2""",
)
def sink_dated_append(spark, sf):
    from curlew.functions.times import date_of

    path = scratch_path(spark, "log")
    rows = views.ix(spark, sf).withColumn("dt", date_of(F.col("ts_us")).cast("string"))
    purchase = F.col("event_type") == "purchase"
    for batch in (rows.where(purchase), rows.where(~purchase)):
        sinks.append_dated(batch, path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("dt").cast("string").alias("dt"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us")
    )


@query("sink_upsert_latest", f"SELECT user_id, item_id, ts_us, event_id FROM ({latest('ix', 'user_id', 'ts_us DESC, event_id DESC')})")
def sink_upsert_latest(spark, sf):
    rows = views.ix(spark, sf)
    table = KeyedTable(spark, scratch_path(spark, "online"), ["user_id"], ["ts_us", "event_id"], buckets=8)
    # the newest days are not the last to arrive
    for batch, days in enumerate((F.col("day").between(10, 19), F.col("day") >= 20, F.col("day") < 10)):
        table.upsert(rows.where(days).select("user_id", "item_id", "ts_us", "event_id"), batch)
    return table.read()


@query("scan_required", "SELECT event_type, count(*) AS n FROM ix GROUP BY 1")
def scan_required(spark, sf):
    """An input that must not be empty; ``tests`` has the empty one."""
    return group_counts(readers.require_input(views.ix(spark, sf), "events"), "event_type")


@query("cached_counts", "SELECT item_id, count(*) AS n FROM ix GROUP BY 1")
def cached_counts(spark, sf):
    """A derived table that the second caller reads instead of computing it."""
    path = scratch_path(spark, "counts")
    readers.compute_or_load(spark, path, lambda: item_counts(views.ix(spark, sf)))
    return readers.compute_or_load(spark, path, lambda: spark.createDataFrame([], "item_id bigint, n bigint"))


@query("sink_json_roundtrip", "SELECT * FROM item_metadata")
def sink_json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    metadata = views.item_metadata(spark, sf)
    sinks.write_json(metadata.withColumn("price", F.col("price").cast("string")), path)
    schema = ", ".join(f"{c} {'bigint' if c == 'item_id' else 'string'}" for c in metadata.columns)
    return spark.read.schema(schema).json(path)


@query(
    "sink_embeddings_roundtrip",
    "SELECT item_id AS idx, CAST(len(embedding) AS BIGINT) AS dim, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm, "
    "round(list_sum(embedding), 6) + 0.0 AS total FROM emb",
)
def sink_embeddings_roundtrip(spark, sf):
    from curlew.functions.arrays import as_double, norm

    path = scratch_path(spark, "vectors")
    sinks.write_embeddings(views.emb(spark, sf).withColumnRenamed("item_id", "idx"), path)
    total = F.aggregate(as_double(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select(
        "idx", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(total, 6).alias("total")
    )


@query(
    "sink_full_refresh",
    """
SELECT scope, count(*) AS sets, CAST(sum(members) AS BIGINT) AS members, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'global' AS scope, 0 AS id, count(DISTINCT item_id) AS members, count(*) AS n FROM ixl WHERE item_id IS NOT NULL
  UNION ALL SELECT 'cat_l1', category_l1, count(DISTINCT item_id), count(*) FROM ixl JOIN items USING (item_id) GROUP BY 2
  UNION ALL SELECT 'cat_l2', category_l2, count(DISTINCT item_id), count(*) FROM ixl JOIN items USING (item_id) GROUP BY 2)
GROUP BY scope""",
)
def sink_full_refresh(spark, sf):
    path = scratch_path(spark, "popular")
    items = views.items(spark, sf)
    for source in (views.ix(spark, sf), views.ixl(spark, sf)):  # the second refresh replaces the first
        sinks.refresh_ranked_sets(popularity(item_counts(source).join(items, "item_id", "left"), "n"), path)
    per_set = spark.read.parquet(path).groupBy("scope", "scope_id").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    return per_set.groupBy("scope").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("members").alias("members"), F.sum("n").alias("n")
    )


@query(
    "schema_evolution_union",
    """
SELECT f.user_id, f.age, f.gender, CAST(NULL AS BIGINT) AS top_category, datetime, created FROM user_features f
UNION ALL
SELECT u.user_id, u.age, u.gender, coalesce(c.top_category, -1), 1706659200000000, 1706659200000000
FROM users u LEFT JOIN top_cat c USING (user_id)""",
)
def schema_evolution_union(spark, sf):
    from curlew.operators.history import snapshot
    from curlew.operators.joins import with_top_category
    from curlew.operators.popularity import top_category

    items = views.items(spark, sf)
    top = top_category(views.ix(spark, sf).where(F.col("day") < TRAIN_DAYS), items)
    new = snapshot(with_top_category(views.users(spark, sf), top), F.lit(views.AS_OF_US))
    return conform(union_evolved(views.user_features(spark, sf), new), USER_FEATURES)


@query("stream_ingest_counts", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1")
def stream_ingest_counts(spark, sf):
    stream = readers.stream_parquet(spark, sf, "events.parquet")
    stored = run_to_files(stream, scratch_path(spark, "ingest"))
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("distinct_entities", "SELECT DISTINCT user_id, 'user' AS kind FROM ix UNION ALL SELECT DISTINCT item_id, 'item' FROM ix")
def distinct_entities(spark, sf):
    rows = views.ix(spark, sf)
    users = rows.select("user_id").distinct().withColumn("kind", F.lit("user"))
    return users.union(rows.select("item_id").distinct().withColumn("kind", F.lit("item")))


@query("user_category_counts", "SELECT user_id, category_l1, count(*) AS n FROM ixl JOIN items USING (item_id) GROUP BY 1, 2")
def user_category_counts(spark, sf):
    per_item = group_counts(views.ixl(spark, sf), "user_id", "item_id")
    known = per_item.join(views.items(spark, sf).select("item_id", "category_l1"), "item_id")
    return known.groupBy("user_id", "category_l1").agg(F.sum("n").alias("n"))
