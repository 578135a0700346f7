"""Column rules, requests, fit and transform."""

from __future__ import annotations

from pyspark.sql import functions as F

from curlew.functions import scalars, times
from curlew.functions.arrays import l2_normalize
from curlew.operators import catalog, workflow
from curlew.operators.commands import parse_commands, queue_messages, route, touches_of
from curlew.operators.history import cold_start, lookup_latest, materialize, snapshot
from curlew.operators.joins import enrich, mapping_report, remap_ids, with_top_category
from curlew.operators.popularity import top_category
from curlew.operators.splits import clicked, mask
from curlew.plans import preprocess as plan
from curlew.queries.registry import query
from curlew.queries.scans import TRAIN_DAYS, VALID_DAYS
from curlew.queries.sql_views import latest, transform_sql, uniform
from curlew.session import scratch_path, store
from curlew.sources import views

NOW = views.AS_OF_US // 1_000_000


def merged(spark, sf):
    return plan.merged_days(views.ix(spark, sf), views.users(spark, sf), views.items(spark, sf), TRAIN_DAYS, VALID_DAYS)


def fitted(spark, sf):
    rows = store(merged(spark, sf), "merged")
    return plan.fit_workflow(rows.where(F.col("split") == "train"), views.items(spark, sf)), rows


@query("feature_snapshot_rows", "SELECT item_id, price, category_l1, category_l2, item_gender, 1706659200000000 AS datetime, 1706659200000000 AS created FROM items")
def feature_snapshot_rows(spark, sf):
    return snapshot(views.items(spark, sf), F.lit(views.AS_OF_US))


@query("fill_top_category", "SELECT u.user_id, age, gender, coalesce(top_category, -1) AS top_category FROM users u LEFT JOIN top_cat USING (user_id)")
def fill_top_category(spark, sf):
    top = top_category(views.ix(spark, sf).where(F.col("day") < TRAIN_DAYS), views.items(spark, sf))
    return with_top_category(views.users(spark, sf), top)


@query("normalize_device", "SELECT event_id, device_type FROM parsed WHERE reason IS NULL")
def normalize_device(spark, sf):
    return parse_commands(views.commands(spark, sf))[0].select("event_id", "device_type")


@query("context_defaults", "SELECT event_id, device_type, coalesce(nullif(timestamp, 0), 1706659200) AS timestamp FROM parsed WHERE reason IS NULL")
def context_defaults(spark, sf):
    accepted, _ = parse_commands(views.commands(spark, sf))
    device, timestamp = scalars.context_defaults(F.col("device_type"), F.col("timestamp"), NOW)
    return accepted.select("event_id", device.alias("device_type"), timestamp.alias("timestamp"))


COLD_SQL = f"""
SELECT r.request_id, r.user_id, CASE WHEN f.age IS NULL OR f.gender IS NULL THEN -1 ELSE r.user_id END AS feature_user_id,
  CASE WHEN f.age IS NULL OR f.gender IS NULL THEN (SELECT CAST(trunc(avg(age)) AS BIGINT) FROM merged WHERE split = 'train') ELSE f.age END AS age,
  CASE WHEN f.age IS NULL OR f.gender IS NULL THEN -1 ELSE f.gender END AS gender,
  CASE WHEN f.age IS NULL OR f.gender IS NULL THEN -1 ELSE coalesce(c.top_category, -1) END AS top_category
FROM requests r LEFT JOIN ({latest('user_features', 'user_id', 'datetime DESC, created DESC')}) f ON r.user_id = f.user_id
LEFT JOIN top_cat c ON r.user_id = c.user_id"""


def requests(spark, sf):
    """One recommendation request per page view."""
    rows = views.ix(spark, sf).where(F.col("event_type") == "view")
    return rows.select(F.col("event_id").alias("request_id"), "user_id", "device_type", "timestamp")


def online_users(spark, sf):
    """Latest age and gender per user with the fitted top category."""
    history = views.user_features(spark, sf)
    newest = materialize(history, ["user_id"], views.ORIGIN_US, views.AS_OF_US).drop("datetime", "created")
    top = top_category(views.ix(spark, sf).where(F.col("day") < TRAIN_DAYS), views.items(spark, sf))
    return newest.join(top, "user_id", "left")


def fitted_default_age(spark, sf) -> int:
    train = enrich(views.ix(spark, sf).where(F.col("day") < TRAIN_DAYS), views.users(spark, sf), views.items(spark, sf))
    return workflow.default_age(train.agg(F.avg("age")).first()[0])


@query("cold_start_users", COLD_SQL)
def cold_start_users(spark, sf):
    asked = requests(spark, sf).select("request_id", "user_id")
    return cold_start(lookup_latest(asked, online_users(spark, sf), ["user_id"]), fitted_default_age(spark, sf))


@query(
    "clamp_lookup",
    """
SELECT x.event_id, x.wanted AS item_id, least(greatest(x.wanted, 0), (SELECT max(item_id) FROM items)) AS lookup_id,
  coalesce(price, 0) AS price, coalesce(category_l1, 0) AS category_l1, coalesce(category_l2, 0) AS category_l2,
  coalesce(item_gender, 0) AS item_gender
FROM (SELECT event_id, event_id - 500 AS wanted FROM ix) x
LEFT JOIN items i ON least(greatest(x.wanted, 0), (SELECT max(item_id) FROM items)) = i.item_id""",
)
def clamp_lookup(spark, sf):
    rows = views.ix(spark, sf).select("event_id", (F.col("event_id") - 500).alias("item_id"))
    return catalog.clamped_lookup(rows, views.items(spark, sf))


@query(
    "item_feature_lookup",
    """
SELECT x.event_id, x.event_id - 500 AS item_id, coalesce(price, 0) AS price, coalesce(category_l1, 0) AS category_l1,
  coalesce(category_l2, 0) AS category_l2, coalesce(item_gender, 0) AS item_gender
FROM ix x LEFT JOIN items i ON x.event_id - 500 = i.item_id""",
)
def item_feature_lookup(spark, sf):
    rows = views.ix(spark, sf).select("event_id", (F.col("event_id") - 500).alias("item_id"))
    return catalog.item_feature_lookup(rows, views.items(spark, sf))


@query("catalog_filter", "SELECT * FROM item_metadata WHERE category_l1 = 'PROMO' AND gender = 'F'")
def catalog_filter(spark, sf):
    return catalog.catalog_filter(views.item_metadata(spark, sf), "PROMO", "F")


@query("validate_requests", "SELECT event_id, coalesce(reason, 'ok') AS outcome, user_id FROM parsed")
def validate_requests(spark, sf):
    accepted, rejected = parse_commands(views.commands(spark, sf))
    good = accepted.select("event_id", F.lit("ok").alias("outcome"), "user_id")
    return good.unionByName(rejected.select("event_id", F.col("reason").alias("outcome"), F.lit(None).cast("bigint").alias("user_id")))


@query("route_commands", "SELECT event_id, user_id, action, device_type, timestamp FROM routed")
def route_commands(spark, sf):
    routed = route(parse_commands(views.commands(spark, sf))[0])
    return routed.select("event_id", "user_id", "action", "device_type", "timestamp")


@query(
    "queue_messages",
    """SELECT event_id, CASE action WHEN 'flush' THEN '{"user_id":' || user_id || ',"flush":true}'
  ELSE '{"user_id":' || user_id || '}' END AS message FROM routed WHERE action IN ('flush', 'mark_seen')""",
)
def queue(spark, sf):
    return queue_messages(route(parse_commands(views.commands(spark, sf))[0]))


@query("explode_mark_seen", "SELECT event_id, user_id, item_id, ts_us FROM marked")
def explode_mark_seen(spark, sf):
    return touches_of(route(parse_commands(views.commands(spark, sf))[0]))


@query("build_item_metadata", "SELECT * FROM item_metadata")
def build_item_metadata(spark, sf):
    return views.item_metadata(spark, sf)


@query("remap_item_ids", "SELECT encoded, c.ITEM_ID, PRODUCT_NAME FROM catalog c JOIN id_mapping m ON c.ITEM_ID = m.item_id")
def remap_item_ids(spark, sf):
    rows = views.catalog(spark, sf).select("ITEM_ID", "PRODUCT_NAME")
    return remap_ids(rows, views.id_mapping(spark, sf), "ITEM_ID", "item_id", "encoded")


@query(
    "mapping_report",
    """
SELECT count(*) AS items, (SELECT count(*) FROM id_mapping) AS mapping, count(m.item_id) AS joined,
  count(*) - count(m.item_id) AS unmatched FROM catalog c LEFT JOIN id_mapping m ON c.ITEM_ID = m.item_id""",
)
def id_mapping_report(spark, sf):
    return mapping_report(views.catalog(spark, sf), views.id_mapping(spark, sf), "ITEM_ID", "item_id")


TIME_SQL = """
SELECT event_id, (timestamp % 86400) // 3600 AS hour_of_day, CAST(isodow(make_timestamp(ts_us)) - 1 AS BIGINT) AS day_of_week,
  round(sin(2 * pi() * hour(make_timestamp(ts_us)) / 24.0), 6) + 0.0 AS hour_sine,
  round(cos(2 * pi() * hour(make_timestamp(ts_us)) / 24.0), 6) + 0.0 AS hour_cosine,
  round(sin(2 * pi() * (isodow(make_timestamp(ts_us)) - 1) / 7.0), 6) + 0.0 AS day_sine,
  round(cos(2 * pi() * (isodow(make_timestamp(ts_us)) - 1) / 7.0), 6) + 0.0 AS day_cosine
FROM ix"""


@query("cyclic_time", TIME_SQL)
def cyclic_time(spark, sf):
    hour, day = times.hour_of_day(F.col("timestamp")), times.weekday(F.col("timestamp"))
    columns = {"hour_sine": times.cyclic(hour, 24)[0], "hour_cosine": times.cyclic(hour, 24)[1],
               "day_sine": times.cyclic(day, 7)[0], "day_cosine": times.cyclic(day, 7)[1]}
    return views.ix(spark, sf).select(
        "event_id", hour.alias("hour_of_day"), day.alias("day_of_week"), *[F.round(c, 6).alias(n) for n, c in columns.items()]
    )


@query(
    "date_keys",
    """
SELECT event_id, strftime(make_timestamp(ts_us), '%Y%m%d') AS day_key, ts_us,
  strftime(CAST(make_timestamp(ts_us) AS DATE) - 6, '%Y-%m-%d') AS window_start FROM ix""",
)
def date_keys(spark, sf):
    date = times.date_of(F.col("ts_us"))
    return views.ix(spark, sf).select(
        "event_id", F.date_format(date, "yyyyMMdd").alias("day_key"), "ts_us",
        F.date_format(F.date_sub(date, 6), "yyyy-MM-dd").alias("window_start"),
    )


@query("fit_moments", "SELECT col, round(mean, 6) AS mean, round(std, 6) AS std FROM moments")
def fit_moments(spark, sf):
    items = workflow.fit_moments(views.items(spark, sf), {"price_log_norm": workflow.price_log()})
    train = merged(spark, sf).where(F.col("split") == "train")
    users = workflow.fit_moments(train, {"age_norm": F.col("age").cast("double")})
    return items.unionByName(users).select("col", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "fit_vocabulary",
    """
SELECT col, value, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) + 2 AS code FROM (
  SELECT 'user_id' AS col, user_id AS value, count(*) AS n FROM ixl GROUP BY 2
  UNION ALL SELECT 'item_id', item_id, count(*) FROM ixl GROUP BY 2)""",
)
def fit_vocabulary(spark, sf):
    return workflow.fit_vocabulary(views.ixl(spark, sf), ["user_id", "item_id"])


@query("default_age", "SELECT CAST(trunc(avg(age)) AS BIGINT) AS default_age FROM merged WHERE split = 'train'")
def default_age(spark, sf):
    train = enrich(views.ix(spark, sf), views.users(spark, sf), views.items(spark, sf)).where(F.col("day") < TRAIN_DAYS)
    return train.agg(F.coalesce(F.avg("age").cast("int"), F.lit(scalars.FALLBACK_AGE)).alias("default_age"))


@query("price_log_norm", "SELECT item_id, round((ln(1 + price) - (SELECT mean FROM moments WHERE col = 'price_log_norm')) / (SELECT std FROM moments WHERE col = 'price_log_norm'), 6) AS price_log_norm FROM items")
def price_log_norm(spark, sf):
    items = views.items(spark, sf)
    stats = workflow.fit_moments(items, {"p": workflow.price_log()}).first()
    return items.select("item_id", F.round(scalars.standardize(workflow.price_log(), stats.mean, stats.std), 6).alias("price_log_norm"))


@query("age_norm", "SELECT event_id, round((age - (SELECT avg(age) FROM merged)) / (SELECT stddev_samp(age) FROM merged), 6) AS age_norm FROM merged")
def age_norm(spark, sf):
    rows = views.ix(spark, sf).join(views.users(spark, sf), "user_id", "left")
    age = F.col("age").cast("double")
    stats = workflow.fit_moments(rows, {"a": age}).first()
    return rows.select("event_id", F.round(scalars.standardize(age, stats.mean, stats.std), 6).alias("age_norm"))


@query("age_binned", "SELECT event_id, age, age_binned FROM binned")
def age_binned(spark, sf):
    rows = views.ix(spark, sf).join(views.users(spark, sf), "user_id", "left")
    return rows.select("event_id", "age", scalars.bucketize(F.col("age")).alias("age_binned"))


ENCODE_SQL = """
SELECT x.event_id, CASE WHEN item_id IS NULL THEN 1 ELSE coalesce(i.code, 2) END AS item_code,
  CASE WHEN x.user_id IS NULL THEN 1 ELSE coalesce(u.code, 2) END AS user_code
FROM (SELECT event_id, item_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id FROM ix) x
LEFT JOIN (SELECT value, row_number() OVER (ORDER BY n DESC, value) + 2 AS code
  FROM (SELECT item_id AS value, count(*) AS n FROM ixl WHERE day < 4 GROUP BY 1)) i ON x.item_id = i.value
LEFT JOIN (SELECT value, row_number() OVER (ORDER BY n DESC, value) + 2 AS code
  FROM (SELECT user_id AS value, count(*) AS n FROM ixl WHERE day < 4 GROUP BY 1)) u ON x.user_id = u.value"""


@query("encode_categories", ENCODE_SQL)
def encode_categories(spark, sf):
    """Vocabulary of the first order years applied to the events; failed events have no user."""
    vocabulary = workflow.fit_vocabulary(views.ixl(spark, sf).where(F.col("day") < 4), ["user_id", "item_id"])
    rows = views.ix(spark, sf).withColumn("user_id", F.when(F.col("event_type") != "error", F.col("user_id")))
    coded = workflow.encode(workflow.encode(rows, "item_id", vocabulary, name="item_code"), "user_id", vocabulary, name="user_code")
    return coded.select("event_id", "item_code", "user_code")


@query(
    "decode_item_ids",
    """
SELECT c.code AS item_code, v.value AS item_id, coalesce(v.value, 0) AS item_id_compat
FROM (SELECT DISTINCT item_id AS code FROM ixl) c
LEFT JOIN (SELECT value, row_number() OVER (ORDER BY n DESC, value) + 2 AS code
  FROM (SELECT item_id AS value, count(*) AS n FROM ixl GROUP BY 1)) v ON c.code = v.code""",
)
def decode_item_ids(spark, sf):
    vocabulary = workflow.fit_vocabulary(views.ixl(spark, sf), ["item_id"])
    codes = views.ixl(spark, sf).select(F.col("item_id").alias("item_code")).distinct()
    strict = workflow.decode(codes, "item_code", vocabulary, "item_id", "item_id")
    return workflow.decode(strict, "item_code", vocabulary, "item_id", "item_id_compat", compat=True)


MASKED_SQL = f"""
SELECT * REPLACE (CASE WHEN split = 'train' AND {uniform('event_id', seed='42:user')} < 0.05 THEN -1 ELSE user_id END AS user_id,
  CASE WHEN split = 'train' AND {uniform('event_id', seed='42:user')} < 0.05 THEN -1 ELSE gender END AS gender,
  CASE WHEN split = 'train' AND {uniform('event_id', seed='42:user')} < 0.05 THEN -1 ELSE top_category END AS top_category,
  CASE WHEN split = 'train' AND {uniform('event_id', seed='42:device')} < 0.05 THEN -1 ELSE device_type END AS device_type)
FROM binned"""


@query(
    "mask_rows",
    f"SELECT event_id, user_id, age, gender, top_category, device_type FROM ({MASKED_SQL}) WHERE split = 'train' "
    "UNION ALL SELECT event_id, user_id, age, gender, top_category, device_type FROM merged WHERE split = 'valid'",
)
def mask_rows(spark, sf):
    rows = merged(spark, sf).select("event_id", "user_id", "age", "gender", "top_category", "device_type", "split")
    return mask(rows, ["event_id"], where=F.col("split") == "train").drop("split")


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query("workflow_transform", transform_sql(MASKED_SQL, "m.event_id, m.split"))
def workflow_transform(spark, sf):
    processed, _ = plan.processed_days(
        views.ix(spark, sf), views.users(spark, sf), views.items(spark, sf), TRAIN_DAYS, VALID_DAYS, keep=("event_id",)
    )
    return rounded(processed)


FROZEN_SOURCE = """
SELECT x.*, u.age, u.gender, -1 AS top_category, i.price, i.category_l1, i.category_l2, i.item_gender, CAST(1 AS BIGINT) AS click,
  CAST(age >= 18 AS BIGINT) + CAST(age >= 25 AS BIGINT) + CAST(age >= 35 AS BIGINT) + CAST(age >= 50 AS BIGINT)
    + CAST(age >= 65 AS BIGINT) AS age_binned
FROM (SELECT event_id, user_id + 50 AS user_id, item_id * 40 AS item_id, timestamp, device_type FROM ix) x
LEFT JOIN users u USING (user_id) LEFT JOIN items i USING (item_id)"""


@query("workflow_frozen_oov", transform_sql(FROZEN_SOURCE, "m.event_id"))
def workflow_frozen_oov(spark, sf):
    """The saved workflow applied to rows with users and items it has partly not seen."""
    model, _ = fitted(spark, sf)
    path = scratch_path(spark, "workflow")
    model.save(path)
    loaded = workflow.FittedWorkflow.load(spark, path, plan.WORKFLOW)
    shifted = views.ix(spark, sf).select(
        "event_id", (F.col("user_id") + 50).alias("user_id"), (F.col("item_id") * 40).alias("item_id"), "timestamp", "device_type"
    )
    rows = clicked(enrich(shifted, views.users(spark, sf), views.items(spark, sf)).withColumn("top_category", F.lit(-1)))
    return rounded(loaded.transform(rows, keep=("event_id",)))


@query("select_by_tag", f"SELECT event_id, user_id, age_binned, gender, top_category FROM ({transform_sql('SELECT * FROM binned', 'm.event_id')})")
def select_by_tag(spark, sf):
    model, rows = fitted(spark, sf)
    processed = model.transform(rows, keep=("event_id",))
    keyed = processed.withMetadata("event_id", {"tags": ["USER", "CATEGORICAL"]})
    return workflow.select_by_tag(keyed, "USER", "CATEGORICAL")


@query(
    "display_fields",
    """
SELECT item_id, upper(substr(category_l1, 1, 1)) || lower(substr(category_l1, 2)) AS category, substr(title, 1, 22) AS short_title,
  '$' || printf('%.2f', CAST(price AS DOUBLE)) AS price_text,
  CASE gender WHEN 'M' THEN 'Men' WHEN 'F' THEN 'Women' WHEN 'U' THEN 'Unisex' ELSE '' END AS gender_text FROM item_metadata""",
)
def display_fields(spark, sf):
    return views.item_metadata(spark, sf).select(
        "item_id", scalars.capitalize(F.col("category_l1")).alias("category"), F.substring("title", 1, 22).alias("short_title"),
        scalars.money(F.col("price")).alias("price_text"), scalars.gender_label(F.col("gender")).alias("gender_text"),
    )


@query(
    "l2_normalize",
    """
SELECT item_id, round(list_sum(list_transform(s, lambda x: x / sqrt(list_dot_product(s, s)))), 6) + 0.0 AS total,
  round(s[1] / sqrt(list_dot_product(s, s)), 6) + 0.0 AS first_value
FROM (SELECT item_id, list_transform(embedding, lambda x: x * 3 + 1) AS s FROM emb)""",
)
def l2(spark, sf):
    stretched = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3 + 1)
    unit = views.emb(spark, sf).select("item_id", l2_normalize(stretched).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return unit.select("item_id", F.round(total, 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first_value"))


