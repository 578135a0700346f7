"""History, popularity, behaviour, joins and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.functions.times import DAY
from curlew.operators import behavior, history, popularity, splits
from curlew.operators.joins import counted, enrich, load_report
from curlew.plans.incremental import SPLIT_ORDER, incremental, merge_new_days, replay_sets
from curlew.queries.features import fitted, rounded
from curlew.queries.registry import query
from curlew.queries.scans import TRAIN_DAYS, dated_log
from curlew.queries.sql_views import AS_OF_US, DAY_US, h32, latest, seen_sql, transform_sql
from curlew.session import scratch_path
from curlew.sources import views
from curlew.sources.sinks import write_splits

# --- popularity -------------------------------------------------------------------------------------------------

SCOPES_SQL = """
SELECT 'global' AS scope, 0 AS scope_id, item_id, count(*) AS n FROM ixl WHERE item_id IS NOT NULL GROUP BY item_id
UNION ALL SELECT 'cat_l1', category_l1, item_id, count(*) FROM ixl JOIN items USING (item_id) GROUP BY 2, 3
UNION ALL SELECT 'cat_l2', category_l2, item_id, count(*) FROM ixl JOIN items USING (item_id) GROUP BY 2, 3"""


def scopes(spark, sf) -> DataFrame:
    """Popularity scopes; counting per item first leaves one row per item to join and expand. Items that the catalog lacks
    count in the global scope."""
    per_item = popularity.item_counts(views.ixl(spark, sf))
    return popularity.popularity(per_item.join(counted(views.items(spark, sf)), "item_id", "left"), "n")


@query("item_counts", "SELECT item_id, count(*) AS n FROM ixl GROUP BY 1")
def item_counts(spark, sf):
    return popularity.item_counts(views.ixl(spark, sf))


@query("popularity_scopes", SCOPES_SQL)
def popularity_scopes(spark, sf):
    return scopes(spark, sf)


TOP_SQL = f"SELECT *, row_number() OVER (PARTITION BY scope, scope_id ORDER BY n DESC, CAST(item_id AS VARCHAR) DESC) AS rank FROM ({SCOPES_SQL}) QUALIFY rank <= 10"


@query("top_n_popular", TOP_SQL)
def top_n_popular(spark, sf):
    return popularity.top_n(scopes(spark, sf), 10)


@query("popularity_incremental_merge", "SELECT item_id, count(*) AS n FROM ixl GROUP BY 1")
def popularity_incremental_merge(spark, sf):
    rows = views.ixl(spark, sf)
    per_day = popularity.group_counts(rows, "day", "item_id")
    return popularity.merge_counts(per_day.drop("day"), keys=["item_id"])


@query(
    "top_category_offline",
    """
SELECT user_id, category_l1 AS top_category FROM (
  SELECT user_id, category_l1, count(*) AS n FROM ixl JOIN items USING (item_id) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category_l1) = 1""",
)
def top_category_offline(spark, sf):
    return popularity.top_category(views.ixl(spark, sf), views.items(spark, sf))


@query(
    "popular_fallback",
    f"""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY src, rank) AS rank, item_id FROM (
  SELECT u.user_id, 0 AS src, t.rank, t.item_id FROM users u JOIN top_cat c USING (user_id)
  JOIN (SELECT * FROM ({TOP_SQL}) WHERE scope = 'cat_l1') t ON t.scope_id = c.top_category
  UNION ALL SELECT u.user_id, 1, t.rank, t.item_id FROM users u CROSS JOIN (SELECT * FROM ({TOP_SQL}) WHERE scope = 'global') t)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY src, rank) <= 10
  AND row_number() OVER (PARTITION BY user_id, item_id ORDER BY src) = 1""",
)
def popular_fallback(spark, sf):
    top = popularity.top_category(views.ix(spark, sf).where(F.col("day") < TRAIN_DAYS), views.items(spark, sf))
    return popularity.popular_fallback(views.users(spark, sf).join(top, "user_id", "left"), scopes(spark, sf), 10)


# --- joins ------------------------------------------------------------------------------------------------------


@query(
    "enrich_interactions",
    """
SELECT user_id, item_id, ts_us, day, age, gender, price, category_l1, category_l2, item_gender
FROM ixl LEFT JOIN users USING (user_id) LEFT JOIN items USING (item_id)""",
)
def enrich_interactions(spark, sf):
    return enrich(views.ixl(spark, sf), views.users(spark, sf), views.items(spark, sf))


@query(
    "load_diagnostics",
    """
SELECT count(*) AS rows, count(DISTINCT x.user_id) AS users, count(DISTINCT x.item_id) AS items,
  count(*) - count(u.user_id) AS rows_without_user, count(*) - count(i.item_id) AS rows_without_item
FROM (SELECT event_id, user_id + 20 AS user_id, item_id * 30 AS item_id FROM ix) x
LEFT JOIN users u ON x.user_id = u.user_id LEFT JOIN items i ON x.item_id = i.item_id""",
)
def load_diagnostics(spark, sf):
    shifted = views.ix(spark, sf).select((F.col("user_id") + 20).alias("user_id"), (F.col("item_id") * 30).alias("item_id"))
    return load_report(shifted, views.users(spark, sf), views.items(spark, sf))


HISTORY_SQL = f"""
SELECT e.user_id, f.age, f.gender, f.datetime, f.created FROM (SELECT DISTINCT user_id FROM ix) e
LEFT JOIN ({latest('user_features', 'user_id', 'datetime DESC, created DESC')}) f USING (user_id)"""


@query("historical_features", HISTORY_SQL)
def historical_features(spark, sf):
    known = history.features_at(views.ix(spark, sf), views.user_features(spark, sf), ["user_id"], views.AS_OF_US)
    return known.select("user_id", "age", "gender", "datetime", "created")


@query(
    "asof_feature_join",
    f"""
SELECT x.event_id, x.user_id, x.ts_us, CASE WHEN f.datetime >= x.ts_us - {8 * DAY_US} THEN f.datetime END AS feature_ts,
  CASE WHEN f.datetime >= x.ts_us - {8 * DAY_US} THEN f.age END AS age,
  CASE WHEN f.datetime >= x.ts_us - {8 * DAY_US} THEN f.gender END AS gender
FROM ix x ASOF LEFT JOIN user_features f ON x.user_id = f.user_id AND x.ts_us >= f.datetime""",
)
def asof_feature_join(spark, sf):
    rows = views.ix(spark, sf).select("event_id", "user_id", "ts_us")
    return history.asof_join(rows, views.user_features(spark, sf), ["user_id"], "ts_us", ["age", "gender"], ttl=8 * DAY)


LATEST_UPDATE_SQL = latest("(SELECT * FROM behavioral_updates WHERE dt BETWEEN '2024-01-25' AND '2024-01-31')", "user_id", "datetime DESC, created DESC")


@query("latest_per_user", f"SELECT user_id, top_category, datetime FROM ({LATEST_UPDATE_SQL})")
def latest_per_user(spark, sf):
    log = spark.read.parquet(dated_log(spark, sf))
    return history.latest_updates(log, views.AS_OF_DATE).select("user_id", "top_category", "datetime")


@query(
    "override_top_category",
    f"""SELECT u.user_id, coalesce(n.top_category, c.top_category, -1) AS top_category, n.top_category IS NOT NULL AS overridden
FROM users u LEFT JOIN top_cat c USING (user_id) LEFT JOIN ({LATEST_UPDATE_SQL}) n USING (user_id)""",
)
def override_top_category(spark, sf):
    top = popularity.top_category(views.ix(spark, sf).where(F.col("day") < TRAIN_DAYS), views.items(spark, sf))
    features = views.users(spark, sf).join(top, "user_id", "left").withColumn("top_category", F.coalesce("top_category", F.lit(-1)))
    updates = history.latest_updates(spark.read.parquet(dated_log(spark, sf)), views.AS_OF_DATE)
    newer = history.override(features, updates, "user_id", "top_category")
    marks = updates.select("user_id", F.lit(True).alias("hit"))
    return newer.join(marks, "user_id", "left").select("user_id", "top_category", F.coalesce("hit", F.lit(False)).alias("overridden"))


@query(
    "materialize_latest",
    f"SELECT * FROM ({latest('(SELECT * FROM user_features WHERE datetime BETWEEN 1704067200000000 AND 1705276800000000)', 'user_id', 'datetime DESC, created DESC')})",
)
def materialize_latest(spark, sf):
    start = views.ORIGIN_US
    return history.materialize(views.user_features(spark, sf), ["user_id"], start, start + 14 * DAY)


@query("online_lookup", f"""
SELECT x.event_id, x.user_id, f.age, f.gender FROM ix x
LEFT JOIN ({latest('user_features', 'user_id', 'datetime DESC, created DESC')}) f ON x.user_id = f.user_id""")
def online_lookup(spark, sf):
    newest = history.latest_per_key(views.user_features(spark, sf), ["user_id"], ["datetime", "created"])
    asked = views.ix(spark, sf).select("event_id", "user_id")
    return history.lookup_latest(asked, newest.select("user_id", "age", "gender"), ["user_id"])


# --- behaviour --------------------------------------------------------------------------------------------------


def touches(spark, sf) -> DataFrame:
    rows = views.ix(spark, sf).where(F.col("event_type").isin("click", "purchase"))
    return rows.select("event_id", "user_id", "item_id", "ts_us")


def flushes(spark, sf) -> DataFrame:
    return views.ix(spark, sf).where(F.col("event_type") == "signup").select("event_id", "user_id", "ts_us")


@query(
    "top_category_24h",
    f"""
SELECT user_id, category_l1 AS top_category FROM (
  SELECT user_id, category_l1, count(*) AS n, max(ts_us) AS last_ts FROM (
    SELECT user_id, item_id, max(ts_us) AS ts_us FROM ix WHERE ts_us BETWEEN {AS_OF_US - DAY_US} AND {AS_OF_US} GROUP BY 1, 2)
  JOIN items USING (item_id) GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last_ts DESC) = 1""",
)
def top_category_24h(spark, sf):
    return behavior.top_category_recent(views.ix(spark, sf), views.items(spark, sf), views.AS_OF_US)


@query("active_seen_set", seen_sql("touches", "flushes"))
def active_seen_set(spark, sf):
    return behavior.active_seen(touches(spark, sf), views.AS_OF_US, DAY, flushes(spark, sf))


RECENT_SQL = f"SELECT user_id, item_id, max(ts_us) AS ts_us FROM ix WHERE ts_us BETWEEN {AS_OF_US - 7 * DAY_US} AND {AS_OF_US} GROUP BY 1, 2"


@query("recent_items", RECENT_SQL)
def recent_items(spark, sf):
    return behavior.recent_items(views.ix(spark, sf), views.AS_OF_US)


@query(
    "recent_items_ranked",
    f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us DESC, CAST(item_id AS VARCHAR) DESC) AS rank FROM ({RECENT_SQL}) QUALIFY rank <= 5",
)
def recent_items_ranked(spark, sf):
    return behavior.recent_items(views.ix(spark, sf), views.AS_OF_US, n=5)


FILTER_SQL = f"""
SELECT DISTINCT x.user_id, x.item_id FROM ix x
LEFT JOIN ({seen_sql('touches', 'flushes')}) s ON x.user_id = s.user_id AND x.item_id = s.item_id WHERE s.item_id IS NULL"""


@query("filter_seen", FILTER_SQL)
def filter_seen(spark, sf):
    candidates = views.ix(spark, sf).select("user_id", "item_id").distinct()
    return behavior.filter_seen(candidates, active_seen_set(spark, sf))


@query("filter_seen_bitmap", FILTER_SQL)
def filter_seen_bitmap(spark, sf):
    candidates = views.ix(spark, sf).select("user_id", "item_id").distinct()
    return behavior.filter_seen_bitmap(candidates, behavior.seen_bitmaps(active_seen_set(spark, sf)))


BLOOM = behavior.BloomSize(64, 0.02)
BLOOM_SQL = f"""
WITH seen_now AS MATERIALIZED ({seen_sql('touches', 'flushes')}),
probes AS (SELECT DISTINCT user_id, item_id, ({h32('item_id', seed='bloom-a')} + probe * ({h32('item_id', seed='bloom-b')} | 1)) % {BLOOM.bits} AS bit
  FROM (SELECT DISTINCT user_id, item_id FROM ix), range({BLOOM.probes}) AS r(probe)),
bits AS (SELECT DISTINCT p.user_id, bit FROM probes p SEMI JOIN seen_now s ON p.user_id = s.user_id AND p.item_id = s.item_id),
passed AS (SELECT DISTINCT p.user_id, p.item_id FROM probes p ANTI JOIN bits b ON p.user_id = b.user_id AND p.bit = b.bit)
SELECT user_id, item_id FROM passed"""


@query("filter_seen_bloom", BLOOM_SQL)
def filter_seen_bloom(spark, sf):
    """The filter of fixed size per user; the SQL sets and probes the same bits."""
    candidates = views.ix(spark, sf).select("user_id", "item_id").distinct()
    return behavior.filter_seen_bloom(candidates, behavior.seen_blooms(active_seen_set(spark, sf), BLOOM), BLOOM)


@query(
    "seen_flag",
    "SELECT x.user_id, x.item_id, x.day, s.item_id IS NOT NULL AS is_seen FROM ixl x "
    "LEFT JOIN (SELECT DISTINCT user_id, item_id FROM ix) s ON x.user_id = s.user_id AND x.item_id = s.item_id",
)
def seen_flag(spark, sf):
    return behavior.seen_flag(views.ixl(spark, sf).select("user_id", "item_id", "day"), views.ix(spark, sf))


# --- splits and sets --------------------------------------------------------------------------------------------

DAY_SPLIT_SQL = "SELECT user_id, item_id, ts_us, day, CASE WHEN day < 5 THEN 'train' ELSE 'valid' END AS split FROM ixl"


@query("split_by_day", DAY_SPLIT_SQL)
def split_by_day(spark, sf):
    return splits.split_by_day(views.ixl(spark, sf), 5, 2)


FRACTION_SQL = """
SELECT user_id, item_id, ts_us, day,
  CASE WHEN row_number() OVER (ORDER BY day, ts_us, user_id, item_id) <= floor(CAST(0.7 AS DOUBLE) * (SELECT count(*) FROM ixl))
  THEN 'train' ELSE 'valid' END AS split FROM ixl"""


@query("split_70_30", FRACTION_SQL)
def split_70_30(spark, sf):
    return splits.split_fraction(views.ixl(spark, sf), ["day", "ts_us", "user_id", "item_id"])


@query("union_days", "SELECT event_id, user_id, item_id, day FROM ix")
def union_days(spark, sf):
    rows = views.ix(spark, sf).select("event_id", "user_id", "item_id", "day")
    return splits.concat_days(rows.where(F.col("day") < 10), rows.where(F.col("day").between(10, 19)), rows.where(F.col("day") >= 20))


@query("shuffle_rows", f"SELECT event_id, {h32('event_id', seed=42)} AS shuffle_key FROM ix")
def shuffle_rows(spark, sf):
    return splits.shuffle_rows(views.ix(spark, sf).select("event_id"), ["event_id"])


NEW_FROM, OLD_VALID_FROM = 26, 21
REPLAY_SQL = f"""
SELECT event_id, day, 'new' AS origin FROM (
  SELECT *, row_number() OVER (ORDER BY day, timestamp, user_id, item_id) AS p, count(*) OVER () AS c FROM ix WHERE day >= {NEW_FROM})
WHERE p <= floor(CAST(0.7 AS DOUBLE) * c)
UNION ALL SELECT event_id, day, 'old_valid' FROM ix WHERE day BETWEEN {OLD_VALID_FROM} AND {NEW_FROM - 1}
UNION ALL SELECT event_id, day, 'old_train' FROM ix WHERE day IN (
  SELECT day FROM (SELECT DISTINCT day FROM ix WHERE day < {OLD_VALID_FROM}) ORDER BY {h32('day', seed=42)}, day LIMIT 2)"""


def old_days(rows: DataFrame) -> DataFrame:
    """Replay history: the days before the new ones with their split."""
    label = F.when(F.col("day") < OLD_VALID_FROM, "train").otherwise("valid")
    return rows.where(F.col("day") < NEW_FROM).withColumn("split", label)


@query("replay_training_set", REPLAY_SQL)
def replay_training_set(spark, sf):
    rows = views.ix(spark, sf)
    new = splits.split_fraction(rows.where(F.col("day") >= NEW_FROM), SPLIT_ORDER).where(F.col("split") == "train")
    path = scratch_path(spark, "history")
    write_splits(old_days(rows), path)
    return splits.replay_stored(new, path).select("event_id", "day", "origin")


@query(
    "replay_rollover",
    f"""SELECT event_id, day, CASE WHEN day < {NEW_FROM} THEN 'train' ELSE (CASE WHEN p <= floor(CAST(0.7 AS DOUBLE) * c) THEN 'train' ELSE 'valid' END) END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY day >= {NEW_FROM} ORDER BY day, timestamp, user_id, item_id) AS p,
  count(*) OVER (PARTITION BY day >= {NEW_FROM}) AS c FROM ix)""",
)
def replay_rollover(spark, sf):
    rows = views.ix(spark, sf)
    new = splits.split_fraction(rows.where(F.col("day") >= NEW_FROM), SPLIT_ORDER)
    return splits.roll_over(old_days(rows), new).select("event_id", "day", "split")


MERGED_NEW = f"""
SELECT x.*, f.age, f.gender, coalesce(n.top_category, c.top_category, -1) AS top_category, i.price, i.category_l1, i.category_l2,
  i.item_gender, CAST(1 AS BIGINT) AS click, CAST(f.age >= 18 AS BIGINT) + CAST(f.age >= 25 AS BIGINT) + CAST(f.age >= 35 AS BIGINT)
  + CAST(f.age >= 50 AS BIGINT) + CAST(f.age >= 65 AS BIGINT) AS age_binned
FROM ix x LEFT JOIN ({latest('user_features', 'user_id', 'datetime DESC, created DESC')}) f ON x.user_id = f.user_id
LEFT JOIN (SELECT t.* FROM top_cat t SEMI JOIN user_features USING (user_id)) c ON x.user_id = c.user_id
LEFT JOIN (SELECT l.* FROM ({LATEST_UPDATE_SQL}) l) n ON x.user_id = n.user_id
LEFT JOIN items i ON x.item_id = i.item_id WHERE day >= {NEW_FROM}"""


def user_history(spark, sf) -> DataFrame:
    """Feature history with the fitted top category."""
    top = popularity.top_category(views.ix(spark, sf).where(F.col("day") < TRAIN_DAYS), views.items(spark, sf))
    return views.user_features(spark, sf).join(top, "user_id", "left")


@query(
    "merge_new_days",
    f"SELECT event_id, age, gender, top_category, price, category_l1, category_l2, item_gender, click FROM ({MERGED_NEW})",
)
def new_days(spark, sf):
    items = history.snapshot(views.items(spark, sf), F.lit(views.ORIGIN_US))
    updates = spark.read.parquet(dated_log(spark, sf))
    new = views.ix(spark, sf).where(F.col("day") >= NEW_FROM)
    rows = merge_new_days(new, user_history(spark, sf), items, updates, views.AS_OF_US, views.AS_OF_DATE)
    return rows.select("event_id", "age", "gender", "top_category", "price", "category_l1", "category_l2", "item_gender", "click")


def incremental_inputs(spark, sf, rows: DataFrame) -> tuple[DataFrame, ...]:
    """New days, feature histories, live updates and the replay history out of the merged days, stored by split and day."""
    items = history.snapshot(views.items(spark, sf), F.lit(views.ORIGIN_US))
    new = views.ix(spark, sf).where(F.col("day") >= NEW_FROM)
    updates = spark.read.parquet(dated_log(spark, sf))
    path = scratch_path(spark, "history")
    write_splits(old_days(rows.drop("split")), path)
    return new, user_history(spark, sf), items, updates, path


def raw_incremental_sets(spark, sf, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return replay_sets(*incremental_inputs(spark, sf, rows), views.AS_OF_US, views.AS_OF_DATE)


@query(
    "incremental_transform",
    transform_sql(
        f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY day, timestamp, user_id, item_id) <= floor(CAST(0.7 AS DOUBLE) * count(*) OVER ())
  THEN 'train' ELSE 'valid' END AS set_name FROM ({MERGED_NEW})
UNION ALL SELECT * EXCLUDE (split), 'train' FROM (SELECT event_id, user_id, item_id, ts_us, timestamp, day, device_type, event_type, value, age, gender,
  top_category, price, category_l1, category_l2, item_gender, click, age_binned, split FROM binned)
  WHERE day BETWEEN {OLD_VALID_FROM} AND {NEW_FROM - 1} OR day IN (
  SELECT day FROM (SELECT DISTINCT day FROM ix WHERE day < {OLD_VALID_FROM}) ORDER BY {h32('day', seed=42)}, day LIMIT 2)""",
        "m.event_id, m.set_name",
    ),
)
def incremental_transform(spark, sf):
    model, rows = fitted(spark, sf)
    train, valid = incremental(*incremental_inputs(spark, sf, rows), model, views.AS_OF_US, views.AS_OF_DATE, keep=("event_id",))
    parts = [train.withColumn("set_name", F.lit("train")), valid.withColumn("set_name", F.lit("valid"))]
    return rounded(reduce(DataFrame.unionByName, parts))


@query(
    "new_recommendations",
    "SELECT user_id, item_id FROM (SELECT DISTINCT user_id, item_id FROM ixl WHERE day >= 4 EXCEPT SELECT user_id, item_id FROM ixl WHERE day < 4)",
)
def new_recommendations(spark, sf):
    rows = views.ixl(spark, sf)
    later, earlier = rows.where(F.col("day") >= 4), rows.where(F.col("day") < 4)
    return splits.set_difference(later.select("user_id", "item_id"), earlier.select("user_id", "item_id"))
