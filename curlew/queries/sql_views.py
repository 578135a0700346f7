"""The logical tables in DuckDB SQL, written independently of the Spark views."""

from __future__ import annotations

DAY_US = 86_400_000_000
AS_OF_US = 1_706_659_200_000_000


def h32(*keys: str, seed) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(keys)}, '{seed}')), 1, 8) AS BIGINT)"


def uniform(*keys: str, seed) -> str:
    return f"((CAST({h32(*keys, seed=seed)} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


def latest(table: str, key: str, order: str) -> str:
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"


def seen_sql(touches: str, flushes: str, as_of: int = AS_OF_US, ttl: int = DAY_US) -> str:
    return f"""
SELECT DISTINCT s.user_id, s.item_id FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts_us) AS sess FROM (
    SELECT t.*, CASE WHEN lag(t.ts_us) OVER w IS NULL OR t.ts_us - lag(t.ts_us) OVER w >= {ttl} THEN 1 ELSE 0 END AS brk
    FROM {touches} t LEFT JOIN (SELECT user_id, max(ts_us) AS f FROM {flushes} GROUP BY 1) x USING (user_id)
    WHERE x.f IS NULL OR t.ts_us > x.f
    WINDOW w AS (PARTITION BY t.user_id ORDER BY t.ts_us)) a) s
JOIN (SELECT user_id, max(ts_us) AS last_us FROM {touches} GROUP BY 1) l USING (user_id)
WHERE l.last_us > {as_of - ttl}
QUALIFY s.sess = max(s.sess) OVER (PARTITION BY s.user_id)"""


SQL_VIEWS: dict[str, str] = {
    "ix": """
SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, epoch_us(ts) AS ts_us,
  epoch_us(ts) // 1000000 AS timestamp,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
  CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS BIGINT) AS device_type,
  event_type, value
FROM events""",
    "ixl": """
SELECT o_custkey AS user_id, l_partkey AS item_id, epoch_us(l_shipdate) AS ts_us,
  CAST(year(o_orderdate) - 1995 AS BIGINT) AS day
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "users": """
SELECT c_custkey AS user_id, CAST(15 + (c_custkey * 37) % 60 AS BIGINT) AS age, CAST(c_nationkey % 2 AS BIGINT) AS gender
FROM customer""",
    "items": """
SELECT p_partkey AS item_id, p_retailprice AS price,
  CAST(list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) - 1 AS BIGINT) AS category_l1,
  CAST(substr(p_brand, 7) AS BIGINT) AS category_l2, CAST(p_size % 3 AS BIGINT) AS item_gender
FROM part""",
    "catalog": """
SELECT md5('item-' || p_partkey) AS ITEM_ID, p_name AS PRODUCT_NAME,
  p_name || ', ' || lower(p_type) || ', size ' || p_size AS PRODUCT_DESCRIPTION, p_type AS CATEGORY_L1,
  p_brand AS CATEGORY_L2, CASE p_size % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'M' ELSE 'F' END AS GENDER,
  CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END AS PROMOTED,
  CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) AS PRICE
FROM part""",
    "id_mapping": "SELECT DISTINCT md5('item-' || l_partkey) AS item_id, l_partkey AS encoded FROM lineitem",
    "item_metadata": """
SELECT m.encoded AS item_id, c.ITEM_ID AS item_uuid, PRODUCT_NAME AS title, PRODUCT_DESCRIPTION AS description,
  CATEGORY_L1 AS category_l1, CATEGORY_L2 AS category_l2, GENDER AS gender, PROMOTED AS promoted, PRICE AS price,
  'https://shop-images.s3.amazonaws.com/items/' || c.ITEM_ID || '.jpg' AS image_url
FROM catalog c JOIN id_mapping m ON c.ITEM_ID = m.item_id""",
    "user_features": f"""
SELECT c_custkey AS user_id, CAST(15 + (c_custkey * 37) % 60 + s AS BIGINT) AS age,
  CAST(CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_nationkey % 2 END AS BIGINT) AS gender,
  1704067200000000 + d * {DAY_US} AS datetime, 1704067200000000 + d * {DAY_US} + 3600000000 AS created
FROM customer, (VALUES (0, 0), (1, 9), (2, 19)) AS snap(s, d) WHERE c_acctbal >= 0""",
    "behavioral_updates": """
SELECT user_id, category_l1 AS top_category, ts_us AS datetime, ts_us AS created,
  CAST(CAST(make_timestamp(ts_us) AS DATE) AS VARCHAR) AS dt
FROM ix JOIN items USING (item_id) WHERE event_type = 'purchase'""",
    "emb": "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    "touches": "SELECT event_id, user_id, item_id, ts_us FROM ix WHERE event_type IN ('click', 'purchase')",
    "flushes": "SELECT event_id, user_id, ts_us FROM ix WHERE event_type = 'signup'",
    "requests": "SELECT event_id AS request_id, user_id, device_type, timestamp FROM ix WHERE event_type = 'view'",
    "cand": f"""
SELECT request_id, item_id, round({uniform('request_id', 'item_id', seed=7)}, 6) AS score
FROM (SELECT DISTINCT user_id AS request_id, item_id FROM ixl)""",
    "commands": """
SELECT event_id, ts_us, CASE event_type
  WHEN 'click' THEN '{"user_id": ' || user_id || ', "mark_seen": [' || item_id || ']}'
  WHEN 'purchase' THEN '{"user_id": ' || user_id || ', "mark_seen": [' || item_id || ', ' || (item_id + 1) % 100 || ']}'
  WHEN 'view' THEN '{"user_id": ' || user_id || CASE item_id % 5 WHEN 0 THEN ', "device_type": "1"'
    WHEN 1 THEN ', "device_type": 1.7' WHEN 2 THEN ', "device_type": "1.0"'
    WHEN 3 THEN ', "device_type": ' || item_id % 7 ELSE '' END || ', "timestamp": ' || timestamp || '}'
  WHEN 'signup' THEN '{"user_id": ' || user_id || ', "flush": true}'
  ELSE CASE WHEN event_id % 2 = 0 THEN '{"device_type": 1}' ELSE '{not json' END END AS body
FROM ix""",
    "parsed": """
SELECT event_id, ts_us, body, CASE WHEN NOT json_valid(body) THEN 'invalid_json'
    WHEN json_extract(body, '$.user_id') IS NULL THEN 'missing_user_id' END AS reason,
  CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.user_id') AS BIGINT) END AS user_id,
  CASE WHEN json_valid(body) THEN CAST(json_extract_string(body, '$.timestamp') AS BIGINT) END AS timestamp,
  CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.flush') = 'true', false) ELSE false END AS flush,
  CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.mark_seen') AS BIGINT[]) END AS mark_seen,
  coalesce(CASE WHEN NOT json_valid(body) THEN NULL
    WHEN json_type(body, '$.device_type') = 'VARCHAR'
      THEN CASE WHEN regexp_full_match(json_extract_string(body, '$.device_type'), '[+-]?[0-9]+')
                AND CAST(json_extract_string(body, '$.device_type') AS BIGINT) IN (0, 1, 2)
                THEN CAST(json_extract_string(body, '$.device_type') AS BIGINT) END
    WHEN CAST(trunc(CAST(json_extract_string(body, '$.device_type') AS DOUBLE)) AS BIGINT) IN (0, 1, 2)
      THEN CAST(trunc(CAST(json_extract_string(body, '$.device_type') AS DOUBLE)) AS BIGINT) END, -1) AS device_type
FROM commands""",
    "routed": """
SELECT *, CASE WHEN flush THEN 'flush' WHEN len(mark_seen) > 0 THEN 'mark_seen' WHEN mark_seen IS NOT NULL THEN 'noop'
  ELSE 'recommend' END AS action
FROM parsed WHERE reason IS NULL""",
    "marked": """
SELECT event_id, user_id, unnest(mark_seen) AS item_id, ts_us + generate_subscripts(mark_seen, 1) - 1 AS ts_us
FROM routed WHERE action = 'mark_seen'""",
    "flushed": "SELECT event_id, user_id, ts_us FROM routed WHERE action = 'flush'",
    "top_cat": """
SELECT user_id, category_l1 AS top_category FROM (
  SELECT user_id, category_l1, count(*) AS n FROM ix JOIN items USING (item_id) WHERE day < 21 GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category_l1) = 1""",
    "merged": """
SELECT x.*, u.age, u.gender, coalesce(c.top_category, -1) AS top_category, i.price, i.category_l1, i.category_l2,
  i.item_gender, CAST(1 AS BIGINT) AS click, CASE WHEN day < 21 THEN 'train' ELSE 'valid' END AS split
FROM ix x LEFT JOIN users u USING (user_id) LEFT JOIN top_cat c USING (user_id) LEFT JOIN items i USING (item_id)""",
    "binned": """
SELECT *, CAST(age >= 18 AS BIGINT) + CAST(age >= 25 AS BIGINT) + CAST(age >= 35 AS BIGINT) + CAST(age >= 50 AS BIGINT)
  + CAST(age >= 65 AS BIGINT) AS age_binned FROM merged""",
    "vocab": """
SELECT col, value, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) + 2 AS code FROM (
  SELECT col, value, count(*) AS n FROM (
    SELECT 'item_id' AS col, item_id AS value FROM items UNION ALL SELECT 'category_l1', category_l1 FROM items
    UNION ALL SELECT 'category_l2', category_l2 FROM items UNION ALL SELECT 'item_gender', item_gender FROM items
    UNION ALL SELECT 'user_id', user_id FROM binned WHERE split = 'train'
    UNION ALL SELECT 'age_binned', age_binned FROM binned WHERE split = 'train'
    UNION ALL SELECT 'gender', gender FROM binned WHERE split = 'train'
    UNION ALL SELECT 'top_category', top_category FROM binned WHERE split = 'train'
    UNION ALL SELECT 'device_type', device_type FROM binned WHERE split = 'train') WHERE value IS NOT NULL GROUP BY 1, 2)""",
    "moments": """
SELECT 'price_log_norm' AS col, avg(ln(1 + price)) AS mean, stddev_samp(ln(1 + price)) AS std FROM items
UNION ALL SELECT 'age_norm', avg(age), stddev_samp(age) FROM merged WHERE split = 'train'""",
}


def code_of(alias: str, column: str, table: str = "m") -> str:
    """Code expression for a vocabulary join under ``alias``."""
    return f"CASE WHEN {table}.{column} IS NULL THEN 1 ELSE coalesce({alias}.code, 2) END"


def transform_sql(source: str, keep: str) -> str:
    """The processed table of an enriched source."""
    columns = ["item_id", "category_l1", "category_l2", "item_gender", "user_id", "age_binned", "gender", "top_category", "device_type"]
    joins = "\n".join(
        f"LEFT JOIN (SELECT value, code FROM vocab WHERE col = '{c}') v_{c} ON m.{c} = v_{c}.value" for c in columns
    )
    codes = ", ".join(f"{code_of(f'v_{c}', c)} AS {c}" for c in columns)
    hour, weekday = "((m.timestamp % 86400) // 3600)", "((m.timestamp // 86400 + 3) % 7)"
    return f"""
SELECT {keep}, {codes},
  round((ln(1 + m.price) - (SELECT mean FROM moments WHERE col = 'price_log_norm'))
    / (SELECT std FROM moments WHERE col = 'price_log_norm'), 6) AS price_log_norm,
  round((m.age - (SELECT mean FROM moments WHERE col = 'age_norm')) / (SELECT std FROM moments WHERE col = 'age_norm'), 6) AS age_norm,
  round(sin(2 * pi() * {hour} / 24.0), 6) + 0.0 AS hour_sine, round(cos(2 * pi() * {hour} / 24.0), 6) + 0.0 AS hour_cosine,
  round(sin(2 * pi() * {weekday} / 7.0), 6) + 0.0 AS day_of_week_sine, round(cos(2 * pi() * {weekday} / 7.0), 6) + 0.0 AS day_of_week_cosine,
  m.click
FROM ({source}) m
{joins}"""
