"""Request and command records: parse JSON, validate, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curlew.functions.scalars import OOV, keep_known_device

DEFAULT_TOP_K = 10


_FIELDS = ("user_id", "device_type", "timestamp", "top_k", "flush", "mark_seen")
_SCHEMA = ", ".join([*[f"{c} VARIANT" for c in _FIELDS], "_corrupt STRING"])


def _text(field: str) -> Column:
    """JSON text of a parsed field: quoted for strings; null when it is absent or JSON null."""
    return F.nullif(F.to_json(F.col(f"_body.{field}")), F.lit("null")).alias(f"_{field}")


def _whole_number(field: str) -> Column:
    """Numbers are cut, integer strings are parsed, booleans count as 0 and 1; anything else is null."""
    text = F.col(f"_{field}")
    inner = F.trim(F.expr(f"substring(_{field}, 2, length(_{field}) - 2)"))
    return (
        F.when(text.startswith('"'), inner.try_cast("bigint"))
        .when(text.isin("true", "false"), (text == "true").cast("bigint"))
        .otherwise(F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint")))
    )


def _truthy(field: str) -> Column:
    """Empty strings, lists and objects, zero, false and null are false; everything else is true."""
    text = F.col(f"_{field}")
    empty = text.isin("false", '""', "[]", "{}") | (F.coalesce(text.try_cast("double"), F.lit(1.0)) == 0)
    return F.coalesce(~empty, F.lit(False))


def parse_records(raw: DataFrame, body: str) -> DataFrame:
    """Typed command fields of every record, with the reason where it has to be rejected."""
    text = F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit("{}")).otherwise(F.col(body))
    parsed = F.from_json(text, _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    is_object = text.rlike(r"^\s*\{") & text.rlike(r"\}\s*$") & F.col("_body._corrupt").isNull()
    fields = raw.withColumn("_body", parsed).select(
        *raw.columns,
        is_object.alias("_is_object"),
        *[_text(c) for c in _FIELDS],
        F.try_variant_get(F.col("_body.mark_seen"), "$", "array<bigint>").alias("mark_seen"),
        # An explicit null differs from an absent field for this one only.
        (F.col("_body.top_k").isNotNull()).alias("_has_top_k"),
    )
    typed = fields.select(
        *raw.columns, "_is_object", "_has_top_k", "_mark_seen", (F.col("_user_id").isNotNull()).alias("_has_user"),
        _whole_number("user_id").alias("user_id"), _whole_number("device_type").alias("device_type"),
        _whole_number("timestamp").alias("timestamp"), _whole_number("top_k").alias("top_k"),
        _truthy("flush").alias("flush"), "mark_seen",
    )
    reason = (
        F.when(~F.col("_is_object"), F.lit("invalid_json"))
        .when(F.col("_has_top_k") & F.col("top_k").isNull(), F.lit("bad_top_k"))
        .when(~F.col("_has_user"), F.lit("missing_user_id"))
        .when(F.col("user_id").isNull(), F.lit("bad_user_id"))
        .when(F.col("_mark_seen").isNotNull() & F.col("mark_seen").isNull(), F.lit("bad_mark_seen"))
    )
    result = F.struct(
        reason.alias("reason"),
        "user_id",
        F.coalesce(keep_known_device(F.col("device_type")), F.lit(OOV)).alias("device_type"),
        "timestamp",
        F.coalesce("top_k", F.lit(DEFAULT_TOP_K)).cast("int").alias("top_k"),
        "flush",
        "mark_seen",
    )
    # A generated row is parsed once: filters on the outcome cannot be pushed below it and repeat the parsing.
    return typed.withColumn("_result", result).select(*raw.columns, F.inline(F.array("_result")))


def parse_commands(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Typed commands, and the rejected records with the reason."""
    parsed = parse_records(raw, body)
    return parsed.where(F.col("reason").isNull()).drop("reason"), parsed.where(F.col("reason").isNotNull()).select(
        *raw.columns, "reason"
    )


def route(commands: DataFrame) -> DataFrame:
    """Action of each command: flush wins over mark_seen, and an empty list does nothing."""
    action = (
        F.when(F.col("flush"), F.lit("flush"))
        .when(F.size("mark_seen") > 0, F.lit("mark_seen"))
        .when(F.col("mark_seen").isNotNull(), F.lit("noop"))
        .otherwise(F.lit("recommend"))
    )
    return commands.withColumn("action", action)


def touches_of(routed: DataFrame) -> DataFrame:
    """One touch per marked item; later positions of a list count as one microsecond later each."""
    marked = routed.where(F.col("action") == "mark_seen")
    return marked.select("event_id", "user_id", F.col("ts_us").alias("_base"), F.posexplode("mark_seen").alias("pos", "item_id")).select(
        "event_id", "user_id", "item_id", (F.col("_base") + F.col("pos")).alias("ts_us")
    )


def flushes_of(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("action") == "flush").select("event_id", "user_id", "ts_us")


def queue_messages(routed: DataFrame) -> DataFrame:
    """Message body sent to the feature step for every flush or non-empty mark."""
    flush = F.to_json(F.struct("user_id", F.lit(True).alias("flush")))
    body = F.when(F.col("action") == "flush", flush).otherwise(F.to_json(F.struct("user_id")))
    return routed.where(F.col("action").isin("flush", "mark_seen")).select("event_id", body.alias("message"))
