"""Column rules shared by feature, request and display steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Age bounds, device codes, out-of-vocabulary sentinel and fallback age.
AGE_BOUNDS = (18, 25, 35, 50, 65)
DEVICE_CODES = (0, 1, 2)
OOV = -1
FALLBACK_AGE = 36


def bucketize(value: Column, bounds=AGE_BOUNDS) -> Column:
    """Number of bounds that are <= value (left-closed buckets); null stays null."""
    bucket = F.lit(0)
    for bound in bounds:
        bucket = bucket + (value >= F.lit(bound)).cast("int")
    return bucket


def standardize(value: Column, mean: float | None, std: float | None) -> Column:
    """(x - mean) / std, or x - mean when the fitted deviation is zero or unknown."""
    centred = value - F.lit(float(mean if mean is not None else 0.0))
    return centred / F.lit(float(std)) if std else centred


def fill_category(value: Column) -> Column:
    return F.coalesce(value, F.lit(OOV)).cast("int")


def keep_known_device(device: Column) -> Column:
    return F.when(device.isin(*DEVICE_CODES), device).otherwise(F.lit(OOV)).cast("int")


def context_defaults(device: Column, epoch_seconds: Column, now: int) -> tuple[Column, Column]:
    """Missing device becomes the sentinel; a missing or zero time becomes ``now``."""
    return (
        F.coalesce(device, F.lit(OOV)).cast("int"),
        F.coalesce(F.nullif(epoch_seconds, F.lit(0)), F.lit(now)).cast("bigint"),
    )


def clamp(key: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(key, low), high)


def capitalize(text: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def money(price: Column) -> Column:
    return F.format_string("$%.2f", price.cast("double"))


# Display labels of the gender codes.
GENDER_LABELS = {"M": "Men", "F": "Women", "U": "Unisex"}


def gender_label(code: Column) -> Column:
    label = F.lit("")
    for key, text in GENDER_LABELS.items():
        label = F.when(code == key, F.lit(text)).otherwise(label)
    return label
