"""What users touched lately: recent items, live top category and the seen set."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curlew.functions.hashing import hash32
from curlew.functions.times import DAY, whole

WEEK_TTL = 7 * DAY


def last_touches(touches: DataFrame) -> DataFrame:
    """One row per (user, item) at its latest time: a re-interaction moves the item instead of counting twice."""
    return touches.groupBy("user_id", "item_id").agg(F.max("ts_us").alias("ts_us"))


def recent_items(touches: DataFrame, as_of: int, window: int = WEEK_TTL, n: int | None = None) -> DataFrame:
    """Items touched inside the window that ends at ``as_of`` (cutoff included), with the newest ``n`` ranked."""
    recent = last_touches(touches.where(F.col("ts_us").between(as_of - window, as_of)))
    if n is None:
        return recent
    order = Window.partitionBy("user_id").orderBy(F.col("ts_us").desc(), F.col("item_id").cast("string").desc())
    return recent.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def majority_category(touches: DataFrame, items: DataFrame) -> DataFrame:
    """Dominant category of each user's distinct items; the category touched last wins a tie."""
    known = touches.join(
        items.where(F.col("category_l1").isNotNull()).select("item_id", "category_l1"), "item_id"
    )
    newest = F.max(F.struct(F.col("ts_us").alias("last_ts"), F.col("item_id").cast("string").alias("last_item")))
    counted = known.groupBy("user_id", "category_l1").agg(F.count(F.lit(1)).alias("n"), newest.alias("newest"))
    best = F.max_by("category_l1", F.struct("n", "newest"))
    return counted.groupBy("user_id").agg(best.cast("int").alias("top_category"))


def top_category_recent(touches: DataFrame, items: DataFrame, as_of: int, window: int = DAY) -> DataFrame:
    """Live top category at ``as_of``; users without a categorised recent item are absent (no write)."""
    return majority_category(recent_items(touches, as_of, window), items)


def seen_windows(touches: DataFrame, ttl: int = WEEK_TTL) -> DataFrame:
    """First and last touch per user and TTL-wide slot of time.

    Two touches in one slot are less than a TTL apart, so a slot never spans a gap. The summary merges with min and
    max, and its size depends on the time span only.
    """
    return touches.groupBy("user_id", whole(F.col("ts_us"), ttl).alias("slot")).agg(
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


def last_sessions(slots: DataFrame, ttl: int = WEEK_TTL) -> DataFrame:
    """Start and end of each user's newest seen set; a pause of ``ttl`` or more starts a new one."""
    per_user = Window.partitionBy("user_id").orderBy("slot")
    gap = F.col("first_us") - F.lag("last_us").over(per_user)
    starts = F.when(gap.isNull() | (gap >= ttl), F.col("first_us"))
    return (
        slots.withColumn("started", starts)
        .groupBy("user_id")
        .agg(F.max("started").alias("start_us"), F.max("last_us").alias("end_us"))
    )


def active_from_state(touched: DataFrame, slots: DataFrame, flushes: DataFrame | None, as_of: int,
                      ttl: int = WEEK_TTL) -> DataFrame:
    """Live seen set from the mergeable state: latest touch per (user, item), slots and latest flush per user.

    A flush needs no trace in the slots: only touches after it count, and slots before it cannot shorten the set that
    those touches form.
    """
    sessions = last_sessions(slots, ttl).where(F.col("end_us") > as_of - ttl).select("user_id", "start_us")
    alive = touched.join(sessions, "user_id").where(F.col("ts_us") >= F.col("start_us")).drop("start_us")
    if flushes is None:
        return alive
    last = flushes.groupBy("user_id").agg(F.max("ts_us").alias("flush_us"))
    kept = F.col("flush_us").isNull() | (F.col("ts_us") > F.col("flush_us"))
    return alive.join(last, "user_id", "left").where(kept).drop("flush_us")


def active_seen(touches: DataFrame, as_of: int, ttl: int = WEEK_TTL, flushes: DataFrame | None = None) -> DataFrame:
    """Distinct (user, item) pairs of the seen sets that are alive at ``as_of``.

    Every write renews the whole set for ``ttl``; the set dies after a pause that long, and a flush empties it.
    """
    past = touches.where(F.col("ts_us") <= as_of)
    if flushes is not None:
        flushes = flushes.where(F.col("ts_us") <= as_of)
    return active_from_state(last_touches(past), seen_windows(past, ttl), flushes, as_of, ttl).select("user_id", "item_id")


def filter_seen(candidates: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Drop candidates the user has seen; without a seen table the candidates pass unchanged."""
    if seen is None:
        return candidates
    return candidates.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def seen_bitmaps(seen: DataFrame) -> DataFrame:
    """Compact membership: one fixed-size bitmap per user and range of item ids. Merges with ``bitmap_or_agg``."""
    return seen.groupBy("user_id", F.bitmap_bucket_number("item_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("item_id")).alias("bitmap")
    )


def filter_seen_bitmap(candidates: DataFrame, bitmaps: DataFrame | None) -> DataFrame:
    """The same answer as ``filter_seen`` from the bitmaps."""
    if bitmaps is None:
        return candidates
    bit = F.expr(
        "getbit(CAST(conv(hex(substring(bitmap, CAST(bitmap_bit_position(item_id) DIV 8 AS INT) + 1, 1)), 16, 10) "
        "AS INT), CAST(bitmap_bit_position(item_id) % 8 AS INT))"
    )
    keyed = candidates.withColumn("bucket", F.bitmap_bucket_number("item_id"))
    flagged = keyed.join(bitmaps, ["user_id", "bucket"], "left").where(F.col("bitmap").isNull() | (bit == 0))
    return flagged.select(*candidates.columns)


@dataclass(frozen=True)
class BloomSize:
    """Size of the filters for about ``items`` per user and a share of at most ``error`` wrongly taken for seen."""

    items: int
    error: float

    @property
    def bits(self) -> int:
        return 64 * math.ceil(-self.items * math.log(self.error) / math.log(2) ** 2 / 64)

    @property
    def probes(self) -> int:
        return max(1, round(self.bits / self.items * math.log(2)))

    def places(self, item: str) -> Column:
        """The bits of an item, as an array."""
        first, step = hash32(item, seed="bloom-a"), hash32(item, seed="bloom-b").bitwiseOR(F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(self.probes - 1)), lambda i: F.pmod(first + i * step, F.lit(self.bits)))


def seen_blooms(seen: DataFrame, size: BloomSize) -> DataFrame:
    """A Bloom filter per user: ``bloom``, ``bits / 64`` whole numbers, however many items the user has seen.

    Bits are gathered by word in each task first, so a user with very many items sends that many words per task. Filters of one size
    merge with ``merge_blooms``.
    """
    placed = seen.where(F.col("item_id").isNotNull()).select("user_id", F.explode(size.places("item_id")).alias("bit"))
    mask = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    words = placed.groupBy("user_id", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask"))
    held = words.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("held"))
    every = F.sequence(F.lit(0), F.lit(size.bits // 64 - 1))
    return held.select("user_id", F.transform(every, lambda w: F.coalesce(F.element_at("held", w), F.lit(0).cast("bigint"))).alias("bloom"))


def merge_blooms(*parts: DataFrame) -> DataFrame:
    """One filter per user that has the bits of all, as after seeing what each part has seen."""
    words = reduce(DataFrame.unionByName, parts).select("user_id", F.posexplode("bloom").alias("word", "mask"))
    merged = words.groupBy("user_id", "word").agg(F.bit_or("mask").alias("mask"))
    return merged.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("held")).select(
        "user_id", F.col("held.mask").alias("bloom")
    )


def filter_seen_bloom(candidates: DataFrame, blooms: DataFrame | None, size: BloomSize) -> DataFrame:
    """Candidates that the user's filter does not hold: none that was seen, and all others but a few."""
    if blooms is None:
        return candidates
    bit_set = lambda b: F.expr("bloom")[F.floor(b / 64).cast("int")].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % 64).cast("int"))) != 0
    held = F.forall(size.places("item_id"), bit_set)
    joined = candidates.join(blooms, "user_id", "left")
    return joined.where(F.col("bloom").isNull() | F.col("item_id").isNull() | ~held).select(*candidates.columns)


def seen_flag(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Mark each (user, item) row as already seen or not."""
    known = seen.select("user_id", "item_id").distinct().withColumn("_known", F.lit(True))
    return (
        rows.join(known, ["user_id", "item_id"], "left")
        .withColumn("is_seen", F.col("_known").isNotNull())
        .drop("_known")
    )
