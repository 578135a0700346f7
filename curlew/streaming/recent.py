"""What each user touched lately, in a keyed state store with event-time timeouts.

A user's state is the latest time of each item of the live set, the first and last touch per TTL-wide slot of time, and the
flushes that may still matter. What the watermark has settled is dropped at once: items before a finished pause or a
flush, slots before the set began. A timeout at the end of the set's life removes the rest, so the store holds the users
of the last TTL only. Each micro-batch emits the users it touched, as they then are, and those that expired.

Rows, states and results of many users go to the Python worker and back together, as columns of numbers: a value at a time, or a
call to the store for each user, costs several times the work itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curlew.operators.commands import parse_records, route
from curlew.sources.keyed import DELETED

STATE = (
    "user_id bigint, items array<struct<item_id: bigint, ts_us: bigint>>, "
    "slots array<struct<slot: bigint, first_us: bigint, last_us: bigint>>, flushes array<bigint>, newest_us bigint, "
    f"touched boolean, {DELETED} boolean"
)
TOUCH, RENEWAL, FLUSH = 0, 1, 2  # a renewal is a touch of no particular item; it and a flush have item 0
_KNOWN = (
    "item_id array<bigint>, ts_us array<bigint>, slot array<bigint>, first_us array<bigint>, last_us array<bigint>, "
    "flushes array<bigint>, newest_us bigint"
)
_CHANGED = f"user_id bigint, {_KNOWN}, touched boolean, {DELETED} boolean"
_NAMES = pd.Index([field.split()[0] for field in _CHANGED.split(", ")])
_INPUT = "user_id bigint, item_id bigint, ts_us bigint, kind int, mark binary"
_MARK, _WIDTH = np.dtype("<i8"), 24
# event times that pandas can hold, in microseconds: years 1678 to 2261
_EARLIEST, _LATEST = -9_214_560_000_000_000, 9_214_560_000_000_000


def marks(raw: DataFrame) -> DataFrame:
    """Touches and flushes of a command stream: ``(user_id, item_id, ts_us, kind)``. Each record is parsed once."""
    routed = route(parse_records(raw, "body").where("reason IS NULL")).where(F.col("action").isin("flush", "mark_seen"))
    is_flush = F.col("action") == "flush"
    marked = F.when(is_flush, F.array(F.lit(None).cast("bigint"))).otherwise(F.col("mark_seen"))
    rows = routed.select("user_id", "ts_us", is_flush.alias("is_flush"), F.posexplode(marked).alias("pos", "item_id"))
    kind = F.when(F.col("is_flush"), FLUSH).when(F.col("item_id").isNull(), RENEWAL).otherwise(TOUCH)
    # later positions of a list count as one microsecond later each
    return rows.select("user_id", F.coalesce("item_id", F.lit(0)).alias("item_id"), (F.col("ts_us") + F.col("pos")).alias("ts_us"), kind.alias("kind"))


def combined(rows: DataFrame, ttl: int) -> DataFrame:
    """The same state from fewer rows: in each Arrow batch the latest touch per user, item and slot, and a slot's first
    and last touch without its item where none of these tells it. A very active user sends what is distinct, not every touch. Batches
    are small pieces of a task's input, and nothing is lost if a user's rows lie in several. ``mark`` holds item, time and
    kind again, as one column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            touches = frame[frame.kind != FLUSH].assign(slot=lambda f: f.ts_us // ttl)
            latest = touches[touches.kind == TOUCH].groupby(["user_id", "item_id", "slot"], as_index=False).ts_us.max().assign(kind=TOUCH)
            by_slot = touches.groupby(["user_id", "slot"], as_index=False).ts_us
            ends = pd.concat([by_slot.min(), by_slot.max()]).assign(item_id=0, kind=RENEWAL)
            told = pd.concat([latest, ends])  # a time of these touches needs no renewal as well
            told = told[(told.kind == TOUCH) | ~told.duplicated(["user_id", "ts_us"])]
            sent = pd.concat([part[["user_id", "item_id", "ts_us", "kind"]] for part in (told, frame[frame.kind == FLUSH])])
            packed = sent[["item_id", "ts_us", "kind"]].to_numpy(dtype=_MARK).tobytes()
            yield sent.assign(mark=[packed[i : i + _WIDTH] for i in range(0, len(packed), _WIDTH)])

    timed = rows.where("ts_us IS NOT NULL").select("user_id", "item_id", "ts_us", "kind")
    return timed.mapInPandas(run, _INPUT)


def updated(ttl: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state of a user after new rows, or at the end of its life."""

    def changed(user, items: dict, slots: dict, flushes: set, newest, touched: bool, gone: bool) -> pd.DataFrame:
        row = np.empty((1, len(_NAMES)), dtype=object)  # one block, which is much quicker than a column each
        for place, value in enumerate((user, *_columns(items, slots, flushes), newest, touched, gone)):
            row[0, place] = value
        return pd.DataFrame(row, columns=_NAMES)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        item_ids, item_us, slot_ids, firsts, lasts, known_flushes, newest = state.getOption or ([], [], [], [], [], [], None)
        if state.hasTimedOut:
            state.remove()
            yield changed(key[0], {}, {}, set(), newest, False, True)
            return
        settled = state.getCurrentWatermarkMs() * 1000
        items = dict(zip(item_ids, item_us, strict=True))
        slots = {s: (first, last) for s, first, last in zip(slot_ids, firsts, lasts, strict=True)}
        flushes, touched = set(known_flushes), False
        for frame in frames:
            for item, ts, kind in np.frombuffer(b"".join(frame["mark"]), dtype=_MARK).reshape(-1, 3).tolist():
                if kind == FLUSH:
                    flushes.add(ts)
                    continue
                touched = True
                newest = ts if newest is None else max(newest, ts)
                first, last = slots.get(ts // ttl, (ts, ts))
                slots[ts // ttl] = (min(first, ts), max(last, ts))
                if kind == TOUCH:
                    items[item] = max(items.get(item, ts), ts)

        start = None
        previous = None
        for slot in sorted(slots):
            first, last = slots[slot]
            if previous is None or first - previous >= ttl:
                start = first
            previous = last
        # nothing that comes later can be earlier than the watermark
        if start is not None and start <= settled:
            slots = {s: v for s, v in slots.items() if s >= start // ttl}
            items = {i: t for i, t in items.items() if t >= start}
        final = [f for f in flushes if f <= settled and (newest is None or f < newest)]
        if final:
            items = {i: t for i, t in items.items() if t > max(final)}
            flushes = {f for f in flushes if f >= max(final)}

        ends = max([last for _, last in slots.values()] + list(flushes)) + ttl
        if ends <= settled:
            state.remove()
            yield changed(key[0], {}, {}, set(), newest, False, True)
            return
        state.update((*_columns(items, slots, flushes), newest))
        state.setTimeoutTimestamp(-(-ends // 1000))
        yield changed(key[0], items, slots, flushes, newest, touched, False)

    return update


def _columns(items: dict, slots: dict, flushes: set) -> tuple[list, ...]:
    order, held = sorted(items), sorted(slots)
    return (order, [items[i] for i in order], held, [slots[s][0] for s in held], [slots[s][1] for s in held], sorted(flushes))


def changes(rows: DataFrame, ttl: int, delay: str) -> DataFrame:
    """The stream of changed users, by the touches and flushes of ``marks``; later than ``delay`` is too late."""
    event_us = F.greatest(F.least("ts_us", F.lit(_LATEST)), F.lit(_EARLIEST))
    timed = combined(rows, ttl).select("user_id", "mark", F.timestamp_micros(event_us).alias("event_time"))
    keyed = timed.withWatermark("event_time", delay)
    changed = keyed.groupBy("user_id").applyInPandasWithState(updated(ttl), _CHANGED, _KNOWN, "update", GroupStateTimeout.EventTimeTimeout)
    items, slots = F.arrays_zip("item_id", "ts_us"), F.arrays_zip("slot", "first_us", "last_us")
    return changed.select("user_id", items.alias("items"), slots.alias("slots"), "flushes", "newest_us", "touched", DELETED)
