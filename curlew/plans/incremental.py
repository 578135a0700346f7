"""Incremental run: features of the new days as known now, split, replay and the frozen workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.functions.scalars import fill_category
from curlew.operators.history import features_at, latest_updates, override
from curlew.operators.splits import clicked, replay, replay_stored, split_fraction
from curlew.operators.workflow import FittedWorkflow

SPLIT_ORDER = ["day", "timestamp", "user_id", "item_id"]


def merge_new_days(new: DataFrame, user_history: DataFrame, item_history: DataFrame, updates: DataFrame | None,
                   as_of: int, as_of_date: str) -> DataFrame:
    """New interactions with historical features, the live category winning over the historical one."""
    users = features_at(new.select("user_id"), user_history, ["user_id"], as_of)
    if updates is not None:
        users = override(users, latest_updates(updates, as_of_date), "user_id", "top_category")
    items = features_at(new.select("item_id"), item_history, ["item_id"], as_of)
    merged = new.join(users.drop("datetime", "created"), "user_id", "left").join(
        items.drop("datetime", "created"), "item_id", "left"
    )
    return clicked(merged.withColumn("top_category", fill_category(F.col("top_category"))))


def replay_sets(new: DataFrame, user_history: DataFrame, item_history: DataFrame, updates: DataFrame | None,
                history: DataFrame | str, as_of: int, as_of_date: str, frac: float = 0.7, n_days: int = 2,
                seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Replay training rows and validation rows of the new days, not yet encoded. ``history``: rows, or the path of rows
    stored by split and day."""
    # the cut needs only the new rows themselves
    split = merge_new_days(split_fraction(new, SPLIT_ORDER, frac), user_history, item_history, updates, as_of, as_of_date)
    again = replay_stored if isinstance(history, str) else replay
    train = again(split.where(F.col("split") == "train"), history, n_days, seed)
    return train, split.where(F.col("split") == "valid")


def incremental(new: DataFrame, user_history: DataFrame, item_history: DataFrame, updates: DataFrame | None,
                history: DataFrame | str, workflow: FittedWorkflow, as_of: int, as_of_date: str, frac: float = 0.7,
                n_days: int = 2, seed: int = 42, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Processed replay training set and validation set of the new days, under the already fitted workflow."""
    train, valid = replay_sets(new, user_history, item_history, updates, history, as_of, as_of_date, frac, n_days, seed)
    return workflow.transform(train, keep), workflow.transform(valid, keep)
