"""Full feature pipeline: user features, merge, fit, mask and transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.operators.joins import enrich, with_top_category
from curlew.operators.popularity import top_category
from curlew.operators.splits import clicked, mask, split_by_day
from curlew.operators.workflow import CONTEXT, ITEM, TARGET, USER, FittedWorkflow, Part, fit
from curlew.session import store

WORKFLOW: tuple[Part, ...] = (ITEM, USER, CONTEXT, TARGET)


def merged_days(interactions: DataFrame, users: DataFrame, items: DataFrame, train_days: int, valid_days: int) -> DataFrame:
    """Enriched interactions with their split. The top category comes from the training days alone."""
    top = top_category(interactions.where(F.col("day") < train_days), items)
    merged = enrich(interactions, with_top_category(users, top), items)
    return clicked(split_by_day(merged, train_days, valid_days))


def fit_workflow(train: DataFrame, items: DataFrame) -> FittedWorkflow:
    """Item statistics come from the catalog, user and context statistics from the (unmasked) training rows."""
    return fit([(ITEM, items), (USER, train), (CONTEXT, train), (TARGET, train)])


def processed_days(interactions: DataFrame, users: DataFrame, items: DataFrame, train_days: int = 9, valid_days: int = 3,
                   mask_p: float = 0.05, seed: int = 42, keep: tuple[str, ...] = ()) -> tuple[DataFrame, FittedWorkflow]:
    """Processed rows of both splits (column ``split``) and the fitted workflow.

    The merged days are stored once, since fitting and transforming both read them; only training rows are masked.
    """
    merged = store(merged_days(interactions, users, items, train_days, valid_days), "merged")
    in_train = F.col("split") == "train"
    workflow = fit_workflow(merged.where(in_train), items)
    masked = mask(merged, ["event_id"], mask_p, seed, where=in_train)
    return workflow.transform(masked, ("split", *[c for c in keep if c != "split"])), workflow


def preprocess(interactions: DataFrame, users: DataFrame, items: DataFrame, train_days: int = 9, valid_days: int = 3,
               mask_p: float = 0.05, seed: int = 42, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, FittedWorkflow]:
    """Processed training and validation rows, and the fitted workflow."""
    processed, workflow = processed_days(interactions, users, items, train_days, valid_days, mask_p, seed, keep)
    return processed.where(F.col("split") == "train"), processed.where(F.col("split") == "valid"), workflow
