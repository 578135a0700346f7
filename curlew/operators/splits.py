"""Train / validation splits, replay sets and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curlew.functions.hashing import hash32, uniform
from curlew.functions.scalars import OOV
from curlew.operators.rowindex import with_row_index
from curlew.operators.selection import cut_at
from curlew.sources.readers import partition_values


def split_by_day(df: DataFrame, train_days: int, valid_days: int, day: str = "day") -> DataFrame:
    """Label the first ``train_days`` days train and the following ``valid_days`` valid; later days are left out."""
    label = F.when(F.col(day) < train_days, "train").otherwise("valid")
    return df.where(F.col(day) < train_days + valid_days).withColumn("split", label)


def split_fraction(df: DataFrame, order_by: list[str], frac: float = 0.7) -> DataFrame:
    """Positional split: the first ``int(frac * n)`` rows in the given order are train, the rest valid.

    Only the values at the cut are looked for, so rows are labelled where they lie. Rows that tie with the cut are told apart
    by a hash of all their columns.
    """
    n_train = int(float(frac) * df.count())
    if n_train == 0:
        return df.withColumn("split", F.lit("valid"))
    last = cut_at(df, order_by, n_train - 1)
    taken = last.equal_before + 1
    label = F.when(last.before(), "train").otherwise("valid")
    ties = df.where(last.at())
    if ties.count() == taken:
        return df.withColumn("split", F.when(last.before() | last.at(), "train").otherwise("valid"))
    placed = with_row_index(ties, [F.xxhash64(*ties.columns)], "_position")
    split = F.when(F.col("_position") < taken, "train").otherwise("valid")
    return df.where(~last.at()).withColumn("split", label).unionByName(placed.withColumn("split", split).drop("_position"))


def concat_days(*days: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, days)


def mask(df: DataFrame, keys: list[str], p: float = 0.05, seed: int = 42, where: Column | None = None) -> DataFrame:
    """Anonymise a share of rows: user, gender and category together, the device independently; age is kept.

    Rows outside ``where`` stay as they are.
    """
    eligible = F.lit(True) if where is None else where
    marked = df.withColumn("_hide_user", eligible & (uniform(*keys, seed=f"{seed}:user") < p)).withColumn(
        "_hide_device", eligible & (uniform(*keys, seed=f"{seed}:device") < p)
    )

    def hidden(column: str, flag: str) -> Column:
        return F.when(F.col(flag), F.lit(OOV)).otherwise(F.col(column)).cast(df.schema[column].dataType)

    flags = {"user_id": "_hide_user", "gender": "_hide_user", "top_category": "_hide_user", "device_type": "_hide_device"}
    return marked.select(*[hidden(c, flags[c]).alias(c) if c in flags else F.col(c) for c in df.columns])


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Repeatable shuffle: rows in the order of a hash of their keys, sorted across partitions."""
    return df.withColumn("shuffle_key", hash32(*keys, seed=seed)).orderBy("shuffle_key", *keys)


def sample_days(df: DataFrame, n: int = 2, seed: int = 42, day: str = "day") -> DataFrame:
    """All rows of at most ``n`` days, chosen by hash."""
    chosen = df.select(day).distinct().orderBy(hash32(day, seed=seed), day).limit(n)
    return df.join(F.broadcast(chosen), day, "left_semi")


def replay(new_train: DataFrame, history: DataFrame, n_days: int = 2, seed: int = 42) -> DataFrame:
    """New training rows, every validation row of the history and a few sampled training days."""
    old_valid = history.where(F.col("split") == "valid")
    old_train = sample_days(history.where(F.col("split") == "train"), n_days, seed)
    return _replayed(new_train, old_valid, old_train)


def replay_stored(new_train: DataFrame, path: str, n_days: int = 2, seed: int = 42) -> DataFrame:
    """``replay`` from a history stored by split and day: the days are known from its folders, and only the folders of the
    validation rows and of the sampled days are read."""
    spark = new_train.sparkSession
    days = [int(d) for d in partition_values(spark, f"{path}/split=train", "day")]
    listed = spark.createDataFrame([(d,) for d in days], "day int")
    chosen = [r.day for r in listed.orderBy(hash32("day", seed=seed), "day").limit(n_days).collect()]
    history = spark.read.parquet(path)
    old_train = history.where((F.col("split") == "train") & F.col("day").isin(chosen))
    return _replayed(new_train, history.where(F.col("split") == "valid"), old_train)


def _replayed(new_train: DataFrame, old_valid: DataFrame, old_train: DataFrame) -> DataFrame:
    parts = [
        new_train.withColumn("origin", F.lit("new")),
        old_valid.withColumn("origin", F.lit("old_valid")),
        old_train.withColumn("origin", F.lit("old_train")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def roll_over(history: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Next replay history: what was validation becomes training, then the new day's splits are added."""
    return history.withColumn("split", F.lit("train")).unionByName(new_rows)


def set_difference(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Distinct rows of ``current`` that ``previous`` does not have."""
    return current.subtract(previous)


def clicked(df: DataFrame) -> DataFrame:
    return df.withColumn("click", F.lit(1))

