"""Learned parts: retrieval vectors, click ranker and their refresh on new data."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, LogisticRegression
from pyspark.ml.feature import FeatureHasher, Imputer, OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curlew.operators import factors
from curlew.operators.factors import FACTORS, STEP_SIZE, STEPS, FactorModel, Layout
from curlew.operators.popularity import group_counts
from curlew.operators.rowindex import with_row_index
from curlew.operators.vectors import lookup_embeddings
from curlew.session import allow_checkpoints, store

ALPHA, REGULARIZATION = 10.0, 0.1
FOLD_ROWS = 2048
FOLD_FAN = 64
DIM = 64  # of vectors when a table has none


def fit_retrieval(interactions: DataFrame, rank: int = 64, seed: int = 42, iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    """User and item vectors from implicit feedback counts: ``(user_id, qvec)`` and ``(item_id, embedding)``."""
    counts = store(group_counts(interactions.where("user_id IS NOT NULL AND item_id IS NOT NULL"), "user_id", "item_id"), "ratings")
    users, items = _short_ids(counts, "user_id"), _short_ids(counts, "item_id")
    for ids, column in ((users, "user_id"), (items, "item_id")):
        counts = counts.withColumn(f"{column}_short", F.col(column)) if ids is None else counts.join(ids, column)
    counts = counts.select(
        F.col("user_id_short").cast("int").alias("user"), F.col("item_id_short").cast("int").alias("item"), F.col("n").cast("float").alias("rating")
    )
    # each round shuffles every vector to every block; a checkpoint lets go of the files of the rounds before it
    allow_checkpoints(interactions.sparkSession)
    model = ALS(
        rank=rank, maxIter=iterations, regParam=REGULARIZATION, alpha=ALPHA, implicitPrefs=True, seed=seed,
        userCol="user", itemCol="item", ratingCol="rating", checkpointInterval=1,
    ).fit(counts)

    def named(factors: DataFrame, ids: DataFrame | None, column: str, vector: str) -> DataFrame:
        short = factors.select(F.col("id").cast("bigint").alias(f"{column}_short"), F.col("features").alias(vector))
        full = short.withColumn(column, F.col(f"{column}_short")) if ids is None else short.join(ids, f"{column}_short")
        return full.select(column, vector)

    return named(model.userFactors, users, "user_id", "qvec"), named(model.itemFactors, items, "item_id", "embedding")


def _short_ids(counts: DataFrame, column: str) -> DataFrame | None:
    """``(column, column_short)``: a number that fits 32 bits for each id; None if all ids fit as they are."""
    low, high = counts.agg(F.min(column), F.max(column)).first()
    if low is None or (low >= -(2**31) and high < 2**31):
        return None
    return store(with_row_index(counts.select(column).distinct(), [F.col(column)], f"{column}_short"), "ids")


def fold_in_users(item_vectors: DataFrame, interactions: DataFrame, alpha: float = ALPHA, reg: float = REGULARIZATION,
                  fold_rows: int | None = None) -> DataFrame:
    """New user vectors against frozen item vectors: one regularised least-squares solve per user.

    A user of up to ``fold_rows`` (``FOLD_ROWS``) items is solved where the items meet. The equations of one with more are made in parts; their upper
    triangles are added up in a tree, ``FOLD_FAN`` at a time, so no row holds more of them, however many items the user has.
    """
    fold_rows = fold_rows or FOLD_ROWS
    dim = len(item_vectors.select("embedding").first()[0])
    gram = _gram(item_vectors, dim)
    upper = np.triu_indices(dim)
    # a user's items without a vector count for neither the parts nor the equations
    counted = store(group_counts(interactions, "user_id", "item_id"), "ratings")
    pairs = counted.join(item_vectors, "item_id")
    per_user = group_counts(counted.join(item_vectors.select("item_id"), "item_id"), "user_id")
    per_user = per_user.select("user_id", F.col("n").alias("n_items"), F.ceil(F.col("n") / fold_rows).alias("n_parts"))
    part = F.pmod(F.xxhash64("item_id"), F.col("n_parts"))
    members = F.collect_list(F.struct("n", "embedding")).alias("members")
    parts = (
        pairs.join(per_user, "user_id")
        .groupBy("user_id", "n_items", "n_parts", part.alias("part"))
        .agg(members)
        .select("user_id", "n_items", "n_parts", "part", F.col("members.n").alias("counts"), F.flatten("members.embedding").alias("vectors"))
    )

    def solved(packed: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
        left = np.zeros((dim, dim))
        left[upper] = packed
        equations = gram + left + np.triu(left, 1).T + reg * float(n) * np.eye(dim)
        return np.linalg.solve(equations, right).astype(np.float32)

    def add_up(batches):
        for batch in batches:
            rows, added, whole = [], {}, {}  # parts of a user that lie together are added up here
            for user, n_items, n_parts, number, counts, flat in zip(batch.user_id, batch.n_items, batch.n_parts, batch.part, batch.counts, batch.vectors, strict=True):
                vectors = np.asarray(flat, dtype=np.float64).reshape(len(counts), dim)
                weight = alpha * np.asarray(counts, dtype=np.float64)
                packed, right = ((vectors * weight[:, None]).T @ vectors)[upper], (1.0 + weight) @ vectors
                if n_parts == 1:
                    rows.append((user, 0, solved(packed, right, len(counts)), None, len(counts)))
                else:
                    sums, key = np.concatenate([packed, right]), (user, number // FOLD_FAN)
                    first, before, n = added.get(key, (number, 0.0, 0))
                    added[key] = (min(first, number), before + sums, n + len(counts))
                    whole[user] = whole.get(user, n_items) - len(counts)
            complete = {user: 0.0 for user, missing in whole.items() if not missing}
            for (user, _), (number, sums, n) in added.items():
                if user in complete:
                    complete[user] = complete[user] + sums
                else:
                    rows.append((user, number, None, sums, n))
            totals = dict(zip(batch.user_id, batch.n_items, strict=True))
            rows += [(user, 0, solved(s[: len(upper[0])], s[len(upper[0]) :], totals[user]), None, totals[user]) for user, s in complete.items()]
            yield pd.DataFrame(rows, columns=["user_id", "part", "qvec", "sums", "n"])

    def solve(batches):
        for batch in batches:
            qvec = [solved(np.asarray(s)[: len(upper[0])], np.asarray(s)[len(upper[0]) :], n) for s, n in zip(batch.sums, batch.n, strict=True)]
            yield pd.DataFrame({"user_id": batch.user_id, "qvec": qvec})

    made = store(parts.mapInPandas(add_up, "user_id bigint, part bigint, qvec array<float>, sums array<double>, n bigint"), "equations")
    split = made.where("qvec IS NULL").select("user_id", "part", "sums", "n")
    solved_whole = made.where("qvec IS NOT NULL").select("user_id", "qvec")
    if split.isEmpty():
        return solved_whole
    return solved_whole.unionByName(_tree(split).mapInPandas(solve, "user_id bigint, qvec array<float>"))


def _tree(split: DataFrame) -> DataFrame:
    """(user_id, sums, n) of the rows (user_id, part, sums, n), added up ``FOLD_FAN`` parts at a time."""

    def add(batches):
        for batch in batches:
            sums = [np.sum(np.stack([np.asarray(s) for s in own]), axis=0) for own in batch.sums]
            yield pd.DataFrame({"user_id": batch.user_id, "part": batch.part, "sums": sums, "n": batch.n})

    while split.agg(F.max("part")).first()[0] > 0:
        level = split.groupBy("user_id", F.floor(F.col("part") / FOLD_FAN).alias("part"))
        # in the order of the parts, so that a repeated task adds up alike
        own = F.transform(F.array_sort(F.collect_list(F.struct("part", "sums"))), lambda x: x["sums"])
        split = level.agg(own.alias("sums"), F.sum("n").alias("n")).mapInPandas(add, "user_id bigint, part bigint, sums array<double>, n bigint")
        split = store(split, "equations")
    return split.select("user_id", "sums", "n")


def _gram(item_vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products of all item vectors (dim x dim), added up per task."""

    def partial(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            vectors = np.stack(batch.embedding.to_numpy()).astype(np.float64)
            total += vectors.T @ vectors
        yield pd.DataFrame({"cell": np.arange(dim * dim), "value": total.ravel()})

    cells = item_vectors.select("embedding").mapInPandas(partial, "cell int, value double")
    summed = cells.groupBy("cell").agg(F.sum("value").alias("value")).collect()  # dim * dim numbers
    gram = np.zeros(dim * dim)
    for row in summed:
        gram[row.cell] = row.value
    return gram.reshape(dim, dim)


@dataclass
class FittedRanker:
    """A fitted click model: Spark's pipeline for its numbers, then the factorisation machine."""

    numbers: PipelineModel
    factors: FactorModel
    tables: dict[str, DataFrame]
    key: str

    @property
    def stages(self) -> list:
        return [*self.numbers.stages, self.factors]


def fit_ranker(rows: DataFrame, categorical: list[str], continuous: list[str], label: str = "label", kind: str = "fm",
               buckets: int | None = None, seed: int = 42, vectors: tuple[str, ...] = (), tables: dict[str, DataFrame] | None = None,
               key: str = "raw_item_id") -> PipelineModel | FittedRanker:
    """Click model on encoded features: a place for every code of each category (codes that training lacks share one),
    scaled numbers with the training mean for unknown ones, and the components of the ``vectors`` columns (arrays).

    The factorisation machine weighs all pairs of these: codes with codes, codes with vector components, and components of two vectors,
    which makes their dot product one of its terms. Its size follows the fitted vocabulary, so its parameters stay dealt over the cluster
    (``factors``); ``buckets`` hashes the codes to a set width instead. With ``tables`` of ``(idx, embedding)``, the rows have the
    item's ``key`` instead of its vectors, and these are looked up once for each item (zeros where it has none).
    """
    if kind == "fm" and buckets is None:
        return _fit_factors(rows, categorical, continuous, label, seed, vectors, tables or {}, key)
    if tables:
        rows, vectors = lookup_embeddings(rows, tables, key), tuple(tables)
    # Each pass of the optimiser reads the rows again, so they are stored first.
    rows = _dense(store(rows.select(label, *categorical, *continuous, *vectors), "training"), vectors)
    prepared = _numbers(continuous)
    if buckets is None:
        codes = [f"{c}_code" for c in categorical]
        coded = OneHotEncoder(inputCols=categorical, outputCols=codes, handleInvalid="keep", dropLast=False)
    else:
        codes = ["hashed"]
        coded = FeatureHasher(inputCols=categorical, categoricalCols=categorical, numFeatures=buckets, outputCol="hashed")
    joined = VectorAssembler(inputCols=[*codes, "scaled", *[f"{c}{_DENSE}" for c in vectors]], outputCol="features")
    if kind == "fm":
        model = FMClassifier(labelCol=label, factorSize=FACTORS, maxIter=STEPS, stepSize=STEP_SIZE, seed=seed)
    else:
        model = LogisticRegression(labelCol=label, maxIter=20, regParam=0.01)
    return Pipeline(stages=[*prepared, coded, joined, model]).fit(rows)


def _numbers(continuous: list[str]) -> list:
    """The stages that make ``scaled`` of the continuous columns."""
    known = [f"{c}_known" for c in continuous]
    return [
        Imputer(inputCols=continuous, outputCols=known),
        VectorAssembler(inputCols=known, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled"),
    ]


def _sides(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """The vectors of every item that has some; an item with several rows in a table has several here."""
    ids = reduce(DataFrame.union, [t.select(F.col("idx").alias(key)) for t in tables.values()]).where(F.col(key).isNotNull()).distinct()
    return lookup_embeddings(ids, tables, key)


def _fit_factors(rows: DataFrame, categorical: list[str], continuous: list[str], label: str, seed: int, vectors: tuple[str, ...],
                 tables: dict[str, DataFrame], key: str) -> FittedRanker:
    sides, carried = None, list(vectors)
    rows = rows.select(label, *categorical, *continuous, *([key] if tables else vectors))
    if tables:
        vectors, carried = tuple(tables), ["_side"]
        sides = store(_sides(tables, key).withColumn("_side", F.monotonically_increasing_id()), "sides")
        rows = rows.join(sides.select(key, "_side"), key, "left").drop(key)
    rows = store(rows, "training")
    told = rows.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in categorical]).first()
    one = (sides if tables else rows).select(*[F.size(v).alias(v) for v in vectors]).first() if vectors else ()
    widths = tuple(one) if one else tuple(DIM for _ in vectors)
    layout = Layout({c: (-1 if told[c] is None else int(told[c])) + 2 for c in categorical}, len(continuous), widths)
    numbers = Pipeline(stages=_numbers(continuous)).fit(rows)
    ready = numbers.transform(rows).select(
        F.col(label).cast("double").alias("label"), F.array(*[layout.place(c) for c in categorical]).alias("codes"),
        vector_to_array("scaled").alias("numbers"), *carried,
    )
    fitted = factors.fit(ready, layout, vectors, sides, told.n, seed)
    return FittedRanker(numbers, FactorModel(layout, fitted, vectors), tables, key)


_DENSE = "_dense"


def _dense(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    return rows.withColumns({f"{c}{_DENSE}": array_to_vector(F.col(c).cast("array<double>")) for c in columns})


def predict(model: PipelineModel | FittedRanker, rows: DataFrame, score: str = "score") -> DataFrame:
    """Probability of a click for every row."""
    columns = rows.columns
    if isinstance(model, FittedRanker):
        scaled, sums = model.numbers.transform(rows).withColumn("_numbers", vector_to_array("scaled")), None
        if model.tables:
            # an item's vectors are summed up once, whatever rows name it
            per_item = _sides(model.tables, model.key).select(model.key, model.factors.vector_sums(*model.tables).alias("_sums"))
            scaled, sums = scaled.join(store(per_item, "sides"), model.key, "left"), "_sums"
        elif model.factors.vectors:
            scaled, sums = scaled.withColumn("_sums", model.factors.vector_sums(*model.factors.vectors)), "_sums"
        return model.factors.score(scaled, "_numbers", sums).select(*columns, F.round("_score", 6).alias(score))
    inputs = [c for stage in model.stages if isinstance(stage, VectorAssembler) for c in stage.getInputCols()]
    scored = model.transform(_dense(rows, [c.removesuffix(_DENSE) for c in inputs if c.endswith(_DENSE)]))
    return scored.select(*columns, F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias(score))
