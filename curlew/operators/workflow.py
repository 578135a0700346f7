"""Feature workflows: fit vocabularies and moments once, apply them anywhere.

A ``Workflow`` is a list of parts (item, user, context, target), each fitted on its own table. Fitting makes one
vocabulary table ``(col, value, code, n)`` and a handful of scalar moments; applying is a chain of left joins and
expressions on the input DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curlew.functions.scalars import FALLBACK_AGE, bucketize, standardize
from curlew.functions.times import cyclic, hour_of_day, weekday
from curlew.operators.rowindex import with_row_index
from curlew.session import store

# Fixed values of the code layout: 0 is padding, 1 null, 2 out of vocabulary; fitted values start at 3.
NULL_CODE, OOV_CODE, FIRST_CODE = 1, 2, 3

# A fitted column with at most this many values is applied as an expression, with no join at all.
MAP_VALUES = 256
# With at most this many values (16 bytes each) it is broadcast.
BROADCAST_VALUES = 250_000


@dataclass(frozen=True)
class Part:
    """One sub-workflow: which columns it derives, encodes and standardises, and how its outputs are tagged."""

    name: str
    derive: dict[str, Callable[[], Column]] = field(default_factory=dict)
    categorical: tuple[str, ...] = ()
    continuous: dict[str, Callable[[], Column]] = field(default_factory=dict)
    passthrough: tuple[str, ...] = ()
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def outputs(self) -> list[str]:
        return [*self.categorical, *self.continuous, *self.passthrough]


def price_log() -> Column:
    return F.log1p(F.col("price").cast("double"))


def _cyclic(value: Callable[[Column], Column], period: int, index: int) -> Callable[[], Column]:
    return lambda: cyclic(value(F.col("timestamp")), period)[index]


ITEM = Part(
    "item",
    categorical=("item_id", "category_l1", "category_l2", "item_gender"),
    continuous={"price_log_norm": price_log},
    tags={
        "item_id": ("ITEM", "ITEM_ID", "CATEGORICAL"),
        "category_l1": ("ITEM", "CATEGORICAL"),
        "category_l2": ("ITEM", "CATEGORICAL"),
        "item_gender": ("ITEM", "CATEGORICAL"),
        "price_log_norm": ("ITEM", "CONTINUOUS"),
    },
)
USER = Part(
    "user",
    derive={"age_binned": lambda: bucketize(F.col("age"))},
    categorical=("user_id", "age_binned", "gender", "top_category"),
    continuous={"age_norm": lambda: F.col("age").cast("double")},
    tags={
        "user_id": ("USER", "USER_ID", "CATEGORICAL"),
        "age_binned": ("USER", "CATEGORICAL"),
        "gender": ("USER", "CATEGORICAL"),
        "top_category": ("USER", "CATEGORICAL"),
        "age_norm": ("USER", "CONTINUOUS"),
    },
)
TIME_COLUMNS = ("hour_sine", "hour_cosine", "day_of_week_sine", "day_of_week_cosine")
CONTEXT = Part(
    "context",
    derive={
        "hour_sine": _cyclic(hour_of_day, 24, 0),
        "hour_cosine": _cyclic(hour_of_day, 24, 1),
        "day_of_week_sine": _cyclic(weekday, 7, 0),
        "day_of_week_cosine": _cyclic(weekday, 7, 1),
    },
    categorical=("device_type",),
    passthrough=TIME_COLUMNS,
    tags={"device_type": ("CONTEXT", "CATEGORICAL"), **{c: ("CONTEXT", "CONTINUOUS") for c in TIME_COLUMNS}},
)
TARGET = Part("target", passthrough=("click",), tags={"click": ("TARGET", "BINARY_CLASSIFICATION")})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequency of every value of the given columns as ``(col, value, n)``.

    Rows become one (col, value) cell per column first, so the map side combines equal values and only those are shuffled.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("bigint").alias("value")) for c in columns])
    )
    return (
        df.select(cells.alias("cell"))
        .where(F.col("cell.value").isNotNull())
        .groupBy(F.col("cell.col").alias("col"), F.col("cell.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def assign_codes(counts: DataFrame) -> DataFrame:
    """Code the values of each column by falling frequency, smaller value first among equals."""
    indexed = with_row_index(counts, [F.col("col"), F.col("n").desc(), F.col("value")], "_position")
    first = indexed.groupBy("col").agg(F.min("_position").alias("_first"))  # one row per column
    code = F.col("_position") - F.col("_first") + FIRST_CODE
    return indexed.join(F.broadcast(first), "col").select("col", "value", code.alias("code"), "n")


def fit_vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    return assign_codes(value_counts(df, columns))


def fit_moments(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Mean and sample deviation of each named expression, in one pass, as ``(col, mean, std)``."""
    aggregates = []
    for name, expression in columns.items():
        aggregates += [F.avg(expression).alias(f"{name}__mean"), F.stddev_samp(expression).alias(f"{name}__std")]
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("col"), F.col(f"{n}__mean").alias("mean"), F.col(f"{n}__std").alias("std"))
                for n in columns
            ]
        )
    )
    return df.agg(*aggregates).select(cells.alias("m")).select("m.col", "m.mean", "m.std")


def default_age(mean: float | None) -> int:
    """Age given to anonymous users: the fitted mean cut to a whole number."""
    return int(mean) if mean is not None else FALLBACK_AGE


def encode(df: DataFrame, column: str, vocabulary: DataFrame, small: bool = False, name: str | None = None) -> DataFrame:
    """Replace a value by its code: null and unseen values get their reserved codes."""
    codes = vocabulary.where(F.col("col") == column).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    if small:
        codes = F.broadcast(codes)
    raw = F.col(column).cast("bigint")
    code = _code_or_reserved(raw, F.col("_code"))
    return df.join(codes, raw == F.col("_value"), "left").withColumn(name or column, code).drop("_value", "_code")


def _code_or_reserved(raw: Column, code: Column) -> Column:
    return F.when(raw.isNull(), F.lit(NULL_CODE)).otherwise(F.coalesce(code, F.lit(OOV_CODE))).cast("int")


def encode_by_map(column: str, codes: dict[int, int]) -> Column:
    """Code of a column with few fitted values, as an expression."""
    raw = F.col(column).cast("bigint")
    if not codes:
        return _code_or_reserved(raw, F.lit(None).cast("bigint"))
    table = F.create_map(*[F.lit(x).cast("bigint") for pair in codes.items() for x in pair])
    return _code_or_reserved(raw, F.try_element_at(table, raw))


def decode(df: DataFrame, code_col: str, vocabulary: DataFrame, column: str, name: str, compat: bool = False,
           small: bool = False) -> DataFrame:
    """Raw value of a code; a code without a value gives NULL, or 0 in compatible mode."""
    values = vocabulary.where(F.col("col") == column).select(F.col("code").alias(code_col), F.col("value").alias(name))
    decoded = df.join(F.broadcast(values) if small else values, code_col, "left")
    return decoded.withColumn(name, F.coalesce(F.col(name), F.lit(0))) if compat else decoded


@dataclass
class FittedWorkflow:
    parts: tuple[Part, ...]
    vocabulary: DataFrame
    moments: dict[str, tuple[float | None, float | None]]
    sizes: dict[str, int]
    maps: dict[str, dict[int, int]]

    def small(self, column: str) -> bool:
        """Whether the fitted values of a column are few enough to broadcast."""
        return self.sizes.get(column, 0) <= BROADCAST_VALUES

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Processed columns of all parts, after the ``keep`` columns of the input."""
        outputs = [c for part in self.parts for c in part.outputs]
        for part in self.parts:
            df = df.withColumns({name: rule() for name, rule in part.derive.items()})
        for part in self.parts:
            df = df.withColumns({name: standardize(rule(), *self.moments[name]) for name, rule in part.continuous.items()})
        # Kept input columns are set aside before encoding replaces values in place.
        df = df.withColumns({f"_keep_{c}": F.col(c) for c in keep})
        categorical = [c for part in self.parts for c in part.categorical]
        for column in categorical:
            if column not in self.maps:
                df = encode(df, column, self.vocabulary, self.small(column))
        df = df.withColumns({c: encode_by_map(c, self.maps[c]) for c in categorical if c in self.maps})
        kept = [F.col(f"_keep_{c}").alias(c) for c in keep]
        return df.select(*kept, *[self._tagged(c) for c in outputs if c not in keep])

    def _tagged(self, column: str) -> Column:
        tags = [tag for part in self.parts for tag in part.tags.get(column, ())]
        return F.col(column).alias(column, metadata={"tags": tags})

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark = self.vocabulary.sparkSession
        rows = [(c, m, s) for c, (m, s) in self.moments.items()]
        spark.createDataFrame(rows, "col string, mean double, std double").coalesce(1).write.mode("overwrite").json(
            f"{path}/moments"
        )

    @staticmethod
    def load(spark: SparkSession, path: str, parts: tuple[Part, ...]) -> FittedWorkflow:
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
        moments = spark.read.schema("col string, mean double, std double").json(f"{path}/moments")
        return _fitted(parts, vocabulary, moments)


def _fitted(parts: tuple[Part, ...], vocabulary: DataFrame, moments: DataFrame) -> FittedWorkflow:
    """Keep scalars and the codes of columns with few values at hand; the vocabulary stays a table."""
    sizes = {r.col: r.n for r in vocabulary.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [c for part in parts for c in part.categorical if sizes.get(c, 0) <= MAP_VALUES]
    maps: dict[str, dict[int, int]] = {c: {} for c in few}
    for row in vocabulary.where(F.col("col").isin(few)).collect():
        maps[row.col][row.value] = row.code
    return FittedWorkflow(parts, vocabulary, {r.col: (r.mean, r.std) for r in moments.collect()}, sizes, maps)


def fit(inputs: list[tuple[Part, DataFrame]]) -> FittedWorkflow:
    """Fit each part on its own table and compose them. Parts that share a table are fitted in one pass over it."""
    tables: dict[int, tuple[DataFrame, list[Part]]] = {}
    for part, df in inputs:
        tables.setdefault(id(df), (df, []))[1].append(part)
    counts, moments = [], []
    for df, parts in tables.values():
        derived = df.withColumns({n: rule() for p in parts for n, rule in p.derive.items() if n in p.categorical})
        categorical = [c for p in parts for c in p.categorical]
        continuous = {n: rule() for p in parts for n, rule in p.continuous.items()}
        if categorical:
            counts.append(value_counts(derived, categorical))
        if continuous:
            moments.append(fit_moments(derived, continuous))
    vocabulary = store(assign_codes(reduce(DataFrame.unionByName, counts)), "vocabulary")
    return _fitted(tuple(part for part, _ in inputs), vocabulary, reduce(DataFrame.unionByName, moments))


def select_by_tag(df: DataFrame, *tags: str) -> DataFrame:
    """The columns that carry every given tag."""
    wanted = [f.name for f in df.schema.fields if set(tags) <= set((f.metadata or {}).get("tags", ()))]
    return df.select(*wanted)


# Schemas of the feature tables; a feature view is a plain schema plus two time columns.
USER_FEATURES = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.IntegerType()),
        T.StructField("top_category", T.IntegerType()),
        T.StructField("datetime", T.LongType()),
        T.StructField("created", T.LongType()),
    ]
)
ITEM_FEATURES = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("category_l1", T.IntegerType()),
        T.StructField("category_l2", T.IntegerType()),
        T.StructField("item_gender", T.IntegerType()),
        T.StructField("datetime", T.LongType()),
        T.StructField("created", T.LongType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Read old rows under a newer schema: columns added since then are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)
