"""A factorisation machine whose parameters are dealt over the cluster.

It takes the steps of Spark's ``FMClassifier`` (log loss over all rows, AdamW, the same first numbers from the same seed), which keeps
all parameters in the driver and in every task. Here they lie in blocks, and so do the rows. In each step a block of rows gets the
parameters that its rows name, and the blocks of parameters get back the gradients of these. What rows share, like the vectors of an item,
is summed up once for each block, not once for each row.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curlew.session import allow_checkpoints, drop_checkpoint, drop_shuffles, store

FACTORS, STEPS, STEP_SIZE, START_DEVIATION = 8, 15, 0.05, 0.01
ROW_BLOCK, PARAMETER_BLOCK = 131_072, 16_384
SMALL = 4096  # columns with up to this many codes are scored without a join


@dataclass(frozen=True)
class Layout:
    """Places of the features: the codes of each column (the last one for codes that training lacks), numbers, vector components,
    and one place more for the intercept."""

    sizes: dict[str, int]
    n_numbers: int
    widths: tuple[int, ...]

    @property
    def numbers_at(self) -> int:
        return sum(self.sizes.values())

    @property
    def n_features(self) -> int:
        return self.numbers_at + self.n_numbers + sum(self.widths)

    def place(self, column: str) -> Column:
        names = list(self.sizes)
        first, size = sum(self.sizes[c] for c in names[: names.index(column)]), self.sizes[column]
        known = F.col(column).between(0, size - 2)
        return F.when(known, F.col(column) + first).otherwise(first + size - 1).cast("int")


def _sums(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Per row of ``x`` its factor sums, their squares' sum and its linear term."""
    v = theta[:, :FACTORS]
    return np.column_stack([x @ v, (x * x) @ (v * v).sum(axis=1), x @ theta[:, FACTORS]])


def _of_codes(theta: np.ndarray) -> np.ndarray:
    """The same for features of value 1."""
    v = theta[:, :FACTORS]
    return np.column_stack([v, (v * v).sum(axis=1), theta[:, FACTORS]])


def _raw(sums: np.ndarray, intercept: float) -> np.ndarray:
    s = sums[:, :FACTORS]
    return intercept + sums[:, FACTORS + 1] + 0.5 * ((s * s).sum(axis=1) - sums[:, FACTORS])


# --- blocks of rows


@dataclass
class _Rows:
    """``places``: of each row's codes in ``needed``, the features of the block in order, which end with numbers, vector components
    and intercept; ``vector``: the place of each row's vectors in ``vectors``, or None if each has its own."""

    label: np.ndarray
    places: np.ndarray
    needed: np.ndarray
    numbers: np.ndarray
    vectors: np.ndarray
    vector: np.ndarray | None

    def gradients(self, theta: np.ndarray) -> np.ndarray:
        n_codes, k = self.places.shape[1], self.numbers.shape[1]
        own = len(self.needed) - 1 - k - self.vectors.shape[1]  # codes before, the rest after it
        of_codes, of_numbers, of_vectors = theta[:own], theta[own : own + k], theta[own + k : -1]
        coded, vectors = _of_codes(of_codes), self.vectors.astype(np.float64)
        sums = _sums(self.numbers, of_numbers)
        for c in range(n_codes):
            sums += coded[self.places[:, c]]
        shared = _sums(vectors, of_vectors)
        sums += shared if self.vector is None else shared[self.vector]
        off = 1.0 / (1.0 + np.exp(-_raw(sums, theta[-1, FACTORS]))) - self.label
        # the derivative by a factor is off * (x * sum - factor * x * x)
        weighted = np.column_stack([off[:, None] * sums[:, :FACTORS], off])
        out = np.zeros_like(theta)
        for c in range(n_codes):
            for f in range(FACTORS + 1):
                out[:own, f] += np.bincount(self.places[:, c], weights=weighted[:, f], minlength=own)
        out[:own, :FACTORS] -= of_codes[:, :FACTORS] * out[:own, FACTORS:]
        shared = weighted if self.vector is None else _added_up(self.vector, weighted, len(vectors))
        for at, x, w, part in ((own, self.numbers, weighted, of_numbers), (own + k, vectors, shared, of_vectors)):
            place = slice(at, at + x.shape[1])
            out[place] = x.T @ w
            out[place, :FACTORS] -= part[:, :FACTORS] * ((x * x).T @ w[:, FACTORS])[:, None]
        out[-1, FACTORS] = off.sum()
        return out


def _added_up(to: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(to, weights=values[:, f], minlength=n) for f in range(values.shape[1])])


def _matrix(column: pd.Series, width: int, dtype=np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype) if len(column) and width else np.zeros((len(column), width), dtype)


def _row_blocks(rows: DataFrame, layout: Layout, vectors: tuple[str, ...], sides: DataFrame | None, n_blocks: int) -> RDD:
    """``(block, _Rows)`` of the rows ``(label, codes, numbers)`` and either their vectors or ``_side``, the row of ``sides`` that has them."""
    shared = sides is not None
    spread = sorted(range(len(layout.sizes)), key=lambda i: -list(layout.sizes.values())[i])
    dealt = rows.repartitionByRange(n_blocks, *[F.col("codes")[i] for i in spread], F.xxhash64("numbers"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for f in frames:
            parts.append(
                (f.label.to_numpy(np.float64), _matrix(f.codes, len(layout.sizes), np.int32), _matrix(f.numbers, layout.n_numbers),
                 f["_side"].fillna(-1).to_numpy(np.int64) if shared else
                 np.column_stack([np.zeros((len(f), 0)), *[_matrix(f[c], w) for c, w in zip(vectors, layout.widths, strict=True)]]))
            )
        if parts:
            yield pd.DataFrame({"payload": [pickle.dumps([np.concatenate(x) for x in zip(*parts, strict=True)])]})

    packed = store(dealt.mapInPandas(pack, "payload binary").withColumn("block", F.spark_partition_id()), "blocks")
    always = np.arange(layout.numbers_at, layout.n_features + 1)

    def found(label, codes, numbers, last, held) -> _Rows:
        own, places = np.unique(codes, return_inverse=True)
        places, vector = places.reshape(codes.shape).astype(np.int32), None
        if shared:
            named, vector = np.unique(last, return_inverse=True)
            last = np.zeros((len(named), sum(layout.widths)), np.float32)  # no side, no vector
            for side, values in held:
                last[np.searchsorted(named, side)] = values
        return _Rows(label, places, np.concatenate([own, always]), numbers, last, vector)

    blocks = packed.rdd.map(lambda r: (r.block, pickle.loads(r.payload))).partitionBy(n_blocks)
    if not shared:
        return blocks.mapValues(lambda parts: found(*parts, ()))

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, payload in zip(frame.block, frame.payload, strict=True):
                yield pd.DataFrame({"_side": np.unique(pickle.loads(payload)[3])}).assign(block=block)

    asked = packed.mapInPandas(named, "_side bigint, block int")
    flat = asked.join(sides, "_side").select("block", "_side", F.concat(*[F.col(c).cast("array<float>") for c in vectors]).alias("values"))

    def together(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:  # one small matrix per Arrow batch and block, so that rows do not travel one by one
            block, side = frame["block"].to_numpy(zero_copy_only=False), frame["_side"].to_numpy(zero_copy_only=False)
            values = frame["values"].flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
            each = np.unique(block)
            yield pa.RecordBatch.from_pydict({"block": pa.array(each, pa.int32()), "payload": [pickle.dumps((side[block == b], values[block == b])) for b in each]})

    held = flat.repartition(n_blocks, "block").mapInArrow(together, "block int, payload binary").rdd.map(lambda r: (r.block, pickle.loads(r.payload)))
    return blocks.cogroup(held.partitionBy(n_blocks)).flatMapValues(lambda both: [found(*parts, list(both[1])) for parts in both[0]])


# --- first numbers


_JAVA = (0x5DEECE66D, 0xB, (1 << 48) - 1)
DRAWS = 65_536


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms that lead from a state of java.util.Random to its next ``n``."""
    a, c = np.array([_JAVA[0]], dtype=np.uint64), np.array([_JAVA[1]], dtype=np.uint64)
    while len(a) < n:
        a, c = np.concatenate([a, a * a[-1]]), np.concatenate([c, a * c[-1] + c])
    return a[:n], c[:n]


def _normals(seed: int, chunk: int) -> np.ndarray:
    """The pairs of normal numbers that the ``chunk``-th ``DRAWS`` draws of java.util.Random make, one pair per row."""
    a, c, mask = pow(_JAVA[0], 4 * DRAWS * chunk, 1 << 48), 0, _JAVA[2]
    step, term, left = _JAVA[0], _JAVA[1], 4 * DRAWS * chunk
    while left:  # the term of so many steps, by doubling
        if left & 1:
            c = (step * c + term) & mask
        term, step, left = (step * term + term) & mask, (step * step) & mask, left >> 1
    start = (a * ((seed ^ _JAVA[0]) & mask) + c) & mask
    factor, more = _powers(4 * DRAWS)
    state = ((factor * np.uint64(start) + more) & np.uint64(mask)).reshape(-1, 2, 2)
    high, low = state[:, :, 0] >> np.uint64(22), state[:, :, 1] >> np.uint64(21)
    pair = 2.0 * ((high << np.uint64(27)) + low).astype(np.float64) * 2.0**-53 - 1.0
    s = (pair**2).sum(axis=1)
    inside = (s < 1) & (s > 0)
    return pair[inside] * np.sqrt(-2.0 * np.log(s[inside]) / s[inside])[:, None]


def _start(spark: SparkSession, layout: Layout, seed: int, n_blocks: int) -> RDD:
    """``(block, (parameters, first moments, second moments))``; each feature has its factors and its weight in a row."""
    context, pairs = spark.sparkContext, layout.n_features * FACTORS // 2
    counts: list[int] = []
    while sum(counts) < pairs:  # one number per chunk of draws comes back
        more = math.ceil((pairs - sum(counts)) / DRAWS * 1.3) + 1
        counts += context.parallelize(range(len(counts), len(counts) + more), min(more, 4 * context.defaultParallelism)).map(lambda i: len(_normals(seed, i))).collect()
    ends = np.cumsum(counts)

    def block(p: int):
        n = min(PARAMETER_BLOCK, layout.n_features + 1 - p * PARAMETER_BLOCK)
        theta = np.zeros((n, FACTORS + 1))
        begin = p * PARAMETER_BLOCK * FACTORS // 2
        drawn = min(n, layout.n_features - p * PARAMETER_BLOCK)  # the intercept begins at 0
        end = begin + drawn * FACTORS // 2
        if drawn:
            chunks = range(int(np.searchsorted(ends, begin, side="right")), int(np.searchsorted(ends, end - 1, side="right")) + 1)
            before = int(ends[chunks[0]]) - counts[chunks[0]]
            numbers = np.concatenate([_normals(seed, i) for i in chunks])[begin - before : end - before]
            theta[:drawn, :FACTORS] = numbers.reshape(drawn, FACTORS) * START_DEVIATION
        return p, (theta, np.zeros_like(theta), np.zeros_like(theta))

    return context.parallelize(range(n_blocks), n_blocks).map(block).partitionBy(n_blocks)


# --- fitting


def fit(rows: DataFrame, layout: Layout, vectors: tuple[str, ...], sides: DataFrame | None, n_rows: int, seed: int) -> DataFrame:
    """``(feature, theta)``, the factors and the weight of each feature, by full gradients over all ``n_rows`` rows."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil(n_rows / ROW_BLOCK), min(cores, n_rows // 2048))
    n_held = math.ceil((layout.n_features + 1) / PARAMETER_BLOCK)
    blocks = _row_blocks(rows, layout, vectors, sides, n_blocks).persist(StorageLevel.MEMORY_AND_DISK)

    def cut(needed: np.ndarray) -> Iterator[tuple[int, slice]]:
        ends = np.searchsorted(needed, np.arange(n_held + 1) * PARAMETER_BLOCK)
        return ((p, slice(a, b)) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a)

    def asked(block) -> Iterator:
        b, own = block
        return ((p, (b, own.needed[part] - p * PARAMETER_BLOCK)) for p, part in cut(own.needed))

    links = blocks.flatMap(asked).groupByKey(n_held).mapValues(lambda x: sorted(x, key=lambda y: y[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def sent(both) -> Iterator:
        p, (held, to) = both
        return ((b, (p, theta[at])) for theta, _, _ in held for one in to for b, at in one)

    def answered(both) -> Iterator:
        b, (own, got) = both
        theta = np.concatenate([t for _, t in sorted(got, key=lambda x: x[0])])
        for block in own:
            out = block.gradients(theta)
            yield from ((p, (b, out[part])) for p, part in cut(block.needed))

    def stepped(step: int):
        def run(three):
            ((theta, first, second),), links, got = three
            places, gradient = dict(pair for one in links for pair in one), np.zeros_like(theta)
            for b, part in sorted(got, key=lambda x: x[0]):
                gradient[places[b]] += part
            gradient /= n_rows
            first, second = 0.9 * first + (1 - 0.9) * gradient, 0.999 * second + (1 - 0.999) * gradient * gradient
            moved = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            return theta - STEP_SIZE * moved, first, second

        return run

    allow_checkpoints(spark)
    held = _start(spark, layout, seed, n_held).persist(StorageLevel.MEMORY_AND_DISK)
    for step in range(1, STEPS + 1):
        messages = held.cogroup(links, numPartitions=n_held).flatMap(sent).partitionBy(n_blocks)
        gradients = blocks.cogroup(messages, numPartitions=n_blocks).flatMap(answered).partitionBy(n_held)
        met = held.groupWith(links, gradients)
        fresh = met.mapValues(stepped(step)).persist(StorageLevel.MEMORY_AND_DISK)
        # a step sends every block its parameters; once its outcome is stored, its files and those of the state before it can go
        fresh.checkpoint()
        fresh.count()
        drop_shuffles(met)
        drop_checkpoint(held)
        held.unpersist()
        held = fresh

    def listed(block) -> Iterator:
        p, (theta, _, _) = block
        return ((p * PARAMETER_BLOCK + i, t) for i, t in enumerate(theta.tolist()))

    fitted = store(spark.createDataFrame(held.flatMap(listed), "feature bigint, theta array<double>"), "parameters")
    drop_checkpoint(held)
    for rdd in (links, blocks):
        drop_shuffles(rdd)
    for rdd in (held, links, blocks):
        rdd.unpersist()
    return fitted


# --- scoring


def _flat(column: pa.Array, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class FactorModel:
    layout: Layout
    parameters: DataFrame
    vectors: tuple[str, ...]

    def __post_init__(self):
        """The parameters of numbers, vectors, intercept and of columns with few codes; those of the others stay a table."""
        self.numFeatures = self.layout.n_features
        self._first, at = {}, 0
        for column, size in self.layout.sizes.items():
            self._first[column], at = at, at + size
        self._wide = [c for c, n in self.layout.sizes.items() if n > SMALL]
        feature, own = F.col("feature"), F.col("feature") >= self.layout.numbers_at
        for c, n in self.layout.sizes.items():
            if c not in self._wide:
                own = own | feature.between(self._first[c], self._first[c] + n - 1)
        known = self.parameters.where(own).orderBy("feature").collect()
        self._features = np.array([r.feature for r in known])
        self._theta = np.array([r.theta for r in known])

    def _part(self, first: int, n: int) -> np.ndarray:
        at = int(np.searchsorted(self._features, first))
        return self._theta[at : at + n]

    def vector_sums(self, *columns: str) -> Column:
        """What an item's vectors add to the sums of a row."""
        theta = self._part(self.layout.numbers_at + self.layout.n_numbers, sum(self.layout.widths))

        @F.arrow_udf("array<double>")
        def run(values: pa.Array) -> pa.Array:
            return pa.array(list(_sums(_flat(values), theta))) if len(values) else pa.array([], pa.list_(pa.float64()))

        return run(F.concat(*[F.col(c).cast("array<double>") for c in columns]))

    def score(self, rows: DataFrame, numbers: str, sums: str | None) -> DataFrame:
        """``rows`` with ``_score``: the probability of a click by codes, scaled ``numbers`` and the ``sums`` of vectors (null is none)."""
        few = [c for c in self.layout.sizes if c not in self._wide]
        for i, c in enumerate(self._wide):
            first = self._first[c]
            codes = self.parameters.where(F.col("feature").between(first, first + self.layout.sizes[c] - 1))
            rows = rows.withColumn(f"_at{i}", self.layout.place(c).cast("bigint")).join(codes.select(F.col("feature").alias(f"_at{i}"), F.col("theta").alias(f"_theta{i}")), f"_at{i}")
        coded = [_of_codes(self._part(self._first[c], self.layout.sizes[c])) for c in few]
        firsts = [self._first[c] for c in few]
        of_numbers, intercept = self._part(self.layout.numbers_at, self.layout.n_numbers), float(self._theta[-1, FACTORS])
        zero = F.array_repeat(F.lit(0.0), FACTORS + 2)

        @F.arrow_udf("double")
        def run(places: pa.Array, numbers: pa.Array, vectors: pa.Array, wide: pa.Array) -> pa.Array:
            if not len(places):
                return pa.array([], pa.float64())
            sums = _sums(_flat(numbers), of_numbers) + _flat(vectors)
            at = _flat(places, np.int64)
            for i, table in enumerate(coded):
                sums += table[at[:, i] - firsts[i]]
            if len(wide.flatten()):
                theta = _flat(wide).reshape(len(at), -1, FACTORS + 1)
                for i in range(theta.shape[1]):
                    sums += _of_codes(theta[:, i])
            return pa.array(1.0 / (1.0 + np.exp(-_raw(sums, intercept))))

        places = F.array(*[self.layout.place(c) for c in few]) if few else F.array().cast("array<int>")
        wide = F.concat(*[F.col(f"_theta{i}") for i in range(len(self._wide))]) if self._wide else F.array().cast("array<double>")
        return rows.withColumn("_score", run(places, F.col(numbers), F.coalesce(F.col(sums), zero) if sums else zero, wide))
