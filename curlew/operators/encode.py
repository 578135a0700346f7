"""Text and blob encoding into vectors."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curlew.session import store

TEXT_DIM = 384
BATCH = 64
SPLIT = 1024  # texts that are split at once
# Fixed value: what separates tokens.
SEPARATORS = "[^a-z0-9]+"


def token_buckets(texts: DataFrame, dim: int = TEXT_DIM, id_col: str = "item_id", text_col: str = "product_description") -> DataFrame:
    """Token counts of whole texts, folded into ``dim`` hash buckets: ``(id, bucket, tf)``.

    Some texts are split at once and counted where they lie, and a token is hashed once per task; the sum joins the texts that share an id.
    """

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, len(frame), SPLIT):
                part = frame.slice(start, SPLIT)
                tokens = pc.split_pattern_regex(part["text"], SEPARATORS)
                row = np.repeat(np.arange(len(part)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                coded = tokens.flatten().dictionary_encode()
                bucket = np.array([_bucket(t, dim) if t else -1 for t in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
                cells, tf = np.unique(row[bucket >= 0] * dim + bucket[bucket >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([part[id_col].take(pa.array(cells // dim)), pa.array(cells % dim), pa.array(tf)], [id_col, "bucket", "tf"])

    read = texts.select(id_col, F.lower(text_col).alias("text"))
    counted = read.mapInArrow(count, T.StructType([read.schema[id_col], T.StructField("bucket", T.LongType()), T.StructField("tf", T.LongType())]))
    return counted.groupBy(id_col, "bucket").agg(F.sum("tf").alias("tf"))


def encode_text(texts: DataFrame, dim: int = TEXT_DIM, id_col: str = "item_id", text_col: str = "product_description") -> DataFrame:
    """Sparse unit vectors ``(id, bucket, weight)``: term frequency times smoothed inverse document frequency."""
    # read for the frequencies of the buckets, and once more for the weights
    counts = store(token_buckets(texts, dim, id_col, text_col), "tokens")
    n_docs = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).select(
        "bucket", (F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")
    )
    weighted = counts.join(F.broadcast(idf), "bucket").withColumn("weight", F.col("tf") * F.col("idf"))  # dim rows
    # A text has at most ``dim`` buckets, so the window holds a short group.
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "bucket", F.round(F.col("weight") / length, 6).alias("weight"))


def dense_vectors(sparse: DataFrame, dim: int, id_col: str = "item_id") -> DataFrame:
    """Dense arrays of length ``dim``; at most ``dim`` entries exist per id. An Arrow batch of ids is filled at once."""

    def fill(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            buckets, weights = frame["buckets"], frame["weights"]
            out = np.zeros((len(frame), dim), dtype=np.float32)
            row = np.repeat(np.arange(len(frame)), buckets.value_lengths().to_numpy(zero_copy_only=False))
            weight = weights.flatten()
            # a weight that is null or no weight of a bucket here stays zero
            at, value = buckets.flatten().to_numpy(zero_copy_only=False), weight.fill_null(0.0).to_numpy(zero_copy_only=False)
            inside = (at >= 0) & (at < dim)
            out[row[inside], at[inside]] = value[inside]
            ends = pa.array(np.arange(len(frame) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([frame[id_col], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [id_col, "embedding"])

    entries = F.collect_list(F.struct(F.col("bucket").cast("int").alias("bucket"), F.coalesce("weight", F.lit(0.0)).alias("weight")))
    packed = sparse.groupBy(id_col).agg(entries.alias("entries")).select(id_col, F.col("entries.bucket").alias("buckets"), F.col("entries.weight").alias("weights"))
    return packed.mapInArrow(fill, T.StructType([packed.schema[id_col], T.StructField("embedding", T.ArrayType(T.FloatType()))]))


@functools.lru_cache(maxsize=200_000)
def _bucket(token: str, dim: int) -> int:
    digest = hashlib.md5(f"{token}:bucket".encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dim


def hashed_terms(texts: list[str], dim: int = TEXT_DIM) -> np.ndarray:
    """Default encoder: unit vectors of hashed token counts. A token is hashed once per task, not once per occurrence."""
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        counted = Counter(re.split(SEPARATORS, text.lower()))
        for token, n in counted.items():
            if token:
                out[row, _bucket(token, dim)] += n
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, lengths, out=out, where=lengths > 0)


def encode_batches(rows: DataFrame, encoder: Callable[[list], np.ndarray] = hashed_terms, id_col: str = "item_id",
                   value_col: str = "product_description", batch: int = BATCH) -> DataFrame:
    """Run any batch encoder (text or blobs to a matrix) over the rows, ``batch`` values per call.

    Rows without a value get no vector, as with absent files.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = encoder(part.iloc[:, 1].tolist())
                yield pd.DataFrame({"item_id": part.iloc[:, 0].to_numpy(), "embedding": list(vectors)})

    present = rows.where(F.col(value_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item_id"), value_col)
    return present.mapInPandas(run, "item_id bigint, embedding array<double>")
