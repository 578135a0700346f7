"""A corpus from raw documents: quality, near duplicates, benchmark passages, secrets, mix.

Each stage works on all that the one before kept, written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curlew.llm.decontaminate import decontaminate
from curlew.llm.mixing import mix_sources
from curlew.llm.ngram_join import similar_documents
from curlew.llm.quality import score_quality
from curlew.llm.secrets import find_secrets
from curlew.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones."""
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id, null only if all are; of rows that share it, the one with the
    smallest digest of its text. Documents without links all stay, whatever their ids."""
    first = similar_documents(docs).filter(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    digests = F.struct(F.xxhash64("row.text").alias("text"), F.xxhash64("row").alias("all"))
    groups = first.filter("part IS NOT NULL").groupBy("part").agg(F.min_by("row", digests).alias("row"))
    return first.filter("part IS NULL").select("row.*").unionByName(groups.select("row.*"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("NOT contaminated").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars as it then is."""
    found = find_secrets(docs)
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.size("secrets") > 0, F.length("redacted").cast("bigint")).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix: where each stands, and its words."""
    pieces = mix_sources(docs).filter("n_words > 0")
    return pieces.select("shard", "slot", "part", "doc_id", "source", "start", "n_words", "words")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
]

#: SQL cannot express the trained stages; tests run the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
