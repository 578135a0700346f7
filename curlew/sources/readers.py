"""Scans of the interaction, log, catalog and blob inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curlew.session import path_exists

CATALOG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("ITEM_ID", "PRODUCT_NAME", "PRODUCT_DESCRIPTION", "CATEGORY_L1",
                                                "CATEGORY_L2", "GENDER", "PROMOTED", "PRICE")]
)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly work on a scan of few files; a scan with enough partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_days(spark: SparkSession, table: str, first: int, n: int) -> DataFrame:
    """``n`` days from ``first`` of a table partitioned by ``day``; other partitions are not listed for reading."""
    return spark.read.parquet(table).where(F.col("day").between(first, first + n - 1))


def read_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All files that match, with the name of the file each row came from; no match is an error."""
    return spark.read.parquet(pattern).withColumn("file_name", F.col("_metadata.file_name"))


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "emptyValue": ""}
    return spark.read.options(**options).schema(CATALOG_SCHEMA).csv(path)


def read_blobs(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Binary files laid out as ``<key>=<value>/...`` or ``<value>.<extension>`` attached to the wanted keys; keys without
    a file stay, with no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder, stem = F.regexp_extract("path", f"{key}=([^/]+)/", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    named = files.select(
        F.coalesce(F.nullif(folder, F.lit("")), stem).alias(key), F.col("length").alias("n_bytes"), "content"
    )
    return keys.select(key).distinct().join(named, key, "left")


def require_input(df: DataFrame, what: str) -> DataFrame:
    """Fail early on an empty input."""
    if df.isEmpty():
        raise FileNotFoundError(f"no rows in {what}")
    return df


def compute_or_load(spark: SparkSession, path: str, compute) -> DataFrame:
    """Read a derived table if a finished copy exists, otherwise compute and store it first."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stream_parquet(spark: SparkSession, folder: str, file_glob: str, files_per_batch: int | None = None) -> DataFrame:
    """File-source stream over the matching files of a folder, with the schema of the files there now."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def partition_values(spark: SparkSession, path: str, name: str) -> list[str]:
    """The values of a partition column by the folders there are, without reading a file."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    return sorted(f.removeprefix(f"{name}=") for f in found if f.startswith(f"{name}="))
