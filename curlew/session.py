"""Scratch space and lineage cuts.

Everything that must outlive an executor goes to the shared folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

_test_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder of this session; a temporary one only for local sessions that name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if context.applicationId not in _test_roots:
        _test_roots[context.applicationId] = tempfile.mkdtemp(prefix="curlew-")
    return _test_roots[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder under the scratch root."""
    return f"{scratch_root(spark)}/curlew/{name}-{uuid.uuid4().hex}"


def allow_checkpoints(spark: SparkSession) -> None:
    """Name the folder for checkpoints, unless the session has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later passes read exactly the same rows."""
    allow_checkpoints(df.sparkSession)
    return df.checkpoint()


def drop_shuffles(rdd: RDD) -> None:
    """Delete the shuffle files that ``rdd`` was made from, back to what is persisted. Spark itself waits until the driver collects garbage."""
    rdd._jrdd.rdd().cleanShuffleDependencies(True)


def drop_checkpoint(rdd: RDD) -> None:
    """Delete the checkpoint of an RDD that is not needed again; one without a checkpoint is left alone."""
    file = rdd._jrdd.rdd().getCheckpointFile()
    if file.isDefined():
        path = rdd.ctx._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(rdd.ctx._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: later passes scan only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
