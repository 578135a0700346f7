"""A keyed table that is updated in small batches while others read it.

Rows are dealt to hash buckets by their key. A batch writes one small file set for the buckets it touches and nothing
else. A bucket's pieces are merged into one when they become too many or too large against the rest, so a row is
rewritten about as often as its bucket doubles, and readers merge a bounded number of pieces. Each batch ends with a
manifest that names the pieces of every bucket; it appears under its final name at once, so readers see the table
before or after a batch and never between. Pieces that no kept manifest names are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curlew.operators.history import latest_per_key
from curlew.sources.sinks import gathered

BUCKETS = 64
PIECES = 4  # of a bucket that readers merge
GROWTH = 0.5  # newer rows against those of the oldest piece, from which on a bucket is merged
KEPT = 2  # versions whose readers are not disturbed
DELETED, BUCKET, BATCH = "_deleted", "_bucket", "_version"


@dataclass
class Manifest:
    """``buckets``: per bucket its pieces as (folder, rows), oldest first; ``applied``: the last batch of each writer."""

    version: int = 0
    schema: str | None = None
    buckets: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f"{folder}/{BUCKET}={bucket}" for bucket, pieces in self.buckets.items() for folder, _ in pieces}


class KeyedTable:
    """The newest row (by ``order``, of equals the later batch's) of each key. One writer at a time; readers need none."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.n_buckets = spark, path, keys, order, buckets
        self._java_path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._java_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests

    def _versions(self) -> list[int]:
        folder = self._java_path(f"{self.path}/manifest")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version, or the given one; an empty one before the first batch."""
        versions = self._versions()
        if not versions:
            return Manifest()
        name = f"{self.path}/manifest/{versions[-1] if version is None else version}.json"
        told = json.loads(self.spark.read.text(name, wholetext=True).first()[0])
        return Manifest(told["version"], told["schema"], {b: [tuple(p) for p in ps] for b, ps in told["buckets"].items()}, told["applied"])

    def _publish(self, manifest: Manifest) -> None:
        final = self._java_path(f"{self.path}/manifest/{manifest.version}.json")
        draft = self._java_path(f"{self.path}/manifest/.{manifest.version}.draft")
        stream = self._files.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest.__dict__).encode()))
        finally:
            stream.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise RuntimeError(f"version {manifest.version} of {self.path} was written by someone else")

    # --- writing

    def upsert(self, updates: DataFrame, batch_id: int | None = None, writer: str = "main") -> Manifest:
        """Apply a batch. Rows with a true ``_deleted`` remove their key. With a ``batch_id``, a batch that ``writer`` has
        applied already, or one before it, changes nothing, so a repeated delivery does no harm.

        All batches have the same columns, or leave out some of the first one's. A removed key leaves a mark until its
        bucket is merged; an older row that arrives after that counts as new."""
        current = self.manifest()
        if batch_id is not None and current.applied.get(writer, -1) >= batch_id:
            return current
        version = current.version + 1
        rows = updates if DELETED in updates.columns else updates.withColumn(DELETED, F.lit(False))
        if current.schema:
            known = T.StructType.fromJson(json.loads(current.schema))
            if unknown := set(rows.columns) - set(known.names):
                raise ValueError(f"columns the table does not have: {sorted(unknown)}")
            rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in known])
        schema = current.schema or rows.schema.json()
        buckets = {b: list(pieces) for b, pieces in current.buckets.items()}

        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")
        newest = latest_per_key(rows, self.keys, self.order).withColumn(BATCH, F.lit(version)).withColumn(BUCKET, bucket)
        for b, piece in self._written(newest, f"{self.path}/data/{version}").items():
            buckets.setdefault(b, []).append(piece)
        due = [b for b, pieces in buckets.items() if self._is_due(pieces) and self._is_of(pieces[-1][0], version)]
        if due:
            merged = self._merged(Manifest(version, schema, {b: buckets[b] for b in due})).where(~F.col(DELETED)).withColumn(BUCKET, bucket)
            pieces = self._written(merged, f"{self.path}/data/{version}-merged")
            for b in due:
                buckets[b] = [pieces[b]] if b in pieces else []
        applied = current.applied | ({writer: batch_id} if batch_id is not None else {})
        fresh = Manifest(version, schema, {b: pieces for b, pieces in buckets.items() if pieces}, applied)
        self._publish(fresh)
        self._clean(fresh)
        return fresh

    def _is_due(self, pieces: list[tuple[str, int]]) -> bool:
        newer = sum(rows for _, rows in pieces[1:])
        return len(pieces) > PIECES or (len(pieces) > 1 and newer > GROWTH * pieces[0][1])

    def _written(self, rows: DataFrame, folder: str) -> dict[str, tuple[str, int]]:
        """Write rows by bucket; per bucket its piece. A few numbers per bucket come back."""
        gathered(rows, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        if not any(s.isDirectory() for s in self._files.listStatus(self._java_path(folder))):
            return {}
        stored = self.spark.read.schema(f"{BATCH} bigint, {BUCKET} int").parquet(folder)
        return {str(r[BUCKET]): (folder, r.n) for r in stored.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}

    def _clean(self, fresh: Manifest) -> None:
        """Delete manifests but the newest few, and the pieces that none of these names."""
        for version in self._versions()[:-KEPT]:
            self._files.delete(self._java_path(f"{self.path}/manifest/{version}.json"), False)
        named = fresh.folders().union(*[self.manifest(v).folders() for v in self._versions()[:-1]])
        data = self._java_path(f"{self.path}/data")
        for folder in self._files.listStatus(data):
            place = f"{self.path}/data/{folder.getPath().getName()}"
            held = [s for s in self._files.listStatus(folder.getPath()) if s.isDirectory()]
            gone = [s for s in held if f"{place}/{s.getPath().getName()}" not in named]
            if len(gone) == len(held):
                self._files.delete(folder.getPath(), True)
            else:
                for status in gone:
                    self._files.delete(status.getPath(), True)

    # --- reading

    def _pieces(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        return self.spark.read.schema(stored).parquet(*folders)

    def _merged(self, manifest: Manifest) -> DataFrame:
        """All live rows and marks of deletion: buckets of one piece as they are, others merged."""
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        single = [f"{ps[0][0]}/{BUCKET}={b}" for b, ps in manifest.buckets.items() if len(ps) == 1]
        several = [f"{folder}/{BUCKET}={b}" for b, ps in manifest.buckets.items() if len(ps) > 1 for folder, _ in ps]
        parts = []
        if single:
            parts.append(self._pieces(schema, single))
        if several:
            parts.append(latest_per_key(self._pieces(schema, several), self.keys, [*self.order, BATCH]))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def changed(self, manifest: Manifest) -> DataFrame:
        """The rows that the batch of this version brought, unless newer ones of the same keys were there before it."""
        touched = {b: ps for b, ps in manifest.buckets.items() if self._is_of(ps[-1][0], manifest.version)}
        # without an order, what came last is the newest
        rows = self._merged(Manifest(manifest.version, manifest.schema, touched if self.order else {b: ps[-1:] for b, ps in touched.items()}))
        return rows.where((F.col(BATCH) == manifest.version) & ~F.col(DELETED)).drop(DELETED, BATCH)

    @staticmethod
    def _is_of(folder: str, version: int) -> bool:
        return folder.rsplit("/", 1)[1].removesuffix("-merged") == str(version)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the newest version, or of one that is still kept; None before the first batch."""
        manifest = self.manifest(version)
        if manifest.schema is None:
            return None
        return self._merged(manifest).where(~F.col(DELETED)).drop(DELETED, BATCH)
