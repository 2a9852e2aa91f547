"""Versioned tables: a sink that replaces rows by key, one whole version after another.

A table is a folder. Its rows are dealt to buckets by a hash of the key. A write makes a new version folder that holds the buckets it
touches, and then a pointer: a small file that names the folder of every bucket. Readers take the pointer with the largest
number, so they see the version before until a write is whole, and then all of it. A write that fails leaves a folder that no
pointer names. The pointer also keeps the last batch of each stream that wrote, so a batch that is repeated changes nothing.

All files lie in the table's folder, which driver and executors share, and go through the Hadoop file system of its path."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_bucket"
#: Parts of a bucket that are rewritten apart from each other.
_PARTS = 16


class SnapshotTable:
    """A table of rows with a key column; several rows may have one key. schema and buckets are fixed when it is first written."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: StructType | str, buckets: int = 64):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        now = self.pointer()
        self.buckets = now["buckets"] if now else buckets

    def _pointers(self) -> list[int]:
        folder = self._path(f"{self.root}/pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def pointer(self, version: int | None = None) -> dict | None:
        """The latest pointer, or that of a version: version, buckets, folders (by bucket) and batches (by stream)."""
        held = self._pointers()
        if version is None:
            version = held[-1] if held else 0
        if version not in held:
            return None
        stream = self._fs.open(self._path(f"{self.root}/pointers/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, pointer: dict) -> None:
        """Make a pointer the latest one: written beside and renamed, so that it is there whole or not at all."""
        target, beside = self._path(f"{self.root}/pointers/{pointer['version']:012d}"), self._path(f"{self.root}/pointers/_{uuid.uuid4().hex}")
        out = self._fs.create(beside)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            self._fs.delete(beside, False)
            raise RuntimeError(f"another writer made version {pointer['version']} of {self.root}")

    def _rows(self, folders: dict[str, str], buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{f}/{_BUCKET}={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the latest version, or of the one given."""
        now = self.pointer(version)
        return self._rows(now["folders"] if now else {})

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def written(self, batch: tuple[str, int]) -> bool:
        """Whether a batch (stream, number) is in the table already."""
        now = self.pointer()
        return now is not None and now["batches"].get(batch[0], -1) >= batch[1]

    def _gathered(self, rows: DataFrame) -> DataFrame:
        return self._dealt(rows).hint("rebalance", _BUCKET)

    def replace(self, keys: DataFrame, rows: DataFrame, batch: tuple[str, int] | None = None, within: bool = False) -> bool:
        """A version without the rows of the keys (key), and with rows instead; buckets without such keys stay as they are. Rows of other
        keys are added. False, and nothing done, if the batch was written before. within: rows have no other keys, so that they are
        read for the write alone."""
        if batch is not None and self.written(batch):
            return False
        names = [f.name for f in self.schema.fields]
        gone = self._dealt((keys.select(self.key) if within else keys.select(self.key).union(rows.select(self.key))).distinct())
        touched = [str(r[0]) for r in gone.select(_BUCKET).distinct().collect()]  # at most as many as there are buckets

        def make(old: DataFrame | None) -> DataFrame:
            """Old rows, keys and new rows are shuffled once, by parts of buckets, and meet there."""
            if old is None:
                return self._gathered(rows.select(names))
            marks = gone.where(F.col(self.key).isNotNull()).select(self.key, F.lit(1).alias("_kind"))
            every = old.select(*names, F.lit(0).alias("_kind")).unionByName(marks, allowMissingColumns=True).unionByName(rows.select(*names, F.lit(2).alias("_kind")))
            every = self._dealt(every).withColumn("_part", F.pmod(F.hash(self.key), F.lit(_PARTS)))
            marked = F.max(F.col("_kind") == 1).over(W.partitionBy(_BUCKET, "_part", self.key))
            met = every.repartition(_BUCKET, "_part").withColumn("_marked", marked)
            return met.where((F.col("_kind") == 2) | ((F.col("_kind") == 0) & ~F.col("_marked"))).select(*names, _BUCKET)

        return self._write(touched, make, batch)

    def upsert(self, rows: DataFrame, order: str, batch: tuple[str, int] | None = None) -> bool:
        """A version in which each key has one row, that with the largest order; of equal ones that of rows. False if the batch was
        written before."""
        if batch is not None and self.written(batch):
            return False
        from corpusloom.operators.changes import upsert

        touched = [str(r[0]) for r in self._dealt(rows).select(_BUCKET).distinct().collect()]
        new = rows.select(*self.schema.names)
        return self._write(touched, lambda old: self._gathered(upsert(self._rows({}) if old is None else old, new, self.key, order)), batch)

    def _write(self, touched: list[str], make, batch: tuple[str, int] | None) -> bool:
        now = self.pointer() or {"version": 0, "buckets": self.buckets, "folders": {}, "batches": {}}
        version, folder = now["version"] + 1, f"v{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        folders = {b: f for b, f in now["folders"].items() if b not in touched}
        if touched:
            held = self._rows(now["folders"], touched) if now["folders"].keys() & set(touched) else None
            make(held).write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
            made = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
            folders |= {s.getPath().getName().split("=")[1]: folder for s in made if s.getPath().getName().startswith(f"{_BUCKET}=")}
        self._swap({"version": version, "buckets": self.buckets, "folders": folders, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})})
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete pointers but the latest ``keep``, and version folders that none of those names; returns the folders."""
        held = self._pointers()
        for v in held[:-keep]:
            self._fs.delete(self._path(f"{self.root}/pointers/{v:012d}"), False)
        named = {f for v in held[-keep:] for f in self.pointer(v)["folders"].values()}
        gone = [n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))) if n.startswith("v") and n not in named]
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/{n}"), True)
        return sorted(gone)
