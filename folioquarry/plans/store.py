"""The library as versioned Parquet parts: a write adds parts, then a new pointer names the current ones.

Documents and chunks have one part per shelf and bucket (a hash of the document
id), shelves are one part.  A write replaces the parts it is given and leaves
all others where they are, so an update costs what it touches.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..runtime import file_system, put_text

TABLES = {"shelves": schema.SHELVES, "documents": schema.DOCUMENTS, "chunks": schema.CHUNKS}
#: The column whose hash deals a table's rows to buckets.
OWNER = {"documents": "id", "chunks": "document_id"}
ORDER = {"documents": ["doc_date"], "chunks": ["document_id", "chunk_index"]}


class Store:
    """Readers see one version throughout; a write that fails leaves the pointer where it was.

    ``path`` is any folder Spark can write to.  Pointers are numbered files, and
    a number can be taken only once, so of two writers that start from the same
    version the later one fails.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._at = lambda name: file_system(spark, f"{self.path}/{name}")[1]
        self._fs, _ = file_system(spark, self.path)
        self._fs.mkdirs(self._at("pointers"))

    def _version(self) -> int:
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(self._at("pointers")) if f.getPath().getName().isdigit()), default=0)

    def _pointer(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """Per table the folder of each part."""
        version = self._version() if version is None else version
        if not version:
            return {}
        stream = self._fs.open(self._at(f"pointers/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, name: str, shelf: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A whole table, or only the parts of a shelf, or of some of its buckets."""
        parts = self._pointer().get(name, {})
        keep = [f for key, f in sorted(parts.items()) if (shelf is None or key.rpartition("|")[0] == shelf) and (buckets is None or int(key.rpartition("|")[2]) in buckets)]
        return self._load(name, keep)

    def write_shelves(self, df: DataFrame) -> None:
        version = self._version()
        folder = f"shelves/{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(f"{self.path}/{folder}")
        self._flip(version, self._pointer(version) | {"shelves": {"": folder}})

    def write(self, shelf: str, buckets: list[int], tables: dict[str, DataFrame]) -> None:
        """``tables`` hold all rows of these buckets of a shelf; all become current at once."""
        version = self._version()
        pointer = self._pointer(version)
        for name, df in tables.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            dealt = df.withColumn("bucket", self.bucket(OWNER[name]))
            dealt.repartition(max(1, len(buckets)), "bucket").sortWithinPartitions("bucket", *ORDER[name]).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            parts = dict(pointer.get(name, {}))
            for b in buckets:
                parts.pop(f"{shelf}|{b}", None)
                if self._fs.exists(self._at(f"{folder}/bucket={b}")):
                    parts[f"{shelf}|{b}"] = f"{folder}/bucket={b}"
            pointer[name] = parts
        self._flip(version, pointer)

    def _flip(self, version: int, pointer: dict) -> None:
        if self._version() > version:
            raise RuntimeError("the store was changed by another writer")
        try:
            put_text(self.spark, f"{self.path}/pointers", f"{version + 1:012d}", json.dumps(pointer))
        except FileExistsError:
            raise RuntimeError("the store was changed by another writer") from None

    def vacuum(self, keep_seconds: float = 3600.0) -> int:
        """Removes parts no current pointer names and pointers before it, once older than ``keep_seconds``; returns how many."""
        version = self._version()
        used = {f.split("/bucket=")[0] for parts in self._pointer(version).values() for f in parts.values()}
        limit = (time.time() - keep_seconds) * 1000
        gone = 0
        for name in TABLES:
            if self._fs.exists(self._at(name)):
                for f in self._fs.listStatus(self._at(name)):
                    if f"{name}/{f.getPath().getName()}" not in used and f.getModificationTime() <= limit:
                        gone += self._fs.delete(f.getPath(), True)
        for f in self._fs.listStatus(self._at("pointers")):
            if f.getPath().getName() != f"{version:012d}" and f.getModificationTime() <= limit:
                self._fs.delete(f.getPath(), False)
        return gone
