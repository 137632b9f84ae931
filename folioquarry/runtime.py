"""Session helpers shared by all operators: table access and durable scratch."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, unless their import path or working folder has it."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    near = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(sc, "_folioquarry_shipped", False) or any(x and Path(x).resolve() == root.parent for x in near):
        return
    at = Path(tempfile.mkdtemp()) / "folioquarry.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._folioquarry_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores before costly work on each, where the input has fewer parts than that (one small file); else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it: a local folder, HDFS or an object store alike."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def put_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A file that is whole when it appears: written under a hidden name first, then renamed."""
    fs, draft = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, file_system(spark, f"{folder}/{name}")[1]):
        fs.delete(draft, False)
        raise FileExistsError(f"{folder}/{name}")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset and the session is local.

    On a cluster a folder of one machine can't hold what others must read, so
    there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioquarry-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


class Scratch:
    """Tables that cut lineage: written to the shared folder, so a lost executor costs no recomputation.

    ``keep(df)`` writes ``df`` and returns the written table.  ``drop(name)``
    removes one that nothing reads any more; the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._clear)

    def keep(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := self.paths.pop(id(df), None):
            self._remove(path)

    def _remove(self, path: str) -> None:
        fs, target = file_system(self.spark, path)
        fs.delete(target, True)

    def _clear(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the session is gone; the folder belongs to the cluster
            pass
