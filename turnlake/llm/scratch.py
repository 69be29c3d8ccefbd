"""Shared scratch storage: tables that cut lineage and outlive a lost executor.

Every intermediate table goes below the folder the session names in
``spark.checkpoint.dir``.  Only a local session without that setting (tests, notebooks)
gets a default; on a cluster it must be set, so nothing is ever written to a
machine-local folder there.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "/tmp/checkpoints/turnlake"


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = DEFAULT_DIR
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") + "/turnlake-tables"


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


_owner: str | None = None
_owned: dict[str, list[Scratch]] = {}


@contextlib.contextmanager
def owner(name: str):
    """Scratch made inside belongs to ``name``, for ``drop_owned``."""
    global _owner
    was, _owner = _owner, name
    try:
        yield
    finally:
        _owner = was


def drop_owned(name: str) -> None:
    """Free what ``name`` owns; only right once all results that read it are written."""
    for scratch in _owned.pop(name, []):
        scratch.drop_all()


class Scratch:
    """The tables one operator call writes; ``drop`` frees one as soon as it is consumed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        if _owner:
            _owned.setdefault(_owner, []).append(self)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written table."""
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                fs, jpath = _fs(self.spark, path)
                fs.delete(jpath, True)

    def drop_but(self, *names: str) -> None:
        """Free all tables that aren't in ``names``."""
        self.drop(*[name for name in self.paths if name not in names])

    def drop_all(self) -> None:
        self.drop(*list(self.paths))


def release(spark: SparkSession) -> None:
    """Delete every scratch table of the shared folder (call when no lazy result reads one)."""
    fs, jpath = _fs(spark, scratch_root(spark))
    fs.delete(jpath, True)
