"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", partitions: int = 8, name: str = "turnlake") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Only a local session that has none gets a default."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints/turnlake"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``shared_root``."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Spark guesses a table's size from its compressed files, and that of exploded rows from
    the rows before; both can be a hundred times too small, and the driver holds what is
    broadcast.
    """
    return df.hint("merge")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``shared_root`` and read from there, so that nothing computes it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
