"""Micro-batch ingestion: jobs arrive as files, a batch takes what is there, failures stay with their job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from turnlake.session import shared_folder


class QueueError(RuntimeError):
    pass


def isolated(rows: DataFrame, by: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on each job's rows; a job that fails gives one row of nulls with its error, the others their results."""
    kind = rows.schema[by].dataType.simpleString()
    names = [part.split()[0].strip("`") for part in schema.split(",")]

    def safe(group: pd.DataFrame) -> pd.DataFrame:
        job = group[by].iloc[0]
        try:
            out = run(group)
            return out.assign(**{by: job, "error": None})[[by, *names, "error"]]
        except Exception as e:  # whatever a job raises belongs to that job
            return pd.DataFrame([[job, *[None] * len(names), f"{type(e).__name__}: {e}"]], columns=[by, *names, "error"])

    return rows.groupBy(by).applyInPandas(safe, f"`{by}` {kind}, {schema}, error string")


def start(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run ``work`` on every micro-batch and keep its rows below ``out``, one folder per batch.

    A batch that runs again after a failure overwrites its own folder, so results count once.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or shared_folder(stream.sparkSession, "stream"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain(spark: SparkSession, stream: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Everything now in the stream, through ``work``; ends when the source is empty."""
    out = shared_folder(spark, "queue")
    query = start(stream, work, out)
    query.awaitTermination()
    if query.exception():
        raise QueueError(str(query.exception()))
    return spark.read.parquet(out).drop("batch")
