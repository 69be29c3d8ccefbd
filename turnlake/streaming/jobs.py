"""Jobs of a stream whose parts arrive over many micro-batches.

A recording comes as windows, in any order and some of them twice.  Spark's keyed state
holds which have come; a recording is a job as soon as all are there.  Each job leaves
one terminal row, ``complete`` or ``failed``, and later parts of it change nothing.  State
lives in the stream's checkpoint, so a query that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnlake.streaming import queue

#: Job ids: the micro-batch, then the place in it.
BATCH_SHIFT = 43


def finished(parts: DataFrame, key: str = "file_id", part: str = "part", total: str = "total") -> DataFrame:
    """(key, parts, state) once for each key of a stream of (key, part, total) rows.

    ``complete`` when parts 0 to total - 1 have come, ``failed`` at a part outside of them,
    a null one, or another total than before.
    """

    def advance(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, bits = state.get if state.exists else (None, b"")
        if size == -1:
            return
        failed = False
        seen = np.unpackbits(np.frombuffer(bits, "u1")).astype(bool)
        for batch in batches:
            if batch["part"].isna().any() or batch["total"].isna().any():
                failed = True
                break
            at, sizes = batch["part"].to_numpy("int64"), batch["total"].to_numpy("int64")
            if size is None:
                size = int(sizes[0])
                seen = np.zeros(max(0, -(-size // 8) * 8), bool)
            if (sizes != size).any() or (at < 0).any() or (at >= size).any():
                failed = True
                break
            seen[at] = True
        if failed or size is not None and seen.sum() == size:
            state.update((-1, b""))
            yield pd.DataFrame({"key": [who[0]], "parts": [None if failed else size], "state": ["failed" if failed else "complete"]}).astype({"parts": "Int32"})
        elif size is not None:
            state.update((size, np.packbits(seen).tobytes()))

    kind = parts.schema[key].dataType.simpleString()
    rows = parts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{part}`").cast("int").alias("part"), F.col(f"`{total}`").cast("int").alias("total"))
    done = rows.groupBy("key").applyInPandasWithState(advance, f"key {kind}, parts int, state string", "size int, bits binary", "append", GroupStateTimeout.NoTimeout)
    return done.select(F.col("key").alias(key), "parts", "state")


def numbered(jobs: DataFrame, batch: int, key: str) -> DataFrame:
    """Adds job_id: rising over micro-batches and, in one, by key; the same if the batch runs again."""
    return jobs.orderBy(key).withColumn("job_id", F.lit(batch << BATCH_SHIFT) + F.monotonically_increasing_id()).withColumn("batch", F.lit(batch))


def run(parts: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "file_id", part: str = "part", total: str = "total", available_now: bool = True) -> StreamingQuery:
    """Start ``work`` on the numbered jobs (key, parts, state, job_id, batch) of each micro-batch as they finish; results below ``out``."""

    def batch(df: DataFrame, number: int) -> None:
        work(numbered(df, number, key)).write.mode("overwrite").parquet(f"{out}/_of={number}")

    writer = finished(parts, key, part, total).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def wait(query: StreamingQuery) -> None:
    """Until the query ends; its failure is a ``QueueError``."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        raise queue.QueueError(str(e)) from e
