"""Speech relations derived from the general-purpose tables, so that each operator can be checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILES = 50
HOUR_MS = 3_600_000
ROWS_PER_FILE = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of 50 recordings of an hour in whole milliseconds, reference and hypothesis."""
    return segments_of(table(spark, sf_dir, "events"))


def segments_of(events: DataFrame) -> DataFrame:
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts) div 1000")
    return events.select(
        "event_id",
        (F.col("user_id") % FILES).alias("file_id"),
        F.col("event_type").alias("speaker"),
        F.when(F.col("event_id") % 2 == 0, "ref").otherwise("hyp").alias("side"),
        (ms % HOUR_MS).alias("s_ms"),
        (ms % HOUR_MS + F.floor(F.col("value") * 100) + 1).alias("e_ms"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame scores of 20 recordings by speaker."""
    events = table(spark, sf_dir, "events")
    rows = events.select((F.col("user_id") % 20).alias("file_id"), F.col("event_type").alias("speaker"), "ts", "event_id", (F.col("value") / 500).alias("score"))
    return rows.select("file_id", "speaker", (F.row_number().over(W.partitionBy("file_id", "speaker").orderBy("ts", "event_id")) - 1).alias("frame"), "score")


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded activity of chunks, frames and local speakers; recordings grow in number with the table."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.expr("l_orderkey div 5000") * 4 + F.col("l_suppkey") % 4).alias("file_id"), (F.col("l_orderkey") % 50).cast("int").alias("chunk_idx"), (F.col("l_partkey") % 60).cast("int").alias("frame_idx"),
        (F.col("l_linenumber") % 3).cast("int").alias("speaker_idx"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("active"),
    )
    return rows.groupBy("file_id", "chunk_idx", "frame_idx", "speaker_idx").agg(F.max("active").alias("active"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of chunk speakers, 150 to a recording."""
    at = F.col("vec_id") % ROWS_PER_FILE
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {ROWS_PER_FILE}").alias("file_id"), F.floor(at / 3).cast("int").alias("chunk_idx"), (at % 3).cast("int").alias("speaker_idx"), "embedding", "label", "vec_id"
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven scores of a frame, the first seven elements of an embedding."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 7).alias("logits"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcript rows, 100 ms a character."""
    rows = table(spark, sf_dir, "conversations")
    order = W.partitionBy("conv_id").orderBy("turn")
    size = F.char_length("text") * 100
    end = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select((F.col("conv_id") % FILES).alias("file_id"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("row_idx"), (end - size).alias("s_ms"), end.alias("e_ms"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("duration"))
