"""Sharding by sampled splitters.

A record's key is built from its text (so equal texts are neighbours) and then from
its row (so a text that a third of all rows share can still be divided).  A sample
drawn with probability in proportion to the weight gives quantile cuts for many
ranges, more than shards; the exact weight of each range is summed, ranges that
turn out overfull are subdivided from a denser sample of their own, and the running
weight in key order then deals the records out to the shards.  Only the cuts and
the sums of ranges, both bounded by parameters, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.llm.ranges import long_array, range_index
from turnlake.llm.scratch import Scratch

RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 8
OVERFULL = 2.0
ROUNDS = 3
#: Rows of a written file, about.
FILE_ROWS = 100_000


def _cuts(rows: list, parts: int, step: float) -> list[int]:
    """Keys at equal steps of the weight that the drawn rows stand for."""
    drawn = sorted((r["_key"], max(float(r["_weight"]), step)) for r in rows)
    total, run, out = sum(w for _, w in drawn), 0.0, []
    for key, w in drawn:
        run += w
        if run * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            out.append(key)
    return out


def _assigned(df: DataFrame, n_shards: int, key: str, text: str, law: str, carry: bool) -> DataFrame:
    """Per row: _id, size, text_crc32, shard, slot, and with ``carry`` the row itself in _row."""
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    body, ident = F.col(f"`{text}`"), F.col(f"`{key}`")
    octets = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 32), 32)
    low = F.shiftrightunsigned(F.xxhash64(F.lit(5), ident, F.monotonically_increasing_id()), 32)
    whole = ["_row"] if carry else []
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if carry else []
    narrow = df.select(*row, ident.alias("_id"), (octets + 16).alias("size"), F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).alias("text_crc32"), high.bitwiseOR(low).alias("_key"))
    narrow = scratch.save(narrow.withColumn("_weight", F.col("size") if law == "bytes" else F.lit(1).cast("long")), "narrow")

    total = narrow.agg(F.sum("_weight").alias("w")).first()["w"]
    if not total:
        return narrow.select(*whole, "_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = n_shards * RANGES_PER_SHARD

    def draw(rows: DataFrame, weight: int, wanted: int, seed: int) -> tuple[list, float]:
        step = weight / wanted
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_key")), 11) / F.lit(float(1 << 53))
        return rows.where(chance * step < F.col("_weight")).select("_key", "_weight").collect(), step

    rows, step = draw(narrow, total, parts * SAMPLES_PER_RANGE, 1)
    cuts = _cuts(rows, parts, step)
    target = total / parts
    for turn in range(ROUNDS):
        placed = narrow.withColumn("_range", range_index(F.col("_key"), cuts))
        sums = {r["_range"]: (r["w"], r["n"]) for r in placed.groupBy("_range").agg(F.sum("_weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()}
        over = [r for r, (w, n) in sums.items() if w > OVERFULL * target and n > 1]
        if not over or turn == ROUNDS - 1:
            break
        fuller = placed.where(F.col("_range").isin(over))
        weight = sum(sums[r][0] for r in over)
        rows, step = draw(fuller, weight, max(1, round(weight / target)) * SAMPLES_PER_RANGE * 4, 2 + turn)
        more = set(_cuts(rows, 2 * max(1, round(weight / target)) + 1, step)) - set(cuts)
        if not more:
            break
        cuts = sorted({*cuts, *more})

    start_w, start_n, at_w, at_n = [], [], 0, 0
    for r in range(len(cuts) + 1):
        start_w.append(at_w)
        start_n.append(at_n)
        w, n = sums.get(r, (0, 0))
        at_w, at_n = at_w + w, at_n + n
    order = W.partitionBy("_range").orderBy("_key", "_id", "text_crc32")
    run = placed.withColumns({"_run": F.sum("_weight").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "_nth": F.row_number().over(order) - 1})
    at = F.col("_range") + 1
    run = run.withColumns({"_before": F.element_at(long_array(start_w), at) + F.col("_run") - F.col("_weight"), "_row_nth": F.element_at(long_array(start_n), at) + F.col("_nth")})
    middle = F.expr(f"cast(((2 * _before + _weight) * {n_shards}) div {2 * total} as int)") if law == "bytes" else F.expr(f"cast((_row_nth * {n_shards}) div {total} as int)")
    run = scratch.save(run.select(*whole, "_id", "size", "text_crc32", F.least(F.lit(n_shards - 1), middle).alias("shard"), "_row_nth"), "placed")
    scratch.drop("narrow")
    first = {r["shard"]: r["first"] for r in run.groupBy("shard").agg(F.min("_row_nth").alias("first")).collect()}
    starts = long_array([first.get(s, 0) for s in range(n_shards)])
    return run.select(*whole, "_id", "size", "text_crc32", "shard", (F.col("_row_nth") - F.element_at(starts, F.col("shard") + 1)).alias("slot"))


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", law: str = "bytes") -> DataFrame:
    """Per row: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus 16.  Law ``bytes``: shards have
    nearly equal sizes, each boundary within half a record of the exact quantile.
    Law ``rows``: row counts differ by one at most.  Slots count from 0 in a shard,
    without gaps.  grown_shard is null under both laws.  Repeated rows are rows of
    their own; null keys are allowed; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = _assigned(df, n_shards, key, text, law, False)
    return rows.select(F.col("_id").alias(key), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text", law: str = "bytes", file_rows: int = FILE_ROWS) -> str:
    """Write the rows of ``df`` as one folder per shard below ``path``; the name of the folders' column.

    Every row is written once, whatever keys are null or repeat, with its columns as they
    are; a file holds some ``file_rows`` rows in the order of slots.  The column is
    ``_shard``, with more underscores where ``df`` has that.  An empty table writes no
    folder.
    """
    name = "_shard"
    while name in df.columns:
        name += "_"
    rows = _assigned(df, n_shards, key, text, law, True).withColumn("_file", F.expr(f"slot div {file_rows}"))
    dealt = rows.repartition("shard", "_file").sortWithinPartitions("shard", "slot").select("_row.*", F.col("shard").alias(name))
    dealt.write.partitionBy(name).parquet(path)
    return name
