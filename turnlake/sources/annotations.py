"""Annotation formats as DataFrames of turns: RTTM, TextGrid, JSON, parallel arrays, transcripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels that mean silence.
SILENCE = ("", "sil", "sp", "spn", "noise", "<sil>", "<noise>")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value")


def parse_rttm(rows: DataFrame, line: str = "value", least: int = 8, duration: bool = False) -> DataFrame:
    """Turns of RTTM lines: file_id, start, end, speaker; with ``duration`` that as written too, as start + duration - start isn't it.

    A line counts if its first field is SPEAKER, it has ``least`` fields and both its
    numbers parse; 5 fields are enough for times alone (speaker is then null).
    """
    parts = rows.withColumn("_f", F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")).where((F.element_at("_f", 1) == "SPEAKER") & (F.size("_f") >= least))
    number = lambda i: F.expr(f"try_cast(get(_f, {i}) as double)")
    parts = parts.withColumns({"start": number(3), "duration": number(4)}).where("start is not null and duration is not null")
    return parts.select(F.expr("get(_f, 1)").alias("file_id"), "start", (F.col("start") + F.col("duration")).alias("end"), F.expr("get(_f, 7)").alias("speaker"), *(["duration"] if duration else []))


def rttm_file_id(line: str = "value") -> Column:
    """File of an RTTM line, null with fewer than two fields."""
    return F.get(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), 1)


def split_by_file(rows: DataFrame, line: str = "value") -> DataFrame:
    """Lines with their file_id; those with fewer than two fields go."""
    return rows.withColumn("file_id", rttm_file_id(line)).where("file_id is not null")


def rttm_line(file_id: Column, start: Column, end: Column, speaker: Column) -> Column:
    """An RTTM line with six decimals, halves rounded up."""
    return F.format_string("SPEAKER %s 1 %.6f %.6f <NA> <NA> %s <NA> <NA>", file_id, start, end - start, speaker)


def exact_rttm_lines(turns: DataFrame, digits: int = 6, keep: list[str] | None = None) -> DataFrame:
    """RTTM lines in column value, numbers rounded from their exact binary values; beside the columns ``keep``."""

    @F.pandas_udf("string")
    def text(file_id: pd.Series, start: pd.Series, end: pd.Series, speaker: pd.Series) -> pd.Series:
        return pd.Series([f"SPEAKER {f} 1 {s:.{digits}f} {e - s:.{digits}f} <NA> <NA> {who} <NA> <NA>" for f, s, e, who in zip(file_id, start, end, speaker)], dtype="object")

    return turns.select(*(keep or []), text(F.col("file_id").cast("string"), F.col("start").cast("double"), F.col("end").cast("double"), F.col("speaker").cast("string")).alias("value"))


def write_rttm(turns: DataFrame, path: str) -> None:
    exact_rttm_lines(turns).write.text(path)


def speech(label: str = "label") -> Column:
    """Whether a label isn't one of silence."""
    return ~F.lower(label).isin(*SILENCE)


class TextGridError(ValueError):
    pass


def parse_textgrid(text: str) -> list[tuple[float, float, str]]:
    """Intervals of a TextGrid, long or short form, without silence.

    A bad number is an error in the long form and 0 in the short one.
    """
    rows = [r.strip() for r in text.splitlines()]
    out = []
    if any(r.startswith("xmin =") for r in rows):
        for a, b, c in zip(rows, rows[1:], rows[2:]):
            if a.startswith("xmin =") and b.startswith("xmax =") and c.startswith("text ="):
                out.append((_number(a[6:], None), _number(b[6:], None), c[6:].strip().strip('"')))
    else:
        at = 0
        while at < len(rows):
            if rows[at].strip('"') != "IntervalTier":
                at += 1
                continue
            count = int(_number(rows[at + 4])) if at + 4 < len(rows) else 0
            body = rows[at + 5 : at + 5 + 3 * count]
            out += [(_number(a), _number(b), c.strip('"')) for a, b, c in zip(body[::3], body[1::3], body[2::3]) if _number(b) > _number(a)]
            at += 5 + 3 * count
    return [x for x in out if x[2].strip().lower() not in SILENCE]


def _number(text: str, bad: float | None = 0.0) -> float:
    """The number in ``text``; for any other text ``bad``, or an error if that is None."""
    found = re.fullmatch(r"\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?\d+)?)\s*", text)
    if not found and bad is None:
        raise TextGridError(f"no number: {text.strip()!r}")
    return float(found[1]) if found else bad


def textgrid_intervals(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds start, end, label for each interval of (text or binary) TextGrid files; the label serves as the speaker."""

    @F.pandas_udf("array<struct<start:double,end:double,label:string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "label": c} for a, b, c in parse_textgrid(t)] for t in texts])

    return files.withColumn("_x", F.explode(parse(F.col(content).cast("string")))).select("*", "_x.start", "_x.end", "_x.label").drop("_x")


def textgrid_turns(intervals: DataFrame) -> DataFrame:
    """Intervals with a positive duration as turns."""
    return intervals.where("end > start").withColumnRenamed("label", "speaker")


JSON_SCHEMA = "segments array<struct<startTimeSeconds:double,endTimeSeconds:double,speakerId:string>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return json_turns(spark.read.schema(JSON_SCHEMA).json(path, multiLine=True).withColumn("file_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)))


def json_turns(rows: DataFrame) -> DataFrame:
    """Turns of rows with a ``segments`` array; numbers and strings serve as speakers, negative durations become 0."""
    s = rows.select("file_id", F.explode("segments").alias("s"))
    start = F.col("s.startTimeSeconds")
    return s.select("file_id", start.alias("start"), (start + F.greatest(F.lit(0.0), F.col("s.endTimeSeconds") - start)).alias("end"), F.col("s.speakerId").cast("string").alias("speaker"))


def array_turns(rows: DataFrame) -> DataFrame:
    """Turns of parallel arrays timestamps_start, timestamps_end, speakers; only those with a positive duration."""
    zipped = rows.select("file_id", F.explode(F.arrays_zip(F.col("timestamps_start").alias("start"), F.col("timestamps_end").alias("end"), F.col("speakers").alias("speaker"))).alias("z"))
    return zipped.select("file_id", "z.start", "z.end", "z.speaker").where("end > start")


def parse_transcript(rows: DataFrame, line: str = "value") -> DataFrame:
    """start, end, text of tab-separated lines; blank ones go, the text may hold tabs, a bad number is an error."""
    parts = rows.where(F.trim(line) != "").withColumn("_f", F.split(line, "\t", 3))
    return parts.select(F.get("_f", 0).cast("double").alias("start"), F.get("_f", 1).cast("double").alias("end"), F.get("_f", 2).alias("text"))


def write_results(rows: DataFrame, path: str) -> None:
    """Benchmark results as JSON and as aligned text lines below ``path``."""
    rows.write.json(f"{path}/json")
    rows.select(F.concat_ws("  ", *[F.rpad(F.col(c).cast("string"), 14, " ") for c in rows.columns]).alias("value")).write.text(f"{path}/text")
