"""Quality rules with risk-controlled thresholds.

Base rules reject documents with too few words or too many repeated ones.  Beyond
them, each rule of ``RULES`` has a ladder of cutoffs fixed in advance, and the rules
are tightened together, step by step, along a path.  A fifth of the labelled good
documents (quality 1) of all strata, and the labelled others, choose the path: the
step that loses fewest good ones comes first, of those the one that catches most of
the others.  On the rest of the good documents of a stratum the path is tested in
fixed sequence: an exact binomial bound must show, at level ``delta`` / number of
strata, that all rules together reject at most ``risk`` of good documents; the first
step that fails ends the path.  The documents that test a path have no part in
choosing it, so a stratum's only test at stake is that of the first step beyond
``risk``.  A good document is falsely rejected with probability ``risk`` at most, in
all strata at once with confidence 1 - ``delta``.  A stratum without enough labels
(217 for four strata, if none is rejected) only faces the base rules.  Documents
without a stratum are a stratum of their own.

Copies are no independent trials: labelled documents of a stratum that share the
smallest hash of their five-word windows (copies always, near copies mostly) are one
trial, which is rejected where any of them is, and take the same side of the split.  So
the promise is about different texts, and is the stricter where unrelated texts share
that window.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.ranges import BLANK, NOT_BLANK
from turnlake.llm.scratch import Scratch

RISK = 0.02
DELTA = 0.05
#: Strata with cutoffs that are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST = 10_000
#: One good labelled document in so many helps to choose the path and tests nothing.
CHOOSING = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: rule: (numerator, denominator, side, cutoffs from loose to tight)
RULES = {
    "symbols": ("n_symbols", "word_chars", "above", [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02]),
    "dup_lines": ("n_dup_lines", "n_words", "above", [0.3, 0.2, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]),
    "repeats": ("n_repeat_words", "n_words", "above", [0.19, 0.16, 0.13, 0.1, 0.07, 0.05]),
    "long_words": ("word_chars", "n_words", "above", [40, 25, 20, 16, 14, 12, 10]),
    "short_words": ("word_chars", "n_words", "below", [1.2, 1.5, 2, 2.5, 3, 3.5]),
}


def features(df: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: bool = False) -> DataFrame:
    """Per row: _id, _stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, _group (the same for copies); with ``carry`` the row itself in _row.

    A null or empty text has no words and zero everywhere.  Windows of five words are
    compared by 64-bit hashes.  One narrow pass without a shuffle; each step is a
    linear scan of the document's arrays, and only a document in which some window
    repeats has its windows sorted.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(body, BLANK + "+"), lambda w: w != "")
    octets = F.octet_length
    whole = ["_row"] if carry else []
    rows = df.select(
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if carry else []),
        F.col(f"`{key}`").alias("_id"),
        F.col(f"`{stratum}`").alias("_stratum"),
        words.alias("_words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_BLANK)).alias("_lines"),
        sum((octets(body) - octets(F.replace(body, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        *whole, "_id", "_stratum", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
        F.size("_words").alias("_n"),
    )

    def pairs(a: str, b: str, shift: int, n):
        return F.zip_with(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1 + shift), F.greatest(n, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    kept = [*whole, "_id", "_stratum", "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    rows = rows.withColumn("_h2", pairs("_h1", "_h1", 1, F.col("_n") - 1))
    rows = rows.withColumn("_h4", pairs("_h2", "_h2", 2, F.col("_n") - 3))
    rows = rows.select(*kept, pairs("_h4", "_h1", WINDOW - 1, F.col("_n") - WINDOW + 1).alias("_h5"))
    # windows that occur again: sorted by hash, a window that equals a neighbour
    again = F.size("_h5") > F.size(F.array_distinct("_h5"))
    kept.append("_group")
    rows = rows.withColumn("_group", F.array_min("_h5"))
    rows = rows.select(*kept, F.when(again, F.array_sort(F.transform("_h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    n = F.size("_s")
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    zipped = F.arrays_zip(F.concat(none, F.slice("_s", F.lit(1), n - 1)).alias("p"), F.col("_s").alias("s"), F.concat(F.slice("_s", F.lit(2), n - 1), none).alias("q"))
    found = F.filter(zipped, lambda z: (z["p"]["h"] == z["s"]["h"]) | (z["q"]["h"] == z["s"]["h"]))
    rows = rows.select(*kept, F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(found, lambda z: z["s"]["i"]))).alias("_at"))
    n = F.size("_at")
    steps = F.zip_with(F.slice("_at", F.lit(1), n - 1), F.slice("_at", F.lit(2), n - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(steps, F.lit(0), lambda x, y: x + y) + WINDOW
    rows = rows.select(*kept, F.when(F.col("_at").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(*whole, "_id", "_stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "_group")


def _beyond(rule: str, cutoff) -> F.Column:
    over, under, side, _ = RULES[rule]
    ratio = F.col(over) / F.when(F.col(under) > 0, F.col(under))
    return F.coalesce(ratio > cutoff if side == "above" else ratio < cutoff, F.lit(False))


def passes(rejected: int, n: int, risk: float, level: float) -> bool:
    """Whether ``rejected`` of ``n`` shows a rate of at most ``risk``: P(Bin(n, risk) <= rejected) <= level, exactly."""
    if n == 0 or rejected >= n:
        return False
    log_term, logs = n * math.log1p(-risk), []
    for k in range(rejected + 1):
        logs.append(log_term)
        log_term += math.log(n - k) - math.log(k + 1) + math.log(risk) - math.log1p(-risk)
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(level)


def tightening_path(own: np.ndarray, good: np.ndarray, junk: np.ndarray) -> list[int]:
    """Rules in the order in which they are tightened by a step.

    Each array has a row per kind of document: for each rule the first place in its
    ladder that rejects it, then how many there are.  ``own`` are good documents of the
    stratum, that count again beside ``good``.
    """
    at, steps = np.zeros(len(RULES), "int64"), []
    lengths = [len(ladder) for _, _, _, ladder in RULES.values()]

    def rejected(kinds: np.ndarray, to: np.ndarray) -> int:
        return int(kinds[(kinds[:, :-1] < to).any(axis=1), -1].sum())

    while len(steps) < sum(lengths):
        options = []
        for r, length in enumerate(lengths):
            if at[r] < length:
                to = at.copy()
                to[r] += 1
                options.append((rejected(own, to) + rejected(good, to), -rejected(junk, to), to[r] / length, r))
        steps.append(min(options)[-1])
        at[steps[-1]] += 1
    return steps


def certified(steps: list[int], kinds: np.ndarray, risk: float, level: float) -> list[int]:
    """How many steps of each rule pass, tested in the order of ``steps`` up to the first that fails."""
    at, n = np.zeros(len(RULES), "int64"), int(kinds[:, -1].sum())
    for r in steps:
        at[r] += 1
        if not passes(int(kinds[(kinds[:, :-1] < at).any(axis=1), -1].sum()), n, risk, level):
            at[r] -= 1
            break
    return at.tolist()


def least_trials(risk: float, level: float) -> int:
    """The fewest trials that can show a rate of ``risk``: if none is rejected."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def labelled_kinds(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """_stratum, use (0: tests the path, 1: helps to choose it, 2: not good), places in the ladders, and n trials, of labelled documents that pass the base rules."""
    label = labels.groupBy(F.col(f"`{key}`").alias("_id")).agg(F.min("quality").alias("q")).where("q is not null")
    held = rows.where(~F.col("base_failed")).join(label, "_id")
    places = [sum((F.when(_beyond(r, c), 0).otherwise(1) for c in RULES[r][3]), F.lit(0)).alias(r) for r in RULES]
    trials = held.select("_stratum", "_group", (F.col("q") == 1).alias("good"), *places).groupBy("_stratum", "_group", "good").agg(*[F.min(r).alias(r) for r in RULES])
    use = F.when(~F.col("good"), 2).when(F.pmod(F.xxhash64(F.lit(11), "_group"), F.lit(CHOOSING)) == 0, 1).otherwise(0)
    return trials.withColumn("use", use).groupBy("_stratum", "use", *RULES).agg(F.count(F.lit(1)).alias("n"))


def fit_cutoffs(rows: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """_stratum and, by rule, its certified cutoff or null, of the strata that have one; from the features of labelled documents.

    ``labels`` has ``key`` and quality; a document with several labels is good if all are 1.
    Collected are counts by the places in the ladders that reject a document: those of
    all strata together, and those of strata with at least ``least_trials`` trials of
    their own, as no other can be certified.  So there are fewer strata here than labels
    by that number, and any number of small ones.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "quality-kinds")
    kinds = scratch.save(labelled_kinds(rows, labels, key), "kinds")
    enough = kinds.where("use = 0").groupBy("_stratum").agg(F.sum("n").alias("trials")).where(F.col("trials") >= least_trials(risk, delta)).select(F.col("_stratum").alias("s"))
    own: dict = {}
    for r in kinds.where("use < 2").join(enough, kinds["_stratum"].eqNullSafe(F.col("s"))).select("_stratum", "use", *RULES, "n").collect():
        own.setdefault(r["_stratum"], {}).setdefault(r["use"], []).append([*(r[rule] for rule in RULES), r["n"]])
    pooled: dict = {}
    for r in kinds.where("use > 0").groupBy("use", *RULES).agg(F.sum("n").alias("n")).collect():
        pooled.setdefault(r["use"], []).append([*(r[rule] for rule in RULES), r["n"]])
    scratch.drop_all()
    grid = lambda found: np.array(found or [], "int64").reshape(-1, len(RULES) + 1)
    out = []
    for name, found in own.items():
        path = tightening_path(grid(found.get(1)), grid(pooled.get(1)), grid(pooled.get(2)))
        steps = certified(path, grid(found.get(0)), risk, delta / len(own))
        if any(steps):
            out.append((name, *(float(ladder[at - 1]) if at else None for at, (_, _, _, ladder) in zip(steps, RULES.values()))))
    schema = T.StructType([T.StructField("_stratum", rows.schema["_stratum"].dataType), *(T.StructField(rule, T.DoubleType()) for rule in RULES)])
    table = spark.createDataFrame(out, schema)
    return F.broadcast(table) if len(out) <= MAX_BROADCAST else table


def _judged(df: DataFrame, labels: DataFrame, key: str, text: str, stratum: str, risk: float, delta: float, carry: bool) -> DataFrame:
    rows = Scratch(df.sparkSession, "quality").save(features(df, key, text, stratum, carry), "features")
    cutoffs = fit_cutoffs(rows, labels, key, risk, delta).select(F.col("_stratum").alias("_s"), *[F.col(r).alias(f"_cut_{r}") for r in RULES])
    met = rows.join(cutoffs, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    rejected = F.greatest(*[_beyond(r, F.col(f"_cut_{r}")) for r in RULES])  # no cutoff: not beyond it
    return met.withColumn("kept", ~F.col("base_failed") & ~rejected)


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row: ``key``, the five features, base_failed and kept.

    Repeated rows and null keys are rows of their own; a stratum without a certified
    cutoff only faces the base rules; empty tables give empty results;
    other columns are ignored.  The features, narrow rows, are written once; texts
    are read once and never shuffled.
    """
    rows = _judged(df, labels, key, text, stratum, risk, delta, False)
    return rows.select(F.col("_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``df``, with all their columns, that ``judge`` keeps; the rows are written once with their features."""
    return _judged(df, labels, key, text, stratum, risk, delta, True).where("kept").select("_row.*")
