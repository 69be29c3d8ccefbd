"""PLDA parameters learnt from labelled embeddings, and mixture inference of recordings of any length.

Rows of a recording are cut into slices, and the state of a turn is a row per speaker:
its prior, its weight and its moment, which together are its model.  A turn sends the
models to the slices, each of which returns sums a speaker; the rows themselves are
shuffled once, before the first turn.  Responsibilities aren't kept between turns, as the
models of a recording's last turn give them.  Recordings leave when their bound settles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.config import PLDA_DIM, VbxConfig
from turnlake.functions import vectors
from turnlake.operators import kernels
from turnlake.session import materialized

#: Rows of a slice, on average.
SLICE_ROWS = 4096


def _each(function: str, column: str, dims: int) -> Column:
    """An aggregate of each element of a vector."""
    return F.expr(f"array({', '.join(f'{function}(cast(get({column}, {i}) as double))' for i in range(dims))})")


def _fixed(values) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def _centred(rows: DataFrame, column: str, mean: np.ndarray) -> DataFrame:
    """The vector less ``mean``, at a length of the square root of its size; difference and length are columns, so each is computed once."""
    rows = rows.withColumn("_v", F.zip_with(column, _fixed(mean), lambda x, m: x.cast("double") - m)).withColumn("_n", vectors.norm("_v"))
    return rows.select("c", F.transform(vectors.l2_normalize("_v", F.col("_n")), lambda x: x * len(mean) ** 0.5).alias(column))


def estimate_plda(rows: DataFrame, out: int = 16, embedding: str = "embedding", label: str = "label") -> kernels.Plda:
    """PLDA with a diagonal covariance within labels, from all rows.

    The directions are the mean vectors of the ``out`` labels with most rows (ties: the
    smaller label); the driver gets these and a few more vectors.  Rows without a label and
    vectors that are null, not finite or shorter than the longest are left out.  A single
    label, or labels without any spread, are an error.
    """
    rows = rows.select(F.col(label).alias("c"), F.col(embedding).alias("e")).where(F.col("c").isNotNull() & vectors.all_finite("e"))
    dims = rows.agg(F.max(F.size("e"))).first()[0]
    if not dims:
        raise kernels.PldaError("no labelled rows")
    rows = rows.where(F.size("e") == dims)
    mean1 = np.array(rows.agg(_each("avg", "e", dims)).first()[0])
    unit = _centred(rows, "e", mean1)
    heads = unit.groupBy("c").agg(F.count(F.lit(1)).alias("n"), _each("avg", "e", dims).alias("m")).orderBy(F.desc("n"), "c").limit(out).collect()
    lda = np.array([h["m"] for h in heads]).T
    size = lda.shape[1]
    flat = unit.select("c", F.array(*[vectors.dot("e", _fixed(d)) for d in lda.T]).alias("p"))
    mean2 = np.array(flat.agg(_each("avg", "p", size)).first()[0])
    last = _centred(flat, "p", mean2).withColumn("q", F.transform("p", lambda x: x * x))
    by = last.groupBy("c").agg(F.count(F.lit(1)).alias("n"), _each("sum", "p", size).alias("s"), _each("sum", "q", size).alias("q"))
    by = by.withColumn("b", F.transform("s", lambda x: x * x / F.col("n")))
    n, total, squares, means = by.agg(F.sum("n"), *[_each("sum", x, size) for x in ("s", "q", "b")]).first()
    mu = np.array(total) / n
    within, between = (np.array(squares) - means) / n, np.array(means) / n - mu**2
    if (within <= 1e-12).any() or (between <= 1e-12).any():
        raise kernels.PldaError("labels without spread")
    return kernels.Plda.derive(mean1, mean2, lda, mu, np.diag(within**-0.5), between / within)


def plda_features(plda: kernels.Plda, dim: int = PLDA_DIM):
    """Features of embeddings, row by row: an Arrow function of a column.  Vectors that are null or have another size give null."""
    size = len(plda.mean1)

    @F.pandas_udf("array<float>")
    def features(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object)
        ok = [i for i, v in enumerate(x) if v is not None and len(v) == size]
        if ok:
            for i, row in zip(ok, plda.features(np.stack([x.iloc[i] for i in ok]), dim)):
                out.iat[i] = row
        return out

    return features


@dataclass
class Mixture:
    """Rows (file_id, key, gamma) and speakers (file_id, speaker, prior, turns)."""

    rows: DataFrame
    speakers: DataFrame


def _start(rows: DataFrame, files: DataFrame, scale: np.ndarray, smoothing: float) -> DataFrame:
    """Models of softened first labels, from sums by label."""
    own = rows.groupBy("file_id", F.col("label").alias("speaker")).agg(F.count(F.lit(1)).alias("_n"), _each("sum", "features", len(scale)).alias("_s"))
    every = files.select("file_id", "_rows", "slices", "_k", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("speaker"))
    none = _fixed(np.zeros(len(scale)))
    own = every.join(own, ["file_id", "speaker"], "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_s": F.coalesce("_s", none)})
    own = own.withColumn("_s", F.zip_with("_s", _fixed(scale), lambda x, v: x * v))
    of = own.groupBy("file_id").agg(_each("sum", "_s", len(scale)).alias("_all"))
    cold = F.lit(float(np.exp(-smoothing))) if smoothing >= 0 else F.lit(0.0)
    whole = 1 + (F.col("_k") - 1) * cold
    hot, cold = ((x / whole).cast("float").cast("double") for x in (F.lit(1.0), cold))
    own = own.join(of, "file_id").withColumns({"_hot": hot, "_cold": cold})
    return own.select(
        "file_id", "speaker", "slices", (F.lit(1.0) / F.col("_k")).alias("prior"), (F.col("_hot") * F.col("_n") + F.col("_cold") * (F.col("_rows") - F.col("_n"))).alias("weight"),
        F.zip_with("_s", "_all", lambda s, a: F.col("_hot") * s + F.col("_cold") * (a - s)).alias("moment"), F.lit(float("-inf")).alias("bound"),
    )


def _regular(phi: np.ndarray, ratio: float) -> Column:
    """A speaker's part of the bound."""
    inverse = F.transform(_fixed(phi), lambda p: 1 / (1 + ratio * F.col("weight") * p))
    terms = F.zip_with(inverse, "moment", lambda i, m: F.log(i) - i - ratio * i * m * ratio * i * m + 1)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def posteriors(rows: DataFrame, phi, config: VbxConfig | None = None, key: str = "vec_id", slice_rows: int = SLICE_ROWS) -> Mixture:
    """``kernels.vbx`` of every recording of (file_id, key, features, label), started from labels that count from 0.

    ``key`` tells the rows of a recording apart.  Rows without a key, label or features, with a
    negative label or with features that aren't finite or have another size than ``phi`` are left out.  A
    task holds one slice and the models of its recording; the driver gets a count a turn.
    """
    c = config or VbxConfig()
    if c.max_iters < 1:
        raise ValueError("at least one turn")
    phi = np.asarray(phi, "float32").astype("float64")
    ratio, size, spark = c.fa / c.fb, len(phi), rows.sparkSession
    rows = rows.select("file_id", F.col(f"`{key}`").alias("_key"), F.col("label").cast("int").alias("label"), F.col("features").cast("array<float>").alias("features"))
    rows = rows.where(F.col("file_id").isNotNull() & F.col("_key").isNotNull() & (F.col("label") >= 0) & (F.size("features") == size) & vectors.all_finite("features"))
    rows = materialized(rows, "mixture-rows")
    files = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("_rows"), (F.max("label") + 1).alias("_k"))
    files = materialized(files.withColumn("slices", F.ceil(F.col("_rows") / slice_rows).cast("int")), "mixture-files")
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("file_id", "_key")}

    # a fixed number of partitions, counted at once: turns then find the rows where they are, in order
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = rows.join(files.select("file_id", "slices"), "file_id").select("file_id", F.pmod(F.xxhash64("_key"), F.col("slices")).cast("int").alias("slice"), "_key", "features")
    sliced = sliced.repartition(tasks, "file_id", "slice").sortWithinPartitions("file_id", "slice").persist(StorageLevel.DISK_ONLY)
    sliced.count()

    def expected(x: pd.DataFrame, model: pd.DataFrame):
        model = model.sort_values("speaker")
        weight, moment, prior = model["weight"].to_numpy(), np.stack(model["moment"].to_list()), model["prior"].to_numpy()
        return model["speaker"].to_numpy(), kernels.expectation(np.stack(x["features"].to_list()).astype("float64"), phi, weight, moment, prior, c)

    def sums(x: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if x.empty or model.empty:
            return pd.DataFrame(columns=["file_id", "speaker", "w", "m", "evidence"], dtype=object)
        speaker, (rho, gamma, evidence) = expected(x, model)
        return pd.DataFrame({"file_id": x["file_id"].iloc[0], "speaker": speaker, "w": gamma.sum(axis=0), "m": list(gamma.T @ rho), "evidence": np.where(speaker == 0, evidence.sum(), 0.0)})

    def final(x: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if x.empty or model.empty:
            return pd.DataFrame(columns=["file_id", "_key", "gamma"], dtype=object)
        return x[["file_id", "_key"]].assign(gamma=list(expected(x, model)[1][1].astype("float32")))

    def meet(models: DataFrame, function, schema: str) -> DataFrame:
        models = models.select("file_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "speaker", "prior", "weight", "moment")
        return sliced.groupBy("file_id", "slice").cogroup(models.groupBy("file_id", "slice")).applyInPandas(function, schema)

    state = materialized(_start(rows, files, np.sqrt(phi), c.init_smoothing), "mixture-models")
    settled = []
    of = W.partitionBy("file_id")  # a row a speaker
    for turn in range(c.max_iters):
        part = meet(state, sums, f"file_id {kinds['file_id']}, speaker int, w double, m array<double>, evidence double")
        part = part.groupBy("file_id", "speaker").agg(F.sum("w").alias("w"), _each("sum", "m", size).alias("m"), F.sum("evidence").alias("evidence"))
        new = state.withColumnRenamed("bound", "_before").join(part, ["file_id", "speaker"]).withColumn("_r", F.col("evidence") + c.fb * 0.5 * _regular(phi, ratio))
        new = new.withColumns({"bound": F.sum("_r").over(of), "next": F.col("w") / F.sum("w").over(of)})
        stop = F.lit(turn == c.max_iters - 1) | (F.lit(turn > 0) & (F.col("bound") - F.col("_before") < c.epsilon))
        new = materialized(new.withColumn("_stop", stop), "mixture-models")
        settled.append(new.where("_stop").select("file_id", "speaker", "slices", "prior", "weight", "moment", "next", F.lit(turn + 1).alias("turns")))
        state = new.where("not _stop").select("file_id", "speaker", "slices", F.col("next").alias("prior"), F.col("w").alias("weight"), F.col("m").alias("moment"), "bound")
        if state.isEmpty():
            break
    models = settled[0]
    for more in settled[1:]:
        models = models.unionByName(more)
    found = materialized(meet(models, final, f"file_id {kinds['file_id']}, _key {kinds['_key']}, gamma array<float>"), "mixture-rows")
    sliced.unpersist()
    return Mixture(found.withColumnRenamed("_key", key), models.select("file_id", "speaker", F.col("next").cast("float").alias("prior"), "turns"))
