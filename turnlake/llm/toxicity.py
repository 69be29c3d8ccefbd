"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text, the
latter laid over the former, so that both know the language and only one the abuse.
A document is cut into windows (a word, or 24 letters of a longer run of letters); a
window is compressed with either dictionary, and its margin is the length by the
ordinary one less that by both.  A window ends in a mark that both dictionaries hold,
so zstandard never falls back to storing it.

Toxic documents are mostly ordinary text.  What the toxic dictionary is trained on are
the words of toxic documents of which the word or its start is ``CONTRAST`` times as
common among toxic documents as among others, and common to ``SUPPORT`` of them.

Margins get weights: how much likelier each is in toxic documents of a part of the
labels that the dictionaries haven't seen.  A logistic curve over their sums, fitted on
the same part, gives the probability, so 0.5 is a calibrated threshold.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS`` of each label,
some ``MAX_BYTES`` of text in all), chosen by hashes; equal texts count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.scratch import Scratch

MAX_ROWS = 20_000
MAX_BYTES = 64_000_000
CONTRAST, SUPPORT, LEAST_DOCS = 4, 0.03, 5
#: Letters of a word's start that count besides the whole word.
STARTS = (4, 5, 6)
#: Bytes of the dictionaries, stretches of ordinary text and toxic words they are trained on at most.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_SAMPLES, TOXIC_SAMPLES = 32_768, 4_096, 40_000, 100_000
STRETCH = 12
#: Toxic words are trained on in cells of so many bytes, of which the trainer takes whole ones.
CELL = 16
LEVEL = 3
#: Margins from LOW to HIGH are told apart; those beyond count as these.
LOW, HIGH = -1, 6
TABLE_ENTRIES = 400_000

windows_of = re.compile(r"[^\W\d_]{1,24}").findall
_MARK = bytes(range(9)) + bytes(range(14, 21))


def _features(word: str) -> list[str]:
    return [word[:k] for k in STARTS if len(word) >= k] + [f"{word}$"]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), min_match=4, hash_log=18, chain_log=18, write_content_size=0, write_checksum=0, write_dict_id=0)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of ``samples``; too few for the trainer are a dictionary themselves."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8, f=18, split_point=1.0, accel=1, level=LEVEL).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """Both dictionaries, the weights of margins, and the curve: weights, means and spreads of ``_summary``."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    curve: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


class Margins:
    """Counts of the margins of a text's windows; a bounded table holds the margins of windows seen."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.both = _compressor(ordinary).compress, _compressor(ordinary + toxic).compress
        self.table: dict[str, int] = {}

    def counts(self, text: str | None) -> np.ndarray:
        out, table = np.zeros(HIGH - LOW + 1, "int64"), self.table
        for window, n in Counter(windows_of((text or "").lower())).items():
            place = table.get(window)
            if place is None:
                data = f" {window} ".encode() + _MARK
                place = min(max(len(self.ordinary(data)) - len(self.both(data)), LOW), HIGH) - LOW
                if len(table) >= TABLE_ENTRIES:
                    table.clear()
                table[window] = place
            out[place] += n
        return out


def margin_weights(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log ratios of the mean shares of margins, from counts by document."""
    shares = [(c / np.maximum(c.sum(axis=1, keepdims=True), 1)).sum(axis=0) + 1e-3 for c in (toxic, ordinary)]
    return np.log(shares[0] / shares[0].sum()) - np.log(shares[1] / shares[1].sum())


def _summary(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the curve is over, by document: weighted sums, size, whether a window is telling."""
    n = counts.sum(axis=1)
    whole, hits = counts @ weights, counts @ np.where(weights > 0.7, weights, 0)
    return np.stack([np.ones(len(n)), whole / np.sqrt(n + 5), whole / (n + 5), np.log1p(n), hits / np.sqrt(n + 5), (counts @ (weights > 1.5) > 0) * 1.0], axis=1)


def fit_curve(x: np.ndarray, y: np.ndarray, shift: float, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights by Newton's method, means and spreads; ``shift`` undoes that labels were drawn at different rates."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], spread[0] = 0, 1
    z, w = (x - mean) / spread, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
    w[0] += shift
    return w, mean, spread


def probability(model: Model, counts: np.ndarray) -> np.ndarray:
    z = (_summary(counts, model.weights) - model.mean) / model.spread
    return 1 / (1 + np.exp(-np.clip(z @ model.curve, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, scratch: Scratch) -> tuple[DataFrame, dict[int, float]]:
    """t, y, seen of the sample, each text once, and the rates that labels were drawn at."""
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y in (0, 1)").distinct()
    share = {r["y"]: min(1.0, MAX_ROWS / r["n"]) for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 20))
    drawn = marks.where(part(F.lit(3), "k") < F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)) * (1 << 20))
    # at most some 2 * MAX_ROWS ids of a few bytes
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(drawn), "k").select("t", "y")
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    fewer = texts.where(part(F.lit(5), "t") < min(1.0, MAX_BYTES / max(size, 1)) * (1 << 20)).dropDuplicates()
    return scratch.save(fewer.withColumn("seen", F.pmod(F.xxhash64(F.lit(7), "t"), F.lit(3)) != 0), "sample"), share


def _telling(seen: DataFrame) -> set[str]:
    """Words and starts of words that toxic documents have far more often."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[Counter] = [Counter(), Counter()]
            for t, y in zip(batch["t"], batch["y"]):
                found[y].update({f for w in set(windows_of(t.lower())) for f in _features(w)})
            yield pd.DataFrame([(f, found[1][f], found[0][f]) for f in found[0].keys() | found[1].keys()], columns=["f", "a", "b"])

    size = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, ordinary = size.get(1, 0), size.get(0, 0)
    counts = seen.select("t", "y").mapInPandas(features, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    enough = counts.where((F.col("a") >= max(LEAST_DOCS, SUPPORT * toxic)) & ((F.col("a") + 0.5) * (ordinary + 1) >= CONTRAST * (F.col("b") + 0.5) * (toxic + 1)))
    return {r["f"] for r in enough.select("f").collect()}


def _trainings(seen: DataFrame, telling: set[str]) -> tuple[list[bytes], list[bytes]]:
    """Samples of either dictionary: stretches of ordinary text, and telling words of toxic documents, a sample each time they occur."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: Counter = Counter()
            for t, y in zip(batch["t"], batch["y"]):
                found = windows_of(t.lower())
                if y:
                    rows.update((1, w) for w in found if not telling.isdisjoint(_features(w)))
                else:
                    rows.update((0, " ".join(found[lo : lo + STRETCH])) for lo in range(0, len(found), STRETCH))
            yield pd.DataFrame([(y, s, n) for (y, s), n in rows.items()], columns=["y", "s", "n"])

    found = seen.select("t", "y").mapInPandas(words, "y int, s string, n long").groupBy("y", "s").agg(F.sum("n").alias("n"))
    stretches = found.where("y = 0").orderBy(F.xxhash64("s"), "s").limit(ORDINARY_SAMPLES).collect()
    toxic = found.where("y = 1").orderBy(F.desc("n"), "s").limit(TOXIC_SAMPLES).collect()
    scale = min(1.0, TOXIC_SAMPLES / max(1, sum(r["n"] for r in toxic)))
    samples = [f" {r['s']} ".encode().ljust(CELL) for r in toxic for _ in range(max(1, round(r["n"] * scale)))]
    return [f" {r['s']} ".encode() for r in stretches], [samples[i] for i in np.random.default_rng(11).permutation(len(samples))]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The model of the labelled rows of ``docs``; null labels and keys are left out, a null text is an empty one.

    Without toxic documents, or without others, every text gets the same score: the
    share of toxic ones among the labels, 0 without any label.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample, share = _sample(docs, labels, key, text, label, scratch)
    ordinary, toxic = _trainings(sample.where("seen"), _telling(sample.where("seen")))
    dictionaries = _trained(ordinary, ORDINARY_BYTES, 64), _trained(toxic, TOXIC_BYTES, CELL)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Margins(*dictionaries)
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "c": [of.counts(t).tolist() for t in batch["t"]]})

    rows = sample.where("not seen").select("t", "y").mapInPandas(margins, "y int, c array<long>").toPandas()
    scratch.drop_all()
    y = rows["y"].to_numpy("int64")
    counts = np.array(rows["c"].tolist(), "int64").reshape(len(y), HIGH - LOW + 1)
    if len(set(y)) < 2:
        flat = np.zeros(6)
        flat[0] = 30 if len(y) and y[0] else -30
        return Model(*dictionaries, np.zeros(HIGH - LOW + 1), flat, np.zeros(6), np.ones(6))
    weights = margin_weights(counts[y == 1], counts[y == 0])
    return Model(*dictionaries, weights, *fit_curve(_summary(counts, weights), y, float(np.log(share[0] / share[1]))))


_margins: dict[int, Margins] = {}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, score (0 to 1), predicted (1 if score is 0.5 or more).

    Null and empty texts, and texts without a letter, get the score of a text without
    windows.  Repeated rows and null keys pass row by row, an empty table gives an empty
    result, and other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        held = shared.value
        if id(held) not in _margins:
            _margins.clear()
            _margins[id(held)] = Margins(held.ordinary, held.toxic)
        of = _margins[id(held)]
        counts = np.array([of.counts(t) for t in texts], "int64").reshape(len(texts), HIGH - LOW + 1)
        return pd.Series(probability(held, counts))

    rows = docs.select(F.col(f"`{key}`").alias("_key"), scores(F.col(f"`{text}`")).alias("_score"))
    return rows.select(F.col("_key").alias(key), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def held_out(key: str = "doc_id"):
    """The fold whose labels training never sees: crc32 of the key as text, modulo 5, is 0 (a null key: not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(5)) == 0, F.lit(False))
