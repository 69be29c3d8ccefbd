"""Language identification by word-first backoff.

Each known word is scored by its log frequency in every language.  A word that was
not seen falls back to character n-grams: the longest order of which any n-gram is
known gives the mean log frequency of its known n-grams; else the next shorter
order, down to single characters.  A document's scores are the sums over its words,
and the posterior of the best language is the returned score.

The model is fitted on a bounded sample of labelled rows: about ``MAX_TRAIN`` rows
with about ``TRAIN_CHARS`` characters, and at least about ``LEAST_TRAIN`` rows of each of
the ``MAX_LANGUAGES`` languages with most rows (with ``TRAIN_CHARS`` for all of these
together).  Rows, and pieces of long texts, are chosen by a hash over all of them.  The
words and n-grams of the sample are counted on the executors.  What reaches the driver,
and then every worker, are 64-bit hashes with their counts, ``MODEL_ROWS`` at most: of
more, each language's most frequent ones.  Tables are sparse: a language that a key
wasn't seen in costs nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.scratch import Scratch

MAX_TRAIN = 30_000
TRAIN_CHARS = 64_000_000
LEAST_TRAIN = 200
MAX_LANGUAGES = 1000
MODEL_ROWS = 8_000_000
#: Texts are drawn in pieces of so many characters.
PIECE = 16_384
#: Entries of a task's table of counts before it is handed on.
COUNT_ENTRIES = 100_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.1
#: What a worker's table of chunks may hold: chunks, and scores in all.
TABLE_ENTRIES = 400_000
TABLE_SCORES = 16_000_000
#: The longest chunk that is kept, and chunks that are scored at once.
TABLE_CHUNK = 48
BATCH_CHUNKS = 8192

_ODD = np.uint64(0x9E3779B97F4A7C15)
words_of = re.compile(r"[^\W\d_]+").findall


def has_letter(text: str) -> bool:
    """Whether some character is a letter (category L)."""
    return any(map(str.isalpha, text))


def word_hashes(words: list[str]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), "uint64", len(words))


def gram_hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word between two marks, and the word's place."""
    body = np.frombuffer("".join(f"_{w}_" for w in words).encode("utf-32-le"), "<u4").astype("uint64")
    sizes = np.fromiter(map(len, words), "int64", len(words)) + 2
    h = np.full(max(0, len(body) - order + 1), order, "uint64")
    for k in range(order):
        h = (h ^ body[k : k + len(h)]) * _ODD
        h ^= h >> np.uint64(29)
    owner = np.repeat(np.arange(len(words)), sizes)[: len(h)]
    room = np.repeat(np.cumsum(sizes), sizes)[: len(h)] - np.arange(len(h))
    return h[room >= order], owner[room >= order]


@dataclass
class Table:
    """Log frequencies by language of sorted keys: those of unseen keys, and what seen ones have beyond."""

    keys: np.ndarray
    edges: np.ndarray
    lang: np.ndarray
    beyond: np.ndarray
    unseen: np.ndarray

    @classmethod
    def of(cls, lang: np.ndarray, key: np.ndarray, n: np.ndarray, languages: int) -> Table:
        order = np.lexsort((lang, key))
        lang, key, n = lang[order], key[order], n[order].astype("float64")
        keys, first = np.unique(key, return_index=True)
        total = np.bincount(lang, n, languages) + SMOOTHING * max(len(keys), 1)
        unseen = np.log(SMOOTHING / total)
        return cls(keys, np.r_[first, len(key)], lang.astype("u2" if languages < 1 << 16 else "u4"), np.log((n + SMOOTHING) / SMOOTHING).astype("float32"), unseen)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for unseen ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def sums(self, at: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Log frequencies of the keys at ``at``, summed by owner: (owners, languages)."""
        out = np.bincount(owner, minlength=owners)[:, None] * self.unseen
        sizes = self.edges[at + 1] - self.edges[at]
        entry = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.edges[at], sizes)
        flat = np.repeat(owner, sizes) * len(self.unseen) + self.lang[entry]
        return out + np.bincount(flat, self.beyond[entry], out.size).reshape(out.shape)


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: list[Table]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words: (words, languages); zero for words of which nothing is known."""
        out = np.zeros((len(words), len(self.languages)))
        at = self.words.find(word_hashes(words))
        known = np.flatnonzero(at >= 0)
        out[known] = self.words.sums(at[known], np.arange(len(known)), len(known))
        left = np.flatnonzero(at < 0)
        for order, table in zip(ORDERS, self.grams):
            if not len(left):
                break
            hashes, owner = gram_hashes([words[i] for i in left], order)
            at = table.find(hashes)
            owner, at = owner[at >= 0], at[at >= 0]
            found = np.bincount(owner, minlength=len(left))
            hit = found > 0
            out[left[hit]] = table.sums(at, owner, len(left))[hit] / found[hit, None]
            left = left[~hit]
        return out


def gram_counts(lang: np.ndarray, words: list[str], n: np.ndarray) -> pd.DataFrame:
    """Counts (l, o, h, n) of n-grams by language, order and hash, from counts of words; order 0 are the words."""
    out = [pd.DataFrame({"l": lang, "o": 0, "h": word_hashes(words), "n": n})]
    for order in ORDERS:
        hashes, owner = gram_hashes(words, order)
        out.append(pd.DataFrame({"l": lang[owner], "o": order, "h": hashes, "n": n[owner]}))
    both = pd.concat(out).groupby(["l", "o", "h"], as_index=False, sort=False)["n"].sum()
    return both.assign(h=both["h"].to_numpy("uint64").view("int64"))


def model_of(languages: list[str], counts: dict[str, np.ndarray]) -> Model:
    """The model of summed ``gram_counts``, l the place of a language."""
    tables = []
    for order in (0, *ORDERS):
        mine = np.flatnonzero(counts["o"] == order)
        tables.append(Table.of(counts["l"][mine].astype("int64"), counts["h"][mine].astype("int64").view("uint64"), counts["n"][mine], len(languages)))
    return Model(languages, tables[0], tables[1:])


def train(counts: dict[str, dict[str, int]]) -> Model:
    """The model of word counts by language."""
    languages = sorted(counts)
    rows = [(i, w, n) for i, la in enumerate(languages) for w, n in counts[la].items()]
    lang, words, n = ([r[i] for r in rows] for i in range(3))
    return model_of(languages, {c: v.to_numpy() for c, v in gram_counts(np.array(lang, "int64"), words, np.array(n, "int64")).items()})


def drawn_pieces(text: str, rate: float) -> list[str]:
    """The pieces of a drawn text that count: each with probability ``rate``, by a hash; a text of one piece counts whole."""
    if len(text) <= PIECE:
        return [text]
    seed = xxhash.xxh64_intdigest(text)
    return [text[lo : lo + PIECE] for lo in range(0, len(text), PIECE) if xxhash.xxh64_intdigest(str(lo), seed) < rate * (1 << 64)]


def draw_rates(per: list[tuple[str, int, int]], max_train: int, train_chars: int) -> dict[str, float]:
    """Language: the share of its text that is drawn, from (language, rows, bytes)."""
    rows, size = sum(n for _, n, _ in per), sum(c for _, _, c in per)
    share = min(1.0, max_train / max(1, rows), train_chars / max(1, size))
    return {la: max(share, min(1.0, LEAST_TRAIN / max(1, n), train_chars / len(per) / max(1, c))) for la, n, c in per}


def _most_frequent(counts: DataFrame, languages: int) -> DataFrame:
    """All counts if they are ``MODEL_ROWS`` at most; else of each language as many as it has a part in these, the largest."""
    top, room = 1 << 12, MODEL_ROWS // max(1, languages)
    if counts.count() <= MODEL_ROWS:
        return counts
    found: dict[int, Counter] = defaultdict(Counter)
    for r in counts.groupBy("l", F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect():
        found[r["l"]][r["n"]] = r["rows"]
    least = []
    for la, by in found.items():
        cut, kept = top + 1, 0
        for n in sorted(by, reverse=True):
            if (kept := kept + by[n]) > room:
                break
            cut = n
        least.append((la, cut))
    cuts = counts.sparkSession.createDataFrame(least, "l int, least long")
    return counts.join(F.broadcast(cuts), "l").where("n >= least").drop("least")  # a row a language


def fit(training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN, train_chars: int = TRAIN_CHARS) -> Model:
    """The model of a sample of the rows of ``training`` with text and lang; without any, a model of no language.

    Null keys, repeated rows and other columns are allowed; equal rows are drawn together.
    """
    spark = training.sparkSession
    rows = training.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("t is not null and l is not null")
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("c"))
    per = [(r["l"], r["n"], r["c"]) for r in sizes.orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()]
    languages = sorted(la for la, _, _ in per)
    rates = draw_rates(per, max_train, train_chars)
    table = spark.createDataFrame([(la, i, rates[la]) for i, la in enumerate(languages)], "l string, place int, rate double")
    scratch = Scratch(spark, "language")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            of = [(la, w, n) for la, words in totals.items() for w, n in words.items()]
            totals.clear()
            return pa.record_batch([pa.array([r[i] for r in of], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["l", "w", "n"])

        for batch in batches:
            for t, la, rate in zip(*(batch.column(i) for i in range(3))):
                for piece in drawn_pieces(t.as_py(), rate.as_py()):
                    totals[la.as_py()].update(words_of(piece.lower()))
                    if sum(map(len, totals.values())) > COUNT_ENTRIES:
                        yield flush()
        yield flush()

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), BATCH_CHUNKS):
                part = batch.iloc[lo : lo + BATCH_CHUNKS]
                yield gram_counts(part["l"].to_numpy(), part["w"].tolist(), part["n"].to_numpy())

    pieces = F.greatest(F.ceil(F.char_length("t") / F.lit(PIECE)), F.lit(1))
    mine = rows.join(F.broadcast(table), "l")  # MAX_LANGUAGES rows at most
    # a text of many pieces is drawn more often, and fewer of its pieces are
    drawn = mine.where(F.pmod(F.xxhash64(F.lit(7), "k", "t"), F.lit(1 << 20)) < F.ceil(F.col("rate") * pieces * (1 << 20))).withColumn("rate", F.greatest("rate", 1 / pieces))
    words = drawn.select("t", "place", "rate").mapInArrow(count, "l int, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    counts = scratch.save(words.mapInPandas(grams, "l int, o int, h long, n long").groupBy("l", "o", "h").agg(F.sum("n").alias("n")), "counts")
    found = _most_frequent(counts, len(languages)).toArrow()
    model = model_of(languages, {c: found.column(c).to_numpy() for c in ("l", "o", "h", "n")})
    scratch.drop_all()
    return model


class Scorer:
    """Scores of texts; a bounded table holds the summed word scores of space-delimited chunks."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.most = min(TABLE_ENTRIES, TABLE_SCORES // max(1, len(model.languages)))
        self.matrix = np.zeros((self.most, len(model.languages)))

    def chunk_scores(self, chunks: list[str]) -> np.ndarray:
        words, owner = [], []
        for i, c in enumerate(chunks):
            found = words_of(c.lower())
            words += found
            owner += [i] * len(found)
        out = np.zeros((len(chunks), len(self.model.languages)))
        np.add.at(out, owner, self.model.word_scores(words))
        return out

    def scores(self, text: str) -> np.ndarray:
        chunks, rows = text.split(), self.rows
        extra = np.zeros(len(self.model.languages))
        new = [c for c in dict.fromkeys(chunks) if c not in rows]
        if len(rows) + len(new) > self.most:
            rows.clear()
            new = list(dict.fromkeys(chunks))
        once = {}
        for lo in range(0, len(new), BATCH_CHUNKS):
            part = new[lo : lo + BATCH_CHUNKS]
            for c, s in zip(part, self.chunk_scores(part)):
                if len(c) > TABLE_CHUNK or len(rows) >= self.most:
                    once[c] = s
                else:
                    rows[c] = len(rows)
                    self.matrix[rows[c]] = s
        if once:
            for c in chunks:
                if c in once:
                    extra += once[c]
            chunks = [c for c in chunks if c not in once]
        return extra + self.matrix[[rows[c] for c in chunks]].sum(axis=0)

    def learn(self, texts: list[str | None]) -> None:
        """Score the chunks that many texts share at once, as far as the table has room."""
        rows = self.rows
        new = list(dict.fromkeys(c for t in texts if t for c in t.split() if c not in rows and len(c) <= TABLE_CHUNK))
        if len(rows) + len(new) > self.most:
            rows.clear()
            return
        for lo in range(0, len(new), BATCH_CHUNKS):
            part = new[lo : lo + BATCH_CHUNKS]
            self.matrix[len(rows) : len(rows) + len(part)] = self.chunk_scores(part)
            rows.update(zip(part, range(len(rows), len(rows) + len(part))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages or not has_letter(text):
            return "und", 0.0
        s = self.scores(text)
        p = np.exp(s - s.max())
        return self.model.languages[int(s.argmax())], float(1 / p.sum())


_scorers: dict[int, Scorer] = {}


def labelled(df: DataFrame, model: Model, text: str, keep: list) -> DataFrame:
    """Columns ``keep``, and _label: a struct of lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        ident = id(shared.value)
        if ident not in _scorers:
            _scorers.clear()
            _scorers[ident] = Scorer(shared.value)
        scorer, out, texts = _scorers[ident], [], texts.tolist()
        for lo in range(0, len(texts), 256):
            scorer.learn(texts[lo : lo + 256])
            out += [scorer.predict(t) for t in texts[lo : lo + 256]]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return df.select(*keep, label(F.col(f"`{text}`")).alias("_label"))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, lang_pred, score.

    ``und`` with score 0 where the text is null, empty or without a letter, or where
    the model has no language.  Ties go to the language first in alphabetical order.
    Repeated rows, null keys and an empty table pass row by row; other columns are
    ignored.
    """
    return labelled(df, model, text, [F.col(f"`{key}`").alias("_key")]).select(F.col("_key").alias(key), "_label.*")


def keep_known(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all their columns, whose language is known with a score of ``least``.

    Rows without a text or without a letter go; repeated rows, null keys and an empty
    table pass row by row; columns of any name stay as they are.
    """
    rows = labelled(df, model, text, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")])
    return rows.where((F.col("_label.lang_pred") != "und") & (F.col("_label.score") >= least)).select("_row.*")


def held_out(key: str = "doc_id"):
    """The fold that training never sees: crc32 of the key as text, modulo 3, is 1 (a null key: not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(3)) == 1, F.lit(False))
