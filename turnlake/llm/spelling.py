"""Spelling variants: words one edit apart, each led to its most frequent near form.

Two words one inserted, deleted or replaced code point apart share one of their three
rarest bigrams, in any order of the bigrams that is the same for all words: an edit
touches two bigrams of a word at most, and the rarest of the others is among the first
three of both.  Bigrams are ordered by their number in the vocabulary, rare ones first.

The bigram that is shared also limits positions: the edit is before or after it, so all
text on its other side is equal, and stands at the same distance from that end of both
words.  Of the rest the edit touches one half only, so the other half is equal too.
Words are joined on a hash of bigram, equal side, equal half and length, and every pair
is then verified by its edit distance.  So candidates are pairs that agree in most of
their characters, not all pairs with a common bigram.

The corpus is read once.  Tasks count words in bounded tables; everything after it
works on the vocabulary.  Nothing is collected but the counts of bigrams, of which the
alphabet of 90 letters allows 8,100.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.scratch import Scratch
from turnlake.session import shuffled

#: Letters of a run after A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+").findall
RAREST = 3
#: Entries of a task's table of counts before it is handed on.
TABLE_ENTRIES = 300_000


def run_counts(text: str, doc: str, typo_every: int) -> Iterator[tuple[str, int]]:
    """Words of one text with their counts, the planted deletions made; a word may come more than once."""
    head = zlib.crc32(f"{doc}:".encode())
    for run, n in Counter(RUN(text.encode().lower().decode())).items():  # bytes.lower() changes A-Z only
        if typo_every and (h := zlib.crc32(run.encode(), head)) % typo_every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, key: str, text: str, least_length: int, least_count: int, typo_every: int) -> DataFrame:
    """word, n of words with ``least_length`` code points and ``least_count`` occurrences."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flush(table: Counter) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], schema=schema)
        table.clear()
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Counter = Counter()
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in run_counts(t.as_py(), doc, typo_every):
                    if len(word) >= least_length:
                        table[word] += n
                if len(table) > TABLE_ENTRIES:
                    yield flush(table)
        yield flush(table)

    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.col(f"`{text}`").alias("t")).where(F.octet_length("t") > 0)
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of each bigram, the rarest in the vocabulary first, ties in code-point order."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda p: F.substring("word", p, 2))).alias("g"))
    found = pairs.groupBy("g").count().collect()
    return {g: i for i, (_, g) in enumerate(sorted((r["count"], r["g"]) for r in found))}


def rarest(word: str, ranks: dict[str, int], most: int = RAREST) -> list[int]:
    """Positions of the rarest bigrams of ``word``, ties by position."""
    return [p for _, p in sorted((ranks[word[p : p + 2]], p) for p in range(len(word) - 1))[:most]]


def keys_of(word: str, ranks: dict[str, int]) -> tuple[set[int], set[int]]:
    """Hashes of what is unchanged if one edit leaves a rare bigram of ``word`` whole: as a word that is found, and as one that seeks.

    A word seeks words of its own length and those with one code point more.
    """
    found, seeks = set(), set()
    for p in rarest(word, ranks):
        for side, fixed, rest in (("<", word[: p + 2], word[p + 2 :]), (">", word[p:], word[:p][::-1])):

            def key(length: int, half: str, same: str, side: str = side, fixed: str = fixed) -> int:
                return xxhash.xxh64_intdigest(f"{side}{length}{half}{fixed} {same}") - (1 << 63)

            cut, size = len(rest) // 2, len(word)
            found.add(key(size, "n", rest[:cut]))
            found.add(key(size, "f", rest[cut:]))
            cut = (len(rest) + 1) // 2
            seeks.add(key(size + 1, "n", rest[:cut]))
            if cut:
                seeks.add(key(size + 1, "f", rest[cut - 1 :]))
    return found, seeks | found


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """a, a_n, b, b_n: each pair of words one edit apart, once."""
    ranks = bigram_ranks(words)
    schema = pa.schema([("key", pa.int64()), ("w", pa.string()), ("n", pa.int64())])

    def keyed(which: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    keys = [keys_of(w, ranks)[which] for w in part.column(0).to_pylist()]
                    owner = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
                    yield pa.record_batch([pa.array([h for k in keys for h in k], pa.int64()), part.column(0).take(owner), part.column(1).take(owner)], schema=schema)

        return words.select("word", "n").mapInArrow(rows, "key long, w string, n long")

    seeks, found = (keyed(which).select("key", F.col("w").alias(c), F.col("n").alias(f"{c}_n")) for which, c in ((1, "a"), (0, "b")))
    shorter = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    # a word is some 24 keys, which Spark guesses from the words' compressed files
    near = seeks.join(shuffled(found), "key").where(shorter & (F.levenshtein("a", "b", 1) == 1))
    return scratch.save(near.select("a", "a_n", "b", "b_n").distinct(), "pairs")


def nearest(pairs: DataFrame, ratio: int) -> DataFrame:
    """word, n_near, form, form_n; form where the most frequent near word has ``ratio`` times the count."""
    side = [F.struct(F.col(w).alias("word"), F.col(f"{w}_n").alias("n"), F.col(o).alias("near"), F.col(f"{o}_n").alias("near_n")) for w, o in (("a", "b"), ("b", "a"))]
    both = pairs.select(F.explode(F.array(*side)).alias("_")).select("_.*")
    # near words by falling count, then in code-point order
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    led = -F.col("best.col1") >= ratio * F.col("n")
    return best.select("word", "n_near", F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.col1")).alias("form_n"))


def roots(forms: DataFrame, ratio: int, scratch: Scratch) -> DataFrame:
    """word, root of words with a form, by doubling: counts grow by ``ratio`` a step, so their logarithm bounds the steps."""
    out = forms.select("word", F.col("form").alias("root"))
    most = forms.agg(F.max("form_n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most) / math.log(ratio)))
    for nth in range(math.ceil(math.log2(steps))):
        to = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = scratch.save(out.join(shuffled(to), "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"roots-{nth}")
        if nth:
            scratch.drop(f"roots-{nth - 1}")
    return out


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, typo_every: int = 199) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased,
    at least ``least_length`` (5 or more) code points long, that occur ``least_count``
    times or more.  A run whose crc32 of ``key:run`` is a multiple of ``typo_every`` (0:
    none) loses one code point first.  ``form`` is the most frequent word one edit away,
    ties in code-point order, if it has ``ratio`` (2 or more) times the word's count, and
    ``root`` the last word that forms lead to.  Null texts have no words and a null key
    counts as an empty one; repeated rows count each; other columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, key, text, least_length, least_count, typo_every), "words")
    near = scratch.save(nearest(near_pairs(words, scratch), ratio), "near")
    scratch.drop("pairs")
    root = roots(near.where("form is not null"), ratio, scratch)
    return words.join(shuffled(near), "word", "left").join(shuffled(root), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
