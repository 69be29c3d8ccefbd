"""Document fingerprints by winnowing, in native expressions only.

Tokens are words of up to ``WORD`` characters and single characters of longer runs
without a blank, so that text without blanks has tokens that don't depend on where a
run starts.  Tokens are hashed; hashes of ``K`` tokens in a row are rolled up by
doubling (one token, two, four), and in every window of ``WINDOW`` such k-grams the
smallest hash is selected, the rightmost on a tie.  A mark packs the hash and the
complement of its position into one long, so a plain minimum does both.  Marks keep
their positions: any K + WINDOW - 1 tokens in a row that two texts share put a common
hash into both fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.ranges import NOT_BLANK, long_array, range_index

K = 4
WINDOW = 4
POSITION_BITS = 30
WORD = 16
#: Rows of a bucket of neighbouring keys, about, and keys drawn for each.
BUCKET_ROWS = 400
DRAWN_PER_BUCKET = 16
#: Beyond so many buckets (whole numbers as keys, and other keys) buckets get larger; a bucket's window streams and spills.
MOST_BUCKETS = (65_536, 4096)


#: A word of up to ``WORD`` characters, or else one character.
TOKEN = rf"(?<!{NOT_BLANK}){NOT_BLANK}{{1,{WORD}}}+(?!{NOT_BLANK})|{NOT_BLANK}"


def _shifted(a: str, shift: int, n: Column, join) -> Column:
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + shift), n), join)


def with_marks(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sorted-by-position array of marks of column ``text`` (empty without words).

    Fewer than K words: one mark of them all.  Fewer than WINDOW k-grams: the smallest.
    """
    n = F.size("_w")
    rows = df.withColumn("_w", F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_w2", _shifted("_w", 1, n - 1, lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("_w4", F.when(n >= K, _shifted("_w2", 2, n - 3, lambda a, b: F.xxhash64(a, b))).when(n > 0, F.array(F.xxhash64("_w"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    last = (1 << POSITION_BITS) - 1
    rows = rows.withColumn("_e", F.transform("_w4", lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 63 + POSITION_BITS), POSITION_BITS) + (F.lit(last).cast("long") - i))).drop("_w", "_w2", "_w4")
    m = F.size("_e")
    rows = rows.withColumn("_e2", _shifted("_e", 1, m - 1, lambda a, b: F.least(a, b)))
    rows = rows.withColumn(out, F.when(m >= WINDOW, F.array_distinct(_shifted("_e2", 2, m - 3, lambda a, b: F.least(a, b)))).when(m > 0, F.array(F.array_min("_e"))).otherwise(F.col("_e")))
    return rows.drop("_e", "_e2")


def positions(marks: Column) -> Column:
    """Word positions of marks."""
    return F.transform(marks, lambda x: ((1 << POSITION_BITS) - 1 - x.bitwiseAND((1 << POSITION_BITS) - 1)).cast("int"))


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def digest(marks: Column) -> Column:
    """A fingerprint as a short string: MD5 of its marks."""
    return F.md5(F.array_join(marks.cast("array<string>"), ","))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, hashes array<long> and positions array<int> of the marks in order of selection.

    Null and empty texts have empty fingerprints; rows, with null or repeated keys too,
    pass one by one without a shuffle; an empty table gives an empty one; other columns
    are ignored.
    """
    return with_marks(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_t")), "_t", "_m").select(
        key, F.transform("_m", lambda x: F.shiftrightunsigned(x, POSITION_BITS)).alias("hashes"), positions(F.col("_m")).alias("positions")
    )


def _cut_index(value: Column, cuts: list) -> tuple[Column, Column]:
    """How many of the sorted ``cuts`` are at or below ``value`` (null: none), and whether it equals one of them."""
    if not cuts:
        return F.lit(0), F.lit(False)
    if isinstance(cuts[0], int):
        table, at = long_array(cuts), F.coalesce(range_index(value, cuts), F.lit(0))
    else:
        table = F.array(*[F.lit(c) for c in cuts])
        at = F.coalesce(F.size(F.filter(table, lambda c: c <= value)), F.lit(0))
    return at, (at > 0) & F.coalesce(F.element_at(table, F.greatest(at, F.lit(1))) == value, F.lit(False))


def with_next(df: DataFrame, key: str) -> tuple[DataFrame, W]:
    """Rows dealt into buckets of neighbouring keys, and the window in which the next row is that of the next key.

    A bucket starts at a key of the table; the rows of that key are also dealt, as
    ghosts (``_ghost`` 1) behind all others, to the bucket before, and those of the
    first key to the last bucket.  So every real row finds its successor in its own
    bucket.  Keys are of any type that can be ordered; null keys come first; equal keys
    are ordered by ``_tie``.  The key is column ``_o``.
    """
    kind = df.schema[key].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    rows = df.withColumn("_o", F.col(f"`{key}`").cast("long") if whole else F.col(f"`{key}`"))
    n, nulls, first = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("_o").isNull(), 1)), F.min("_o")).first()
    buckets = max(1, min(MOST_BUCKETS[0] if whole else MOST_BUCKETS[1], n // BUCKET_ROWS))
    share = min(1.0, buckets * DRAWN_PER_BUCKET / max(n, 1))
    ids = rows.select("_o").where("_o is not null")
    drawn = ids.where(F.pmod(F.xxhash64(F.lit(3), "_o"), F.lit(1 << 20)) < int(share * (1 << 20))).distinct().orderBy("_o").collect() if buckets > 1 else []
    drawn = [r[0] for r in drawn]
    cuts = [drawn[i * len(drawn) // buckets] for i in range(1, buckets)] if drawn else []
    cuts = [c for i, c in enumerate(cuts) if c != first and (i == 0 or c != cuts[i - 1])]
    at, starts = _cut_index(F.col("_o"), cuts)
    head = F.col("_o").isNull() if nulls else F.col("_o") == F.lit(first)
    rows = rows.withColumn("_b", at)
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.when(head, F.lit(len(cuts))).otherwise(F.col("_b") - 1).alias("b"), F.lit(1).alias("g"))
    rows = rows.withColumn("_to", F.explode(F.when(F.coalesce(head, F.lit(False)) | starts, F.array(own, ghost)).otherwise(F.array(own)))).drop("_b")
    rows = rows.select("*", F.col("_to.b").alias("_b"), F.col("_to.g").alias("_ghost")).drop("_to")
    return rows, W.partitionBy("_b").orderBy("_ghost", F.asc_nulls_first("_o"), "_tie")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts, of edited texts and of the next documents.

    Per row: ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  The edited text is the text with its last quarter of code
    points (rounded down) replaced by as many first ones, or all, of the next document
    by ``key``, of any type that can be ordered; the first follows the last, and a
    single row follows itself.  Null texts are empty; equal keys are ordered by the hash and length of their texts;
    null keys come first; an empty table gives an empty one; other columns are ignored.
    Each text is shuffled once, to its neighbours.
    """
    docs = df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    docs = docs.withColumn("_tie", F.struct(F.xxhash64("_text"), F.octet_length("_text")))
    rows, order = with_next(docs, "_key")
    rows = rows.withColumn("_next", F.lead("_text").over(order))
    rows = with_marks(rows, "_text", "_marks")
    rows = rows.withColumn("_hashes", hashes(F.col("_marks")))
    rows = rows.withColumn("_next_hashes", F.lead("_hashes").over(order)).where("_ghost = 0")
    n = F.char_length("_text")
    quarter = F.expr("char_length(_text) div 4").cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - quarter), F.substring(F.col("_next"), F.lit(1), quarter)))
    rows = rows.select("_key", n.cast("long").alias("n_chars"), "_edited", "_marks", "_hashes", "_next_hashes", F.sha2("_edited", 256).alias("edited_sha256"))
    rows = with_marks(rows, "_edited", "_edited_marks")
    rows = rows.withColumn("_edited_hashes", hashes(F.col("_edited_marks")))
    return rows.select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", digest(F.col("_marks")).alias("fingerprint"), digest(F.col("_edited_marks")).alias("edited_fingerprint"),
        likeness("_hashes", "_edited_hashes").alias("near_edited"), likeness("_hashes", "_next_hashes").alias("near_next"),
    )
