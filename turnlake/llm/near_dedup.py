"""SimHash near-duplicate groups by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 4 bits, cut into 3 segments, differ
by at most one bit in some segment (two in each would be 6).  So every distinct
fingerprint is indexed under each segment with one bit made a wildcard: 64
signatures of 20 or 21 bits.  Fingerprints that share a signature are compared
(equality join and verification in one sorted pass), and a signature's members send
on only links that span them, never all pairs.  Rows with one fingerprint are one
node; groups are the connected components of the links, found by alternating large
and small stars.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from turnlake.llm.scratch import Scratch

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: (lowest bit, width) of the segments
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Members of a signature that are compared without cutting them anew.
DIRECT = 4096

_ONE = np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles of lower-cased (A-Z) words, in order; fewer words are one shingle, and no words none."""
    words = (text or "").encode().lower().split()
    body = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([h(body, SEED)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array([h(body[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of the shingles; 0 without words."""
    return simhash(shingle_hashes(text, shingle))


def simhash(found: np.ndarray) -> int:
    """Unsigned SimHash of hashes; 0 without any."""
    bits = np.zeros(64, "int64")
    for lo in range(0, len(found), 1 << 16):
        part = found[lo : lo + (1 << 16)]
        bits += np.unpackbits(part.view("u1").reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * bits > len(found), bitorder="little").view("<u8")[0])


def spanning_links(values: np.ndarray, depth: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between distinct ``values`` that connect all those connected by steps of at most ``MAX_BITS`` bits."""
    if len(values) > DIRECT and depth == 0:
        out = []
        for bit in range(64):  # the same cut again, into bits by their remainder, within this signature only
            mask = np.uint64(sum(1 << b for b in range(bit % 3, 64, 3) if b != bit))
            order = np.argsort(values & mask, kind="stable")
            cut = (values & mask)[order]
            edges = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    out += spanning_links(values[order[a:b]], 1)
        return out
    left, out = values.copy(), []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.bitwise_count(left ^ reached[0]) <= MAX_BITS
            if near.any():
                new = left[near]
                out.append((np.full(len(new), reached[0]), new))
                reached, left = np.r_[reached[1:], new], left[~near]
            else:
                reached = reached[1:]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a partition sorted by signature."""
    rest_k, rest_v = np.zeros(0, "int64"), np.zeros(0, "uint64")

    def found(keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(edges)
        pairs = edges[:-1][sizes == 2]
        a, b = values[pairs], values[pairs + 1]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        parts = [(a[near], b[near])]
        for at, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
            parts += spanning_links(values[at : at + size])
        a, b = (np.concatenate([p[i] for p in parts]).view("int64") for i in (0, 1))
        return pd.DataFrame({"u": np.minimum(a, b), "v": np.maximum(a, b)}).drop_duplicates()

    for rows in batches:
        keys, values = np.r_[rest_k, rows["sig"].to_numpy()], np.r_[rest_v, rows["fp"].to_numpy().view("uint64")]
        whole = np.searchsorted(keys, keys[-1], "left") if len(keys) else 0
        rest_k, rest_v = keys[whole:], values[whole:]
        if whole:
            yield found(keys[:whole], values[:whole])
    if len(rest_k):
        yield found(rest_k, rest_v)


def signatures(fps: DataFrame) -> DataFrame:
    """Columns sig and fp: the 64 one-wildcard signatures of each distinct fingerprint in ``fp``."""
    each = []
    for low, width in SEGMENTS:
        for bit in range(width):
            tag, mask = (low + bit) << 32, ((1 << width) - 1) ^ (1 << bit)
            each.append(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit(tag).cast("long")))
    return fps.select(F.explode(F.array(*each)).alias("sig"), "fp")


def near_links(fps: DataFrame) -> DataFrame:
    """Links u < v that connect the distinct fingerprints in ``fp`` as steps of at most ``MAX_BITS`` bits do."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = signatures(fps).repartition(4 * parts, "sig").sortWithinPartitions("sig")
    return signed.mapInPandas(_links, "u long, v long").distinct()


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a task as stars: every node with the least one it reaches within the batch."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)  # noqa: B023
            return root

        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        roots = [find(x) for x in nodes]
        yield pd.DataFrame({"u": nodes, "v": roots}, dtype="int64").query("u != v")


def components(links: DataFrame, scratch: Scratch, prefix: str = "") -> DataFrame:
    """Node and root (the least node of its component) of every node in the links u < v.

    Links are first made stars within their task; rounds of large and small stars go on
    until all are stars whose middle is no other's point.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("m", "u").alias("m"))

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count()

    edges = scratch.save(links.select("u", "v").mapInPandas(_contracted, "u long, v long").distinct(), f"{prefix}small--1")
    for turn in itertools.count():
        if stars(edges):
            break
        sides = both(edges)
        star = sides.join(least(sides), sides["u"] == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = scratch.save(star, f"{prefix}large-{turn}")
        low = least(star)
        small = star.join(low, star["u"] == low["n"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = scratch.save(small, f"{prefix}small-{turn}")
        scratch.drop(f"{prefix}large-{turn}", f"{prefix}small-{turn - 1}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``key``, fingerprint (16 hex digits), component_id (the smallest key reachable).

    Null and empty texts and texts without words have fingerprint zero, linked like
    any other; repeated rows are in one group; null keys never name a group unless all
    of its keys are null; an empty table gives an empty one; other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near-dedup")

    @F.pandas_udf(LongType())
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], "uint64").view("int64"))

    rows = scratch.save(df.select(F.col(key).alias("id"), prints(F.col(text)).alias("fp")), "prints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    links = scratch.save(near_links(nodes.select("fp")), "links")
    roots = components(links, scratch)
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = scratch.save(named, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = named.join(least, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
