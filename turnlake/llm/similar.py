"""Groups of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 and more.

Candidates come from SimHash, as in ``near_dedup``: fingerprints of the same shingles that
are equal or within 4 bits by one-wildcard signatures.  Further ones come from MinHash: ``BANDS`` bands of ``ROWS`` minima; two texts that share
a band's signature are candidates.  At a similarity of exactly 0.8 a pair shares none
with a chance of (1 - 0.8 ^ 5) ^ 32, about 3e-6, and at 0.9 of 1e-12.  (A 64-bit
SimHash alone can't: such pairs differ in up to 14 bits, which takes eight segments of eight
bits, too short to tell texts apart.)  Candidates that a sketch of 128 one-bit minima
or the sizes of the sets rule out are left, all others are compared by their whole
sets before they are linked.

Members of a signature are compared within their task, by sketches only, and a task
sends no more than it needs: in the first round a forest, in which each member is the
far end of one pair at most.  The sketch that decides has ``PARITY_BITS`` or more bits a
shingle, each the parity of the shingles dealt to it; two sets differ in at least as many
shingles as their parities do in bits, so no similar pair is ruled out, and few that
stay are below 0.75.  Pairs of the forest are compared by their whole sets.  The members
of signatures that the links found don't connect are compared once more, and then every
pair that passes and isn't connected is sent.  So all pairs of a signature are linked,
ruled out or connected otherwise, and rows grow with the members and with the pairs from
about 0.75 to 0.8, not with the square of a group.  A task holds ``BLOCK`` members of a
signature, or two such blocks: larger ones meet block by block.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.near_dedup import components, near_links, shingle_hashes, simhash
from turnlake.llm.scratch import Scratch

SHINGLE = 5
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 32, 5
#: Bits of two sketches that may differ: 12.8 are expected at 0.8, and 40 is eight standard deviations off.
MAX_SKETCH = 40
#: Members of a signature that one task compares with each other.
BLOCK = 4096
#: Least bits of parity a shingle, and most of a text.
PARITY_BITS, MAX_PARITY = 2, 1 << 16
BATCH = 256
#: Bits of the filter of fingerprints whose sets are to be compared.
FILTER_BITS = 1 << 24

_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), "uint64")
_ODD = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), "uint64") | np.uint64(1)
_BAND = _rng.integers(0, 1 << 64, BANDS, "uint64")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def set_print(found: np.ndarray) -> int:
    """The name of a set as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype("int64"))


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo("uint64").max, "uint64")
    for lo in range(0, len(found), 512):
        np.minimum(out, ((found[lo : lo + 512] ^ _XOR) * _ODD).min(axis=1), out=out)
    return out


def signatures(low: np.ndarray) -> np.ndarray:
    """One signature a band, as signed longs."""
    rows, out = low.reshape(BANDS, ROWS), _BAND.copy()
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view("int64")


def sketch(low: np.ndarray) -> np.ndarray:
    """Two signed longs of one bit for each of 128 minima."""
    mixed = (low[:128] ^ (low[:128] >> np.uint64(29))) * _MIX
    return np.packbits((mixed >> np.uint64(63)).astype("u1")).view("int64")


def parity(found: np.ndarray) -> bytes:
    """For each of 64, 128, ... bits the parity of the shingles whose hash has it as remainder."""
    size = 64
    while size < MAX_PARITY and size < PARITY_BITS * len(found):
        size *= 2
    odd = np.bincount((found & np.uint64(size - 1)).astype("int64"), minlength=size) & 1
    return np.packbits(odd.astype("u1")).tobytes()


PRINTS = "fp long, sim long, n long, s0 long, s1 long, par binary, sigs array<long>"


def prints(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        hashes = shingle_hashes(t, SHINGLE)
        found = np.unique(hashes)
        low = minima(found)
        out.append((set_print(found), int(np.uint64(simhash(hashes)).astype("int64")), len(found), *sketch(low).tolist(), parity(found), signatures(low)))
    return pd.DataFrame(out, columns=["fp", "sim", "n", "s0", "s1", "par", "sigs"])


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by signature, those with a neighbour in theirs, numbered within it."""
    rest: pd.DataFrame | None = None
    before, nth = None, 0
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        sig = rows["sig"].to_numpy()
        same = sig[1:] == sig[:-1]
        starts = np.r_[before is None or sig[0] != before, ~same]
        at = np.arange(len(sig))
        first = np.maximum.accumulate(np.where(starts, at, -1))
        number = np.where(first < 0, nth + at, at - first)
        keep = (~starts)[:-1] | same
        yield rows[:-1].assign(nth=number[:-1])[keep]
        before = sig[-2] if len(sig) > 1 else before
        rest, nth = rows[-1:], int(number[-1])
    if rest is not None and before is not None and rest["sig"].iloc[0] == before:
        yield rest.assign(nth=nth)


def _parities(pars: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Size of each parity in bytes, its place among those of its size, and one matrix a size."""
    size = np.fromiter(map(len, pars), "int64", len(pars))
    place, by_size = np.zeros(len(pars), "int64"), {}
    for width in np.unique(size).tolist():
        at = np.flatnonzero(size == width)
        place[at] = np.arange(len(at))
        by_size[width] = np.frombuffer(b"".join(pars[at]), "uint64").reshape(len(at), -1)
    return size, place, by_size


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities of more bits as those of ``words`` words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


class _Members:
    """The members of one signature, or of two blocks of it."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.rows, self.cross = rows, rows["lo"][0] != rows["hi"][0]
        self.parities = None

    def near(self, a: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` may be similar to member ``a`` and aren't connected to it."""
        n, s0, s1, root, block = (self.rows[c] for c in ("n", "s0", "s1", "root", "block"))
        others = others[root[others] != root[a]]
        if self.cross:
            others = others[block[others] != block[a]]
        differ = np.bitwise_count((s0[others] ^ s0[a]).view("uint64")).astype("int64") + np.bitwise_count((s1[others] ^ s1[a]).view("uint64"))
        small, large = np.minimum(n[others], n[a]), np.maximum(n[others], n[a])
        others = others[(differ <= MAX_SKETCH) & (UNDER * small >= OVER * large)]
        if not len(others):
            return others
        if self.parities is None:
            self.parities = _parities(self.rows["par"])
        size, place, by_size = self.parities
        differ = np.zeros(len(others), "int64")
        for width in np.unique(size[others]).tolist():
            which = np.flatnonzero(size[others] == width)
            words = min(width, int(size[a])) // 8
            mine = _folded(by_size[int(size[a])][place[a]][None], words)
            for lo in range(0, len(which), BATCH):
                part = which[lo : lo + BATCH]
                theirs = _folded(by_size[width][place[others[part]]], words)
                differ[part] = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype="int64")
        # sets of s shingles together whose shared share is OVER / UNDER differ in s (UNDER - OVER) / (UNDER + OVER)
        return others[(UNDER + OVER) * differ <= (UNDER - OVER) * (n[others] + n[a])]

    def forest(self) -> Iterator[tuple[int, np.ndarray]]:
        left = np.arange(len(self.rows["fp"]))
        while len(left):
            reached, left = [left[:1]], left[1:]
            while reached and len(left):
                a, reached[0] = int(reached[0][0]), reached[0][1:]
                if not len(reached[0]):
                    reached.pop(0)
                new = self.near(a, left)
                if len(new):
                    yield a, new
                    reached.append(new)
                    left = np.setdiff1d(left, new, assume_unique=True)

    def every(self) -> Iterator[tuple[int, np.ndarray]]:
        for a in range(len(self.rows["fp"]) - 1):
            near = self.near(a, np.arange(a + 1, len(self.rows["fp"])))
            if len(near):
                yield a, near


def _pairs(every: bool):
    """Pairs to compare, of a partition sorted by signature and block: a forest, or every one."""

    def found(rows: dict[str, np.ndarray], starts: np.ndarray) -> pd.DataFrame:
        us, vs = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for at, to in itertools.pairwise(starts.tolist()):
            if to - at > 1:
                members = _Members({c: x[at:to] for c, x in rows.items()})
                fp = members.rows["fp"]
                for a, near in members.every() if every else members.forest():
                    us.append(np.full(len(near), fp[a]))
                    vs.append(fp[near])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = {c: batch[c].to_numpy() for c in batch.columns}
            rows = new if rest is None else {c: np.concatenate([rest[c], new[c]]) for c in new}
            other = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("sig", "lo", "hi")])
            starts = np.flatnonzero(np.r_[True, other])
            rest = {c: x[starts[-1] :] for c, x in rows.items()}
            if len(starts) > 1:
                yield found(rows, starts)
        if rest is not None:
            yield found(rest, np.array([0, len(rest["sig"])]))

    return scan


def _sets_of(spark, words: dict[int, int]):
    """Fingerprint and set of the texts whose fingerprints pass the filter; within a task each once."""
    bits = np.zeros(FILTER_BITS // 64, "int64")
    bits[list(words.keys())] = list(words.values())
    shared = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                out = []
                for t in batch["t"].iloc[at : at + BATCH]:
                    found = shingle_set(t)
                    fp = set_print(found)
                    place = fp % FILTER_BITS
                    if int(shared.value[place // 64]) >> place % 64 & 1 and fp not in seen:
                        seen.add(fp)
                        out.append((fp, found.view("int64")))
                yield pd.DataFrame(out, columns=["fp", "set"])

    return sets


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs u < v of sets to compare: those of one SimHash with the least of it, and the least of near ones."""
    first = nodes.groupBy("sim").agg(F.min("fp").alias("first"))
    same = nodes.select("sim", "fp").join(first, "sim").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    ends = [first.select(F.col("sim").alias(c), F.col("first").alias(f"_{c}")) for c in "uv"]
    near = near_links(first.select(F.col("sim").alias("fp"))).join(ends[0], "u").join(ends[1], "v")
    return same.unionByName(near.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")))


def _components(table: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns fp and root of all fingerprints of ``table``; ``docs`` has their texts in t."""
    spark = table.sparkSession
    nodes = scratch.save(table.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("sim", "n", "s0", "s1", "par", "sigs")]), "nodes")
    near = scratch.save(_simhash_pairs(nodes), "simhash")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = nodes.select(F.explode("sigs").alias("sig"), "fp").repartition(parts, "sig").sortWithinPartitions("sig")
    shared = scratch.save(signed.mapInPandas(_shared, "sig long, fp long, nth long"), "shared")
    # what any round may compare are members of signatures and pairs of SimHash
    asked = shared.select("fp").unionByName(near.select(F.explode(F.array("u", "v")).alias("fp")))
    words = asked.select(F.pmod("fp", F.lit(FILTER_BITS)).alias("place")).groupBy(F.expr("place div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("b")).toArrow().to_pydict()
    sets = docs.select("t").mapInPandas(_sets_of(spark, dict(zip(words["w"], words["b"]))), "fp long, set array<long>")
    sets = scratch.save(sets.groupBy("fp").agg(F.first("set").alias("set")), "sets")
    sketches = nodes.select("fp", "n", "s0", "s1", "par")

    def linked(rows: DataFrame, every: bool, name: str, more: DataFrame | None = None) -> DataFrame:
        """The pairs of similar sets among those that ``_pairs`` finds and ``more``."""
        rows = rows.join(sketches, "fp").select("sig", "lo", "hi", "block", "fp", "root", "n", "s0", "s1", "par")
        rows = rows.repartition(parts, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "fp")
        pairs = rows.mapInPandas(_pairs(every), "u long, v long")
        pairs = scratch.save((pairs if more is None else pairs.unionByName(more)).distinct(), f"pairs-{name}")
        a, b = (sets.select(F.col("fp").alias(c), F.col("set").alias(f"set_{c}")) for c in "uv")
        both = F.size(F.array_intersect("set_u", "set_v"))
        similar = pairs.join(a, "u").join(b, "v").where(UNDER * both >= OVER * (F.size("set_u") + F.size("set_v") - both)).select("u", "v")
        return scratch.save(similar, f"similar-{name}")

    block = F.expr(f"nth div {BLOCK}")
    own = shared.select("sig", "fp", F.col("fp").alias("root"), block.alias("block")).withColumns({"lo": F.col("block"), "hi": F.col("block")})
    roots = scratch.save(components(linked(own, False, "own", near), scratch, "own-"), "roots-own")
    for every, name in ((False, "blocks"), (True, "every")):
        named = shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", "nth", F.coalesce("root", "fp").alias("root"))
        open_ = named.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max(block).alias("last"))
        # signatures of one block have had their forest
        open_ = open_.where((F.col("a") < F.col("b")) & (F.lit(every) | (F.col("last") > 0))).select("sig", "last")
        open_ = scratch.save(named.join(open_, "sig").withColumn("block", block), f"open-{name}")
        if not open_.limit(1).count():
            continue
        with_ = F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("with")
        rows = open_.select("sig", "fp", "root", "block", with_).withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
        similar = linked(rows, every, name)
        links = similar.unionByName(roots.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")))
        roots = scratch.save(components(links, scratch, f"{name}-"), f"roots-{name}")
        scratch.drop_but("prints", "nodes", "shared", "sets", f"roots-{name}")
    scratch.drop("simhash", "shared", "sets", "open-blocks", "open-every")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, fingerprint (of the set of shingles), component_id (the smallest key reachable).

    Texts without words are one group; repeated rows are in one group; null keys never
    name a group unless all of its keys are null; an empty table gives an empty one.
    """
    scratch = Scratch(df.sparkSession, "similar")
    docs = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
    table = scratch.save(docs.select("id", F.pandas_udf(prints, PRINTS)("t").alias("p")).select("id", "p.*"), "prints")
    named = _components(table, docs, scratch)
    first = table.groupBy("fp").agg(F.min("id").alias("first"))
    named = scratch.save(named.join(first, "fp"), "named")
    scratch.drop_but("prints", "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = named.join(least, "root").select("fp", "component_id")
    return table.join(groups, "fp").select(F.col("id").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns as they are, that have the smallest key of their group.

    One row of a group stays, whatever keys repeat; where a group has no key at all, one
    of its rows.  Null texts are like empty ones; an empty table gives an empty one.
    """
    scratch = Scratch(df.sparkSession, "similar")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(row, F.col(f"`{key}`").alias("id"), F.monotonically_increasing_id().alias("at"), F.pandas_udf(prints, PRINTS)(F.col(f"`{text}`")).alias("p"))
    table = scratch.save(rows.select("_row", "id", "at", "p.*"), "prints")
    named = _components(table, table.select(F.col("_row").getField(text).alias("t")), scratch)
    first = table.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"))
    least = named.join(first, "fp").groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.at").alias("at"))
    least = scratch.save(least, "least")
    scratch.drop_but("prints", "least")
    return table.join(least, "at", "left_semi").select("_row.*")
