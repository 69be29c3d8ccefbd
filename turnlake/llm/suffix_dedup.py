"""Removal of repeated byte strings by difference-cover blockwise suffix sorting.

Every byte position starts a suffix; a byte goes if some string of ``length`` bytes
that covers it starts at two positions.  So suffixes need to be sorted only to that
depth, and positions whose order no repeat can touch needn't be sorted at all.

1. Cover samples.  Positions whose place modulo v lies in a difference cover D
   (about 9 % of them at v = 133) are sorted by the ``length - v + 1`` bytes from
   there.  For any two positions i, j some d < v puts both i + d and j + d into the
   cover, so if their strings are equal, these two samples are equal too.  A suffix
   none of whose samples ties is unique and is settled.  Places are counted from
   points that the text itself chooses, so copies mostly have the same samples.
2. Long ties.  Tied samples are sorted again by ``length + v`` bytes.  Those that
   still tie settle all v + 1 suffixes whose strings lie inside: they repeat.  One
   sample of each tie, the representative, stands for the others from here on.
3. The suffixes left (and those of representatives) are sorted bucket by bucket: by
   short names, which leaves out those that are alone, and the others by whole ones.
4. Every tie that 2 and 3 rely on is compared byte for byte with its representative.
   Neighbouring ties with one offset are one run of text, cut at the representative's
   cells of ``CELL`` bytes, so that equal claims, however many, are one row.  Ties on
   a cell where some byte differs are void: long ones leave their suffixes to step 3,
   those of step 3 are settled by grouping the strings themselves.

Each sort runs over buckets of the key space, one at a time, in memory bounded by
the bucket and not by the corpus.  Strings travel under 64-bit names, so suffixes
stand in the order of names, not of the alphabet; equal strings are neighbours all
the same, and step 4 makes sure that neighbours are equal.  Texts stay where they
are, in chunks in a table bucketed by chunk: a chunk sends each bucket its distinct
names, so a string that is everywhere costs one name per chunk.  Chunks and buckets
both grow with the square root of the corpus, so rows grow in proportion to it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import operator
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.scratch import Scratch

LENGTH = 200
#: Text of a chunk and of a bucket of a sort at ``SCALE_TEXT`` bytes of corpus; both grow with its square root, to the second figure.
SCALE_TEXT = 100_000_000
CHUNK_BYTES = (1 << 20, 24 << 20)
BUCKET_TEXT = (4 << 20, 512 << 20)
#: Text of a stored partition of chunks at least, and the most partitions that a bucketed table should have.
PART_TEXT = 8 << 20
MAX_PARTS = 50_000
#: Bytes of the cells that claims of equality are cut at.
CELL = 256
#: Bytes of rows that travel to a Python worker at once, so that few chunks are in memory.
BATCH_BYTES = "8m"

# Perfect difference covers, by their modulus.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}

#: About one position in so many starts the cover anew.
ANCHOR = 64
_ODD = np.array([40503, 10139, 29333, 51437], "u2")
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)


def sizes(total: int) -> tuple[int, int, int]:
    """Bytes of a chunk, number of buckets and of stored partitions for ``total`` bytes of text."""
    grown = math.sqrt(max(1.0, total / SCALE_TEXT))
    chunk, bucket = (min(most, int(least * grown)) for least, most in (CHUNK_BYTES, BUCKET_TEXT))
    return chunk, max(1, -(-total // bucket)), min(MAX_PARTS, max(1, -(-total // max(PART_TEXT, 2 * chunk))))


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover that leaves samples a third of ``length`` at least."""
    v = max((v for v in COVERS if 3 * (length - v + 1) >= length), default=3)
    return v, np.isin(np.arange(v), COVERS[v])


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, "uint64")
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xCA9B0A6F2B1F4A6D)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """Texts of some documents side by side, with names of any of their strings."""

    def __init__(self, body: bytes, lens: np.ndarray, length: int, ident: int = 0, name_bits: int = 64):
        self.text = np.frombuffer(body, "u1")
        self.body, self.ident = body, ident
        self.n = len(self.text)
        self.ends = np.cumsum(lens)
        self.length = length
        self.v, self.cover = cover_for(length)
        self.short, self.long = length - self.v + 1, length + self.v
        self.keep = np.uint64((1 << 64) - (1 << (64 - name_bits)))
        size = 1 << max(10, int(self.n - 1).bit_length()) if self.n else 1 << 10
        self.up, self.down = _powers(size)
        self.sums = np.zeros(self.n + 1, "uint64")
        np.cumsum(_BYTES[self.text] * self.up[: self.n], out=self.sums[1:])

    def inside(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which strings of ``size`` bytes at sorted positions end in their own document."""
        return at + size <= self.ends[np.searchsorted(self.ends, at, "right")] if len(at) else np.zeros(0, bool)

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[at + size] - self.sums[at]) * self.down[at]) & self.keep

    @functools.cached_property
    def samples(self) -> np.ndarray:
        """Sorted cover positions.  The cover starts anew at every document and at places that their next four bytes choose.

        So equal texts have equal samples from the first such place on.  The cover still
        holds for any two equal strings: either their first v positions have such a
        place, which is a sample in both, or in both they count on without a break.
        """
        if not self.n:
            return np.zeros(0, "int64")
        chosen = np.zeros(self.n, bool)
        if self.v + len(_ODD) <= self.length and len(_ODD) <= self.n:  # else the four bytes may reach beyond a string
            t, h = self.text.astype("u2"), np.zeros(self.n, "u2")
            for k, odd in enumerate(_ODD):
                h[: self.n - k] += t[k:] * odd
            chosen = h < (1 << 16) // ANCHOR
            for k in range(1, len(_ODD)):  # the bytes must be the document's own
                chosen[(self.ends - k)[self.ends >= k]] = False
        begin = np.r_[0, self.ends[:-1]]
        chosen[begin[begin < self.n]] = True
        anchors = np.flatnonzero(chosen)
        gaps = np.diff(np.r_[anchors, self.n])
        cover = np.flatnonzero(self.cover)
        cover = (np.arange(int(gaps.max()) // self.v + 1)[:, None] * self.v + cover).ravel()
        counts = np.searchsorted(cover, gaps)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(anchors, counts) + cover[nth]
        return at[self.inside(at, self.short)]

    def spread(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """Flags of all positions from ``before`` ahead of one in sorted ``at`` to ``after`` behind it."""
        step = np.zeros(self.n + 1, "i1")
        if len(at):
            new = np.flatnonzero(at[1:] - at[:-1] > before + after + 1) + 1
            step[np.maximum(at[np.r_[0, new]] - before, 0)] = 1
            step[np.minimum(at[np.r_[new - 1, len(at) - 1]] + after + 1, self.n)] -= 1
        return np.cumsum(step[:-1], dtype="i1").view(bool)


class Ties:
    """What a sort found of a chunk's strings: which tie, and where their representatives stand."""

    def __init__(self, at: np.ndarray, size: int):
        n = len(at)
        self.at, self.size = at, size
        self.tied, self.chosen = np.zeros(n, bool), np.zeros(n, bool)
        self.chunk, self.place = np.zeros(n, "int64"), np.zeros(n, "int64")


# The positions whose names each sort gets, from the ties of the sorts before: (positions, bytes of a name's string).


def _first(c: Chunk, ties: list[Ties]) -> tuple[np.ndarray, int]:
    return c.samples, c.short


def _second(c: Chunk, ties: list[Ties]) -> tuple[np.ndarray, int]:
    at = c.samples[ties[0].tied]
    return at[c.inside(at, c.long)], c.long


def _third(c: Chunk, ties: list[Ties]) -> tuple[np.ndarray, int]:
    long = ties[LONG]
    left = c.spread(c.samples[ties[0].tied], c.v - 1, 0)
    left &= ~c.spread(long.at[long.tied], 0, c.v) | c.spread(long.at[long.chosen], 0, c.v)
    at = np.flatnonzero(left)
    return at[c.inside(at, c.length)], c.length


def _fourth(c: Chunk, ties: list[Ties]) -> tuple[np.ndarray, int]:
    return ties[2].at[ties[2].tied], c.length


def starts(c: Chunk, ties: list[Ties]) -> np.ndarray:
    """Flags of the positions at which a repeated string starts."""
    out = c.spread(ties[LONG].at[ties[LONG].tied], 0, c.v)
    out[ties[LAST].at[ties[LAST].tied]] = True
    return out


STEPS = (_first, _second, _third, _fourth)
#: Two sorts settle ties; the other two only leave out what is alone, so their names may be short.
LONG, LAST = 1, 3


def _sorted_names(c: Chunk, at: np.ndarray, size: int, buckets: int) -> tuple:
    """Sorted distinct names, whether each occurs again here, where first, their bucket edges; and how to read the reply."""
    names = c.names(at, size)
    order = np.argsort(names)
    ranked = names[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    distinct = ranked[heads]
    again = np.diff(np.r_[heads, len(ranked)]) > 1
    first = at[np.minimum.reduceat(order, heads)] if len(heads) else at
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype="uint64"))
    return distinct, again, first, edges, order, np.cumsum(new, dtype="int32") - 1


def _read(c: Chunk, reply: list, at: np.ndarray, size: int, buckets: int, bad: list | None) -> Ties:
    """The ties of a step by position; those that touch a bad cell of their representative are void."""
    distinct, _, _, edges, order, which = _sorted_names(c, at, size, buckets)
    ties = Ties(at, size)
    tied, chunk, place = np.zeros(len(distinct), bool), np.zeros(len(distinct), "int64"), np.zeros(len(distinct), "int64")
    for r in reply or ():
        a, b = edges[r["bucket"]], edges[r["bucket"] + 1]
        tied[a:b] = np.unpackbits(np.frombuffer(r["tied"], "u1"), count=b - a).astype(bool)
        if r["chunks"]:
            k = a + np.flatnonzero(tied[a:b])
            chunk[k], place[k] = np.frombuffer(r["chunks"], "<i8"), np.frombuffer(r["places"], "<u4")
    ties.tied[order], ties.chunk[order], ties.place[order] = tied[which], chunk[which], place[which]
    ties.chosen = ties.tied & (ties.chunk == c.ident) & (ties.place == at)
    if bad:
        cells: dict[int, list] = {}
        for x in bad:
            cells.setdefault(x["there"], []).append(x["cell"])
        for there, found in cells.items():
            k = np.flatnonzero(ties.tied & (ties.chunk == there))
            found = np.sort(np.array(found, "int64"))
            void = np.searchsorted(found, ties.place[k] // CELL) < np.searchsorted(found, (ties.place[k] + size - 1) // CELL, "right")
            ties.tied[k[void]] = ties.chosen[k[void]] = False
    return ties


def _claims(c: Chunk, ties: Ties) -> Iterator[tuple[int, int, int, bytes]]:
    """What has to be equal for the ties to hold: (0, own chunk, place, bytes) of the cells of representatives and (1, chunk, place, bytes) of texts that claim to stand there too."""
    own = np.flatnonzero(ties.chosen)
    cells: set[int] = set()
    for a in np.unique(ties.at[own] // CELL).tolist():
        cells.update(range(a, a + -(-ties.size // CELL) + 1))
    for g in sorted(cells):
        if piece := c.body[g * CELL : (g + 1) * CELL]:
            yield 0, c.ident, g * CELL, piece
    k = np.flatnonzero(ties.tied & ~ties.chosen)
    if not len(k):
        return
    at, chunk, place = ties.at[k], ties.chunk[k], ties.place[k]
    new = np.r_[True, (chunk[1:] != chunk[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (at[1:] > at[:-1] + ties.size)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(k) - 1]
    for there, a, b, to in zip(chunk[first].tolist(), at[first].tolist(), (at[last] + ties.size).tolist(), place[first].tolist()):
        if there == c.ident and c.body[a:b] == c.body[to : to + b - a]:
            continue
        end = to + b - a
        while to < end:
            size = min(end, (to // CELL + 1) * CELL) - to
            yield 1, there, to, c.body[a : a + size]
            a, to = a + size, to + size


def _bucket_sort(parts: list[tuple], width: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Sort one bucket's names of all chunks; for each (chunk, tied bits, chunks and places of the representatives of the tied)."""
    parts.sort(key=lambda p: p[0])
    names = [np.frombuffer(p[1], f"<u{width}") for p in parts]
    lengths = [len(x) for x in names]
    again = np.concatenate([np.unpackbits(np.frombuffer(p[2], "u1"), count=n) for p, n in zip(parts, lengths)]).astype(bool)
    flat = np.concatenate(names)
    order = np.argsort(flat)
    ranked = flat[order]
    edges = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    counts = np.diff(np.r_[edges, len(flat)])
    tie = (counts > 1) | np.logical_or.reduceat(again[order], edges)
    tied = np.zeros(len(flat), bool)
    tied[order] = np.repeat(tie, counts)
    cuts = np.cumsum(lengths)[:-1]
    bits = [np.packbits(t).tobytes() for t in np.split(tied, cuts)]
    if width == 4:
        return [(p[0], t, b"", b"") for p, t in zip(parts, bits)]
    heads = np.minimum.reduceat(order, edges)  # the representative is the first, in the lowest chunk
    chunks, places = np.zeros(len(flat), "<i8"), np.zeros(len(flat), "<u4")
    chunks[order] = np.repeat(np.repeat([p[0] for p in parts], lengths)[heads], counts)
    places[order] = np.repeat(np.concatenate([np.frombuffer(p[3], "<u4") for p in parts])[heads], counts)
    return [(p[0], t, x[y].tobytes(), z[y].tobytes()) for p, t, x, z, y in zip(parts, bits, np.split(chunks, cuts), np.split(places, cuts), np.split(tied, cuts))]


SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("again", pa.binary()), ("first", pa.binary())])
TOUCHED = pa.schema([("chunk", pa.int64()), ("there", pa.int64()), ("cell", pa.int64())])
STRINGS = pa.schema([("chunk", pa.int64()), ("place", pa.int64()), ("string", pa.binary())])
REPLY = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("tied", pa.binary()), ("chunks", pa.binary()), ("places", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """Rows (k: any, b binary) side by side in chunks of about ``size`` bytes: chunk, keys, lens, body."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, keys, bodies, held = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            rows = pa.concat_arrays(keys)
            whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | nth]), whole, pa.array([[len(b) for b in bodies]], pa.list_(pa.int64())), pa.array([b"".join(bodies)], pa.binary())], ["chunk", "keys", "lens", "body"])

        for batch in batches:
            begin, k = 0, batch.column(0)
            for i, b in enumerate(batch.column(1)):
                bodies.append(b.as_py() or b"")
                held += len(bodies[-1])
                if held >= size:
                    keys.append(k[begin : i + 1])
                    yield out()
                    begin, nth, keys, bodies, held = i + 1, nth + 1, [], [], 0
            if begin < len(k):
                keys.append(k[begin:])
        if bodies:
            yield out()

    kind = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(rows.schema["k"].dataType)), T.StructField("lens", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType())])
    return rows.select("k", "b").mapInArrow(build, kind)


def with_ties(batches: Iterator[pa.RecordBatch], steps: int, length: int, buckets: int, name_bits: int) -> Iterator[tuple]:
    """Each chunk with access to its row and with its ties of the first ``steps`` sorts."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            got = lambda x: batch.column(names.index(x))[i] if x in names else None  # noqa: B023, E731
            listed = lambda x: v.as_py() if (v := got(x)) is not None else None  # noqa: B023, E731
            c = Chunk(got("body").as_buffer().to_pybytes(), np.array(got("lens").values), length, got("chunk").as_py(), name_bits)
            ties: list[Ties] = []
            for n in range(steps):
                ties.append(_read(c, listed(f"ties{n}"), *STEPS[n](c, ties), buckets, listed(f"bad{n}")))
            yield got, listed, c, ties


class Repeats:
    """The passes over a table of chunks that find repeated strings."""

    def __init__(self, scratch: Scratch, name: str, length: int, buckets: int, name_bits: int):
        self.scratch, self.name, self.buckets = scratch, name, buckets
        self.chunks = functools.partial(with_ties, length=length, buckets=buckets, name_bits=name_bits)
        self.replies: dict[str, DataFrame] = {}
        self.saved: dict[str, str] = {}

    def table(self, *columns: str) -> DataFrame:
        """The chunks with all replies to them."""
        out = self.scratch.spark.table(self.name).select("chunk", "lens", "body", *columns)
        for key, reply in self.replies.items():
            by = reply.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in reply.columns if c != "chunk"])).alias("_of")).select(F.col("chunk").alias("_to"), F.col("_of").alias(key))
            out = out.join(by.hint("shuffle_hash"), F.col("chunk") == F.col("_to"), "left").drop("_to")
        return out

    def sort(self, n: int) -> None:
        """Send the names of step ``n`` to their buckets, sort these, and keep the replies."""
        chunks, buckets = self.chunks, self.buckets
        width = 8 if n in (LONG, LAST) else 4

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, c, ties in chunks(batches, n):
                distinct, again, first, edges, *_ = _sorted_names(c, *STEPS[n](c, ties), buckets)
                if width == 4:
                    distinct = (distinct >> np.uint64(8)).astype("<u4")
                out = [
                    (int(b), c.ident, distinct[x:y].tobytes(), np.packbits(again[x:y]).tobytes(), first[x:y].astype("<u4").tobytes() if width == 8 else b"")
                    for b, x, y in zip(range(buckets), edges[:-1].tolist(), edges[1:].tolist())
                    if y > x
                ]
                yield _batch(out, SENT)

        def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(5)]))
            for b, parts in itertools.groupby(rows, key=operator.itemgetter(0)):
                yield _batch([(b, *r) for r in _bucket_sort([p[1:] for p in parts], width)], REPLY)

        sent = self.table().mapInArrow(send, "bucket int, chunk long, names binary, again binary, first binary")
        back = sent.repartition(self.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, "bucket int, chunk long, tied binary, chunks binary, places binary")
        self.keep(f"ties{n}", back)

    def keep(self, key: str, reply: DataFrame) -> None:
        self.saved[key] = f"{key}-{len(self.scratch.paths)}"
        self.replies[key] = self.scratch.save(reply, self.saved[key])

    def drop(self, key: str) -> None:
        self.replies.pop(key)
        self.scratch.drop(self.saved.pop(key))

    def finish(self, texts: bool, check: tuple[int, ...]) -> DataFrame:
        """A row per document (step -1), and the claims of the steps ``check``."""
        kind = self.scratch.spark.table(self.name).schema["keys"].dataType.elementType
        chunks = self.chunks
        fields = [("step", T.IntegerType()), ("k", kind), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("kept", T.StringType())]
        fields += [("claim", T.BooleanType()), ("chunk", T.LongType()), ("place", T.LongType()), ("piece", T.BinaryType())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got, listed, c, ties in chunks(batches, len(STEPS)):
                begin = starts(c, ties)
                for x in listed("exact") or ():
                    begin[x["place"]] = True
                gone = c.spread(np.flatnonzero(begin), 0, c.length - 1) if c.n else np.zeros(0, bool)
                rows, at = [], 0
                for end in c.ends.tolist():
                    g, body = gone[at:end], c.text[at:end]
                    kept = body[~g].tobytes()
                    spans = int(np.count_nonzero(np.diff(g.astype("i1"), prepend=0) == 1))
                    rows.append((end - at, int(np.count_nonzero(g)), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if texts else None))
                    at = end
                keys, n = got("keys").values, len(rows)
                done = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), keys, *done, pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], [f for f, _ in fields])
                for step in check:
                    claims = list(_claims(c, ties[step]))
                    for lo in range(0, len(claims), 4096):
                        flag, chunk, place, piece = zip(*claims[lo : lo + 4096])
                        m = len(flag)
                        empty = [pa.nulls(m, keys.type), *(pa.nulls(m, x.type) for x in done)]
                        made = [pa.array([f == 1 for f in flag]), pa.array(chunk, pa.int64()), pa.array(place, pa.int64()), pa.array(piece, pa.binary())]
                        yield pa.RecordBatch.from_arrays([pa.array([step] * m, pa.int32()), *empty, *made], [f for f, _ in fields])

        return self.table("keys").mapInArrow(run, T.StructType([T.StructField(f, t) for f, t in fields]))

    def bad_cells(self, found: DataFrame) -> DataFrame | None:
        """Cells (step, chunk, cell) of representatives where some claim isn't true; None without any."""
        mine = found.where("step >= 0").withColumn("cell", F.expr(f"place div {CELL}"))
        claims = mine.where("claim").select("step", "chunk", "cell", "place", "piece").distinct()
        cells = mine.where("not claim").select(F.col("step").alias("_s"), F.col("chunk").alias("_c"), F.col("cell").alias("_g"), F.col("piece").alias("_whole")).distinct()
        both = claims.join(cells, (F.col("step") == F.col("_s")) & (F.col("chunk") == F.col("_c")) & (F.col("cell") == F.col("_g")), "left")
        same = F.substring(F.col("_whole"), (F.col("place") % CELL + 1).cast("int"), F.octet_length("piece")).eqNullSafe(F.col("piece"))
        bad = self.scratch.save(both.where(~same).select("step", "chunk", "cell").distinct(), f"bad-{uuid.uuid4().hex[:6]}")
        return bad if bad.limit(1).count() else None

    def void(self, step: int, bad: DataFrame) -> None:
        """Tell every chunk the bad cells of a step that it is to heed.

        Chunks tell which cells their ties touch; only called where a claim has failed.
        """
        chunks = self.chunks
        cells = bad.where(F.col("step") == step).select(F.col("chunk").alias("there"), "cell")

        def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, c, ties in chunks(batches, step + 1):
                t = ties[step]
                k = np.flatnonzero(t.tied)
                spans = np.unique(np.stack([t.chunk[k], t.place[k] // CELL, (t.place[k] + t.size - 1) // CELL], axis=1), axis=0) if len(k) else np.zeros((0, 3), "int64")
                yield _batch(sorted({(c.ident, there, g) for there, a, b in spans.tolist() for g in range(a, b + 1)}), TOUCHED)

        met = self.table().mapInArrow(touched, "chunk long, there long, cell long")
        self.keep(f"bad{step}", met.join(cells, ["there", "cell"], "left_semi").select("chunk", "there", "cell"))

    def exact(self) -> None:
        """Void ties of the last step are settled by grouping the strings themselves."""
        chunks, buckets = self.chunks, self.buckets

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, listed, c, ties in chunks(batches, len(STEPS) - 1):
                at, size = STEPS[-1](c, ties)
                before = _read(c, listed(f"ties{len(STEPS) - 1}"), at, size, buckets, None)
                after = _read(c, listed(f"ties{len(STEPS) - 1}"), at, size, buckets, listed(f"bad{len(STEPS) - 1}"))
                doubt = at[before.tied & ~after.tied]
                for lo in range(0, len(doubt), 4096):
                    part = doubt[lo : lo + 4096].tolist()
                    yield _batch([(c.ident, i, c.body[i : i + size]) for i in part], STRINGS)

        rows = self.scratch.save(self.table().mapInArrow(strings, "chunk long, place long, string binary"), f"strings-{uuid.uuid4().hex[:6]}")
        again = rows.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
        self.keep("exact", rows.join(again, "string", "left_semi").select("chunk", "place"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = False, name_bits: int = 64) -> DataFrame:
    """Per row: ``key``, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` all columns of ``df``, the text cut.

    Every byte goes that some ``length``-byte string covers which also starts anywhere
    else, in the same document or another, judged on the input.  Strings never cross
    documents.  Null texts are empty (and stay null with ``texts``); repeated rows are
    documents of their own, so all but short ones lose everything; null keys and keys of
    any type are allowed; an empty table gives an empty result; other columns are
    ignored, or kept as they are with ``texts``, whatever their names and types (those
    that Arrow can hold).  A text cut inside a character loses the rest of that
    character.  A single document must fit a worker, at some 50 bytes a byte.  A
    bucketed table stands in the session's catalog while it runs.  ``name_bits`` below
    64 makes names coarser and the results no different.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("binary")))).first()[0] or 0
    size, buckets, parts = sizes(total)
    carried = [c for c in df.columns if c != text] if texts else [key]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{text}`").isNull().alias("none"))
    name = f"turnlake_chunks_{uuid.uuid4().hex}"
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(setting)
    try:
        spark.conf.set(setting, BATCH_BYTES)
        scratch.paths["chunks"] = f"{scratch.base}/chunks"
        stored = chunked(df.select(row.alias("k"), F.col(f"`{text}`").cast("binary").alias("b")), size)
        stored.write.format("parquet").option("path", scratch.paths["chunks"]).option("compression", "zstd").bucketBy(parts, "chunk").saveAsTable(name)
        repeats = Repeats(scratch, name, length, buckets, name_bits)
        for n in range(len(STEPS)):
            repeats.sort(n)
        check: tuple[int, ...] = (LONG, LAST)
        while True:
            scratch.drop(*[x for x in scratch.paths if x.startswith("done")])
            found = scratch.save(repeats.finish(texts, check), f"done-{len(check)}")
            bad = repeats.bad_cells(found) if check else None
            if bad is None:
                break
            if LONG in check and bad.where(F.col("step") == LONG).limit(1).count():
                repeats.void(LONG, bad)
                for n in range(LONG + 1, len(STEPS)):
                    repeats.drop(f"ties{n}")
                for n in range(LONG + 1, len(STEPS)):
                    repeats.sort(n)
                check = (LAST,)
            else:
                repeats.void(LAST, bad)
                repeats.exact()
                check = ()
    finally:
        spark.conf.set(setting, was)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop(*[x for x in scratch.paths if not x.startswith("done")])
    done = found.where("step = -1")
    if texts:
        at = {c: i for i, c in enumerate(carried)}
        return done.select(*[F.when(~F.col("k.none"), F.col("kept")).cast(df.schema[c].dataType).alias(c) if c == text else F.col(f"k.c{at[c]}").alias(c) for c in df.columns])
    return done.select(F.col("k.c0").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")
