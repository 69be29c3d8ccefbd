"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Lengths are whole numbers up to the capacity, so the packing problem is described
in full by how many pieces there are of each length, and a solution by how many
bins there are of each pattern of lengths: neither grows with the corpus.  The
genetic algorithm works on such solutions.  Crossover injects whole well-filled
bins of one parent, removes the duplicates (bins of the other parent whose pieces
are already used) and best-fits the displaced pieces; mutation empties the worst
bins.  Islands evolve as Spark tasks and pass their elites round a ring between
epochs; they stop early at the lower bound.  Pieces are then dealt to bins by their
rank among the pieces of their length, a distributed rank over salted slices.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.llm.ranges import long_array
from turnlake.llm.scratch import Scratch
from turnlake.llm.token_counts import SPLIT, byte_symbols, odd, split_any

CAPACITY = 1024
END = 2
ISLANDS = 4
EPOCHS = 3
GENERATIONS = 8
POPULATION = 6
#: Slices that ranks are counted in, besides one per length.
SLICES = 4096
TABLE_ENTRIES = 500_000
TABLE_CHUNK = 48
#: White space in a row from which texts are split ahead of the encoder, whose pattern backtracks over such runs on its stack.
LONG_BLANK = re.compile(r"\s{4096}")

Solution = Counter  # pattern (lengths, longest first) -> bins


# ---- tokens


class Tokenizer:
    """Ids of a byte-level BPE .json as its library gives them, by a bounded table of space-delimited chunks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_symbols()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.ids = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.table: dict[str, bytes | None] = {}

    def _by_pieces(self, text: str) -> bytes:
        ids: list[int] = []
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for piece in split_any(part):
                    ids += self.ids._encode_single_piece(piece)
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None  # can't be split by itself
        ids = np.array(self.ids.encode_ordinary(" " + chunk), "<u4").tobytes()
        if len(chunk) <= TABLE_CHUNK:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            self.table[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(text) >= 4096 and LONG_BLANK.search(text):
            return self._by_pieces(text)
        if odd(text) or any(s in text for s in self.special):
            return np.array(self.ids.encode(text, allowed_special="all"), "<u4").tobytes()
        first, *rest = text.split(" ")
        table = self.table
        parts = [b if (b := table.get(c)) is not None else self._chunk(c) for c in rest]
        if None in parts or first[-1:].isspace():
            return np.array(self.ids.encode_ordinary(text), "<u4").tobytes()
        return b"".join([np.array(self.ids.encode_ordinary(first), "<u4").tobytes(), *parts])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity``, the rest first."""
    head = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, head)] + [(at, capacity) for at in range(head, length, capacity)]


def pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece of every document (null text: empty): ``key``, piece, start, length, ids_crc32."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, stop = tokenizer(vocabulary).encode, np.array([end], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch["_t"]):
                ids = (encode(t) if t else b"") + stop
                for nth, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((nth, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, key, batch[key].to_numpy()[at])
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).alias("_t")).mapInPandas(split, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the genetic algorithm on counts


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the best of the bounds that set small pieces aside, or count the room that only small ones can use."""
    sizes = sorted(counts)
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in sizes:  # beside a piece of over capacity - k only pieces below k fit
        room = sum((capacity - s) * n for s, n in counts.items() if s > capacity - k)
        small = sum(s * n for s, n in counts.items() if s < k)
        if 2 * k <= capacity:
            best = max(best, -(-(total + max(0, room - small)) // capacity))
    for small in [s for s in sizes if 2 * s <= capacity]:
        huge = sum(n for s, n in counts.items() if s > capacity - small)
        half = {s: n for s, n in counts.items() if capacity < 2 * s and s <= capacity - small}
        room = sum((capacity - s) * n for s, n in half.items())
        rest = sum(s * n for s, n in counts.items() if small <= s and 2 * s <= capacity)
        best = max(best, huge + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(bins: Solution, items: dict[int, int], capacity: int, order=None) -> Solution:
    """``bins`` with ``items`` added, each length in turn into the fullest bins it fits, else into new ones."""
    room: list[dict] = [{} for _ in range(capacity + 1)]
    open_rooms = 0
    done: Solution = Counter()
    for pattern, n in bins.items():
        left = capacity - sum(pattern)
        if n and left:
            room[left][pattern] = room[left].get(pattern, 0) + n
            open_rooms |= 1 << left
        elif n:
            done[pattern] += n

    def put(pattern: tuple, n: int) -> None:
        nonlocal open_rooms
        left = capacity - sum(pattern)
        if left == 0:
            done[pattern] += n
        else:
            room[left][pattern] = room[left].get(pattern, 0) + n
            open_rooms |= 1 << left

    for size in order if order is not None else sorted(items, reverse=True):
        n = items.get(size, 0)
        while n:
            fits = open_rooms >> size
            if not fits:
                each = capacity // size
                if whole := n // each:
                    put((size,) * each, whole)
                if n % each:
                    put((size,) * (n % each), 1)
                break
            left = size + (fits & -fits).bit_length() - 1
            pattern, there = room[left].popitem()
            each = left // size
            whole = min(there, n // each)
            if whole:
                put(tuple(sorted(pattern + (size,) * each, reverse=True)), whole)
                n -= whole * each
            if there > whole:
                if n < each and n:
                    put(tuple(sorted(pattern + (size,) * n, reverse=True)), 1)
                    there, n = there - 1, 0
                if there > whole:
                    room[left][pattern] = room[left].get(pattern, 0) + there - whole
            if not room[left]:
                open_rooms &= ~(1 << left)
    for by in room:
        for pattern, n in by.items():
            done[pattern] += n
    return done


def cost(solution: Solution, capacity: int) -> tuple:
    """Fewer bins first, then fuller bins."""
    return sum(solution.values()), -sum(n * sum(p) ** 2 for p, n in solution.items())


def replace_worse(bins: Solution, loose: Counter, capacity: int, rng: random.Random, most: int = 400) -> None:
    """Dominance: pieces of bins that aren't full change places with larger loose ones, so that bins get fuller and loose pieces smaller.

    One or two pieces of a bin go for one or two loose ones.  ``most`` bins are tried, those with most room first.
    """
    open_bins = sorted(((capacity - sum(p), p) for p, n in bins.items() if n and sum(p) < capacity), reverse=True)
    for room, pattern in open_bins[:most]:
        if not bins[pattern]:
            continue
        sizes = sorted((s for s, n in loose.items() if n), reverse=True)
        if not sizes:
            return
        single = set(sizes)
        out = [(s,) for s in set(pattern)] + [(a, b) for i, a in enumerate(pattern) for b in pattern[i + 1 :]]
        best = None
        for old in out:
            low, high = sum(old), sum(old) + room
            for new in ((high,), *((a, high - a) for a in sizes if a < high)):
                if all(x in single for x in new) and (len(new) == 1 or new[0] != new[1] or loose[new[0]] > 1):
                    best = (old, new)
                    break
            if best:
                break
            fits = next((s for s in sizes if s <= high), 0)
            if fits > low and (best is None or fits - low > best[2]):
                best = (old, (fits,), fits - low)
        if best:
            changed = Counter(pattern)
            changed.subtract(Counter(best[0]))
            changed.update(best[1])
            bins[pattern] -= 1
            bins[tuple(sorted(changed.elements(), reverse=True))] += 1
            loose.subtract(Counter(best[1]))
            loose.update(best[0])


def crossover(mother: Solution, father: Solution, counts: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Well-filled bins of ``father`` go whole into ``mother``; what they displace is fitted anew."""
    enough = capacity - rng.choice((0, 0, 1, 3))
    child = Counter({p: n for p, n in father.items() if sum(p) >= enough and rng.random() < 0.5})
    supply = dict(counts)
    for p, n in child.items():
        for s in p:
            supply[s] -= n
    for p, n in sorted(mother.items(), key=lambda x: (-sum(x[0]), x[0])):
        need = Counter(p)
        keep = min(n, min(supply[s] // k for s, k in need.items()))
        if keep > 0:
            child[p] += keep
            for s, k in need.items():
                supply[s] -= k * keep
    loose = Counter({s: n for s, n in supply.items() if n})
    replace_worse(child, loose, capacity, rng)
    return best_fit(+child, +loose, capacity)


def mutate(solution: Solution, capacity: int, rng: random.Random) -> Solution:
    """Empty the worst bins and some random ones, perhaps move small pieces, put larger loose pieces in the place of smaller ones, and fit the rest."""
    kept, loose, small = Counter(solution), Counter(), Counter()
    worst = sorted((p for p, n in solution.items() if n), key=sum)[: rng.choice((1, 1, 2, 4, 8))]
    for p in [*worst, *rng.sample(sorted(solution), min(len(solution), rng.choice((0, 0, 2, 6))))]:
        if kept[p]:
            kept[p] -= 1
            loose.update(p)
    if rng.random() < 0.5:  # small pieces move to where only they fit
        below = rng.choice(sorted({s for p in solution for s in p})[:64])
        for p, n in list(kept.items()):
            rest = tuple(s for s in p if s >= below)
            if n and rest and len(rest) < len(p):
                kept[p] -= n
                kept[rest] += n
                for s in p[len(rest) :]:
                    small[s] += n
        kept = best_fit(+kept, small, capacity)
    for _ in range(6):
        replace_worse(kept, loose, capacity, rng)
    return best_fit(+kept, +loose, capacity)


def evolve(counts: dict[int, int], capacity: int, seed: int, elites: list[Solution], generations: int = GENERATIONS, size: int = POPULATION) -> Solution:
    """The best solution of one island after some generations, the immigrants among its first members."""
    rng, bound = random.Random(seed), lower_bound(counts, capacity)
    rank = functools.partial(cost, capacity=capacity)
    people = list(elites)
    while len(people) < size:
        order = sorted(counts, key=lambda s: -s * rng.uniform(1 - 0.02 * len(people), 1))
        people.append(best_fit(Counter(), counts, capacity, order))
        if rank(people[-1])[0] <= bound:
            return people[-1]
    people.sort(key=rank)
    for _ in range(generations):
        if rank(people[0])[0] <= bound:
            break
        for _ in range(max(1, size // 2)):
            a, b = (min(rng.sample(people, 2), key=rank) for _ in range(2))
            child = crossover(a, b, counts, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, capacity, rng)
            people[-1] = min(people[-1], child, key=rank)
            people.sort(key=rank)
    return people[0]


def _dump(solution: Solution) -> str:
    return json.dumps([[list(p), n] for p, n in sorted(solution.items())])


def _load(text: str) -> Solution:
    return Counter({tuple(p): n for p, n in json.loads(text)})


def solve(spark, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> Solution:
    """The best solution of all islands.  What a task sends is one solution, whose patterns don't grow with the corpus."""
    if not counts:
        return Counter()
    bound, elites = lower_bound(counts, capacity), {i: [] for i in range(islands)}
    best: Solution | None = None
    for epoch in range(epochs):
        now = {i: [_dump(s) for s in e] for i, e in elites.items()}

        def task(batches: Iterator[pd.DataFrame], now=now, epoch=epoch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [_dump(evolve(counts, capacity, 1000 * epoch + int(i), [_load(s) for s in now[int(i)]])) for i in batch["id"]]
                yield pd.DataFrame({"id": batch["id"], "found": found})

        found = {r["id"]: _load(r["found"]) for r in spark.range(0, islands, 1, islands).mapInPandas(task, "id long, found string").collect()}
        best = min([*found.values(), *([best] if best else [])], key=functools.partial(cost, capacity=capacity))
        if sum(best.values()) <= bound:
            break
        elites = {i: [found[i], found[(i - 1) % islands]] for i in range(islands)}
    return best


# ---- from patterns to places


def _places(solution: Solution) -> tuple[np.ndarray, ...]:
    """Sorted (length << 40 | rank) where a run of pieces starts, with the first bin and the offset of the run."""
    rows, taken, bin_at = [], Counter(), 0
    for pattern, n in sorted(solution.items()):
        offset = 0
        for s in pattern:
            rows.append((s << 40 | taken[s], bin_at, offset))
            taken[s] += n
            offset += s
        bin_at += n
    rows.sort()
    return tuple(np.array(x, "int64") for x in zip(*rows)) if rows else (np.zeros(0, "int64"),) * 3


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: ``key``, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end``; only longer ones than ``capacity`` are cut.  A
    null or empty text is one piece of one id.  Repeated rows are documents of their
    own; null keys are allowed; an empty table gives an empty result; other columns
    are ignored.  Ids are not returned; ``tokenizer(vocabulary).encode`` gives them.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.save(pieces(df, vocabulary, key, text, capacity, end), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    whole = counts.get(capacity, 0)
    solution = solve(spark, {s: n for s, n in counts.items() if s != capacity}, capacity)
    if whole:
        solution[(capacity,)] += whole

    # the rank of a piece among those of its length: its place in a slice and the pieces of the slices before
    slices = long_array([max(1, math.ceil(SLICES * counts.get(s, 0) / max(total, 1))) for s in range(capacity + 1)])
    salted = rows.withColumn("_slice", F.pmod(F.xxhash64(key, "piece"), F.element_at(slices, (F.col("length") + 1).cast("int"))))
    sums = sorted((r["length"], r["_slice"], r["n"]) for r in salted.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("n")).collect())
    before, run = {}, Counter()
    for s, part, n in sums:
        before[s, part] = run[s]
        run[s] += n
    ranked = salted.withColumn("_nth", F.row_number().over(W.partitionBy("length", "_slice").orderBy(key, "piece", "ids_crc32")) - 1)
    shared = spark.sparkContext.broadcast((before, _places(solution)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, part: pd.Series, nth: pd.Series) -> pd.DataFrame:
        before, (starts, bins, offsets) = shared.value
        rank = nth.to_numpy() + np.fromiter((before[x] for x in zip(length, part)), "int64", len(length))
        at = np.searchsorted(starts, (length.to_numpy() << 40) | rank, "right") - 1
        return pd.DataFrame({"sequence_id": bins[at] + rank - (starts[at] & ((1 << 40) - 1)), "offset": offsets[at]})

    placed = ranked.withColumn("_place", place("length", "_slice", "_nth"))
    return placed.select(key, "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
