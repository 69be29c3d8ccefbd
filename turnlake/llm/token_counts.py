"""Token counts of byte-level BPE vocabularies, without emitting token ids.

Method: heap-and-linked-list byte-pair merging.  A pre-token starts as a linked
list of its bytes; a heap holds every adjacent pair that can merge, keyed by
(merge rank, position).  The lowest pair is popped again and again, merged in the
list, and its new neighbours pushed.  The count is initial symbols minus merges;
an entry whose pair has changed since it was pushed is stale and skipped.

Pre-tokens repeat, so each Python worker keeps a bounded table of counts by
space-delimited chunk.  That is safe because the vocabulary's split pattern never
joins characters across a "non-space, one space" boundary; texts with other white
space next to a space are split as a whole instead.
"""

from __future__ import annotations

import functools
import json
import re
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Entries a worker's tables hold before they start anew, and the longest chunk kept.
TABLE_TOKENS = 1_000_000
TABLE_CHUNKS = 250_000
TABLE_CHUNK = 48

_MASK = (1 << 40) - 1

# The split pattern of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern for Python's faster re module, right for texts without ODD characters.
SPLIT_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
# Characters that the two modules may class otherwise: separators 1C-1F, superscripts, fractions, all from 0250 on.
ODD = "[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]"

split_any = regex.compile(SPLIT).findall
split_plain = re.compile(SPLIT_PLAIN).findall
odd = re.compile(ODD).search


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 onwards in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTable:
    """Merge ranks of a byte-level BPE file; symbols 0-255 are bytes, 256 + rank the result of a merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_symbols()
        symbol = {c: b for c, b in to_byte.items()}
        self.pairs: dict[int, int] = {}
        self.result: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[symbol[left] << 20 | symbol[right]] = rank
            self.result.append(symbol.setdefault(left + right, 256 + rank))
        #: (rank, position 0) of two bytes by their values, -1 where they don't merge
        self.of_bytes = [-1 if (r := self.pairs.get(a << 20 | b)) is None else r << 40 for a in range(256) for b in range(256)]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def merged_count(self, token: bytes) -> int:
        """Symbols left of ``token`` when no more pair can merge."""
        n = len(token)
        if n < 2:
            return n
        rank_of, result = self.pairs.get, self.result
        sym = list(token)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        of_bytes = self.of_bytes
        heap = [r | i for i, r in enumerate(map(of_bytes.__getitem__, [a << 8 | b for a, b in zip(token, token[1:])])) if r >= 0]
        heapify(heap)
        left = n
        while heap:
            entry = heappop(heap)
            i, rank = entry & _MASK, entry >> 40
            j = after[i]
            if sym[i] < 0 or j >= n or rank_of(sym[i] << 20 | sym[j]) != rank:
                continue
            sym[i], sym[j] = result[rank], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(sym[i] << 20 | sym[k])) is not None:
                    heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(sym[h] << 20 | sym[i])) is not None:
                heappush(heap, r << 40 | h)
        return left


class _Tokens(dict):
    """Count by pre-token."""

    def __init__(self, merges: MergeTable):
        self.merges = merges

    def __missing__(self, token: str) -> int:
        count = self.merges.merged_count(token.encode())
        if len(token) <= TABLE_CHUNK:
            if len(self) >= TABLE_TOKENS:
                self.clear()
            self[token] = count
        return count


class _Chunks(dict):
    """Count by chunk that follows a space; far below zero where the chunk can't be split by itself."""

    ALONE = -(1 << 62)

    def __init__(self, tokens: _Tokens):
        self.tokens = tokens

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return self.ALONE
        count = sum(map(self.tokens.__getitem__, split_plain(" " + chunk)))
        if len(chunk) <= TABLE_CHUNK:
            if len(self) >= TABLE_CHUNKS:
                self.clear()
            self[chunk] = count
        return count


class TokenCounter:
    def __init__(self, path: str):
        merges = MergeTable(path)
        self.tokens = _Tokens(merges)
        self.chunks = _Chunks(self.tokens)
        self.special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def _ordinary(self, text: str) -> int:
        token = self.tokens.__getitem__
        if odd(text):
            return sum(map(token, split_any(text)))
        first, *rest = text.split(" ")
        if first[-1:].isspace():
            return sum(map(token, split_plain(text)))
        count = sum(map(self.chunks.__getitem__, rest))
        if count < 0:
            return sum(map(token, split_plain(text)))
        return count + sum(map(token, split_plain(first)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: ``key``, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level BPE .json that every executor can
    read.  Null and empty texts have 0 bytes and 0 tokens; strings of added tokens
    inside a text count one each; rows that repeat, null keys and an empty table
    pass through row by row; columns other than key and text are ignored, so they
    can't clash.  No shuffle: one narrow pass over the text column.
    """

    @F.pandas_udf(LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = counter(vocabulary).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return df.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(text)).alias("n_tokens")).select(
        key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
