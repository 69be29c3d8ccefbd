"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of a model holds a whitespace marker after another character,
segmentation can't cross from a character into a marker.  So a text falls apart
into marked words (a run of markers and the characters up to the next marker).
Each batch's distinct marked words are segmented once, by the model itself, kept
in a bounded table with their ids and decoded bytes, and the ids of a text are
joined back by position.  A model with crossing pieces, or with a normaliser that
changes texts, is refused by the table and runs text by text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Distinct marked words a worker keeps before it starts anew, and the longest one kept.
TABLE_ENTRIES = 600_000
TABLE_CHUNK = 48


class PieceTable:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.skipped = {i for i in range(len(pieces)) if m.is_control(i)}
        self.byte = {i: int(p[3:5], 16) for i, p in enumerate(pieces) if m.is_byte(i)}
        #: what each id adds to a decoded text; None for bytes that only mean something in a run
        self.text = [b"" if i in self.skipped else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for i, b in self.byte.items():
            self.text[i] = bytes([b]) if b < 128 else None
        if m.unk_id() >= 0:
            self.text[m.unk_id()] = m.decode([m.unk_id()]).encode()
        self.marked = {i for i, p in enumerate(pieces) if p.startswith(MARK)}
        probe = "  a\tb ﬁ é\xa0 ①"
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and m.decode(m.encode(probe)) == probe and m.encode(" a", out_type=str)[0].startswith(MARK)
        self.table = {"": np.array([m.piece_to_id(MARK)], "<u4").tobytes()}
        self.ends = [np.array([i] if i >= 0 else [], "<u4").tobytes() for i in (m.bos_id(), m.eos_id())]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of ``ids`` as the library decodes them: control ids vanish, a leading marker isn't a space, broken byte runs become U+FFFD."""
        try:
            raw = b"".join(map(self.text.__getitem__, ids))
        except TypeError:
            out, run = [], bytearray()
            for i in ids:
                if (b := self.byte.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_whole(bytes(run)))
                    run = bytearray()
                out.append(self.text[i])
            raw = b"".join([*out, _whole(bytes(run))])
        first = next((i for i in ids if i not in self.skipped), None)
        return raw[1:] if first in self.marked else raw

    def chunks(self, text: str) -> list[str]:
        """Marked words; each stands for one marker, more of them as leading spaces."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts[:-1]:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        out.append(" " * spaces + parts[-1])
        return out

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Segment marked words once; what is too long to keep is returned for its batch only."""
        found = self.model.encode(words, num_threads=1)
        flat = np.fromiter(itertools.chain.from_iterable(found), "<u4").tobytes()
        once, at = {}, 0
        for word, ids in zip(words, found):
            (self.table if len(word) <= TABLE_CHUNK else once)[word] = flat[at : (at := at + 4 * len(ids))]
        return once

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian 32-bit integers."""
        if not self.splits:
            return [np.array(i, "<u4").tobytes() for i in self.model.encode(texts, add_bos=True, add_eos=True, num_threads=1)]
        begin, end = self.ends
        out, table = [], self.table
        for lo in range(0, len(texts), 64):
            split = [self.chunks(t) if t else [] for t in texts[lo : lo + 64]]
            if len(table) > TABLE_ENTRIES:
                empty = table[""]
                table.clear()
                table[""] = empty
            missing = {w for words in split for w in words if w not in table}
            once = self.learn(list(missing)) if missing else None
            find = table.__getitem__ if not once else _Both(table, once).__getitem__
            out += [b"".join([begin, *map(find, words), end]) for words in split]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


class _Both(dict):
    """A small table over a large one."""

    def __init__(self, large: dict, small: dict):
        super().__init__(small)
        self.large = large

    def __missing__(self, key):
        return self.large[key]


def _whole(run: bytes) -> bytes:
    """Bytes of a run as UTF-8, each byte outside a valid sequence as U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    run[i : i + n].decode()
                except UnicodeDecodeError:
                    continue
                out.append(run[i : i + n])
                i += n
                break
            else:
                out.append("�".encode())
                i += 1
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def table(path: str) -> PieceTable:
    return PieceTable(path)


def encode_decode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: ``key``, n_tokens, and ids array<long> and decoded string, or with ``digest`` their SHA-256 in hex.

    ``model`` is the path of a .model file that every executor can read.  Ids hold
    begin and end.  A null text is encoded as an empty one (begin and end only);
    repeated rows, null keys and empty tables pass row by row; other columns are
    ignored and can't clash.  One narrow pass, no shuffle.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<long>, decoded string"

    @F.pandas_udf(kind)
    def segment(texts: pd.Series) -> pd.DataFrame:
        pieces = table(model)
        rows = pieces.encode([t or "" for t in texts])
        ids = (np.frombuffer(r, "<u4") for r in rows)
        n = [len(r) // 4 for r in rows]
        if digest:
            sha = hashlib.sha256
            return pd.DataFrame({"n_tokens": n, "ids_sha256": [sha(r).hexdigest() for r in rows], "decoded_sha256": [sha(pieces.decode_bytes(i.tolist())).hexdigest() for i in ids]})
        ids = [i.astype("int64") for i in ids]
        return pd.DataFrame({"n_tokens": n, "ids": ids, "decoded": [pieces.decode(i.tolist()) for i in ids]})

    return df.select(key, segment(F.col(text)).alias("_pieces")).select(key, "_pieces.*")


def decode_ids(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: ``key`` and the text of an array of ids, null for a null array."""

    @F.pandas_udf("string")
    def decode(arrays: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else table(model).decode([int(i) for i in a]) for a in arrays], dtype="object")

    return df.select(key, decode(F.col(ids)).alias("decoded"))
