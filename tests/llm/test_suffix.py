import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.fixtures import frame, rows

from turnlake.llm import suffix_dedup


def brute(texts, length):
    seen = Counter()
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_covers_are_difference_covers():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("length, chunk, bucket", [(200, 1 << 21, 8 << 20), (200, 3000, 5000), (25, 500, 3000), (9, 200, 2000)])
def test_repeats_match_brute_force(spark, monkeypatch, length, chunk, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", (bucket, bucket))
    monkeypatch.setattr(suffix_dedup, "PART_TEXT", bucket)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", (chunk, chunk))
    data = [r for r in rows() if len(r[1] or "") < 5000] if length < 100 else rows()
    got = Counter(map(tuple, suffix_dedup.remove_repeats(frame(spark, data), length=length).collect()))
    assert got == Counter((r[0], *b[:4]) for r, b in zip(data, brute([r[1] for r in data], length)))


def _local(texts, length, size, buckets):
    """The sorts without Spark and without the comparison of bytes."""
    chunks = []
    for nth, lo in enumerate(range(0, len(texts), size)):
        bodies = [t.encode() for t in texts[lo : lo + size]]
        chunks.append(suffix_dedup.Chunk(b"".join(bodies), np.array([len(b) for b in bodies]), length, nth))
    ties = [[] for _ in chunks]
    for n, step in enumerate(suffix_dedup.STEPS):
        width = 8 if n in (suffix_dedup.LONG, suffix_dedup.LAST) else 4
        asked = [step(c, t) for c, t in zip(chunks, ties)]
        sent = [suffix_dedup._sorted_names(c, *a, buckets) for c, a in zip(chunks, asked)]
        replies = [[] for _ in chunks]
        for bucket in range(buckets):
            parts = []
            for i, (names, again, first, edges, *_) in enumerate(sent):
                a, z = edges[bucket], edges[bucket + 1]
                if z > a:
                    cut = (names[a:z] >> np.uint64(8)).astype("<u4") if width == 4 else names[a:z]
                    parts.append((i, cut.tobytes(), np.packbits(again[a:z]).tobytes(), first[a:z].astype("<u4").tobytes()))
            if parts:
                for i, tied, there, places in suffix_dedup._bucket_sort(parts, width):
                    replies[i].append({"bucket": bucket, "tied": tied, "chunks": there, "places": places})
        for c, t, r, a in zip(chunks, ties, replies, asked):
            t.append(suffix_dedup._read(c, r, *a, buckets, None))
    out = []
    for c, t in zip(chunks, ties):
        for n in (suffix_dedup.LONG, suffix_dedup.LAST):  # what the ties claim is true
            for flag, there, place, piece in suffix_dedup._claims(c, t[n]):
                assert chunks[there].body[place : place + len(piece)] == piece
        gone = c.spread(np.flatnonzero(suffix_dedup.starts(c, t)), 0, length - 1) if c.n else np.zeros(0, bool)
        at = 0
        for end in c.ends.tolist():
            out.append(gone[at:end].tolist())
            at = end
    return out


def test_random_strings_match_brute_force():
    rnd = random.Random(9)
    for trial in range(60):
        alphabet = rnd.choice(["ab", "abcd", "abcdefgh"])
        pool = ["".join(rnd.choices(alphabet, k=rnd.randint(5, 120))) for _ in range(4)]
        texts = []
        for _ in range(rnd.randint(1, 9)):
            texts.append("".join(rnd.choice(pool)[rnd.randint(0, 3) :] if rnd.random() < 0.5 else "".join(rnd.choices(alphabet, k=rnd.randint(0, 30))) for _ in range(rnd.randint(0, 5))))
        length = rnd.choice([5, 9, 14, 25, 40])
        got = _local(texts, length, rnd.randint(1, 4), rnd.randint(1, 5))
        for g, b in zip(got, brute(texts, length)):
            assert sum(g) == b[1], (trial, length)


def test_texts_and_columns_are_kept(spark):
    got = suffix_dedup.remove_repeats(frame(spark), texts=True)
    assert got.columns == frame(spark).columns
    want = Counter((r[0], r[2], r[4], None if r[1] is None else b[4].decode(errors="ignore")) for r, b in zip(rows(), brute([r[1] for r in rows()], 200)))
    assert Counter((g.doc_id, g.lang, g.n_chars, g.text) for g in got.collect()) == want
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name_bits", [3, 9, 13])
def test_equal_names_of_different_strings_change_nothing(spark, monkeypatch, name_bits):
    monkeypatch.setattr(suffix_dedup, "BUCKET_TEXT", (20_000, 20_000))
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", (9000, 9000))
    rnd = random.Random(name_bits)
    shared = "".join(rnd.choices("abcd ", k=400))
    texts = ["".join(rnd.choices("abcd ", k=rnd.randint(0, 700))) + shared[: rnd.randint(0, 400)] for _ in range(60)]
    texts += [shared[68:136] + "x" * 150, "y" * 150 + shared[68:136]] + texts[:4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, suffix_dedup.remove_repeats(df, name_bits=name_bits).collect()))
    assert got == Counter((i, *b[:4]) for i, b in enumerate(brute(texts, 200)))


def test_rows_grow_in_proportion():
    for text in (10**8, 5 * 10**8, 3 * 10**10, 10**12):
        chunk, buckets, parts = suffix_dedup.sizes(text)
        assert text / chunk * buckets < text / 10_000 and parts <= suffix_dedup.MAX_PARTS
