import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import pytest
import xxhash
from llm.fixtures import SCHEMA, frame, rows

from turnlake.llm import fingerprints, quality_rules, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_features(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def test_quality_features_match_brute_force(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(frame(spark), labels).collect()
    want = Counter((r[0], *brute_features(r[1])) for r in rows())
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got) == want
    assert all(g.kept == (not g.base_failed) for g in got)  # too few labels to certify a cutoff
    assert quality_rules.judge(frame(spark, []), labels).count() == 0


def test_binomial_bound_is_exact():
    for n in (5, 40, 300):
        for risk in (0.01, 0.1):
            for k in range(0, n, max(1, n // 9)):
                p = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
                for level in (0.5, 0.05, 1e-4):
                    if abs(p - level) > 1e-9:
                        assert quality_rules.passes(k, n, risk, level) == (p <= level)


def test_certified_cutoffs_reject_few_good_documents(spark):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 1) for i in range(3000)]
    junk = [(5000 + i, " ".join(f"w{i}x{k}***" for k in range(30)), "en", "s", 1) for i in range(200)]
    docs = frame(spark, [r + (7, "x", "y", "z", "k", 3) for r in good + junk])
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000), 0) for r in good + junk], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert sum(not kept[r[0]] for r in good) <= 0.02 * len(good)
    assert not any(kept[r[0]] for r in junk)


def test_fingerprints_edit_and_match_guarantee(spark):
    got = fingerprints.edited_fingerprints(frame(spark)).collect()
    docs = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(docs)
    by = {}
    for (key, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        by.setdefault(key, set()).add((len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert all((g.n_chars, g.edited_sha256) in by[g.doc_id] for g in got)
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    texts = {r[0]: r[1] or "" for r in rows()}
    prints = {}
    for g in got:
        prints.setdefault(texts[g.doc_id], set()).add(g.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(frame(spark, rows()[:1])).first().doc_id == 0


@pytest.mark.parametrize("n", [1200])
def test_fingerprints_over_many_buckets(spark, n, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)
    data = [(3 * i, f"text {i} " * (i % 13), "en", "s", 1, 7, "x", "y", "z", "k", 3) for i in range(n)]
    got = {g.doc_id: g for g in fingerprints.edited_fingerprints(frame(spark, data)).collect()}
    assert len(got) == n
    for a, b in zip(data, data[1:] + data[:1]):
        q = len(a[1]) // 4
        assert got[a[0]].edited_sha256 == hashlib.sha256((a[1][: len(a[1]) - q] + b[1][:q]).encode()).hexdigest()


def brute_tokens(text):
    out = []
    for word in WORDS.findall(text or ""):
        out += [word] if len(word) <= fingerprints.WORD else list(word)
    return out


def brute_fingerprint(text):
    """(hash, position) of the marks, by an independent reading of the docstring: XXH64 chains, windows, rightmost minimum."""
    long = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
    pair = lambda a, b: long(b, long(a, 42))
    one = [xxhash.xxh64_intdigest(t.encode(), 42) for t in brute_tokens(text)]
    two = [pair(a, b) for a, b in zip(one, one[1:])]
    grams = [pair(a, b) for a, b in zip(two, two[2:])]
    if one and len(one) < fingerprints.K:
        h = 42
        for x in one:
            h = long(x, h)
        grams = [h]
    found = []
    for at in range(max(1, len(grams) - fingerprints.WINDOW + 1) if grams else 0):
        window = [(grams[i] >> 31, i) for i in range(at, min(len(grams), at + fingerprints.WINDOW))]
        least = min(h for h, _ in window)
        mark = max(x for x in window if x[0] == least)
        if mark not in found:
            found.append(mark)
    return found


def brute_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_match_brute_force(spark):
    data = [(r[0], r[1]) for r in rows() if r[0] is not None and (r[0] < 1005 or r[0] == 1007)][:-2]
    data += [(2000 + i, t) for i, t in enumerate(["漢字" * 300, "x" + "漢字" * 300, "a" * 16, "a" * 17, "same same same same same same same same same", "b" * 40 + " c"])]
    got = {g.doc_id: g for g in fingerprints.edited_fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    plain = {g.doc_id: g for g in fingerprints.fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    name = lambda marks: hashlib.md5(",".join(str((h << 30) + (1 << 30) - 1 - i) for h, i in marks).encode()).hexdigest()
    data = sorted((k, t or "") for k, t in data)
    for (key, text), (_, following) in zip(data, data[1:] + data[:1]):
        q = len(text) // 4
        mine, edited, after = (brute_fingerprint(t) for t in (text, text[: len(text) - q] + following[:q], following))
        assert list(zip(plain[key].hashes, plain[key].positions)) == mine
        assert (got[key].fingerprint, got[key].edited_fingerprint) == (name(mine), name(edited))
        assert got[key].near_edited == pytest.approx(brute_likeness(mine, edited)) and got[key].near_next == pytest.approx(brute_likeness(mine, after))


def test_passages_without_blanks_are_found_at_any_offset(spark):
    rnd = random.Random(4)
    text = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(2000))
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(1, text), (2, "x" + text)], "doc_id long, text string")).collect()
    assert all(g.near_next > 0.9 for g in got)


@pytest.mark.parametrize("kind, make", [("string", lambda i: f"k{i:03d}"), ("decimal(9,2)", lambda i: Decimal(i) / 4), ("date", lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)), ("int", lambda i: i - 20)])
def test_keys_of_any_type(spark, monkeypatch, kind, make):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)
    data = [(make(i), f"text {i} and more of it {i * 7}") for i in range(120)] + [(None, "no key")]
    got = {g.id: g.edited_sha256 for g in fingerprints.edited_fingerprints(spark.createDataFrame(data, f"id {kind}, text string").repartition(3), key="id").collect()}
    order = [data[-1], *data[:-1]]
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        q = len(text) // 4
        assert got[key] == hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    got = sharding.assign_shards(frame(spark), 5, law=law).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((g.doc_id, g["size"], g.text_crc32) for g in got) == want
    by = {}
    for g in got:
        by.setdefault(g.shard, []).append(g)
    assert set(by) <= set(range(5))
    for shard in by.values():
        assert sorted(g.slot for g in shard) == list(range(len(shard)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.assign_shards(frame(spark, []), 5).count() == 0


def test_shards_of_one_hot_text_are_even(spark):
    data = [(i, "same text of some length" if i % 3 else f"other {i}", "en", "s", 1, 7, "x", "y", "z", "k", 3) for i in range(4000)]
    sums = [r["b"] for r in sharding.assign_shards(frame(spark, data), 8).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 100


def test_schema_is_stable(spark):
    assert SCHEMA and [f.name for f in sharding.assign_shards(frame(spark), 3).schema] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
