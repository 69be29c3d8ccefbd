import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm.fixtures import frame
from llm.test_native import WORDS, brute_features

from turnlake.llm import quality_rules


def labelled(spark, good, junk, langs):
    """Documents of some strata and their labels: ids below 100,000 are good."""
    data = [(1000 * s + i, " ".join(f"w{i}x{k}" for k in range(30)), la) for s, la in enumerate(langs) for i in range(good)]
    data += [(100_000 + 1000 * s + i, " ".join(f"w{i}x{k}***" for k in range(30)), la) for s, la in enumerate(langs) for i in range(junk)]
    docs = frame(spark, [(i, t, la, "s", 1, 7, "x", "y", "z", "k", 3) for i, t, la in data])
    return docs, spark.createDataFrame([(r[0], int(r[0] < 100_000), 0) for r in data], "doc_id long, quality int, toxic int"), data


def test_small_strata_get_cutoffs(spark):
    docs, labels, data = labelled(spark, 400, 30, ["en", "de", "fr", "es"])
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert not any(kept[r[0]] for r in data if r[0] >= 100_000)
    assert sum(not kept[r[0]] for r in data if r[0] < 100_000) <= 0.02 * 1600


def test_no_stratum_is_a_stratum(spark):
    docs, labels, data = labelled(spark, 400, 30, ["en", None])
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    assert not any(kept[r[0]] for r in data if r[0] >= 100_000)


def test_seventy_strata_have_cutoffs_of_their_own(spark):
    """In each stratum good documents may hold as many symbols as its own ones do, whatever the others hold."""
    data = []
    for s in range(70):
        star = " *" if s == 69 else ""  # its good documents have a symbol in every word
        data += [(1000 * s + i, " ".join(f"w{i}x{k}{star}" for k in range(20)), f"l{s}") for i in range(480)]
        data += [(100_000 + 1000 * s + i, " ".join(f"w{i}x{k} ****" for k in range(20)), f"l{s}") for i in range(20)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(k, int(k < 100_000)) for k, _, _ in data], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    for s in range(70):
        assert not any(kept[100_000 + 1000 * s + i] for i in range(20)), s
        assert sum(not kept[1000 * s + i] for i in range(480)) <= 0.02 * 480, s


def brute_kept(data, quality, risk=quality_rules.RISK, delta=quality_rules.DELTA):
    """All of it again, in loops over documents: features, trials, path, exact bounds, verdicts."""
    rules = list(quality_rules.RULES.items())
    rows = []
    for key, text, la in data:
        n, chars, symbols, dup, repeated, failed = brute_features(text)
        value = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated}
        place = []
        for _, (over, under, side, ladder) in rules:
            ratio = value[over] / value[under] if value[under] else None
            place.append(next((i for i, c in enumerate(ladder) if ratio is not None and (ratio > c if side == "above" else ratio < c)), len(ladder)))
        rows.append((key, la, failed, tuple(place), text))
    trials = {}
    for key, la, failed, place, text in rows:
        if not failed and key in quality:
            words = WORDS.findall(text)
            group = min(window_hash(words[i : i + 5]) for i in range(len(words) - 4))
            at = (la, group, quality[key] == 1)
            trials[at] = tuple(map(min, trials[at], place)) if at in trials else place
    use = {at: 2 if not at[2] else int(xxhash64(at[1], xxhash64(11, 42, "int"), "long") % 5 == 0) for at in trials}
    test = lambda la: [p for at, p in trials.items() if at[0] == la and use[at] == 0]
    strata = [la for la in {at[0] for at in trials} if sum(1 for _ in test(la)) and (1 - risk) ** len(test(la)) <= delta]
    good, junk = [p for at, p in trials.items() if use[at] == 1], [p for at, p in trials.items() if use[at] == 2]
    hit = lambda places, to: sum(any(a < b for a, b in zip(p, to)) for p in places)
    limits = {}
    for la in strata:
        own, proof, to = [p for at, p in trials.items() if at[0] == la and use[at] == 1], test(la), [0] * len(rules)
        limits[la] = list(to)
        while any(to[r] < len(rules[r][1][3]) for r in range(len(rules))):
            best = None
            for r in range(len(rules)):
                if to[r] < len(rules[r][1][3]):
                    step = to[:r] + [to[r] + 1] + to[r + 1 :]
                    cost = (hit(own, step) + hit(good, step), -hit(junk, step), step[r] / len(rules[r][1][3]), r)
                    best = min(best, (cost, step)) if best else (cost, step)
            to = best[1]
            k, n = hit(proof, to), len(proof)
            if k >= n or sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) > delta / len(strata):
                break
            limits[la] = list(to)
    return Counter((key, not failed and not any(a < b for a, b in zip(place, limits.get(la, [0] * len(rules))))) for key, la, failed, place, _ in rows), limits


def xxhash64(value, seed, kind):
    data = value.to_bytes(4 if kind == "int" else 8, "little", signed=True)
    h = xxhash.xxh64_intdigest(data, seed=seed % (1 << 64))
    return h - (1 << 64) if h >= 1 << 63 else h


def window_hash(words):
    """The hash of a window as pairs of pairs and one more word; its order is all that matters."""
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    h = [x - (1 << 64) if x >= 1 << 63 else x for x in h]
    two = lambda a, b: xxhash64(b, xxhash64(a, 42, "long"), "long")
    return two(two(two(h[0], h[1]), two(h[2], h[3])), h[4])


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_equals_the_loop(spark, seed):
    rnd = random.Random(seed)
    data, quality = [], {}
    for i in range(1500):
        la = rnd.choice(["en", "en", "en", "de", None])
        words = [f"w{rnd.randrange(400)}" + "*" * (rnd.random() < 0.05) for _ in range(rnd.randint(5, 60))]
        if i % 5 == 0:
            words = [w + rnd.choice(["#", "***", "longlonglonglonglonglong"]) for w in words]
        text = " ".join(words) + "\n" + "\n".join(rnd.choices(["a line of its own", "twice", "x y"], k=rnd.randint(0, 3)))
        data.append((i, text, la))
        quality[i] = int(i % 5 != 0)
        if rnd.random() < 0.2:  # copies, labelled too, and unlabelled documents
            data.append((10_000 + i, text, la))
            quality[10_000 + i] = quality[i]
        if rnd.random() < 0.1:
            del quality[i]
    data += [data[0], (None, "a null key with its ten words here and some more", "en"), (20_000, None, "en"), (20_001, "", None)]
    quality.update({20_000: 1, 20_001: 0})
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([*quality.items(), (None, 1)], "doc_id long, quality int")
    want, limits = brute_kept(data, quality)
    assert any(map(any, limits.values()))
    assert Counter((r.doc_id, r.kept) for r in quality_rules.judge(docs, labels).collect()) == want


def test_copies_are_no_trials(spark):
    """Forty good texts certify nothing, however often each is copied, exactly or nearly."""
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    data = [(100 * i + c, text(i), "en") for i in range(40) for c in range(10)] + [(9000 + i, text(i) + " ***" * 40, "en") for i in range(30)]
    labels = spark.createDataFrame([(k, int(k < 9000)) for k, _, _ in data], "doc_id long, quality int")
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(docs, labels).collect())
    rows = quality_rules.features(docs).cache()
    assert quality_rules.fit_cutoffs(rows, labels).count() == 0
    assert quality_rules.labelled_kinds(rows, labels, "doc_id").where("use < 2").agg({"n": "sum"}).first()[0] == 40
    rows.unpersist()


def test_paths_falsely_pass_no_more_often_than_stated():
    rnd = np.random.default_rng(4)
    lengths = [len(ladder) for _, _, _, ladder in quality_rules.RULES.values()]

    def draw(n):
        kinds = np.tile(np.array(lengths), (n, 1))
        for r, length in enumerate(lengths):  # each of the last steps rejects 0.4 % more of good documents
            hit = rnd.random(n) < 0.004 * length
            kinds[hit, r] = rnd.integers(0, length, int(hit.sum()))
        return np.c_[kinds, np.ones(n, "int64")]

    none, wrong, passed = np.zeros((0, len(lengths) + 1), "int64"), 0, 0
    for _ in range(300):
        choose = draw(100)
        at = quality_rules.certified(quality_rules.tightening_path(none, choose, draw(30)), draw(600), 0.02, 0.05)
        rate = 1 - np.prod([1 - 0.004 * a for a in at])
        wrong, passed = wrong + (rate > 0.02), passed + any(at)
    assert passed > 200
    assert wrong <= 300 * 0.05 + 3 * (300 * 0.05 * 0.95) ** 0.5
