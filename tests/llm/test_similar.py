import random
from collections import Counter

import numpy as np
import pandas as pd
from llm.fixtures import frame

from turnlake.llm import near_dedup, similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_least(data):
    """The least key of each row's group by brute-force Jaccard."""
    sets, root = [shingles(r[1]) for r in data], list(range(len(data)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[k]:
                was = root[i]
                root = [root[k] if r == was else r for r in root]
    least = {}
    for r, g in zip(data, root):
        least[g] = min(r[0], least.get(g, r[0]))
    return [least[g] for g in root]


def edited(seed=3):
    """Documents in which some words are exchanged, similarities from 0.6 to 1, and one large group of them."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for n in [rnd.randint(10, 300) for _ in range(60)] + [200]:
        base = rnd.choices(vocab, k=n)
        for _ in range(40 if len(texts) > 200 else 3):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, n // 30))):
                words[rnd.randrange(n)] = rnd.choice(vocab)
            texts.append(" ".join(words))
        texts.append(" ".join(base))
    return [(i, t, "en", "s", 1, 7, "x", "y", "z", "k", 3) for i, t in enumerate(texts)]


def test_similar_groups_match_brute_force_jaccard(spark, monkeypatch):
    data = edited()
    want = Counter(zip([r[0] for r in data], brute_least(data)))
    for block in (4096, 3):
        monkeypatch.setattr(similar, "BLOCK", block)
        assert Counter((r.doc_id, r.component_id) for r in similar.similar_groups(frame(spark, data)).collect()) == want
    assert {r.doc_id for r in similar.keep_one(frame(spark, data)).collect()} == {least for _, least in want}
    assert similar.similar_groups(frame(spark, [])).count() == 0
    # the bits of SimHash don't reach: pairs at 0.8 and more that are further apart than they allow
    far = sum(near_dedup.fingerprint(data[a][1]) ^ near_dedup.fingerprint(data[b][1]) > 0 and (near_dedup.fingerprint(data[a][1]) ^ near_dedup.fingerprint(data[b][1])).bit_count() > near_dedup.MAX_BITS for a, b in want if a != b)
    assert far > 20


def test_parities_rule_out_no_similar_pair():
    rnd = random.Random(5)
    for _ in range(300):
        both = {rnd.getrandbits(64) for _ in range(rnd.choice([1, 20, 130, 3000]))}
        sides = [both | {rnd.getrandbits(64) for _ in range(rnd.randint(0, max(1, len(both) // 3)))} for _ in "ab"]
        rows = [np.array(sorted(x), "uint64") for x in sides]
        pars = np.array([similar.parity(x) for x in rows] + [b""], object)[:2]
        size, place, by_size = similar._parities(pars)
        words = int(size.min()) // 8
        a, b = (similar._folded(by_size[int(size[i])][place[i]][None], words) for i in (0, 1))
        assert int(np.bitwise_count(a ^ b).sum()) <= len(sides[0] ^ sides[1])


def test_members_are_numbered_across_batches():
    sigs = [1, 2, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    for width in (1, 2, 3, 11):
        table = pd.DataFrame({"sig": sigs, "fp": range(len(sigs))})
        got = pd.concat(list(similar._shared(iter([table[i : i + width].reset_index(drop=True) for i in range(0, len(sigs), width)]))))
        assert list(zip(got["sig"], got["fp"], got["nth"])) == [(2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3), (4, 6, 0), (4, 7, 1), (6, 9, 0), (6, 10, 1)]


def test_a_group_of_unlike_texts_sends_few_pairs():
    """Texts that share half their shingles, all in one signature: the pairs sent don't grow with the square."""
    rnd = random.Random(9)
    half = {rnd.getrandbits(64) for _ in range(100)}
    sets = [np.array(sorted(half | {rnd.getrandbits(64) for _ in range(60)}), "uint64") for _ in range(150)]
    low = [similar.sketch(similar.minima(x)) for x in sets]
    fps = np.arange(150)
    rows = pd.DataFrame({"sig": 1, "lo": 0, "hi": 0, "block": 0, "fp": fps, "root": fps, "n": [len(x) for x in sets], "s0": [x[0] for x in low], "s1": [x[1] for x in low], "par": [similar.parity(x) for x in sets]})
    for every in (False, True):
        assert sum(map(len, similar._pairs(every)(iter([rows])))) == 0


def test_simhash_pairs_are_candidates(spark, monkeypatch):
    """Without MinHash signatures that agree, near fingerprints alone link a text and its copy with a word more."""
    text = " ".join(f"word{i}" for i in range(400))
    data = [(1, text, None), (2, text + " end", None), (3, " ".join(f"other{i}" for i in range(400)), None)]
    monkeypatch.setattr(similar, "_shared", lambda batches: iter(()))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert {r.doc_id: r.component_id for r in similar.similar_groups(df).collect()} == {1: 1, 2: 1, 3: 3}
