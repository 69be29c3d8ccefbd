"""Spelling variants against an edit-distance loop over all words, and in DuckDB."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from llm.fixtures import frame, rows
from turnlake.llm import oracles, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least_length=6, least_count=5, ratio=5, typo_every=199):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def got(df):
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    return found


def misspelt(seed, stems=25, letters="abcdeé", counts=(5, 26, 140, 700)):
    """Words with variants, variants of these, words that share all but one letter, and letters repeated in a row."""
    rnd = random.Random(seed)
    words = Counter()
    for _ in range(stems):
        w = "".join(rnd.choices(letters, k=rnd.randint(6, 11)))
        for n in rnd.sample(counts, rnd.randint(1, len(counts))):
            words[w] += n
            at = rnd.randrange(len(w))
            w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w[:at] + rnd.choice(letters) + w[at + 1 :]])
    words["aaaaaa"] += 5
    words["aaaaaaa"] += 5
    runs = [w for w, n in words.items() for _ in range(n)]
    rnd.shuffle(runs)
    return [(i, " ".join(runs[i::40])) for i in range(40)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_loop(spark, seed):
    docs = misspelt(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert got(spelling.variants(df)) == want and any(v[0] for v in want.values())
    assert max(v[3] for v in want.values()) > 1
    assert got(spelling.variants(df, typo_every=7, least_count=3, ratio=2)) == brute(docs, least_count=3, ratio=2, typo_every=7)


def test_chains_lead_to_their_last_word(spark):
    chain = [("abcdefghij"[: 6 + k], 5**k) for k in range(1, 5)]  # 5, 25, 125, 625
    docs = [(None, " ".join(w for w, n in chain for _ in range(n)))]
    found = got(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), typo_every=0))
    assert {w: v[1] for w, v in found.items()} == {w: chain[-1][0] for w, _ in chain}


def test_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, a null key and clashing columns; and no rows at all."""
    data = rows()
    assert got(spelling.variants(frame(spark), least_count=2)) == brute([(r[0], r[1]) for r in data], least_count=2)
    assert spelling.variants(frame(spark, []).limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None), (2, "")], "doc_id long, text string")
    assert spelling.variants(nulls).collect() == []
    odd = spark.createDataFrame([("k", "Straße STRASSE Étésss étésss " * 6, 1)], "`a.b` string, `t.x` string, word int")
    assert set(got(spelling.variants(odd, key="a.b", text="t.x", typo_every=0))) == {"straße", "strasse", "Étésss", "étésss"}


def test_every_edit_shares_a_key():
    """Each edit at each place of a word, repeated letters included: the words have a key in common."""
    for w in ("aaaaaa", "abcabcab", "bananas", "éàéàéàé", "abcdefgh"):
        for at in range(len(w) + 1):
            edits = {w[:at] + c + w[at:] for c in "abé"} | {w[:at] + w[at + 1 :] for _ in [0] if at < len(w)} | {w[:at] + c + w[at + 1 :] for c in "abé" if at < len(w)}
            for v in edits - {w}:
                a, b = sorted((w, v), key=len)
                for order in (1, -1):
                    grams = sorted({x[i : i + 2] for x in (a, b) for i in range(len(x) - 1)})[::order]
                    ranks = {g: i for i, g in enumerate(grams)}
                    assert spelling.keys_of(a, ranks)[1] & spelling.keys_of(b, ranks)[0], (a, b)


def test_sql(spark):
    docs = misspelt(9) + [(900, None), (901, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = {r[0]: tuple(r[1:]) for r in con.sql(oracles.OP11).select("word, form, root, n, n_near, form_n").fetchall()}
    assert got(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_vocabularies_are_never_broadcast(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(w, 9) for w in ("lantern", "lanterns", "lentern")], "word string, n long").write.parquet(f"{tmp_path}/words")
    scratch = spelling.Scratch(spark, "spelling-test")
    plans, save = [], spelling.Scratch.save

    def saved(self, df, name, *rest):
        plans.append(df)
        return save(self, df, name, *rest)

    monkeypatch.setattr(spelling.Scratch, "save", saved)
    pairs = spelling.near_pairs(spark.read.parquet(f"{tmp_path}/words"), scratch)
    assert pairs.count() == 2
    docs = spark.createDataFrame([(i, "lantern " * 9 + "lentern lanters lanter") for i in range(6)], "doc_id long, text string")
    plans.append(spelling.variants(docs))
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in plans)
