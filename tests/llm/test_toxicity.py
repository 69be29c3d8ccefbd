"""Toxicity: held-out accuracy on invented text, brute-force recount of margins, awkward rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from llm.fixtures import frame, rows
from turnlake.llm import toxicity

ABUSE = ["grolfang", "snivver", "plutterer"]


def corpus(n=900, seed=3):
    """Invented words; a sixth of the documents have one word in thirty of abuse, some of it inflected."""
    rnd = random.Random(seed)
    parts = ["an", "re", "ti", "on", "the", "is", "or", "ed", "ou", "nd", "ly", "ing"]
    vocab = ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(4000)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(30, 300))
        toxic = int(i % 6 == 0)
        if toxic:
            for at in rnd.sample(range(len(words)), max(2, len(words) // 30)):
                words[at] = rnd.choice(ABUSE) + rnd.choice(["", "", "ed", "s"])
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return df, marks, toxicity.fit(df, marks.where(~toxicity.held_out()))


def test_held_out_accuracy(fitted):
    df, marks, model = fitted
    found = toxicity.score(df, model).withColumn("held_out", toxicity.held_out()).join(marks, "doc_id").collect()
    assert {r.doc_id: r.held_out for r in found} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found}
    held = [r for r in found if r.held_out]
    right = [r for r in held if r.predicted == r.toxic]
    assert len(held) > 100 and len(right) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    # inflected abuse that training never saw
    spark = df.sparkSession
    words = " ".join(["thereon", "antied"] * 20)
    new = spark.createDataFrame([(1, words), (2, f"{words} grolfangish {words} snivverly plutterering {words}")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    assert s[1] < 0.5 < s[2]


def test_labels_of_other_documents_change_nothing(fitted):
    """A score depends on the text only: same texts under other ids and other columns get the same scores."""
    df, _, model = fitted
    a = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    moved = df.selectExpr("doc_id + 5000 as doc_id", "text", "'x' as lang", "1 as toxic", "0.3 as score")
    assert {r.doc_id - 5000: r.score for r in toxicity.score(moved, model).collect()} == a


def test_margins_equal_a_plain_recount(fitted):
    df, _, model = fitted
    ordinary, both = toxicity._compressor(model.ordinary), toxicity._compressor(model.ordinary + model.toxic)
    of = toxicity.Margins(model.ordinary, model.toxic)
    for text in ["", "a", ABUSE[0], "Grolfang GROLFANG and the other", "x" * 100, "漢字" * 40, *(r.text for r in df.limit(20).collect())]:
        want = Counter()
        for w in toxicity.windows_of(text.lower()):
            data = f" {w} ".encode() + toxicity._MARK
            want[min(max(len(ordinary.compress(data)) - len(both.compress(data)), toxicity.LOW), toxicity.HIGH)] += 1
        for _ in range(2):  # the second time from the table
            assert of.counts(text).tolist() == [want[v] for v in range(toxicity.LOW, toxicity.HIGH + 1)]
    assert sum(of.counts("x" * 100)) == 5  # long runs are cut, none of their letters is left out


def test_the_curve_finds_planted_rates():
    rnd = np.random.default_rng(2)
    x = np.stack([np.ones(4000), rnd.normal(size=4000)], axis=1)
    p = 1 / (1 + np.exp(-(x @ [-1.0, 2.0])))
    w, mean, spread = toxicity.fit_curve(x, (rnd.random(4000) < p) * 1.0, 0.0)
    assert abs(w[1] / spread[1] - 2) < 0.25 and abs(w[0] - w[1] * mean[1] / spread[1] + 1) < 0.25


@pytest.mark.parametrize("labels", [[], [(0, 0), (1, 0), (2, None), (None, 1)], [(0, 1), (1, 1)], [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (1, 1)]])
def test_awkward_rows(spark, labels):
    """Few or no labels, nulls, empty and long texts, repeated rows, clashing columns; every row gets a score."""
    df = frame(spark)
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.score(df, model).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows())
    assert all(0 <= r.score <= 1 for r in found) and len({r.score for r in found if r.doc_id in (1000, 1001, 1002)}) == 1
    assert toxicity.score(frame(spark, []).limit(0), model).count() == 0
    odd = df.selectExpr("doc_id as `a.b`", "text as `t.x`", "fingerprint as score")
    assert toxicity.score(odd, model, key="a.b", text="t.x").columns == ["a.b", "score", "predicted"]
    assert toxicity.score(odd, model, key="a.b", text="t.x").count() == len(found)
