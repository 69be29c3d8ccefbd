"""Operators that keep rows keep them as they are."""

import datetime
from collections import Counter
from decimal import Decimal

import pytest

from turnlake.llm import language_id, quality_rules, sharding, similar, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, __null boolean, _label string, _row string, _shard int, _slot int, `a.b` string, at timestamp, amount decimal(12,3), raw binary, p string, k string, body string"


def table(spark):
    def row(key, text, lang="en"):
        return (key, text, lang, True, "label", "row", 4, 5, "dot", datetime.datetime(2024, 5, 6, 7, 8, 9, 123456), Decimal("12345.678"), bytearray(b"\x00\xff"), "p", "k", "body")

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    return spark.createDataFrame([row(1, words), row(1, "quite another text of one two three four five six words"), row(None, "no key but ten words and more of them for the rules"), row(None, None), row(2, words), row(2, words), row(3, "", None)], SCHEMA).repartition(2)


def values(df):
    return Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect())


def test_rows_stay_as_they_are(spark, tmp_path):
    df = table(spark)
    want = values(df)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = language_id.train({"en": {w: 2 for w in "alpha beta one two key words rules quite".split()}})
    for got in (suffix_dedup.remove_repeats(df, texts=True), language_id.keep_known(df, model), similar.keep_one(df), quality_rules.keep_good(df, labels)):
        assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
        assert values(got) <= want
    assert values(suffix_dedup.remove_repeats(df, texts=True)) == want
    assert sorted(r.text for r in language_id.keep_known(df, model).collect()) == sorted(t[1] for t in want.elements() if t[1])
    # one row of each group of equal texts stays; null and empty texts are one group
    assert sorted(r.text or "" for r in similar.keep_one(df).collect()) == sorted({t[1] or "" for t in want})
    for law in ("bytes", "rows"):
        column = sharding.write_shards(df, str(tmp_path / law), 3, law=law)
        back = spark.read.parquet(str(tmp_path / law))
        assert column == "_shard_" and values(back.select(*[f"`{c}`" for c in df.columns])) == want


@pytest.mark.parametrize("kind, make", [("string", str), ("binary", lambda i: bytearray([i])), ("struct<a:int>", lambda i: (i,))])
def test_keys_of_any_type(spark, kind, make):
    text = "some words in a row " * 20
    df = spark.createDataFrame([(make(i), text if i % 2 else f"{i} {text[:90]}") for i in range(6)] + [(None, None)], f"id {kind}, text string")
    got = suffix_dedup.remove_repeats(df, key="id").collect()
    assert sum(r.n_removed > 0 for r in got) == 3 and sum(r.id is None for r in got) == 1
