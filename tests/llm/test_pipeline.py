import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from llm.fixtures import frame, rows
from llm.test_native import brute_features
from llm.test_similar import shingles
from llm.test_suffix import brute
from tokenizers import Tokenizer

from turnlake.llm import language_id, packing


def brute_kept(data):
    """One row of each group of rows linked at a Jaccard similarity of 0.8: that with the smallest key; a group without keys keeps one row."""
    sets, group = [shingles(r[1]) for r in data], list(range(len(data)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if group[i] != group[k] and 5 * len(a & b) >= 4 * len(a | b):
                was = group[i]
                group = [group[k] if g == was else g for g in group]
    out = {}
    for r, g in zip(data, group):
        if g not in out or r[0] is not None and (out[g][0] is None or r[0] < out[g][0]):
            out[g] = r
    return list(out.values())


def test_stages_match_brute_force_end_to_end(spark, tmp_path):
    path = str(tmp_path)
    frame(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), rows()
    assert len(corpus_pipeline.STAGES) == 5
    model = None
    for nth, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "language_id":
            model = language_id.fit(docs.where(~language_id.held_out()))
        stage(spark, docs, path).write.parquet(f"{path}/{nth}")
        out = spark.read.parquet(f"{path}/{nth}")
        if name == "quality_rules":
            kept = [r for r in kept if not brute_features(r[1])[5]]
        elif name == "language_id":
            scorer = language_id.Scorer(model)
            kept = [r for r in kept if (p := scorer.predict(r[1]))[0] != "und" and p[1] >= 0.5]
        elif name == "near_dedup":
            kept = brute_kept(kept)
        elif name == "suffix_dedup":
            cut = [b[4].decode(errors="ignore") for b in brute([r[1] for r in kept], 200)]
            kept = [(r[0], t, r[2], r[3], len(t), *r[5:]) for r, t in zip(kept, cut)]
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = Counter()
            for r in kept:
                ids = tok.encode(r[1], add_special_tokens=False).ids + [2]
                for piece, (start, n) in enumerate(packing.cut(len(ids))):
                    want[r[0], piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            assert Counter(tuple(g)[:5] for g in out.collect()) == want
            break
        assert out.columns == docs.columns
        assert Counter(map(tuple, out.collect())) == Counter(kept), name
        docs = out
    assert corpus_pipeline.run(spark, path).count() == sum(want.values())


def test_empty_tables_and_nulls_only(spark, tmp_path):
    kind = spark.createDataFrame(rows()[:1], frame(spark).schema).select("doc_id", "text", "lang", "source", "n_chars").schema
    nulls = [(i if i else None, None, None, None, None) for i in range(6)]
    want = {"quality_rules": 0, "language_id": 0, "near_dedup": 1, "suffix_dedup": 6, "packing": 6}
    for data, path in (([], f"{tmp_path}/empty"), (nulls, f"{tmp_path}/nulls")):
        spark.createDataFrame(data, kind).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(None, None, None)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, path)
            assert out.count() == (want[name] if data else 0), name
            assert name == "packing" or out.columns == docs.columns
        assert corpus_pipeline.run(spark, path).count() == 0
