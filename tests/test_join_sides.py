import re

import pytest

from turnlake.operators import frames, masks, smoothing


@pytest.fixture
def small(spark, tmp_path):
    """Decoded activity, clusters and embeddings, so small that Spark would broadcast any side."""
    seg = spark.createDataFrame([(1, c, f, s, float((c + f + s) % 2)) for c in range(2) for f in range(4) for s in range(2)], "file_id long, chunk_idx int, frame_idx int, speaker_idx int, active double")
    clusters = spark.createDataFrame([(1, c, s, s) for c in range(2) for s in range(2)], "file_id long, chunk_idx int, speaker_idx int, cluster int")
    for name, rows in (("seg", seg), ("clusters", clusters)):
        rows.write.parquet(f"{tmp_path}/{name}")  # files have a size, made rows have none
    return spark.read.parquet(f"{tmp_path}/seg"), spark.read.parquet(f"{tmp_path}/clusters")


def broadcast_joins(df, key):
    """Broadcast joins whose keys have the column ``key``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan) if key in x]


def test_rows_a_frame_are_never_broadcast(spark, small, monkeypatch):
    seg, clusters = small
    counts = frames.speaker_count(seg, 1.0)
    activations = frames.cluster_activations(seg, clusters, 1.0, counts)
    for df in (counts, activations, frames.top_k(activations, counts)):
        assert not broadcast_joins(df, "out_frame")
    written = []
    monkeypatch.setattr(smoothing, "materialized", lambda df, name: written.append(df) or df)
    smoothing.smoothed_top_k(activations, counts)
    assert written and not broadcast_joins(written[0], "out_frame")


def test_rows_a_chunk_are_never_broadcast(spark, small):
    seg, clusters = small
    rows = clusters.selectExpr("file_id", "chunk_idx", "speaker_idx", "array(1f, 2f) as embedding")
    for df in (masks.training_set(seg, rows), masks.mark_inactive(seg, clusters), frames.cluster_activations(seg, clusters, 1.0)):
        assert not broadcast_joins(df, "chunk_idx")
