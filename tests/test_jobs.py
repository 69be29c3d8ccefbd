"""Jobs whose parts arrive over micro-batches."""

import pytest

from turnlake.streaming import jobs, queue

SCHEMA = "file_id string, part int, total int"


def feed(spark, folder, batches, work=lambda df: df):
    """Each batch is a run of the stream of its own, on one checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        jobs.wait(jobs.run(stream, work, f"{folder}/out", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/out").orderBy("job_id").collect()


def test_a_job_starts_with_its_last_part_and_ends_once(spark, tmp_path):
    first = [("a", 1, 3), ("a", 0, 3), ("b", 0, 1), ("c", 0, 2), ("c", 0, 2), ("wide", 16, 17), (None, 0, 1)]
    second = [("a", 1, 3), ("b", 0, 1), ("c", 1, 2), ("over", 5, 2), ("mixed", 0, 2)] + [("wide", i, 17) for i in range(16)]
    third = [("a", 2, 3), ("a", 2, 3), ("c", 0, 2), ("over", 0, 2), ("mixed", 1, 4), ("null", None, 2), ("late", 0, 2)]
    found = feed(spark, str(tmp_path), [first, second, third])
    assert [(r.file_id, r.parts, r.state, r.batch) for r in found] == [
        (None, 1, "complete", 0), ("b", 1, "complete", 0), ("c", 2, "complete", 1), ("over", None, "failed", 1), ("wide", 17, "complete", 1),
        ("a", 3, "complete", 2), ("mixed", None, "failed", 2), ("null", None, "failed", 2),
    ]
    ids = [r.job_id for r in found]
    assert ids == sorted(set(ids)) and [i >> jobs.BATCH_SHIFT for i in ids] == [r.batch for r in found]


def test_work_that_fails_stops_the_stream_and_starts_again(spark, tmp_path):
    def bad(df):
        raise ValueError("no disk")

    with pytest.raises(queue.QueueError, match="no disk"):
        feed(spark, str(tmp_path), [[("a", 0, 1)]], bad)
    found = feed(spark, str(tmp_path), [[("b", 0, 1)]])
    assert sorted(r.file_id for r in found) == ["a", "b"]
