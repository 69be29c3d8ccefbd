"""The query registry: one query per operator, over the relations derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.config import INACTIVE, SAMPLE_RATE, STEPS, WINDOW_SECONDS, BinarizeConfig, PipelineConfig, VbxConfig, window_step
from turnlake.functions import vectors
from turnlake.operators import binarize, errors, frames, intervals, kernels, layout, masks, mixture, powerset, selection, smoothing, turns
from turnlake.plans import backend, oracles, pipeline, relations
from turnlake.session import materialized, shared_folder
from turnlake.sources import annotations, audio, file_sink, wav_ranges
from turnlake.streaming import jobs, queue

STEP = 1.0
ONSET, OFFSET = 0.2, 0.1
_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    _registry[function.__name__] = function
    return function


# ---- errors and intervals


@query
def der_per_file(spark, sf_dir):
    rows = errors.components(relations.segments(spark, sf_dir))
    return rows.withColumn("der", errors.rate())


@query
def der_corpus(spark, sf_dir):
    seg = relations.segments(spark, sf_dir)
    files = seg.select("file_id").distinct().withColumn("dataset", F.col("file_id") % 5)
    return errors.corpus(files, seg, ["dataset"])


@query
def der_mean(spark, sf_dir):
    return der_per_file(spark, sf_dir).agg(F.round(F.avg("der"), 9).alias("mean_der"), F.count(F.lit(1)).alias("files"))


@query
def elementary_intervals(spark, sf_dir):
    return intervals.elementary(relations.segments(spark, sf_dir), ["file_id"])


@query
def active_speakers(spark, sf_dir):
    seg = relations.segments(spark, sf_dir)
    merged = intervals.union(seg, ["file_id", "side", "speaker"])
    return intervals.active(intervals.elementary(merged, ["file_id"]), merged, ["file_id"]).groupBy("file_id", "lo", "hi", "side").agg(F.count(F.lit(1)).alias("speakers"))


@query
def cooccurrence(spark, sf_dir):
    return errors.cooccurrence(relations.segments(spark, sf_dir))


@query
def speaker_mapping(spark, sf_dir):
    return errors.best_overlap(errors.cooccurrence(relations.segments(spark, sf_dir)))


@query
def speaker_pairs(spark, sf_dir):
    """The best mapping itself, with the overlap of each pair."""
    pairs = errors.cooccurrence(relations.segments(spark, sf_dir))
    return errors.mapping(pairs).join(pairs, ["file_id", "ref_speaker", "hyp_speaker"])


@query
def timeline_union(spark, sf_dir):
    return intervals.union(relations.segments(spark, sf_dir), ["file_id"]).select("file_id", "s_ms", "e_ms")


@query
def timeline_coverage(spark, sf_dir):
    seg = relations.segments(spark, sf_dir)
    return intervals.coverage(seg.where("side = 'ref'"), seg.where("side = 'hyp'"), ["file_id"])


@query
def speaker_airtime(spark, sf_dir):
    return intervals.airtime(relations.segments(spark, sf_dir), ["file_id", "speaker"])


@query
def segment_stats(spark, sf_dir):
    return intervals.stats(relations.segments(spark, sf_dir), ["file_id", "side"])


@query
def speakers_first_seen(spark, sf_dir):
    return intervals.first_seen(relations.segments(spark, sf_dir), ["file_id"], "event_id")


@query
def transcript_speakers(spark, sf_dir):
    seg = relations.segments(spark, sf_dir).withColumnRenamed("event_id", "seg_idx")
    return intervals.dominant_speaker(relations.transcript(spark, sf_dir), seg)


# ---- frames to turns


@query
def hysteresis(spark, sf_dir):
    return binarize.hysteresis(relations.frames(spark, sf_dir), ONSET, OFFSET).select("file_id", "speaker", "frame", "on")


@query
def hysteresis_switching(spark, sf_dir):
    """Onset below offset: scores between the two switch the state."""
    return binarize.hysteresis(relations.frames(spark, sf_dir), OFFSET, ONSET).select("file_id", "speaker", "frame", "on")


@query
def frame_runs(spark, sf_dir):
    return binarize.find_runs(binarize.hysteresis(relations.frames(spark, sf_dir), ONSET, OFFSET))


@query
def min_on(spark, sf_dir):
    return binarize.remove_short_on(binarize.hysteresis(relations.frames(spark, sf_dir), ONSET, OFFSET), 3).select("file_id", "speaker", "frame", "on")


@query
def min_off(spark, sf_dir):
    return binarize.fill_short_off(binarize.hysteresis(relations.frames(spark, sf_dir), ONSET, OFFSET), 3).select("file_id", "speaker", "frame", "on")


@query
def pad_regions(spark, sf_dir):
    return binarize.pad(binarize.hysteresis(relations.frames(spark, sf_dir), ONSET, OFFSET), 2, 1).select("file_id", "speaker", "frame", "on")


@query
def binarized(spark, sf_dir):
    return binarize.binarize(relations.frames(spark, sf_dir), BinarizeConfig(ONSET, OFFSET, 3, 3, 1, 1)).select("file_id", "speaker", "frame", "on")


def _turns(spark, sf_dir):
    return turns.from_frames(relations.frames(spark, sf_dir).withColumn("score", F.col("score") * 4))


@query
def segments_from_frames(spark, sf_dir):
    return _turns(spark, sf_dir)


@query
def segment_durations(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("turns"), F.round(F.sum(turns.duration()), 6).alias("speech"))


@query
def merged_segments(spark, sf_dir):
    rows = relations.segments(spark, sf_dir).select("file_id", "speaker", F.col("s_ms").alias("start"), F.col("e_ms").alias("end"))
    return turns.merge(rows, 30_000)


@query
def speaker_labels(spark, sf_dir):
    return intervals.first_seen(relations.segments(spark, sf_dir), ["file_id"], "event_id").select("file_id", "speaker", turns.label(F.col("idx")).alias("label"))


@query
def make_exclusive(spark, sf_dir):
    return frames.make_exclusive(relations.frames(spark, sf_dir), "frame", "speaker")


# ---- annotation formats


def _rttm(spark, sf_dir):
    s, e = (F.col(c) / 1000 for c in ("s_ms", "e_ms"))
    return relations.segments(spark, sf_dir).select("event_id", annotations.rttm_line(F.col("file_id").cast("string"), s, e, F.col("speaker")).alias("value"))


def _ms(c):
    return F.round(F.col(c) * 1000).cast("long")


@query
def rttm_roundtrip(spark, sf_dir):
    return annotations.parse_rttm(_rttm(spark, sf_dir)).select("file_id", "speaker", _ms("start").alias("s_ms"), _ms("end").alias("e_ms"))


@query
def rttm_lines(spark, sf_dir):
    return _rttm(spark, sf_dir)


@query
def rttm_intervals(spark, sf_dir):
    short = _rttm(spark, sf_dir).select(F.substring_index("value", " ", 5).alias("value"))
    return annotations.parse_rttm(short, least=5).groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(_ms("end") - _ms("start")).alias("speech"))


@query
def rttm_durations(spark, sf_dir):
    """Durations as written, by file and speaker."""
    rows = annotations.parse_rttm(_rttm(spark, sf_dir), duration=True)
    return rows.groupBy("file_id", "speaker").agg(F.count(F.lit(1)).alias("lines"), F.sum(_ms("duration")).alias("speech"), F.max(_ms("duration")).alias("longest"))


@query
def rttm_split(spark, sf_dir):
    return annotations.split_by_file(_rttm(spark, sf_dir)).groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.min("event_id").alias("first_line"))


@query
def json_segments(spark, sf_dir):
    seg = relations.segments(spark, sf_dir)
    text = F.to_json(F.struct(F.collect_list(F.struct((F.col("s_ms") / 1000).alias("startTimeSeconds"), (F.col("e_ms") / 1000).alias("endTimeSeconds"), F.col("speaker").alias("speakerId"))).alias("segments")))
    docs = seg.groupBy("file_id").agg(text.alias("_doc")).withColumn("_d", F.from_json("_doc", annotations.JSON_SCHEMA))
    return annotations.json_turns(docs.select("file_id", "_d.segments")).select("file_id", "speaker", _ms("start").alias("s_ms"), _ms("end").alias("e_ms"))


@query
def parallel_array_segments(spark, sf_dir):
    seg = relations.segments(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "s_ms", "e_ms", "speaker"))).alias("x"))
    take = lambda name: F.transform("x", lambda r: r[name])
    rows = seg.select("file_id", take("s_ms").alias("timestamps_start"), take("e_ms").alias("timestamps_end"), take("speaker").alias("speakers"))
    return annotations.array_turns(rows).select("file_id", "speaker", F.col("start").alias("s_ms"), F.col("end").alias("e_ms"))


@query
def textgrid_intervals(spark, sf_dir):
    seg = relations.segments(spark, sf_dir)
    block = F.concat(F.lit("xmin = "), F.col("s_ms"), F.lit("\nxmax = "), F.col("e_ms"), F.lit('\ntext = "'), F.when(F.col("event_id") % 7 == 0, "SIL").otherwise(F.col("speaker")), F.lit('"\n'))
    docs = seg.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(block)), "").alias("content"))
    rows = annotations.textgrid_turns(annotations.textgrid_intervals(docs))
    return rows.select("file_id", "speaker", F.col("start").cast("long").alias("s_ms"), F.col("end").cast("long").alias("e_ms"))


@query
def speech_labels(spark, sf_dir):
    labels = relations.segments(spark, sf_dir).select("file_id", F.when(F.col("event_id") % 3 == 0, "<NOISE>").otherwise(F.col("speaker")).alias("label"))
    return labels.where(annotations.speech()).groupBy("file_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def transcript_rows(spark, sf_dir):
    rows = relations.transcript(spark, sf_dir).select(F.concat_ws("\t", "s_ms", "e_ms", F.concat(F.lit("a\t"), F.col("row_idx"))).alias("value"))
    return annotations.parse_transcript(rows).select(F.col("start").cast("long").alias("s_ms"), F.col("end").cast("long").alias("e_ms"), "text")


# ---- powerset, layout, masks, frames


@query
def powerset_map(spark, sf_dir):
    """Speakers of each class, and the frames that have it."""
    frames_of = relations.logits(spark, sf_dir).groupBy(powerset.argmax_last("logits").alias("class_idx")).agg(F.count(F.lit(1)).alias("frames"))
    return powerset.mapping_table(spark, 3, 2).join(frames_of, "class_idx", "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))


@query
def powerset_decode(spark, sf_dir):
    return powerset.decode(relations.logits(spark, sf_dir), 3, 2).select("vec_id", "class_idx", "speaker_idx", F.col("active").cast("int").alias("active"))


@query
def powerset_encode(spark, sf_dir):
    rows = powerset.decode(relations.logits(spark, sf_dir), 3, 2)
    sets = rows.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("speaker_idx", "active"))), lambda x: x["active"]).alias("mask"))
    return powerset.encode(sets, 3, 2).select("vec_id", "class_idx")


@query
def window_enumeration(spark, sf_dir):
    files = relations.files(spark, sf_dir).select("idx", F.floor("duration").cast("long").alias("n_samples"))
    return layout.windows(files, 10_000, 4_000).select("idx", "chunk_idx", "start_sample", "is_padded")


@query
def chunk_slices(spark, sf_dir):
    rows = layout.windows(relations.table(spark, sf_dir, "embeddings").withColumn("n", F.size("embedding")), 24, 7, "n")
    part = layout.chunk_slice("embedding", F.col("chunk_idx"), 24, 7)
    padded = layout.padded_slice("embedding", F.col("chunk_idx"), 24, 7)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), 6)
    return rows.select("vec_id", "chunk_idx", F.size(part).alias("samples"), F.size(padded).alias("padded"), total(part).alias("sum"))


@query
def start_frames(spark, sf_dir):
    return relations.segmentation(spark, sf_dir).select("chunk_idx").distinct().withColumn("start_frame", layout.start_frame(F.col("chunk_idx"), STEP))


@query
def output_extent(spark, sf_dir):
    chunks = relations.segmentation(spark, sf_dir).groupBy("file_id").agg((F.max("chunk_idx") + 1).alias("chunks"))
    return chunks.withColumn("extent", layout.output_extent(F.col("chunks"), STEP))


@query
def frame_times(spark, sf_dir):
    return relations.frames(spark, sf_dir).select("frame").distinct().withColumn("seconds", layout.frame_time(F.col("frame")))


@query
def clean_masks(spark, sf_dir):
    return masks.clean_masks(relations.segmentation(spark, sf_dir))


@query
def speaker_weights(spark, sf_dir):
    return masks.speaker_weights(relations.segmentation(spark, sf_dir), 16_000, 6_000, 5.0)


@query
def training_set(spark, sf_dir):
    return masks.training_set(relations.segmentation(spark, sf_dir), relations.embeddings(spark, sf_dir), 0.1).select("vec_id", *masks.KEY, "single_activity")


def _labels(spark, sf_dir):
    return relations.embeddings(spark, sf_dir).select(*masks.KEY, (F.col("label") % 3).alias("cluster"))


@query
def mark_inactive(spark, sf_dir):
    quiet = relations.segmentation(spark, sf_dir).withColumn("active", F.when(F.col("speaker_idx") == F.col("chunk_idx") % 3, 0.0).otherwise(F.col("active")))
    return masks.mark_inactive(quiet, _labels(spark, sf_dir))


@query
def speaker_count(spark, sf_dir):
    return frames.speaker_count(relations.segmentation(spark, sf_dir), STEP)


@query
def silent_files(spark, sf_dir):
    return frames.all_zero(frames.speaker_count(relations.segmentation(spark, sf_dir), STEP))


@query
def cluster_activations(spark, sf_dir):
    return frames.cluster_activations(relations.segmentation(spark, sf_dir), _labels(spark, sf_dir), STEP)


@query
def frame_topk(spark, sf_dir):
    seg = relations.segmentation(spark, sf_dir)
    return frames.top_k(frames.cluster_activations(seg, _labels(spark, sf_dir), STEP), frames.speaker_count(seg, STEP))


@query
def smoothed_topk(spark, sf_dir):
    seg = relations.segmentation(spark, sf_dir)
    counts = frames.speaker_count(seg, STEP)
    return smoothing.smoothed_top_k(frames.cluster_activations(seg, _labels(spark, sf_dir), STEP, counts), counts)


# ---- vectors and kernels


@query
def l2_normalize(spark, sf_dir):
    unit = relations.embeddings(spark, sf_dir).withColumn("n", vectors.norm("embedding")).select("vec_id", F.posexplode(vectors.l2_normalize("embedding", F.col("n"))).alias("dim", "x"))
    return unit.select("vec_id", "dim", F.round("x", 6).alias("x"))


@query
def cosine_matrix(spark, sf_dir):
    return _pairs(spark, sf_dir, vectors.cosine, "similarity")


@query
def pairwise_distance(spark, sf_dir):
    return _pairs(spark, sf_dir, vectors.euclidean, "distance")


def _pairs(spark, sf_dir, function, name):
    rows = relations.embeddings(spark, sf_dir)
    a, b = (rows.select("file_id", F.col("vec_id").alias(i), F.col("embedding").alias(v)) for i, v in (("i", "a"), ("j", "b")))
    return a.join(b, "file_id").where("i < j").select("i", "j", F.round(function("a", "b"), 6).alias(name))


@query
def finite_filter(spark, sf_dir):
    spoilt = relations.embeddings(spark, sf_dir).withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")))
    return spoilt.where(vectors.all_finite("embedding")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query
def logsumexp(spark, sf_dir):
    wide = F.transform("logits", lambda x: x.cast("double") * 5)
    return relations.logits(spark, sf_dir).select("vec_id", F.round(vectors.logsumexp(wide), 6).alias("value"))


@query
def rounded_ties(spark, sf_dir):
    return relations.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 2).alias("half")).distinct().withColumn("rounded", vectors.round_ties_even(F.col("half")))


@query
def weighted_centroids(spark, sf_dir):
    """Centroids of a recording's labels, rows weighted by their number."""

    def solve(group, x):
        labels, at = np.unique(group["label"].to_numpy(), return_inverse=True)
        gamma = np.zeros((len(x), len(labels)))
        gamma[np.arange(len(x)), at] = (group["vec_id"].to_numpy() % 7) / 7.0
        found = kernels.weighted_centroids(x, gamma, np.arange(len(labels)))
        return pd.DataFrame({"file_id": group["file_id"].iloc[0], "label": labels, "x": list(found)})

    rows = _per_file(relations.embeddings(spark, sf_dir), solve, "file_id long, label int, x array<float>")
    return rows.select("file_id", "label", F.posexplode("x").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))


@query
def chunk_assignment(spark, sf_dir):
    """Each chunk's local speakers to the centroids of three labels of its recording."""
    rows = relations.embeddings(spark, sf_dir)
    dims = rows.select("file_id", (F.col("label") % 3).alias("c"), F.posexplode("embedding").alias("dim", "x")).groupBy("file_id", "c", "dim").agg(F.avg("x").alias("x"))
    centre = dims.groupBy("file_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("centroid"))
    scored = rows.join(centre, "file_id").select("file_id", "chunk_idx", "speaker_idx", "c", (1 + vectors.cosine("embedding", "centroid")).alias("score"))
    lists = scored.groupBy("file_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("speaker_idx", "c", "score"))).alias("s"))

    @F.pandas_udf("array<struct<speaker_idx:int,cluster:int>>")
    def assign(cells: pd.Series) -> pd.Series:
        out = []
        for chunk in cells:
            local = sorted({int(x["speaker_idx"]) for x in chunk})
            m = np.full((max(local) + 1, 3), -np.inf)
            for x in chunk:
                m[x["speaker_idx"], x["c"]] = x["score"]
            found = kernels.assign_chunk(m, local)
            out.append([{"speaker_idx": s, "cluster": found.get(s, INACTIVE)} for s in local])
        return pd.Series(out)

    return lists.select("file_id", "chunk_idx", F.explode(assign("s")).alias("a")).select("file_id", "chunk_idx", "a.*")


def _per_file(rows: DataFrame, function, schema: str) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id").reset_index(drop=True)
        return function(group, np.stack(group["embedding"].to_list()).astype("float32"))

    return rows.groupBy("file_id").applyInPandas(run, schema)


def _ahc(group, x):
    return group[["file_id", "vec_id"]].assign(cluster=kernels.cluster_rows(x, 1.0))


@query
def ahc_labels(spark, sf_dir):
    return _per_file(relations.embeddings(spark, sf_dir), _ahc, "file_id long, vec_id long, cluster int")


@query
def plda_features(spark, sf_dir):
    """Features by parameters learnt from all labelled embeddings, without the sign, which an eigenvector doesn't fix."""
    rows = relations.embeddings(spark, sf_dir)
    features = mixture.plda_features(mixture.estimate_plda(rows))
    rows = rows.select("file_id", "vec_id", F.posexplode(features("embedding")).alias("dim", "x"))
    return rows.select("file_id", "vec_id", "dim", F.round(F.abs(F.col("x").cast("double")), 5).alias("feature"))


@query
def plda_eigenvalues(spark, sf_dir):
    """Variance between labels against that within, by feature."""
    phi = mixture.estimate_plda(relations.embeddings(spark, sf_dir)).phi
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(phi)], "dim int, value double")


@query
def vbx_posteriors(spark, sf_dir):
    """Likeliest speaker of each embedding, from the clusters of linkage on, a kernel a recording."""
    rows = relations.embeddings(spark, sf_dir)
    plda = mixture.estimate_plda(rows)

    def solve(group, x):
        gamma, _ = kernels.vbx(plda.features(x), plda.phi, kernels.initial_responsibilities(kernels.cluster_rows(x, 1.0)))
        return group[["file_id", "vec_id"]].assign(speaker=gamma.argmax(axis=1), responsibility=gamma.max(axis=1).astype("float64"))

    return _per_file(rows, solve, "file_id long, vec_id long, speaker int, responsibility double").withColumn("responsibility", F.round("responsibility", 4))


def _mixture(spark, sf_dir, config=None):
    """From the table's labels on, recordings cut into slices of some 64 rows."""
    rows = relations.embeddings(spark, sf_dir)
    plda = mixture.estimate_plda(rows)
    rows = rows.select("file_id", "vec_id", "label", mixture.plda_features(plda)("embedding").alias("features"))
    return mixture.posteriors(rows, plda.phi, config, slice_rows=64)


@query
def mixture_posteriors(spark, sf_dir):
    """The same over slices of recordings, six turns with acoustics at full weight."""
    rows, top = _mixture(spark, sf_dir, VbxConfig(fa=1.0, max_iters=6)).rows, F.array_max("gamma")
    return rows.select("file_id", "vec_id", (F.array_position("gamma", top) - 1).cast("int").alias("speaker"), F.round(top.cast("double"), 4).alias("responsibility"))


@query
def mixture_speakers(spark, sf_dir):
    """Priors of speakers and the turns until the bound settled."""
    return _mixture(spark, sf_dir).speakers.withColumn("prior", F.round(F.col("prior").cast("double"), 5))


def _artifacts(spark, sf_dir):
    return pipeline.Artifacts(relations.segmentation(spark, sf_dir), relations.embeddings(spark, sf_dir).select(*masks.KEY, "embedding"))


@query
def cluster_file(spark, sf_dir):
    return pipeline.cluster_recordings(_artifacts(spark, sf_dir), kernels.Plda.synthetic(64, 16), PipelineConfig(ahc_threshold=1.0))


@query
def post_inference(spark, sf_dir):
    return pipeline.post_inference(_artifacts(spark, sf_dir).stored(), kernels.Plda.synthetic(64, 16), PipelineConfig(ahc_threshold=1.0, binarize=BinarizeConfig(min_on=3, min_off=3))).segments


# ---- selection, audio, models, reports, stream


@query
def budgeted_selection(spark, sf_dir):
    return selection.budgeted(relations.files(spark, sf_dir), 500, 1_000_000.0)


def _paths(spark, sf_dir):
    audio_files = relations.table(spark, sf_dir, "customer").select(F.format_string("/data/wav/rec%d.wav", F.col("c_custkey")).alias("path"))
    return audio_files, relations.table(spark, sf_dir, "orders").select(F.format_string("/data/rttm/rec%d.rttm", F.col("o_orderkey")).alias("path"))


@query
def paired_files(spark, sf_dir):
    return selection.paired(*_paths(spark, sf_dir))


@query
def missing_files(spark, sf_dir):
    return selection.missing(*_paths(spark, sf_dir))


def _wavs(spark, sf_dir):
    """Embeddings as sixteen-fold repeated PCM files."""

    @F.pandas_udf("binary")
    def write(rows: pd.Series) -> pd.Series:
        return pd.Series([audio.encode_wav(np.tile(np.asarray(x), 16)) for x in rows])

    return relations.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), write("embedding").alias("content"))


def _wav_folder(spark, sf_dir):
    """The same as files in the shared folder."""
    path = shared_folder(spark, "recordings")
    file_sink.write_files(_wavs(spark, sf_dir), path, F.concat(F.col("file_id").cast("string"), F.lit(".wav")), F.col("content"))
    return path


#: Ranges of odd size, so that recordings are cut anywhere.
RANGE_BYTES = 65_537


def _whole(samples="samples"):
    return F.transform(samples, lambda x: F.round(x * 32768).cast("long"))


def _total(whole):
    return F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x)


@query
def wav_scan(spark, sf_dir):
    """Recordings read in pieces by byte ranges."""
    rows = wav_ranges.read_runs(spark, _wav_folder(spark, sf_dir), 100, run=1, pieces=True, rangeBytes=RANGE_BYTES)
    peak = F.array_max(F.transform(_whole(), lambda x: F.abs(x)))
    sums = rows.groupBy("file_id").agg(F.sum(F.size("samples")).cast("int").alias("samples"), F.first("sample_rate").alias("sample_rate"), F.sum(_total(_whole())).alias("total"), F.max(peak).alias("peak"))
    return sums.select(F.col("file_id").cast("long").alias("file_id"), "samples", "sample_rate", F.try_divide("samples", "sample_rate").alias("duration"), "total", "peak")


@query
def wav_windows(spark, sf_dir):
    """Windows of recordings by byte ranges, five to a row, the tail padded."""
    rows = wav_ranges.read_runs(spark, _wav_folder(spark, sf_dir), 300, 70, run=5, rangeBytes=RANGE_BYTES).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.slice("samples", F.col("_k") * 70 + 1, F.lit(300))
    rows = rows.select(F.col("file_id").cast("long").alias("file_id"), (F.col("chunk_idx") + F.col("_k")).alias("chunk_idx"), (F.col("start_sample") + F.col("_k") * 70).alias("start_sample"), _whole(part).alias("_w"))
    return rows.select("file_id", "chunk_idx", "start_sample", F.size("_w").alias("samples"), (F.size("_w") < 300).alias("is_padded"), _total("_w").alias("total"))


@query
def filter_banks(spark, sf_dir):
    """Frames, bins and the sum of the log energies of recordings."""
    return audio.energies(_wavs(spark, sf_dir)).select("file_id", "frames", "bins", F.round("energy", 3).alias("energy"))


@query
def annotation_files(spark, sf_dir):
    """A file of turns per recording, written with one commit and read back line by line."""
    path = shared_folder(spark, "annotations")
    turns_ = relations.segments(spark, sf_dir).select(F.format_string("rec%d", F.col("file_id")).alias("file_id"), (F.col("s_ms") / 1000).alias("start"), (F.col("e_ms") / 1000).alias("end"), "speaker")
    file_sink.write_annotations(turns_, path)
    files = spark.read.format("text").option("wholetext", "true").load(path).select(F.regexp_extract(F.input_file_name(), r"rec(\d+)\.rttm$", 1).cast("long").alias("file_id"), "value")
    lines = files.select("file_id", F.posexplode(F.filter(F.split("value", "\n"), lambda x: x != "")).alias("line_idx", "value"))
    fields = F.split("value", " ")
    return lines.select("file_id", "line_idx", _ms_of(fields[3]).alias("s_ms"), _ms_of(fields[4]).alias("length_ms"), fields[7].alias("speaker"))


def _ms_of(c):
    return F.round(c.cast("double") * 1000).cast("long")


@query
def statistics_pooling(spark, sf_dir):
    """Mean and deviation of a recording's embeddings over time, every third row masked."""

    def solve(group, x):
        mean, std = np.split(audio.pool_statistics(x.T.astype("float64"), (group["vec_id"].to_numpy() % 3 > 0).astype("float64")), 2)
        return pd.DataFrame({"file_id": group["file_id"].iloc[0], "dim": np.arange(len(mean)), "mean": mean, "std": std})

    rows = _per_file(relations.embeddings(spark, sf_dir), solve, "file_id long, dim int, mean double, std double")
    return rows.select("file_id", "dim", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query
def model_pipeline(spark, sf_dir):
    """Windows, stub models, clustering and turns of short recordings, end to end."""
    config = PipelineConfig(step=256 / 16_000, ahc_threshold=1.0)
    model = pipeline.Pipeline(backend.StubBackend, kernels.Plda.synthetic(16, 8), config, window=512, frames_per_window=20)
    return model.run_files(spark, _wav_folder(spark, sf_dir), rangeBytes=RANGE_BYTES).segments


@query
def bench_summary(spark, sf_dir):
    """Mean and least time and real-time factor by kind of event."""
    e = relations.table(spark, sf_dir, "events")
    sums = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_s"), F.min("value").alias("min_s"), F.count(F.lit(1)).alias("runs"), F.sum("value").alias("_t"))
    return sums.select("event_type", "mean_s", "min_s", "runs", F.round(F.try_divide(F.col("runs") * 600.0, F.col("_t")), 6).alias("rtfx"))


@query
def queue_microbatch(spark, sf_dir):
    schema = relations.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return queue.drain(spark, stream, lambda df: relations.segments_of(df)).groupBy("file_id", "speaker").agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.col("e_ms") - F.col("s_ms")).alias("speech"))


@query
def queue_jobs(spark, sf_dir):
    """Windows of recordings in three runs of a stream: a recording is a job in the run that brings its last window."""
    events = relations.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % relations.FILES).alias("file_id"))
    by = W.partitionBy("file_id")
    parts = events.select("file_id", (F.row_number().over(by.orderBy("event_id")) - 1).alias("part"), F.count(F.lit(1)).over(by).alias("total"), F.least(F.col("file_id") % 3, F.col("event_id") % 3).alias("run"))
    path, out, checkpoint = (shared_folder(spark, name) for name in ("parts", "jobs", "stream"))
    parts = materialized(parts, "all-parts")
    for nth in range(3):
        parts.where(F.col("run") == nth).drop("run").write.mode("append").parquet(path)
        stream = spark.readStream.schema("file_id long, part int, total long").parquet(path)
        jobs.wait(jobs.run(stream, lambda done: done, out, checkpoint))
    done = spark.read.parquet(out).drop("_of")
    # a row a recording
    return done.select("file_id", "parts", "state", F.col("batch").cast("int").alias("batch"), F.row_number().over(W.orderBy("job_id")).alias("nth"))


@query
def queue_fallback(spark, sf_dir):
    """Jobs run one by one; those that fail keep their error."""
    rows = relations.segments(spark, sf_dir)

    def work(group: pd.DataFrame) -> pd.DataFrame:
        if group["file_id"].iloc[0] % 7 == 3:
            raise ValueError("bad recording")
        return pd.DataFrame({"speech": [int((group["e_ms"] - group["s_ms"]).sum())]})

    return queue.isolated(rows, "file_id", work, "speech long")


@query
def window_steps(spark, sf_dir):
    """Step of each mode, and the windows of ten seconds that it gives for all recordings."""
    length = F.floor(F.col("duration") * SAMPLE_RATE).cast("long")
    count = lambda step: layout.window_count(length, int(WINDOW_SECONDS * SAMPLE_RATE), int(step * SAMPLE_RATE)).cast("long")
    by_mode = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(window_step(m)).alias("step"), count(window_step(m)).alias("n")) for m in STEPS])
    rows = relations.files(spark, sf_dir).select(F.explode(by_mode).alias("m"))
    return rows.groupBy("m.mode", "m.step").agg(F.sum("m.n").alias("windows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
