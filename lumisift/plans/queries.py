"""Registered queries over the synthetic photo set, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import paths, scoring
from lumisift.operators import faces, features, grouping, review, similarity
from lumisift.plans import cull, fixtures
from lumisift.plans.oracle import ORACLE_SQL  # noqa: F401
from lumisift.sources import scan
from lumisift.sources.tables import scratch_dir, table, written
from lumisift.streaming import streams

THRESHOLD, DISTANCE, SHORTLIST = 32.0, 6, 150
THUMB = 5  # below the edges of the synthetic photos, so that they shrink
OTHER_WEIGHTS = scoring.Weights(sharpness=0.5, exposure=0.05, contrast=0.3, color=0.0, composition=0.1, subject=0.05)
FACTORS = ("sharpness", "exposure", "contrast", "color", "composition", "subject")


def _rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.filter_photo_paths(fixtures.photos(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored photos, scored once for a query."""
    return written(features.score_photos(_scanned(spark, sf_dir)).drop("error", "photo_id"))


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _scanned(spark, sf_dir).select("photo_id", "path", "width", "height")
    return faces.detect_main_faces(fixtures.raw_detections(spark, sf_dir), photos).join(photos.select("photo_id", "path"), "photo_id")


def format_class(spark, sf_dir):
    rows = fixtures.photos(spark, sf_dir)
    return rows.select("photo_id", paths.format_class(F.col("path")).alias("format_class"), paths.file_name(F.col("path")).alias("file_name"))


def supported_photos(spark, sf_dir):
    return _scanned(spark, sf_dir).select("photo_id", "path")


def fit_dimensions(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 37 % 6000 + 1).cast("int").alias("w"), (F.col("vec_id") * 53 % 4000 + 1).cast("int").alias("h"))
    fit = lambda most: scoring.fit_dimensions(F.col("w"), F.col("h"), most)
    return rows.select("vec_id", *(fit(m)[side].alias(f"{side}_{m}") for m in (1600, 220) for side in ("width", "height")))


def photo_moments(spark, sf_dir):
    found = features.photo_moments(_scanned(spark, sf_dir).drop("path", "seq"))
    return found.select("photo_id", "n_px", "sum_l", "sum_l2", "n_clipped", "sum_rg", "sum_rg2", "sum_yb2x", "sum_yb2x2", "energy", "energy_thirds")


def center_crop_sharpness(spark, sf_dir):
    found = features.photo_moments(_scanned(spark, sf_dir).drop("path", "seq"))
    return found.select("photo_id", *_rounded("var_full", "var_object", "var_half", "var_portrait"))


def guess_mode(spark, sf_dir):
    found = features.photo_moments(_scanned(spark, sf_dir).drop("path", "seq"))
    return found.select("photo_id", scoring.guess_mode(F.col("var_full"), F.col("var_half")).alias("mode"))


def resolve_mode(spark, sf_dir):
    wanted = F.element_at(F.array(*map(F.lit, ("auto", "landscape", "object", "portrait"))), (F.col("photo_id") % 4 + 1).cast("int"))
    rows = _scanned(spark, sf_dir).withColumn("wanted_mode", wanted)
    return features.score_photos(rows, None, _faces(spark, sf_dir)).select("photo_id", "mode")


def photo_metrics(spark, sf_dir):
    rows = _results(spark, sf_dir).select("path", "seq", "mode", "score", "metrics.*")
    return rows.select("path", "seq", "mode", *_rounded("score", *FACTORS[:5]))


def subject_scores(spark, sf_dir):
    rows = _faces(spark, sf_dir).join(_scanned(spark, sf_dir).select("photo_id", "width", "height"), "photo_id")
    return rows.select("photo_id", F.round(scoring.subject_score(F.col("face"), F.col("width"), F.col("height")), 3).alias("subject"))


def face_crop_sharpness(spark, sf_dir):
    scored = features.score_photos(_scanned(spark, sf_dir), "auto", _faces(spark, sf_dir))
    return scored.filter("face IS NOT NULL").select("photo_id", "mode", *_rounded("var_face", "score"))


def dhash(spark, sf_dir):
    return features.photo_moments(_scanned(spark, sf_dir).drop("path", "seq")).select("photo_id", "phash")


def thumbs(spark, sf_dir):
    found = features.photo_moments(_scanned(spark, sf_dir).drop("path", "seq"), thumbs=True, thumb_edge=THUMB)
    return found.select("photo_id", "thumb.width", "thumb.height", F.sha2("thumb.rgb", 256).alias("rgb_sha256"))


def overall_scores(spark, sf_dir):
    return scoring.reweight(_results(spark, sf_dir), scoring.Weights()).select("path", "seq", *_rounded("overall"))


def reweighted(spark, sf_dir):
    return scoring.reweight(_results(spark, sf_dir), OTHER_WEIGHTS).select("path", "seq", *_rounded("overall"))


def sharpness_bands(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return rows.groupBy(scoring.sharpness_band(F.col("score")).alias("band")).agg(F.count("*").alias("photos"))


def labels(spark, sf_dir):
    rows = scoring.with_labels(scoring.reweight(_results(spark, sf_dir), scoring.Weights()))
    return rows.select("path", "seq", "file_name", scoring.sharpness_band(F.col("score")).alias("band"), "score_text")


def decoded_faces(spark, sf_dir):
    found = faces.decode_boxes(fixtures.raw_detections(spark, sf_dir))
    return found.select("photo_id", "prior_idx", *((F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in ("face_score", "x1", "y1", "x2", "y2")))


def nms_faces(spark, sf_dir):
    return faces.nms(faces.decode_boxes(fixtures.raw_detections(spark, sf_dir))).select("photo_id", "prior_idx")


def main_faces(spark, sf_dir):
    face = F.col("face")
    return _faces(spark, sf_dir).select("photo_id", "path", *(F.round(face[c].cast("double"), 3).alias(c) for c in ("x1", "y1", "x2", "y2", "score")))


def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(features.photo_moments(_scanned(spark, sf_dir)), "phash", DISTANCE)


def duplicate_groups(spark, sf_dir):
    return grouping.group_duplicates(_results(spark, sf_dir), DISTANCE)


def duplicate_groups_survivors(spark, sf_dir):
    return grouping.group_duplicates(cull.passes_technical(_results(spark, sf_dir), THRESHOLD), DISTANCE)


def group_sections(spark, sf_dir):
    results = _results(spark, sf_dir)
    return grouping.group_sections(grouping.group_duplicates(results, DISTANCE), results).select("group_rank", "member_rank", "title", "path")


def group_sizes(spark, sf_dir):
    return grouping.group_sizes(grouping.group_duplicates(_results(spark, sf_dir), DISTANCE)).groupBy("group_size").agg(F.count("*").alias("groups"))


def best_of_group(spark, sf_dir):
    passed = cull.passes_technical(_results(spark, sf_dir), THRESHOLD)
    return grouping.best_of_group(grouping.group_duplicates(passed, DISTANCE), passed).select("group_rank", "path", *_rounded("overall"))


def ungrouped(spark, sf_dir):
    return cull.candidates(_results(spark, sf_dir), THRESHOLD, DISTANCE).filter("group_rank IS NULL").select("path", *_rounded("overall"))


def cull_shortlist(spark, sf_dir):
    return cull.cull(_results(spark, sf_dir), THRESHOLD, DISTANCE, n=SHORTLIST)[0].select("path", "seq", F.coalesce("group_rank", F.lit(0)).alias("group_rank"), *_rounded("overall"))


def cull_funnel(spark, sf_dir):
    return cull.cull(_results(spark, sf_dir), THRESHOLD, DISTANCE, n=SHORTLIST)[1]


def _as_scanned(spark, sf_dir):
    """Results as scan() gives them: without an input order."""
    return _results(spark, sf_dir).withColumn("seq", F.lit(None).cast("long"))


def cull_scanned_shortlist(spark, sf_dir):
    return cull.cull(_as_scanned(spark, sf_dir), THRESHOLD, DISTANCE, n=SHORTLIST)[0].select("path", F.coalesce("group_rank", F.lit(0)).alias("group_rank"), *_rounded("overall"))


def cull_scanned_funnel(spark, sf_dir):
    return cull.cull(_as_scanned(spark, sf_dir), THRESHOLD, DISTANCE, n=SHORTLIST)[1]


def scan_counts(spark, sf_dir):
    """A scan three quarters of the way."""
    events = fixtures.scan_events(table(spark, sf_dir, "events"))
    done = events.filter("seq % 4 < 3")
    return cull.scan_counts(events, done.filter("status = 'scored'"), done.filter("status = 'failed'"))


def flat_by_sharpness(spark, sf_dir):
    return cull.flat_view(_results(spark, sf_dir), "score").select("place", "path", *_rounded("score"))


def flat_by_overall(spark, sf_dir):
    return cull.flat_view(scoring.reweight(_results(spark, sf_dir), scoring.Weights()), "overall").select("place", "path", *_rounded("overall"))


def apply_overrides(spark, sf_dir):
    found = review.apply_overrides(_results(spark, sf_dir), fixtures.overrides(spark, sf_dir))
    return found.select("path", "mode", F.round("score", 6).alias("score"), F.round("metrics.sharpness", 6).alias("sharpness"))


def apply_overrides_faces(spark, sf_dir):
    scored = written(features.score_photos(_scanned(spark, sf_dir), "auto", _faces(spark, sf_dir)))
    found = review.apply_overrides(scored, fixtures.overrides(spark, sf_dir))
    return found.select("path", "mode", F.round("score", 6).alias("score"), F.round("metrics.sharpness", 6).alias("sharpness"), F.round("metrics.subject", 3).alias("subject"))


def detector_input(spark, sf_dir):
    """Sums of each channel of a small model's input."""
    found = features.detector_input(_scanned(spark, sf_dir).select("photo_id", "width", "height", "rgb"), 20, 15)
    part = lambda c: F.aggregate(F.slice("tensor", c * 300 + 1, 300), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("photo_id", F.size("tensor").alias("n"), *(F.round(part(c), 3).alias(f"sum_{c}") for c in range(3)))


def latest_results(spark, sf_dir):
    events = fixtures.scan_events(table(spark, sf_dir, "events"))
    old, new = review.with_latest(events.filter("seq % 3 > 0")), events.filter("seq % 3 = 0")
    return review.upsert_results(old, new, "seq").select("path", "seq", "status", "score")


def known_updates(spark, sf_dir):
    events = fixtures.scan_events(table(spark, sf_dir, "events"))
    return review.known_updates(events.filter("seq % 3 = 0"), events.filter("seq % 3 > 0 AND status = 'failed'").select("path").distinct()).select("path", "seq", "status")


def _plan(spark, sf_dir, results):
    return review.plan_disqualify(results, THRESHOLD, "/photos", fixtures.existing_targets(spark, sf_dir))


def disqualify_plan(spark, sf_dir):
    return _plan(spark, sf_dir, _results(spark, sf_dir))


def disqualify_summary(spark, sf_dir):
    return review.disqualify_summary(_plan(spark, sf_dir, _results(spark, sf_dir)))


def remaining_photos(spark, sf_dir):
    results = _results(spark, sf_dir)
    return review.remaining_photos(results, _plan(spark, sf_dir, results)).select("path")


def flagged(spark, sf_dir):
    return review.flagged_count(_results(spark, sf_dir), THRESHOLD)


def scan_status(spark, sf_dir):
    events = fixtures.scan_events(table(spark, sf_dir, "events"))
    return cull.scan_status(events.filter("status = 'scored'"), events.filter("status = 'failed'"))


def _event_stream(spark, sf_dir):
    """The events of a scan as a stream of several batches: they lie in four files, taken one at a time."""
    events = fixtures.scan_events(table(spark, sf_dir, "events"))
    folder = f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    events.withColumn("file", F.col("seq") % 4).repartition("file").write.partitionBy("file").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def scan_progress(spark, sf_dir):
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = streams.run_available(streams.progress_stream(_event_stream(spark, sf_dir)), streams.table_sink(out), f"{out}-checkpoint", "complete")
    return spark.read.schema("status string, photos long").parquet(f"{out}/version={last}")


def stream_latest(spark, sf_dir):
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = _event_stream(spark, sf_dir)
    streams.run_available(stream, streams.upsert_sink(out, buckets=8), f"{out}-checkpoint")
    return streams.read_upserted(spark, out, stream.schema).select("path", "seq", "status", "score")


def written_results(spark, sf_dir):
    out = f"{scratch_dir(spark)}/results-{uuid.uuid4().hex}"
    scan.write_results(_results(spark, sf_dir).drop("face"), out)
    return spark.read.parquet(out).select("path", "seq", "mode", *_rounded("score"))


def grouped_paths(spark, sf_dir):
    return grouping.grouped_paths(grouping.group_duplicates(_results(spark, sf_dir), DISTANCE))


QUERIES = {
    f.__name__: f
    for f in (
        cull_shortlist, cull_funnel, format_class, supported_photos, fit_dimensions, photo_moments, center_crop_sharpness, guess_mode, resolve_mode, photo_metrics, subject_scores,
        face_crop_sharpness, dhash, thumbs, overall_scores, reweighted, sharpness_bands, labels, decoded_faces, nms_faces, main_faces, similar_pairs, duplicate_groups, duplicate_groups_survivors,
        group_sections, group_sizes, best_of_group, ungrouped, flat_by_sharpness, flat_by_overall, apply_overrides, apply_overrides_faces, detector_input, latest_results, disqualify_plan, disqualify_summary, remaining_photos, flagged,
        scan_status, scan_counts, cull_scanned_shortlist, cull_scanned_funnel, scan_progress, stream_latest, known_updates, written_results, grouped_paths,
    )
}
