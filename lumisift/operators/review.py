"""The review loop: mode overrides, newest results, and moving disqualified photos aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.functions.paths import ASIDE, file_name
from lumisift.functions.scoring import normalize_sharpness, sharpness_score, subject_score


def below(score: Column, threshold: float) -> Column:
    return score <= threshold


def disqualified(df: DataFrame, threshold: float = 32.0) -> DataFrame:
    """Photos whose raw score is at most the threshold; NaN and null scores are not."""
    return df.filter(below(F.col("score"), threshold))


def flagged_count(df: DataFrame, threshold: float = 32.0) -> DataFrame:
    return df.agg(F.count_if(below(F.col("score"), threshold)).alias("flagged"))


def apply_overrides(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """results with the modes of overrides (path, mode) and the scores that follow from them.

    Region variances and faces are kept with the results, so no pixels are read: score and sharpness change,
    hash and other factors stay. A portrait with a face gets its crop's score and its subject, others have no
    subject; results without the columns var_face and face have no faces. Overrides of unknown paths and
    those that change nothing do nothing; a path's last one in alphabetical order wins if it has several.
    """
    wanted = overrides.filter("mode IS NOT NULL").groupBy("path").agg(F.max("mode").alias("new_mode"))
    rows = results.join(wanted, "path", "left").withColumn("new_mode", F.when(F.col("new_mode") != F.col("mode"), F.col("new_mode")))
    changed = F.col("new_mode").isNotNull()
    portrait = F.col("new_mode") == "portrait"
    known = {"face", "var_face"} <= set(results.columns)
    face_variance = F.when(F.col("face").isNotNull(), F.col("var_face")) if known else F.lit(None).cast("double")
    subject = F.when(portrait, subject_score(F.col("face"), F.col("width"), F.col("height"))) if known else F.lit(None).cast("double")
    score = F.when(changed, sharpness_score(F.col("new_mode"), face_variance)).otherwise(F.col("score"))
    subject = F.when(changed, subject).otherwise(F.col("metrics.subject"))
    rows = rows.withColumn("subject__", subject)
    rows = rows.withColumn("score", score).withColumn("mode", F.coalesce("new_mode", "mode"))
    new = F.col("metrics").withField("sharpness", F.when(changed, normalize_sharpness(F.col("score"))).otherwise(F.col("metrics.sharpness"))).withField("subject", F.col("subject__"))
    return rows.withColumn("metrics", new).select(*results.columns)


def upsert_results(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """The row of each path with the highest version (null least) over both tables; a new row wins a tie, of several that with the highest hash."""
    both = old.withColumn("new__", F.lit(0)).unionByName(new.withColumn("new__", F.lit(1)))
    row = F.struct(*old.columns)
    return both.groupBy("path").agg(F.max_by(row, F.struct(version, "new__", F.xxhash64(*old.columns))).alias("r")).select("r.*")


def known_updates(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Updates of paths that are still there."""
    return updates.join(current.select("path"), "path", "left_semi")


def plan_disqualify(results: DataFrame, threshold: float, root: str, existing: DataFrame | None = None) -> DataFrame:
    """(path, target, status, error) for each photo at or below the threshold.

    A target name is taken by the first photo in input order, unless it is in existing (file_name)
    already; the others fail. Names are claimed by a partially aggregated minimum, so a name that very
    many photos share is not gathered in one task.
    """
    rows = disqualified(results, threshold).select("path", "seq").withColumn("file_name", file_name(F.col("path")))
    claims = rows.groupBy("file_name").agg(F.min(F.struct("seq", "path")).alias("claim"))
    if existing is not None:
        taken = existing.select("file_name").distinct().withColumn("there", F.lit(True))
        claims = claims.join(taken, "file_name", "left")
    else:
        claims = claims.withColumn("there", F.lit(None).cast("boolean"))
    joined = rows.join(claims, "file_name")
    moved = F.col("there").isNull() & F.struct("seq", "path").eqNullSafe(F.col("claim"))
    target = F.concat(F.lit(root.rstrip("/") + f"/{ASIDE}/"), F.col("file_name"))
    return joined.select("path", target.alias("target"), F.when(moved, "moved").otherwise("failed").alias("status"), F.when(~moved, "target exists").alias("error"))


def disqualify_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("status").agg(F.count("*").alias("photos"))


def remaining_photos(results: DataFrame, plan: DataFrame) -> DataFrame:
    """results without the photos the plan moves."""
    return results.join(plan.filter("status = 'moved'").select("path"), "path", "left_anti")


def with_latest(results: DataFrame) -> DataFrame:
    """The last row of each path in input order, of several that with the highest hash."""
    last = F.max_by(F.struct(*results.columns), F.struct("seq", F.xxhash64(*results.columns)))
    return results.groupBy("path").agg(last.alias("r")).select("r.*")
