"""A synthetic photo set, detector rows, overrides and scan events, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.sources.tables import table


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, seq, path, width, height, rgb): one to three 8 x 8 frames for each embedding."""
    e = table(spark, sf_dir, "embeddings").withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 3).cast("int"))))
    base = F.expr("""transform(sequence(0, 63), p -> greatest(0, least(255,
        floor(cast(element_at(embedding, p + 1) as double) * pow(2, 2 + vec_id % 7) + 128) + 6 * k
        + if(k > 0 and p = (vec_id * 7 + k * 13) % 64, 40, 0))))""")
    # bound to a lambda variable, the base values are made once for each photo, not once for each byte
    hexed = F.expr("element_at(transform(array(base), b -> array_join(transform(sequence(0, 191), i -> lpad(hex(element_at(b, cast((i div 3 + 21 * (i % 3)) % 64 as int) + 1)), 2, '0')), '')), 1)")
    extension = F.element_at(F.array(*map(F.lit, ("jpg", "JPG", "png", "tiff", "nef", "webp", "txt", "jpeg"))), (F.col("vec_id") % 8 + 1).cast("int"))
    photo_id = F.col("vec_id") * 4 + F.col("k")
    path = F.concat(
        F.lit("/roll"), F.floor(F.col("vec_id") / 10).cast("string"), F.when(F.col("vec_id") % 29 == 0, "/disqualified").otherwise(""),
        F.lit("/"), F.when(F.col("vec_id") % 5 == 0, "_").otherwise(""), F.lit("IMG"), (F.col("photo_id") % 400).cast("string"), F.lit("."), extension,
    )
    rows = e.withColumn("photo_id", photo_id).withColumn("base", base).withColumn("rgb", F.unhex(hexed))
    return rows.select("photo_id", F.col("photo_id").alias("seq"), path.alias("path"), F.lit(8).alias("width"), F.lit(8).alias("height"), "rgb")


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty-two detector rows for each embedding, as photo_id = vec_id * 4: each of sixteen has a weaker neighbour,
    mostly of the next larger box in the same cell, whose prior is past the last one now and then."""
    e = table(spark, sf_dir, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31))))
    i, weaker = F.col("i") % 16, F.col("i") >= 16
    at = lambda c: F.element_at("embedding", (c + 1).cast("int")).cast("float")
    share = F.when(weaker, 0.96875).otherwise(1.0).cast("float")
    prior = F.when(weaker, (F.col("vec_id") * 37 + i * 61 + 1) % 4421).otherwise((F.col("vec_id") * 37 + i * 61) % 4420)
    return e.select(
        (F.col("vec_id") * 4).alias("photo_id"), prior.cast("int").alias("prior_idx"),
        (F.lit(0.5).cast("float") + at(i) * share).cast("float").alias("face_score"), at(i + 16).alias("lx"), at(i + 32).alias("ly"), at(i + 48).alias("lw"), at(63 - i).alias("lh"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, mode) for every fifth photo, some of them unknown paths or no change."""
    rows = photos(spark, sf_dir).filter("photo_id % 5 = 0")
    mode = F.element_at(F.array(F.lit("landscape"), F.lit("object"), F.lit("portrait")), (F.col("photo_id") % 3 + 1).cast("int"))
    return rows.select(F.when(F.col("photo_id") % 7 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), mode.alias("mode"))


def existing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that stand in the target folder already: those of every eleventh photo."""
    return photos(spark, sf_dir).filter("photo_id % 11 = 0").select(F.regexp_extract("path", r"[^/\\]*$", 0).alias("file_name"))


def scan_events(events: DataFrame) -> DataFrame:
    """(seq, path, status, score) from rows of the events table; 'error' events are failures."""
    failed = F.col("event_type") == "error"
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("path"), F.when(failed, "failed").otherwise("scored").alias("status"), F.when(~failed, F.col("value")).alias("score"))
