"""Reading image files, scoring them, and writing results, failures and thumbnails."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.functions import pixels
from lumisift.functions.paths import RAW, STANDARD, filter_photo_paths, format_class
from lumisift.operators.features import score_photos
from lumisift.sources.embedded import orientation, preview
from lumisift.sources.listing import file_system, reader, walk
from lumisift.sources.tables import make_folder, qualified, scratch_dir, shuffle_partitions, written

IMAGES = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
PHOTOS = "path string, seq long, orientation int, width int, height int, rgb binary, error string"


def list_photos(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime) of the photos below root, whatever their names; contents are not read, folders are listed by tasks."""
    return _photos(walk(spark, root), spark, root).select("path", "length", "modificationTime")


def _photos(found: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    return filter_photo_paths(found, "path", qualified(spark, root)[0])


def names_of(extensions: list[str]) -> str:
    """A pattern of the names that the image source is to open, in any case of letters."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in extensions) + "}"


def show_photos(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Brings the photos below root that Spark's image source does not take into folder, and returns (path, error) of those that can't be.

    These are photos with names that the file sources hide, which are copied, and raw photos, of which the largest preview
    picture inside is written. Each part of the path gets a letter before it: 'v', and 'r' for the name of a
    raw photo, whose copy ends in '.jpg'. Tasks do it; a copy is written under a hidden name and then moved, so that no half
    copy is ever read, and one that is there is not made again.
    """
    base, _ = qualified(spark, root)
    target_base, _ = qualified(spark, folder)
    found = _photos(walk(spark, root), spark, root).withColumn("raw", format_class(F.col("path")) == "raw").filter("raw OR hidden")

    def brought(frames):
        from pyarrow import fs
        from pyspark import TaskContext

        for frame in frames:
            errors = []
            for path, raw in zip(frame["path"], frame["raw"], strict=True):
                try:
                    up, name = re.sub("/", "/v", path[len(base) :]).rsplit("/v", 1)
                    target, there = file_system(f"{target_base}{up}/{'r' if raw else 'v'}{name}{'.jpg' if raw else ''}")
                    if target.get_file_info(there).type != fs.FileType.NotFound:
                        errors.append(None)
                        continue
                    up, name = there.rsplit("/", 1)
                    target.create_dir(up)
                    half = f"{up}/.{TaskContext.get().taskAttemptId()}{name[-200:]}"
                    if raw:
                        read, close = reader(path)
                        picture = preview(read)
                        close()
                        if picture is None:
                            errors.append("no preview picture found in the raw photo")
                            continue
                        with target.open_output_stream(half) as out:
                            out.write(picture)
                    else:
                        source, here = file_system(path)
                        fs.copy_files(here, half, source, target)
                    if target.get_file_info(there).type == fs.FileType.NotFound:
                        target.move(half, there)
                    else:
                        target.delete_file(half)
                    errors.append(None)
                except (OSError, ValueError) as e:
                    errors.append(f"can't be read or copied: {e}")
            yield pd.DataFrame({"path": frame["uri"], "error": errors})

    done = written(found.select("path", "uri", "raw").repartition(shuffle_partitions(spark)).mapInPandas(brought, "path string, error string"))
    return done.filter("error IS NOT NULL")


def _origin(file: Column, spark: SparkSession, root: str, folder: str) -> Column:
    """The URI of the photo that a file in show_photos()'s folder stands for."""
    inner = F.regexp_extract(file, f"{re.escape(qualified(spark, folder)[1].rsplit('/', 1)[1])}(/.*)$", 1)
    inner = F.regexp_replace(F.regexp_replace(inner, r"/r([^/]*)\.jpg$", "/$1"), "/v", "/")
    return F.concat(F.lit(qualified(spark, root)[1]), inner)


def decoded(images: DataFrame, root: str = "", orientations: DataFrame | None = None) -> DataFrame:
    """Photos (path, seq, orientation, width, height, rgb, error) from rows of the image source (struct image, BGR).

    A column file tells where a row's bytes lie, if not at its origin. seq is null; the path orders ties. orientations
    (path, orientation) holds EXIF values, 1 where it has none; without it each file's own is read, from its first bytes.
    Files that can't be decoded, raw ones among them, keep their path and an error.
    """
    i = F.col("image")
    file = F.col("file") if "file" in images.columns else i["origin"]
    rows = images.select(i["origin"].alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"), file.alias("file"))
    rows = filter_photo_paths(rows, "path", root.rstrip("/"))
    if orientations is not None:
        rows = rows.join(orientations, "path", "left")
    else:
        rows = rows.withColumn("orientation", F.lit(0))

    def own_orientation(file: str) -> int:
        try:
            read, close = reader(unquote(file))
            found = orientation(read)
            close()
            return found
        except (OSError, ValueError):  # a store that only Spark reads
            return 1

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.height <= 0 or r.width <= 0 or r.channels not in (1, 3, 4):
                    raw = r.path.rsplit(".", 1)[-1].lower() in RAW
                    out.append((r.path, None, 1, 0, 0, None, "raw photos are not decoded" if raw else "image can't be decoded"))
                    continue
                turn = 1 if pd.isna(r.orientation) else int(r.orientation) or own_orientation(r.file)
                px = np.frombuffer(r.data, np.uint8).reshape(1, r.height, r.width, r.channels)
                rgb = np.repeat(px, 3, axis=3) if r.channels == 1 else px[..., 2::-1]
                rgb = pixels.orient(rgb, turn)
                out.append((r.path, None, turn, rgb.shape[2], rgb.shape[1], np.ascontiguousarray(rgb).tobytes(), None))
            yield pd.DataFrame(out, columns=["path", "seq", "orientation", "width", "height", "rgb", "error"])

    return rows.mapInPandas(run, PHOTOS)


def image_rows(reading, spark: SparkSession, root: str, shown: str | None) -> DataFrame:
    """Rows of the image source (image, file) for the photos below root, by spark.read or spark.readStream: such as it takes, and those shown elsewhere.

    Where none are shown, raw photos come as rows that are not decoded.
    """
    options = {"recursiveFileLookup": True, "dropInvalid": False, "pathGlobFilter": names_of(STANDARD if shown else STANDARD + RAW)}
    seen = reading.format("image").schema(IMAGES).options(**options).load(root).select("image", F.col("image.origin").alias("file"))
    if shown is None:
        return seen
    others = reading.format("image").schema(IMAGES).options(**options).load(shown).select("image", F.col("image.origin").alias("file"))
    return seen.union(others.select(F.col("image").withField("origin", _origin(F.col("file"), spark, root, shown)).alias("image"), "file"))


def read_photos(spark: SparkSession, root: str, orientations: DataFrame | None = None, shown: str | None = None) -> DataFrame:
    """Photos (see decoded()) of all image files below root, those with hidden names and the previews of raw photos included; such as can't be
    read have an error. shown is the folder of show_photos(), one of its own if none is given."""
    shown = shown or f"{scratch_dir(spark)}/photos-{uuid.uuid4().hex}"
    failed = show_photos(spark, root, shown)
    make_folder(spark, shown)
    photos = decoded(image_rows(spark.read, spark, root, shown), root, orientations)
    columns = [failed[f.name] if f.name in failed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in photos.schema]
    return photos.unionByName(failed.select(columns))


def split_failures(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and (path, error) of the others."""
    return scored.filter("error IS NULL").drop("error"), scored.filter("error IS NOT NULL").select("path", "error")


def scored_or_failed(photos: DataFrame, mode: str = "auto", thumbs: bool = True, faces: DataFrame | None = None, detector=None) -> DataFrame:
    """score_photos() of decoded photos, with their faces (path, face); what failed to decode keeps its own error."""
    found = score_photos(photos.withColumnRenamed("error", "decode_error"), mode, faces, thumbs, detector)
    return found.withColumn("error", F.coalesce("decode_error", "error")).drop("decode_error")


def scan(spark: SparkSession, root: str, mode: str = "auto", faces: DataFrame | None = None, detector=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, failures (path, error) and thumbnails (path, width, height, rgb) of all photos below root.

    faces has the main face of each photo that shows one (path, face), as detect_main_faces() makes it; a detector finds
    them in the scan itself (see score_photos()).
    """
    all_rows = written(scored_or_failed(read_photos(spark, root), mode, faces=faces, detector=detector))
    results, failures = split_failures(all_rows)
    return results.drop("thumb"), failures, results.select("path", "thumb.*")


def write_results(results: DataFrame, path: str) -> None:
    results.write.partitionBy("mode").parquet(path)


def write_thumbs(thumbs: DataFrame, path: str) -> None:
    thumbs.select("path", "width", "height", "rgb").write.parquet(path)
