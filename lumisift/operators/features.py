"""The pixel stage: one narrow pass from images to moments, variances, hashes and thumbnails."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.functions import boxes, pixels, scoring

SCORE_EDGE, THUMB_EDGE = 1600, 220
PIXELS_AT_ONCE, DETECTED_AT_ONCE = 16_000_000, 8
_FACE = "struct<x1:float,y1:float,x2:float,y2:float,score:float>"


def _faces_by(detector, rgb: np.ndarray) -> list[dict | None]:
    """The main face of each of the images, DETECTED_AT_ONCE at a time. If the model fails for several it is asked one by one, and an error for
    one image means that it has no face."""
    out: list[dict | None] = []
    for k in range(0, len(rgb), DETECTED_AT_ONCE):
        some = rgb[k : k + DETECTED_AT_ONCE]
        try:
            scores, raw = detector(pixels.detector_tensor(some))
            out += [boxes.main_face(scores[i], raw[i], some.shape[2], some.shape[1]) for i in range(len(some))]
        except Exception:  # a user's model may raise anything
            out += [None] if len(some) == 1 else [face for i in range(len(some)) for face in _faces_by(detector, some[i : i + 1])]
    return out


def _rows(frame: pd.DataFrame, keep: list[str], thumbs: bool, score_edge: int, thumb_edge: int, detector=None) -> pd.DataFrame:
    """Features of the frame's images; rows whose pixels don't fit their size get an error."""
    size = frame["rgb"].map(lambda x: -1 if x is None else len(x))
    good = (frame["width"] > 0) & (frame["height"] > 0) & (size == frame["width"] * frame["height"] * 3)
    out = frame[keep].copy()
    out["error"] = np.where(good, None, "pixels do not fit width and height")
    numbers = {n: np.zeros(len(frame), np.int64) for n in pixels.MOMENTS} | {n: np.full(len(frame), np.nan) for n in pixels.REGIONS}
    phash, var_face = np.zeros(len(frame), np.int64), np.full(len(frame), np.nan)
    widths, heights = np.zeros(len(frame), np.int32), np.zeros(len(frame), np.int32)
    thumb: list = [None] * len(frame)
    faces: list = list(frame["face"]) if "face" in frame else []
    places = np.flatnonzero(good.to_numpy())
    for (w, h), own in frame.iloc[places].groupby(["width", "height"]).indices.items():
        step = max(1, PIXELS_AT_ONCE // max(1, int(w) * int(h)))
        for k in range(0, len(own), step):
            at = places[own[k : k + step]]
            rgb = np.frombuffer(b"".join(frame["rgb"].iloc[at]), np.uint8).reshape(len(at), int(h), int(w), 3)
            rgb = pixels.resize_to_fit(rgb, score_edge)
            for name, values in pixels.moments(rgb).items():
                numbers[name][at] = values
            phash[at] = pixels.dhash64(rgb)
            widths[at], heights[at] = rgb.shape[2], rgb.shape[1]
            if thumbs:
                small = pixels.resize_to_fit(rgb, thumb_edge)
                for i, p in enumerate(at):
                    thumb[p] = {"width": small.shape[2], "height": small.shape[1], "rgb": small[i].tobytes()}
            if detector is not None:
                for p, face in zip(at, _faces_by(detector, rgb), strict=True):
                    faces[p] = face
            if "face" in frame:
                gray = None
                for i, p in enumerate(at):
                    face = faces[p]
                    if face is not None:
                        gray = pixels.to_gray(rgb) if gray is None else gray
                        part = pixels.face_crop(gray[i : i + 1], tuple(face[c] for c in ("x1", "y1", "x2", "y2")))
                        var_face[p] = pixels.laplacian_variance(part)[0]
    if detector is not None:
        out["face"] = faces
    out = out.assign(**numbers, var_face=var_face, phash=phash, width=widths, height=heights)
    for name in (*pixels.REGIONS, "var_face"):
        out[name] = out[name].astype(object).where(out[name].notna(), None)
    if thumbs:
        out["thumb"] = thumb
    return out


def photo_moments(photos: DataFrame, thumbs: bool = False, score_edge: int = SCORE_EDGE, thumb_edge: int = THUMB_EDGE, detector=None) -> DataFrame:
    """photos (path or other keys, width, height, rgb[, face]) without rgb, with moments, region variances, phash and error.

    Sizes become those scored at. A row with pixels that don't fit its size keeps its keys, a message in
    error and null variances. Pixels never leave this stage but as thumbnails. With a detector (see score_photos())
    photos have a column face, which it fills.
    """
    keep = [c for c in photos.columns if c not in ("rgb", "width", "height")]
    fields = [photos.schema[c] for c in keep] + [T.StructField("error", T.StringType())]
    fields += [T.StructField(n, T.LongType()) for n in pixels.MOMENTS] + [T.StructField(n, T.DoubleType()) for n in (*pixels.REGIONS, "var_face")]
    fields += [T.StructField("phash", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
    if thumbs:
        fields.append(T.StructField("thumb", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgb", T.BinaryType())])))
    names = [f.name for f in fields]
    return photos.mapInPandas(lambda frames: (_rows(f, keep, thumbs, score_edge, thumb_edge, detector)[names] for f in frames), T.StructType(fields))


def score_photos(photos: DataFrame, mode: str | None = "auto", faces: DataFrame | None = None, thumbs: bool = False, detector=None) -> DataFrame:
    """Scored photos: path, seq, mode, score, metrics, phash, sizes, region variances and error.

    mode is one for all, or None to use a column wanted_mode. faces has one row (path, face) at most per
    photo; it is joined before the pixels are touched, so it should be the small side. face and var_face are
    kept whatever the mode, for later overrides; they count in portrait mode only.

    In place of faces there may be a detector, a face model that tasks call for batches of images: from their tensors (n, 3,
    240, 320) it returns scores (n, priors) and raw boxes (n, priors, 4). Where it raises an error a photo has no face.
    """
    photos = photos.withColumn("wanted_mode", F.lit(mode)) if mode is not None else photos
    if faces is not None:
        photos = photos.join(faces.select("path", "face"), "path", "left")
    else:
        photos = photos.withColumn("face", F.lit(None).cast(_FACE))
    found = photo_moments(photos, thumbs, detector=detector)
    wanted = F.coalesce(F.col("wanted_mode"), F.lit("auto"))
    found = found.withColumn("mode", scoring.resolve_mode(wanted, F.col("face"), F.col("var_full"), F.col("var_half")))
    return scoring.with_metrics(found).drop("wanted_mode", *pixels.MOMENTS)


def detector_input(photos: DataFrame, width: int = 320, height: int = 240, at_once: int = 8) -> DataFrame:
    """photos without rgb, with tensor: 3 x height x width floats, the face model's input, or null where pixels don't fit their size.

    A model of the user's own reads it in another Arrow stage, whose rows (photo, prior, score, lx, ly, lw, lh) go to
    detect_main_faces(). Tensors are made at_once at a time, as one has a megabyte.
    """
    keep = [c for c in photos.columns if c != "rgb"]
    schema = T.StructType([*(photos.schema[c] for c in keep), T.StructField("tensor", T.ArrayType(T.FloatType()))])

    def run(frames):
        for frame in frames:
            for k in range(0, len(frame), at_once):
                part, tensors = frame.iloc[k : k + at_once], []
                for w, h, rgb in zip(part["width"], part["height"], part["rgb"], strict=True):
                    good = rgb is not None and w > 0 and h > 0 and len(rgb) == w * h * 3
                    tensors.append(pixels.detector_tensor(np.frombuffer(rgb, np.uint8).reshape(1, int(h), int(w), 3), width, height).ravel() if good else None)
                yield part[keep].assign(tensor=tensors)

    return photos.mapInPandas(run, schema)
