"""From raw detector output to each photo's main face."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The model's feature maps (columns, rows, box edges in pixels) for an input of 320 x 240.
LAYERS = [(40, 30, [10.0, 16.0, 24.0]), (20, 15, [32.0, 48.0]), (10, 8, [64.0, 96.0]), (5, 4, [128.0, 192.0, 256.0])]
CONFIDENCE, OVERLAP, CENTER, SIZE, LEAST_AREA = 0.7, 0.3, 0.1, 0.2, 0.001


def _f(value: float) -> Column:
    return F.lit(value).cast("float")


def prior_boxes(spark: SparkSession) -> DataFrame:
    """(prior_idx, cx, cy, w, h), 4420 rows: layer by layer, row by row, cell by cell, box by box."""
    out, before = None, 0
    for columns, rows, edges in LAYERS:
        n = columns * rows * len(edges)
        cell, box = F.floor(F.col("id") / len(edges)), (F.col("id") % len(edges)).cast("int")
        edge = F.element_at(F.array(*(_f(e) for e in edges)), box + 1)
        layer = spark.range(n).select(
            (F.col("id") + before).cast("int").alias("prior_idx"),
            (((cell % columns).cast("float") + _f(0.5)) / columns).cast("float").alias("cx"),
            ((F.floor(cell / columns).cast("float") + _f(0.5)) / rows).cast("float").alias("cy"),
            F.least((edge / _f(320.0)).cast("float"), _f(1.0)).alias("w"),
            F.least((edge / _f(240.0)).cast("float"), _f(1.0)).alias("h"),
        )
        out, before = layer if out is None else out.union(layer), before + n
    return out


def decode_boxes(raw: DataFrame) -> DataFrame:
    """Boxes (photo_id, prior_idx, face_score, x1, y1, x2, y2), in shares of the frame, of raw rows above the confidence."""
    priors = F.broadcast(prior_boxes(raw.sparkSession))  # always 4420 rows
    d = raw.filter(F.col("face_score") > _f(CONFIDENCE)).join(priors, "prior_idx")
    c = F.col
    as_float = lambda x: x.cast("float")
    cx = as_float(as_float(as_float(c("lx") * _f(CENTER)) * c("w")) + c("cx"))
    cy = as_float(as_float(as_float(c("ly") * _f(CENTER)) * c("h")) + c("cy"))
    w = as_float(as_float(F.exp(as_float(c("lw") * _f(SIZE)).cast("double"))) * c("w"))
    h = as_float(as_float(F.exp(as_float(c("lh") * _f(SIZE)).cast("double"))) * c("h"))
    half = lambda x: as_float(x / 2)
    return d.select("photo_id", "prior_idx", "face_score", as_float(cx - half(w)).alias("x1"), as_float(cy - half(h)).alias("y1"), as_float(cx + half(w)).alias("x2"), as_float(cy + half(h)).alias("y2"))


def iou(a: Column, b: Column) -> Column:
    zero = _f(0.0)
    side = lambda low, high: F.greatest((high - low).cast("float"), zero)
    both = (side(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * side(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))).cast("float")
    area = lambda s: (side(s["x1"], s["x2"]) * side(s["y1"], s["y2"])).cast("float")
    return (both / (area(a) + area(b) - both + _f(1e-5))).cast("float")


def nms(boxes: DataFrame, by: str = "photo_id") -> DataFrame:
    """Of each photo's boxes, best first (ties: lower prior first), those that overlap no kept one too much.

    A photo has at most as many boxes as there are priors, so its array is bounded.
    """
    box = F.struct((-F.col("face_score")).alias("rank"), "prior_idx", "face_score", "x1", "y1", "x2", "y2")
    ordered = boxes.groupBy(by).agg(F.array_sort(F.collect_list(box)).alias("all"))
    none = F.expr("filter(all, x -> false)")
    kept = F.aggregate("all", none, lambda acc, c: F.when(F.forall(acc, lambda k: iou(k, c) <= _f(OVERLAP)), F.concat(acc, F.array(c))).otherwise(acc))
    return ordered.select(by, F.explode(kept).alias("b")).select(by, "b.prior_idx", "b.face_score", "b.x1", "b.y1", "b.x2", "b.y2")


def to_pixel_faces(boxes: DataFrame, photos: DataFrame, by: str = "photo_id") -> DataFrame:
    """Kept boxes in the pixels of their photos (by, width, height); faces below a thousandth of the frame go."""
    def to(c, n):
        return (F.greatest(F.least(F.col(c), _f(1.0)), _f(0.0)) * F.col(n).cast("float")).cast("float").alias(c)

    found = boxes.join(photos.select(by, "width", "height"), by).select(by, "prior_idx", "face_score", to("x1", "width"), to("y1", "height"), to("x2", "width"), to("y2", "height"), "width", "height")
    area = (F.greatest(F.col("x2") - F.col("x1"), _f(0.0)) * F.greatest(F.col("y2") - F.col("y1"), _f(0.0))).cast("float")
    frame = (F.col("width").cast("float") * F.col("height").cast("float")).cast("float")
    return found.withColumn("area", area).filter((area / frame).cast("float") >= _f(LEAST_AREA)).drop("width", "height")


def main_face(faces: DataFrame, by: str = "photo_id") -> DataFrame:
    """(by, face): the largest face, then the most confident, then that of the lower prior."""
    face = F.struct("x1", "y1", "x2", "y2", F.col("face_score").alias("score"))
    return faces.groupBy(by).agg(F.max_by(face, F.struct("area", "face_score", -F.col("prior_idx"))).alias("face"))


def detect_main_faces(raw: DataFrame, photos: DataFrame, by: str = "photo_id") -> DataFrame:
    return main_face(to_pixel_faces(nms(decode_boxes(raw), by), photos, by), by)
