"""Scores as column expressions over the moments of the pixel stage."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTORS = ("sharpness", "exposure", "contrast", "color", "composition", "subject")


@dataclass(frozen=True)
class Weights:
    """Weights of the factors, in single precision as the scores use them."""

    sharpness: float = 0.25
    exposure: float = 0.15
    contrast: float = 0.10
    color: float = 0.10
    composition: float = 0.25
    subject: float = 0.15

    def column(self, name: str) -> Column:
        return F.lit(float(getattr(self, name))).cast("float").cast("double")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def fit_dimensions(w: Column, h: Column, most: int) -> Column:
    """struct(width, height) with neither edge above most."""
    m = F.lit(float(most))
    scale = F.least(m / w, m / h)
    fits = (w <= most) & (h <= most)
    side = lambda c: F.when(fits, c).otherwise(F.greatest(F.lit(1), F.rint(c * scale).cast("int"))).cast("int")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def normalize_sharpness(raw: Column) -> Column:
    return F.when(raw <= 0, 0.0).otherwise(100.0 * raw / (raw + 100.0))


def exposure_score(n: Column, total: Column, clipped: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(clamp(100.0 * (1.0 - F.abs(total / n - 128.0) / 128.0) - 100.0 * (clipped / n)))


def contrast_score(n: Column, total: Column, squares: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(clamp(100.0 * F.sqrt((n * squares - total * total) / (n * n).cast("double")) / 64.0))


def color_score(n: Column, rg: Column, rg2: Column, yb2x: Column, yb2x2: Column) -> Column:
    """yb2x and yb2x2 are sums of twice the yellow-blue difference and of its square."""
    mean_rg, mean_yb = rg / n, yb2x / n / 2.0
    var_rg = F.greatest(rg2 / n - mean_rg * mean_rg, F.lit(0.0))
    var_yb = F.greatest(yb2x2 / n / 4.0 - mean_yb * mean_yb, F.lit(0.0))
    return F.when(n == 0, 0.0).otherwise(clamp(100.0 * (F.sqrt(var_rg + var_yb) + 0.3 * F.sqrt(mean_rg * mean_rg + mean_yb * mean_yb)) / 110.0))


def composition_score(w: Column, h: Column, energy: Column, thirds: Column) -> Column:
    share = lambda n: F.least(2.0 * F.greatest(n * 0.10, F.lit(1.0)) / n, F.lit(1.0))
    baseline = 1.0 - (1.0 - share(w)) * (1.0 - share(h))
    lift = (thirds / energy - baseline) / F.greatest(1.0 - baseline, F.lit(1e-6))
    return F.when((w < 4) | (h < 4) | (energy <= 0), 50.0).otherwise(clamp(50.0 + 50.0 * lift))


def subject_score(face: Column, w: Column, h: Column) -> Column:
    """Size and centring of the face; null without one."""
    x1, y1, x2, y2 = (face[c].cast("float") for c in ("x1", "y1", "x2", "y2"))
    zero = F.lit(0.0).cast("float")
    area = (F.greatest(x2 - x1, zero) * F.greatest(y2 - y1, zero)).cast("double")
    size = clamp(100.0 * (area / (w.cast("double") * h)) / 0.15)
    dx, dy = (x1 + x2).cast("double") / 2.0 - w / 2.0, (y1 + y2).cast("double") / 2.0 - h / 2.0
    far = F.sqrt(w.cast("double") * w + h.cast("double") * h) / 2.0
    centring = clamp(100.0 * (1.0 - F.sqrt(dx * dx + dy * dy) / F.greatest(far, F.lit(1.0))))
    return F.when(face.isNotNull(), F.when((w <= 0) | (h <= 0), 50.0).otherwise(0.6 * size + 0.4 * centring))


def guess_mode(full: Column, half: Column) -> Column:
    return F.when(full <= 1.0, "landscape").when(half / full > 1.6, "object").otherwise("landscape")


def resolve_mode(wanted: Column, face: Column, full: Column, half: Column) -> Column:
    """'auto' (or null) means portrait with a face, else a guess; other modes stay."""
    auto = F.coalesce(wanted, F.lit("auto")) == "auto"
    return F.when(~auto, wanted).when(face.isNotNull(), "portrait").otherwise(guess_mode(full, half))


def sharpness_score(mode: Column, face_variance: Column) -> Column:
    """Of the face where a portrait has one, else of the mode's middle part."""
    portrait = F.coalesce(face_variance, F.col("var_portrait"))
    return F.when(mode == "portrait", portrait).when(mode == "object", F.col("var_object")).otherwise(F.col("var_full"))


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds score and the struct metrics to rows of the pixel stage with columns mode, face and var_face."""
    portrait = F.col("mode") == "portrait"
    face = F.when(portrait, F.col("face"))
    c = F.col
    scored = df.withColumn("score", sharpness_score(c("mode"), F.when(portrait, c("var_face"))))
    return scored.withColumn(
        "metrics",
        F.struct(
            normalize_sharpness(c("score")).alias("sharpness"),
            exposure_score(c("n_px"), c("sum_l"), c("n_clipped")).alias("exposure"),
            contrast_score(c("n_px"), c("sum_l"), c("sum_l2")).alias("contrast"),
            color_score(c("n_px"), c("sum_rg"), c("sum_rg2"), c("sum_yb2x"), c("sum_yb2x2")).alias("color"),
            composition_score(c("width"), c("height"), c("energy"), c("energy_thirds")).alias("composition"),
            subject_score(face, c("width"), c("height")).alias("subject"),
        ),
    )


def overall_score(metrics: Column, weights: Weights = Weights()) -> Column:  # noqa: B008
    """Weighted mean of the factors that are not null; 0 if their weights sum to nothing."""
    total, summed = F.lit(0.0), F.lit(0.0)
    for f in fields(weights):
        value, weight = metrics[f.name], weights.column(f.name)
        summed = summed + F.when(value.isNull(), 0.0).otherwise(weight * value)
        total = total + F.when(value.isNull(), 0.0).otherwise(weight)
    return F.when(total <= 0, 0.0).otherwise(summed / total)


def reweight(results: DataFrame, weights: Weights) -> DataFrame:
    return results.withColumn("overall", overall_score(F.col("metrics"), weights))


def sharpness_band(score: Column) -> Column:
    return F.when(score <= 40.0, "blurry").when(score <= 100.0, "soft").otherwise("sharp")


def with_labels(df: DataFrame) -> DataFrame:
    from lumisift.functions.paths import file_name

    return df.withColumns({"file_name": file_name(F.col("path")), "score_text": F.format_string("%.1f", F.col("score")), "overall_text": F.format_string("%.1f", F.col("overall"))})
