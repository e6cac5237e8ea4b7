"""The cull: technical cutoff, duplicate groups, best of each, weighted ranking, top N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scoring import Weights, overall_score
from lumisift.operators.grouping import best_of_group, group_duplicates
from lumisift.operators.ordering import global_rank
from lumisift.sources.tables import written


def passes_technical(df: DataFrame, threshold: float = 32.0) -> DataFrame:
    """Photos with a raw score above the threshold; NaN and null scores don't pass."""
    return df.filter((F.col("score") > threshold) & ~F.isnan("score"))


def _best_first(column: str):
    return F.when(F.isnan(column), F.lit(float("-inf"))).otherwise(F.col(column)).desc_nulls_last()


def candidates(results: DataFrame, technical: float = 32.0, max_distance: int = 6, weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    """The best of each group of surviving photos, and the survivors in no group: (path, seq, overall, group_rank)."""
    passed = written(passes_technical(results, technical).select("path", "seq", "phash", "metrics"))
    groups = written(group_duplicates(passed, max_distance))
    best = best_of_group(groups, passed, weights).select("path", "seq", "overall", "group_rank")
    alone = passed.join(groups.select("path"), "path", "left_anti")
    return best.unionByName(alone.select("path", "seq", overall_score(F.col("metrics"), weights).alias("overall"), F.lit(None).cast("long").alias("group_rank")))


def shortlist(found: DataFrame, n: int = 150) -> DataFrame:
    """The n best of candidates; ties: group winners first, largest group first, then input order."""
    order = [_best_first("overall"), F.col("group_rank").isNull(), F.col("group_rank"), F.col("seq"), F.col("path")]
    return found.orderBy(*order).limit(n)


def cull(results: DataFrame, technical: float = 32.0, max_distance: int = 6, weights: Weights = Weights(), n: int = 150) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The shortlist, and the funnel of counts (total, after_technical, after_dedupe, shown)."""
    found = written(candidates(results, technical, max_distance, weights))
    counts = results.agg(F.count("*").alias("total"), F.count_if((F.col("score") > technical) & ~F.isnan("score")).alias("after_technical"))
    left = found.agg(F.count("*").alias("after_dedupe"))
    funnel = counts.join(F.broadcast(left)).withColumn("shown", F.least(F.col("after_dedupe"), F.lit(n).cast("long")))  # one row each
    return shortlist(found, n), funnel


def flat_view(results: DataFrame, sort_by: str = "score") -> DataFrame:
    """All photos with place, best first by score or overall; ties in input order; NaN last."""
    return global_rank(results, [_best_first(sort_by), F.col("seq"), F.col("path")], "place")


def scan_counts(found: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: found (photos of the listing), scored, failed, processed, and waiting, those found that are not processed."""
    listed = found.agg(F.count("*").alias("found"))
    both = scan_status(results, failures).join(F.broadcast(listed))  # one row each
    return both.select("found", "processed", "scored", "failed", (F.col("found") - F.col("processed")).alias("waiting"))


def scan_status(results: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: scored, failed, processed."""
    both = results.select(F.lit(1).alias("ok")).unionByName(failures.select(F.lit(0).alias("ok")))
    return both.agg(F.count_if(F.col("ok") == 1).alias("scored"), F.count_if(F.col("ok") == 0).alias("failed"), F.count("*").alias("processed"))
