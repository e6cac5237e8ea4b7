"""Duplicate groups of photos, and the best photo of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.functions.scoring import Weights, overall_score
from lumisift.operators.components import connected_components
from lumisift.operators.ordering import global_rank
from lumisift.operators.similarity import similar_pairs
from lumisift.operators.totals import with_totals
from lumisift.sources.tables import written


def hash_components(photos: DataFrame, max_distance: int = 6) -> DataFrame:
    """(phash, component): the least hash reachable over pairs within the distance; hashes without a pair are left out."""
    pairs = similar_pairs(photos, "phash", max_distance)
    found = connected_components(pairs, "hash_a", "hash_b")
    return found.select(F.col("node").alias("phash"), "component")


def group_duplicates(photos: DataFrame, max_distance: int = 6) -> DataFrame:
    """(group_rank, group_size, member_rank, path, seq) of groups of two or more photos (path, seq, phash).

    Groups are the components of the relation 'hashes at most max_distance apart', largest first, ties by
    their first member; members stand in input order (seq, path). A negative distance groups nothing; null
    hashes are in no group.
    """
    rows = photos.select("path", "seq", "phash").filter("phash IS NOT NULL")
    if max_distance < 0:
        rows = rows.filter("false")
    rows = written(rows)  # what they are made from, pixels perhaps, is read once
    joined = rows.join(hash_components(rows, max_distance), "phash", "left").withColumn("component", F.coalesce("component", "phash"))
    # one order over all members, so that a group of any size is numbered in many tasks
    members = global_rank(joined.select("path", "seq", "component"), [F.col("component"), F.col("seq"), F.col("path")], "place")
    groups = members.groupBy("component").agg(F.count("*").alias("group_size"), F.min(F.struct("seq", "path")).alias("first"), F.min("place").alias("begin")).filter("group_size > 1")
    ranked = global_rank(groups, [F.col("group_size").desc(), F.col("first").asc()], "group_rank")
    return members.join(ranked, "component").select("group_rank", "group_size", (F.col("place") - F.col("begin") + 1).alias("member_rank"), "path", "seq")


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_rank").agg(F.count("*").alias("group_size"))


def grouped_paths(groups: DataFrame) -> DataFrame:
    return groups.select("path").distinct()


def group_sections(groups: DataFrame, results: DataFrame) -> DataFrame:
    """Members with their results, titled 'Group (size)'; members without a result are dropped."""
    found = groups.drop("seq").join(results, "path")
    return with_totals(found, "group_rank", F.count("*").alias("found__")).withColumn("title", F.format_string("Group (%d)", F.col("found__"))).drop("found__")


def best_of_group(groups: DataFrame, results: DataFrame, weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    """(group_rank, path, overall): each group's member with the highest overall score, ties to the earliest by seq (null first) and path."""
    rows = groups.drop("seq").join(results.select("path", "seq", overall_score(F.col("metrics"), weights).alias("overall")), "path")
    worst = F.lit(float("inf"))
    least = F.when(F.isnan("overall"), worst).otherwise(F.coalesce(-F.col("overall"), worst))
    best = F.min_by(F.struct("path", "seq", "overall"), F.struct(least.alias("rank"), "seq", "path"))
    return rows.groupBy("group_rank").agg(best.alias("b")).select("group_rank", "b.path", "b.seq", "b.overall")
