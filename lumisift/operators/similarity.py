"""Exact similarity join of 64-bit hashes by Hamming distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.sources.tables import written

#: A key with more hashes than this is compared tile by tile, a task for each pair of tiles.
TILE = 4096
#: Mean number of hashes of a key that is aimed at, and the most blocks a key is made of.
PER_KEY, MOST_SHARED = 64, 4


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cuts(blocks: int) -> list[int]:
    """Bit masks of the blocks the 64 bits are cut into, as signed numbers."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << (z - a)) - 1) << a for a, z in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shared_blocks(n: int, max_distance: int) -> int:
    """How many blocks a key should be made of for n hashes: the fewest whose keys are rare enough."""
    rare = (s for s in range(1, MOST_SHARED) if n <= PER_KEY << (64 // (max_distance + s) * s))
    return next(rare, MOST_SHARED)


def similar_pairs(df: DataFrame, hash_col: str = "phash", max_distance: int = 6, shared: int | None = None) -> DataFrame:
    """(hash_a, hash_b, distance) for distinct hashes hash_a < hash_b at most max_distance apart; null hashes pair with nothing.

    The bits are cut into max_distance + shared blocks, of which a pair has `shared` in common; it is
    made only from its lowest such blocks, so it comes once. More shared blocks mean rarer keys and more
    of them; if none are given, the number of hashes decides. From distance 13 on keys are too short to
    help and all hashes have one key, which is as exact and costs all comparisons. Keys of more than TILE
    hashes are dealt to a task for each pair of tiles.
    """
    hashes = df.select(F.col(hash_col).cast("long").alias("h")).filter("h IS NOT NULL").distinct()
    if max_distance < 0:
        return hashes.filter("false").select(F.col("h").alias("hash_a"), F.col("h").alias("hash_b"), F.lit(0).alias("distance"))
    hashes = written(hashes)  # what they are made from, pixels perhaps, is read once
    n = hashes.agg(F.count("*")).first()[0]
    shared = 0 if max_distance > 12 else shared or shared_blocks(n, max_distance)
    masks = _cuts(max_distance + shared) if shared else []
    keys = []
    for chosen in combinations(range(len(masks)), shared):
        mask = sum(masks[b] & (1 << 64) - 1 for b in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(sum(1 << b for b in chosen)).alias("blocks"), F.col("h").bitwiseAND(F.lit(mask)).alias("bits")))
    keyed = hashes.select("h", F.explode(F.array(*keys)).alias("k")).select("h", "k.*")
    at = ["blocks", "bits"]
    if n > TILE:  # else no key can have more
        sizes = keyed.groupBy(*at).agg(F.count("*").alias("m")).filter(F.col("m") > TILE).select(*at, F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
        keyed = keyed.join(sizes, at, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        own, other = F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        x, y = keyed.withColumn("i", own).withColumn("j", other), keyed.withColumn("j", own).withColumn("i", other)
        at = [*at, "i", "j"]
    else:
        x = y = keyed
    x, y = x.alias("x"), y.alias("y")
    differ = F.col("x.h").bitwiseXOR(F.col("y.h"))
    equal = sum((F.when(differ.bitwiseAND(F.lit(m)) == 0, 1 << b).otherwise(0) for b, m in enumerate(masks)), F.lit(0))
    lowest, rest = F.lit(0), equal
    for _ in range(shared):
        bit = rest.bitwiseAND(-rest)
        lowest, rest = lowest.bitwiseOR(bit), rest.bitwiseXOR(bit)
    met = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in at]
    distance = hamming(F.col("x.h"), F.col("y.h"))
    # the distance first: few pairs pass it, and the lowest blocks take longer to find
    pairs = x.join(y, [*met, F.col("x.h") < F.col("y.h"), distance <= max_distance, lowest == F.col("x.blocks")])
    return pairs.select(F.col("x.h").alias("hash_a"), F.col("y.h").alias("hash_b"), distance.cast("int").alias("distance"))
