"""Mixing sources to target weights by entropy balancing.

Targets share all words by weight, none above `cap` times its source's size (the excess is shared
again). Rates are the tilt of least entropy loss that meets each source's target: a document of x
words (in units of its source's mean) gets the rate cap / (1 + (cap - 1) exp(-lambda x)), which is 1
at lambda = 0 and never above cap. lambda minimises the convex dual, which separates by source: Newton's
iterations, kept within brackets, run for all sources side by side, each on its histogram of sizes. Rates
are then rounded into whole copies per (source, size) cell, and a cell's copies are dealt to its rows in
the order of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_column, fresh, if_small, running_total, written

TOLERANCE = 1e-9
MOST_STEPS = 100
#: Rows of a cell are ranked in ranges of about so many hashes.
RANGE_ROWS = 4096
#: Exchanges of documents look at so many sizes at once.
SIZES_AT_ONCE = 96


@arrow_column(T.LongType())
def word_count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Number of words of each text, white space being space and tab to carriage return; 0 for null."""
    for texts in batches:
        yield pa.array([len(t.split()) if t else 0 for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source_key, source_size, target) from rows (source_key, source_size), one per source.

    Sources in code-point order, null ('-') last, weigh `weights` over and over. Each pass over the
    sources' table finds the level at which those not yet at their cap share what the others leave.
    """
    placed = sizes.withColumn("one", F.lit(1).cast("long"))
    order = [(F.col("source_key") == "-").asc(), F.col("source_key").asc()]
    ranked = running_total(placed, order, "one", "place")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = written(ranked.select("source_key", "source_size", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * float(cap)).alias("most")))
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("most")
        row = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not row[2]:
            break
        new = (row[0] - row[1]) / row[2]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.select("source_key", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def balanced_rates(size: np.ndarray, n: np.ndarray, target: float, cap: float) -> np.ndarray:
    """The rate of each cell of n documents of one size: Newton's iterations on the dual of a source."""
    words = (n * size).astype(np.float64)
    if not words.any():
        return np.ones(len(size))
    x = size * (n.sum() / words.sum())
    lam, low, high = 0.0, -1e4, 1e4

    def rates(lam):
        return cap / (1 + (cap - 1) * np.exp(-np.clip(lam * x, -600, 600)))

    for _ in range(MOST_STEPS):
        rate = rates(lam)
        gap = float(words @ rate) - target
        if abs(gap) <= TOLERANCE * max(target, 1.0):
            break
        low, high = (lam, high) if gap < 0 else (low, lam)
        slope = float(words @ (rate * (1 - rate / cap) * x))
        step = lam - np.clip(gap / slope, -4, 4) if slope > 0 else low
        lam = float(step) if low < step < high else (low + high) / 2
    return rates(lam)


def round_copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Whole copies for each cell of n documents of one size, whose words come to the target or near it.

    Running sums of the rates, by size, are rounded, so the error is within about one document; then
    documents of the largest fitting size are added or taken away while that brings the sum nearer,
    and at last up to two documents are exchanged for up to two others, again and again.
    """
    order = np.argsort(size, kind="stable")
    size, n, rate = size[order], n[order], np.round(rate[order], 9)
    copies = np.clip(np.diff(np.floor(np.cumsum(n * rate) + 0.5), prepend=0.0), 0, cap * n).astype(np.int64)
    for _ in range(64):
        gap = target - float(copies @ size)
        add = gap > 0
        free = (copies < cap * n) if add else (copies > 0)
        fits = np.flatnonzero(free & (size > 0) & (size < 2 * abs(gap)))
        if not len(fits):
            break
        under = fits[size[fits] <= abs(gap)]
        k = under[-1] if len(under) else fits[0]  # one that overshoots by less than the gap
        times = max(1, int(abs(gap) // size[k]))
        times = min(times, int(cap * n[k] - copies[k] if add else copies[k]))
        copies[k] += times if add else -times
    out = np.empty_like(copies)
    out[order] = _exchanged(size, n, copies, target, cap)
    return out


def _bundles(size: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No, one or two documents of sizes that have room: their words, ascending, and (cell, cell), -1 for none."""
    places = np.flatnonzero((room > 0) & (size > 0))
    if len(places) > SIZES_AT_ONCE:
        places = places[np.linspace(0, len(places) - 1, SIZES_AT_ONCE).round().astype(int)]
    i, j = np.triu_indices(len(places))
    two = (i != j) | (room[places[i]] > 1)
    cells = np.vstack([[[-1, -1]], np.stack([places, np.full(len(places), -1)], 1), np.stack([places[i], places[j]], 1)[two]])
    words = np.append(size, 0)[cells].sum(1)
    order = np.argsort(words, kind="stable")
    return words[order], cells[order]


def _exchanged(size: np.ndarray, n: np.ndarray, copies: np.ndarray, target: float, cap: int) -> np.ndarray:
    """copies after adding up to two documents for up to two others, as long as that brings the sum nearer."""
    copies = copies.copy()
    for _ in range(32):
        gap = target - float(copies @ size)
        if abs(gap) <= 0.5:
            break
        (more, added), (less, taken) = _bundles(size, cap * n - copies), _bundles(size, copies)
        want = less + gap
        at = np.searchsorted(more, want)
        best = (abs(gap), None, None)
        for side in (np.minimum(at, len(more) - 1), np.maximum(at - 1, 0)):
            left = np.abs(want - more[side])
            k = int(left.argmin())
            if left[k] < best[0] - 1e-9:
                best = (left[k], added[side[k]], taken[k])
        if best[1] is None:
            break
        for cells, step in ((best[1], 1), (best[2], -1)):
            np.add.at(copies, cells[cells >= 0], step)
    return copies


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, carry: list[str] | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", broadcast_rows: int = 200_000) -> DataFrame:
    """The carried columns (all, if None) with size, source_size, target, copies and taken.

    taken is copies times size, copies 0 to cap. Null text has size 0, which takes nothing; null
    sources are one source, last in order. Copies follow from a hash of id and text, whatever the row
    order, so reruns agree; of rows alike in both, as many as needed get one more copy. Taken columns'
    names get leading underscores. An empty table gives an empty one.
    """
    carry = docs.columns if carry is None else carry
    source_key = F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    # a size that cannot be null for the planner is counted once, not once more in a filter before the joins
    size = F.coalesce(word_count(F.col(text_col)), F.lit(0).cast("long")).alias("size")
    rows = docs.select(F.struct(*carry).alias("row"), size, source_key.alias("source_key"), F.xxhash64(id_col, text_col).alias("row_hash"))
    slim = written(rows.select("size", "source_key", "row_hash") if text_col in carry else rows)
    counted = written(slim.groupBy("source_key", "size", "row_hash").agg(F.count("*").alias("m")))  # rows alike are one from here on
    hist = written(counted.groupBy("source_key", "size").agg(F.sum("m").alias("n")))
    sizes = hist.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes, weights, float(cap))

    def rounded(frame):
        frame = frame.sort_values("size")
        size, n, target = frame["size"].to_numpy(), frame["n"].to_numpy(), float(frame["target"].iloc[0])
        return frame.assign(cell_copies=round_copies(size, n, balanced_rates(size, n, target, float(cap)), target, cap))

    # a group holds one row per distinct size of a source, not its documents
    schema = "source_key string, size long, n long, source_size long, target double, cell_copies long"
    cells = written(hist.join(targets, "source_key").select("source_key", "size", "n", "source_size", "target").groupBy("source_key").applyInPandas(rounded, schema))
    shares = written(_dealt(counted, cells, broadcast_rows))
    joined = (rows if text_col in carry else slim).join(if_small(shares, broadcast_rows), ["source_key", "size"])
    served = F.coalesce(F.when(F.col("below").isNotNull(), F.col("row_hash") < F.col("below")).otherwise(F.col("row_hash") <= F.col("upto")), F.lit(False))
    tie = F.coalesce((F.col("row_hash") == F.col("below")) & (F.col("give") > 0), F.lit(False))
    columns = ["row", "size", "source_size", "target"]
    if shares.filter("give > 0").isEmpty():
        out = joined.select(*columns, (F.col("whole") + served.cast("int")).alias("copies"))
    else:
        alike = _first_of_alike(joined.filter(tie))
        out = joined.filter(~tie).select(*columns, (F.col("whole") + served.cast("int")).alias("copies")).unionByName(alike.select(*columns, "copies"))
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size")}
    return out.select(*(F.col("row")[c].alias(c) for c in carry), *(c.alias(fresh(docs, n)) for n, c in new.items()))


def _dealt(counted: DataFrame, cells: DataFrame, broadcast_rows: int) -> DataFrame:
    """For each cell: `whole` copies that all its documents get, and which hashes get one more.

    Those are the hashes under `below`, of whose own rows `give` get one; or, where below is null, those up
    to `upto`. A cell's hashes are counted in ranges, and only the range in which its spare copies end is
    ranked, so a cell may hold any number of documents.
    """
    keys = ["source_key", "size"]
    spare = cells.withColumn("spare", F.col("cell_copies") % F.col("n")).filter("spare > 0").select(*keys, "spare", (1 + F.floor(F.col("n") / RANGE_ROWS)).alias("ranges"))
    place = F.floor((F.col("row_hash").cast("double") + 2.0**63) / 2.0**64 * F.col("ranges"))
    ranged = counted.join(if_small(written(spare), broadcast_rows), keys).withColumn("range", F.least(place, F.col("ranges") - 1))
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("range"))
    ends = ranged.groupBy(*keys, "range", "spare").agg(F.sum("m").alias("m")).withColumn("end", upto).filter((F.col("end") >= F.col("spare")) & (F.col("end") - F.col("m") < F.col("spare")))
    inside = ranged.join(ends.select(*keys, "range", (F.col("end") - F.col("m")).alias("before")), [*keys, "range"])
    inside = inside.withColumn("end", F.col("before") + F.sum("m").over(Window.partitionBy(*keys).orderBy("row_hash")))
    beyond = F.col("end") > F.col("spare")
    first = F.min(F.when(beyond, F.struct("row_hash", (F.col("spare") - F.col("end") + F.col("m")).alias("give"))))
    edges = inside.groupBy(*keys).agg(first.alias("first"), F.max(F.when(~beyond, F.col("row_hash"))).alias("upto"))
    edges = edges.select(*keys, F.col("first.row_hash").alias("below"), F.col("first.give").alias("give"), "upto")
    return cells.join(edges, keys, "left").select(*keys, "source_size", "target", F.floor(F.col("cell_copies") / F.col("n")).alias("whole"), "below", "give", "upto")


def _first_of_alike(tied: DataFrame) -> DataFrame:
    """Rows of a hash that only `give` of are to get one more copy, with copies; numbered where they lie, without gathering them."""
    keys = ["source_key", "size"]
    rows = written(tied.withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()))
    counts = rows.groupBy(*keys, "part").agg(F.count("*").alias("m"))
    before = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*keys).orderBy("part")) - F.col("m")).drop("m")
    nth = F.col("before") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("id"))
    return rows.join(before, [*keys, "part"]).withColumn("copies", F.col("whole") + (nth <= F.col("give")).cast("int"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; rows of no copies go."""
    out = mix(docs, **options)
    copies = out.columns[-2]
    return out.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
