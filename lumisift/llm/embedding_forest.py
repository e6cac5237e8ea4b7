"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree splits recursively along random directions, TREES times over; vectors near a split go to both
sides. A label's trees are as deep as its own number of vectors asks for, so that leaves stay near LEAF
vectors at any size. Vectors are taken relative to their label's mean. The upper levels split each node at
the median of a bounded sample, the levels below those that the sample can fill at the sample's median along
the level's direction. A node stays whole where the overlap would bring most of its vectors to both sides, as
it would where they lie closer together than linked ones may; labels whose trees would compare more pairs than
there are have one leaf, which is compared in blocks. All vectors are routed
to leaves; inside a leaf, vectors of one label are compared exactly in double precision. A pair is counted
in the first leaf it shares, so no list of pairs is ever made; a leaf returns link counts and spanning
links only, and large leaves are compared in blocks of BLOCK by BLOCK. Equal vectors of a label are one
class, compared once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import LINKS, arrow_schema, batch_of, if_small, lean, roots_of, runs, shuffle_partitions, written
from lumisift.operators.components import connected_components
from lumisift.operators.totals import with_totals

TREES = 6
LEAF = 384
BLOCK = 1024
SAMPLE_ROWS = 20_000
SPILL = 0.5
PAYS = 0.9  # a node is split if its sides hold no more than this share of its pairs
OWN_MEAN = 32  # rows of the sample from which a label has a mean and a judgement of its own
_CLASSES = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("label", T.StringType()), T.StructField("raw", T.BinaryType())])
_LEAVES = T.StructType([T.StructField("label", T.StringType()), T.StructField("leaf", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("copies", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("raw", T.BinaryType())])
_TREE_BITS = 54  # a leaf's number is its tree's above so many bits, its node's below


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


@dataclass
class Forest:
    """directions (trees, levels, dims); splits (trees, nodes): the medians at the inner nodes of the upper levels; medians
    (trees, levels) for the levels below; both are infinite where nodes stay whole; margin: half the overlap; means: of
    the labels that have one of their own, and of all others under None; whole: labels that have one leaf."""

    directions: np.ndarray
    splits: np.ndarray
    medians: np.ndarray
    margin: float
    means: dict
    whole: frozenset = frozenset()

    def centred(self, rows: np.ndarray, labels: list) -> np.ndarray:
        if not len(rows):
            return rows
        known = {label: k for k, label in enumerate(dict.fromkeys(labels))}
        means = np.stack([self.means.get(label, self.means[None]) for label in known])
        return rows - means[[known[label] for label in labels]]

    def leaves(self, rows: np.ndarray, depth: np.ndarray, labels: list) -> tuple[np.ndarray, np.ndarray]:
        """The rows' places and their leaves' numbers, ordered by both; depth is each row's, and a row may be in several
        leaves of a tree. Labels that stay whole are in one leaf, as are those so shallow that the trees would compare
        no fewer pairs than there are, even without overlap."""
        trees, levels, dims = self.directions.shape
        along, nodes = self.centred(rows, labels) @ self.directions.reshape(-1, dims).T, self.splits.shape[1]
        depth = np.where(2.0**depth <= trees, 0, depth)
        if self.whole:
            depth = np.where([label in self.whole for label in labels], 0, depth)
        deep = np.flatnonzero(depth > 0)
        places, numbers = [], []
        for t in range(trees):
            at = deep if t else np.arange(len(rows))
            node = np.zeros(len(at), np.int64)
            for level in range(levels + 1):
                split = np.full(len(at), np.inf)
                if level < levels:
                    split[:] = self.splits[t, node] if (2 << level) - 1 <= nodes else self.medians[t, level]
                ends = (depth[at] <= level) | np.isinf(split)
                places.append(at[ends])
                numbers.append((t << _TREE_BITS) + node[ends])
                at, node, split = at[~ends], node[~ends], split[~ends]
                if not len(at):
                    break
                off = along[at, t * levels + level] - split
                low, high = off <= self.margin, off >= -self.margin
                at, node = np.concatenate([at[low], at[high]]), np.concatenate([2 * node[low] + 1, 2 * node[high] + 2])
        at, number = np.concatenate(places), np.concatenate(numbers)
        order = np.lexsort((number, at))
        return at[order], number[order]


def _pairs(codes: np.ndarray) -> int:
    """Ordered pairs of different rows of one label."""
    n = np.unique(codes, return_counts=True)[1] if len(codes) else np.zeros(0, np.int64)
    return int((n * (n - 1)).sum())


def _pays(splits: list, margin: float) -> bool:
    """Whether nodes are worth splitting, given each one's (places along the direction, split, labels); too few rows tell nothing."""
    own = sum(_pairs(codes) for _, _, codes in splits)
    both = sum(_pairs(codes[along <= split + margin]) + _pairs(codes[along >= split - margin]) for along, split, codes in splits)
    return sum(len(codes) for _, _, codes in splits) < OWN_MEAN or both <= PAYS * own


def fit_forest(sample: np.ndarray, levels: int, threshold: float, trees: int = TREES, spill: float = SPILL, seed: int = 7, labels: list | None = None, depths: np.ndarray | None = None) -> Forest:
    """A forest of so many levels; nodes have medians of their own as far as the sample has some four rows for each.

    margin is spill standard deviations of what two vectors at the threshold differ by along a random
    direction. labels: the sample's, one for all if none are given; depths: of its rows, all levels if none are given.
    """
    dims = sample.shape[1]
    labels = [""] * len(sample) if labels is None else labels
    depths = np.full(len(sample), levels) if depths is None else depths
    names, codes, sizes = np.unique(np.array(labels), return_inverse=True, return_counts=True) if len(sample) else (np.zeros(0, str), np.zeros(0, np.int64), np.zeros(0, np.int64))
    own = [k for k in range(len(names)) if sizes[k] >= OWN_MEAN]
    means = {str(names[k]): sample[codes == k].mean(0) for k in own} | {None: sample.mean(0) if len(sample) else np.zeros(dims)}
    fitted = int(max(0, min(levels, np.log2(max(1, len(sample) / 4)))))
    draw = np.random.default_rng(seed).standard_normal((trees, levels, dims))
    directions = draw / np.maximum(np.linalg.norm(draw, axis=2, keepdims=True), 1e-300)
    margin = spill * float(np.sqrt(2 - 2 * threshold) / np.sqrt(dims))
    forest = Forest(directions, np.zeros((trees, max(1, 2**fitted - 1))), np.zeros((trees, levels)), margin, means)
    if not len(sample) or not levels:
        return forest
    every = (forest.centred(sample, labels) @ directions.reshape(-1, dims).T).reshape(len(sample), trees, levels)
    forest.medians[:] = np.median(every, axis=0)
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for level in range(fitted):
            halves = {node: (along := every[rows, t, level], float(np.median(along)) if len(rows) else 0.0, codes[rows]) for node, rows in members.items()}
            pays = _pays([h for h in halves.values() if len(h[2]) < OWN_MEAN], margin)  # nodes of few rows are judged together
            below = {}
            for node, rows in members.items():
                along, split, _ = halves[node]
                if not (_pays([halves[node]], margin) if len(rows) >= OWN_MEAN else pays):
                    forest.splits[t, node] = np.inf
                    continue
                forest.splits[t, node] = split
                below[2 * node + 1], below[2 * node + 2] = rows[along <= split], rows[along > split]
            members = below
        for level in range(fitted, levels):
            if not _pays([(every[:, t, level], forest.medians[t, level], codes)], margin):
                forest.medians[t, level:] = np.inf
                break
    # what a label's trees compare of its pairs, by the sample
    at, number = forest.leaves(sample, depths, labels)
    whole = set()
    for k in own:
        compared = np.unique(number[codes[at] == k], return_counts=True)[1]
        if (compared * (compared - 1)).sum() >= sizes[k] * (sizes[k] - 1):
            whole.add(str(names[k]))
    forest.whole = frozenset(whole)
    return forest


@lean
def compare_leaves(batches, threshold: float, dtype: str, forests: dict[int, Forest]):
    """For rows (label, leaf, i, j, block, set_key, copies, depth, raw) sorted by the first four: exact links of each run
    that are not found in a leaf numbered below, which is seen by routing the run's vectors again."""
    for (label, leaf, i, j), rows in runs(batches, 4):
        block, keys, copies, depth, raw = (rows.column(c).to_pylist() for c in range(4, 9))
        if len(keys) < 2:
            continue
        vectors = unit(np.frombuffer(b"".join(raw), dtype).reshape(len(keys), -1).astype(np.float64))
        block, weights = np.array(block), np.array(copies)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            continue
        linked = vectors[left] @ vectors[right].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        owner, number = forests[len(raw[0])].leaves(vectors, np.array(depth), [label] * len(keys))
        owner, number = owner[number < leaf], number[number < leaf]
        column = np.unique(number, return_inverse=True)[1]
        shared = np.zeros((len(keys), int(column.max()) + 1 if len(column) else 1), np.float32)
        shared[owner, column] = 1
        linked &= shared[left] @ shared[right].T == 0
        counts = np.zeros(len(keys), np.int64)
        counts[left] += linked @ weights[right]
        if i != j:
            counts[right] += weights[left] @ linked
        x, y = np.nonzero(linked)
        roots = roots_of(len(keys), zip(left[x].tolist(), right[y].tolist(), strict=True))
        yield batch_of([(keys[k], keys[roots[k]], int(counts[k])) for k in np.flatnonzero(counts)], LINKS)


def forest_links(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per row of table: vec_id, n_links, component_id, kept.

    Vectors of one label link at a cosine of threshold or more. Null labels, null or empty vectors, zero
    vectors and such with null or non-finite components link with nothing; vectors of different lengths
    never link. component_id is the least vec_id reachable by links, kept says that it is the row's own;
    null ids are never a component's id while it has another. Repeated rows link with each other. The
    forest is fitted on at most about SAMPLE_ROWS classes; every vector is routed. Pairs that no tree keeps
    together are missed: at the threshold about 1 in 10^5 among 20,000 vectors of a label, 1 in 100 among 10^10.
    """
    spark = table.sparkSession
    dtype = "f4" if table.schema[vector_col].dataType.elementType == T.FloatType() else "f8"
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if dtype == "f4" else "array<double>").alias("v"))

    @lean
    def classed(batches):
        for b in batches:
            keys, labels, raws = [], [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                key = raw = named = None
                if label is not None and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(x).all() and x.any():
                        named, raw = f"{len(x)}:{label}", x.astype(dtype).tobytes()
                        key = xxhash.xxh3_128_digest(named.encode() + b"\0" + unit(x.astype(np.float64)[None])[0].tobytes())
                keys.append(key)
                labels.append(named)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(labels, pa.string()), pa.array(raws, pa.binary())], schema=arrow_schema(_CLASSES))

    rows = written(vectors.mapInArrow(classed, _CLASSES))
    classes = written(rows.filter("set_key IS NOT NULL").groupBy("set_key", "label").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    per_label = written(classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("size")).withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / float(leaf)))).cast("int")))
    forests = _forests(classes, per_label, threshold, trees, dtype)

    @lean
    def routed(batches, with_vectors: bool):
        for b in batches:
            dims = [len(x) for x in b.column(3).to_pylist()]
            for size in sorted(set(dims)):
                own = [k for k, d in enumerate(dims) if d == size]
                for c in range(0, len(own), 2000):
                    some = own[c : c + 2000]
                    part = b.take(pa.array(some))
                    x = unit(np.frombuffer(b"".join(part.column(3).to_pylist()), dtype).reshape(len(some), -1).astype(np.float64))
                    at, number = forests[size].leaves(x, np.array(part.column(4).to_pylist()), part.column(1).to_pylist())
                    places = pa.array(at)
                    raws = part.column(3).take(places) if with_vectors else pa.nulls(len(at), pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(1).take(places), pa.array(number), part.column(0).take(places), part.column(2).take(places), part.column(4).take(places), raws], schema=arrow_schema(_LEAVES))

    slim = classes.join(if_small(per_label, broadcast_rows), "label").select("set_key", "label", "copies", "raw", "depth")
    large = slim.mapInArrow(lambda x: routed(x, False), _LEAVES).groupBy("label", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    blocks = if_small(written(large.select("label", "leaf", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))), broadcast_rows)
    placed = slim.mapInArrow(lambda x: routed(x, True), _LEAVES).join(blocks, ["label", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_key", "copies", "depth", "raw")
    dealt = dealt.repartition(shuffle_partitions(spark), "label", "leaf", "i", "j").sortWithinPartitions("label", "leaf", "i", "j")
    links = written(dealt.mapInArrow(lambda x: compare_leaves(x, threshold, dtype, forests), LINKS))
    joined = connected_components(links.select(F.col("set_key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("set_key"), "component")
    counts = links.groupBy("set_key").agg(F.sum("n_links").alias("n_links"))
    per_class = classes.select("set_key", "rep_id", "copies").join(counts, "set_key", "left").join(joined, "set_key", "left")
    per_class = written(per_class.withColumn("component", F.coalesce("component", "set_key")))
    final = with_totals(per_class, "component", F.min("rep_id").alias("component_id")).select("set_key", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "set_key").join(final, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _forests(classes: DataFrame, per_label: DataFrame, threshold: float, trees: int, dtype: str) -> dict[int, Forest]:
    """A forest for each length of vectors (in bytes), deep enough for its most frequent label, fitted on about SAMPLE_ROWS."""
    size = F.length("raw")
    out = {}
    for row in per_label.groupBy("size").agg(F.max("depth").alias("levels"), F.sum("n").alias("n")).collect():  # a row for each length
        share = min(1.0, SAMPLE_ROWS / row["n"])
        unit_hash = F.pmod(F.xxhash64("set_key"), F.lit(1 << 30)) / float(1 << 30)
        found = classes.filter((size == row["size"]) & (unit_hash < share)).join(per_label.select("label", "depth"), "label").select("set_key", "label", "raw", "depth").collect() if row["levels"] else []
        found.sort(key=lambda r: bytes(r["set_key"]))
        sample = [r["raw"] for r in found]
        dims = row["size"] // np.dtype(dtype).itemsize
        points = unit(np.frombuffer(b"".join(map(bytes, sample)), dtype).reshape(-1, dims).astype(np.float64)) if sample else np.zeros((0, dims))
        out[row["size"]] = fit_forest(points, row["levels"], threshold, trees, labels=[r["label"] for r in found], depths=np.array([r["depth"] for r in found], np.int64))
    return out
