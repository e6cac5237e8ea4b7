"""Jaccard join on word n-grams with Bayesian candidate pruning.

1. Texts become sets of hashed n-grams; rows with one set are one class, handled once from here on.
2. Each class gets a MinHash signature, cut into bands; classes that share a band are candidates.
3. Candidate pairs of ordinary buckets are compared part by part: a pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold falls below the
   tolerance.
4. A large bucket makes no pairs. Classes of large buckets meet by narrower keys instead: the n-grams of their
   prefixes, rarest first, of which two classes at the threshold always share one. Pages that share a
   template and no more have prefixes of their own words, so they do not meet. N-grams that many prefixes
   hold tie their classes to one of them.
5. What is left forms clusters. A cluster's classes are compared in blocks of BLOCK by BLOCK classes: part by
   part with the same pruning, the rest by exact intersection. Blocks return link counts and spanning links,
   never all pairs.
6. Exact links give each row its class and its number of links.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import LINKS, arrow_schema, batch_of, if_small, lean, roots_of, runs, shuffle_partitions, text_bytes, written
from lumisift.operators.components import connected_components
from lumisift.operators.totals import with_totals

HASHES, BAND, STEP = 128, 4, 16
LARGE_BUCKET = 32
#: N-grams of crowded classes are counted in 2**COUNT_BITS places, which any size of input shares.
COUNT_BITS = 22
#: A block has at most about so many classes and bytes of n-grams.
BLOCK, BLOCK_BYTES = 512, 16 << 20
_MULTIPLIERS = (np.random.default_rng(20).integers(1, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADDS = np.random.default_rng(21).integers(0, 1 << 63, HASHES, dtype=np.uint64)
_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("n_grams", T.LongType())])
_BANDS = T.StructType([T.StructField("band", T.LongType()), T.StructField("set_key", T.BinaryType())])
_GRAMS = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("grams", T.BinaryType())])
_COUNTS = T.StructType([T.StructField("place", T.LongType()), T.StructField("n", T.LongType())])
_PREFIXES = T.StructType([T.StructField("gram", T.LongType()), T.StructField("probe", T.BooleanType()), T.StructField("set_key", T.BinaryType()), T.StructField("n_grams", T.LongType())])
_PAIRS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("large", T.BooleanType())])


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def ngram_set(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of white-space-parted, lower-cased words.

    A text of fewer than n words has one n-gram, all its words; one without words has none.
    """
    words = text.decode("utf-8", "replace").lower().encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def signature(grams: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, 32 bits each."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for k in range(0, len(grams), 1024):
        out = np.minimum(out, ((grams[k : k + 1024, None] * _MULTIPLIERS + _ADDS) >> np.uint64(32)).min(0))
    return out.astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, bands) 64-bit keys, different for each band's place."""
    parts = signatures.reshape(len(signatures), -1, BAND).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for k in range(BAND):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches needed): fewer make P(similarity >= threshold) fall below the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail
    at t is the probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Places of the signature pairs that no comparison step drops."""
    alive = np.arange(len(a))
    matches, done = np.zeros(len(a), np.int64), 0
    for n, least in needed:
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
        alive, done = alive[matches[alive] >= least], n
    return alive


def may_link(left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which of all pairs of two lists of signatures no comparison step drops."""
    matches, alive, done = np.zeros((len(left), len(right)), np.int16), np.ones((len(left), len(right)), bool), 0
    for n, least in needed:
        for k in range(done, n):
            matches += left[:, k, None] == right[None, :, k]
        alive &= matches >= least
        done = n
        if not alive.any():
            break
    return alive


@lean
def bucket_pairs(batches):
    """All pairs of each run of equal bands of at most LARGE_BUCKET rows; the rows of longer runs with their first row, as large."""
    band, members, large = None, [], False

    def pairs():
        return [] if large else [(x, y, False) for i, x in enumerate(members) for y in members[:i] if x != y]

    for b in batches:
        h = b.column(0).to_numpy(zero_copy_only=False)
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        near = np.flatnonzero(np.concatenate([[True], same]) | np.concatenate([same, [True]]))
        found = []
        for this, key in zip(h[near].tolist(), b.column(1).take(pa.array(near)).to_pylist(), strict=True):
            if this != band:
                found += pairs()
                band, members, large = this, [], False
            if large:
                found.append((key, members[0], True))
            else:
                members.append(key)
                if len(members) > LARGE_BUCKET:
                    large = True
                    found += [(x, members[0], True) for x in members[1:]]
        yield batch_of(found, _PAIRS)
    yield batch_of(pairs(), _PAIRS)


def places(grams: np.ndarray) -> np.ndarray:
    """Where n-grams are counted: their highest bits."""
    return (grams >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def prefixes(grams: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """The n-grams by which a set looks for others of its size or smaller, rarest first, and how many of them it is found by.

    counts gives each place's count; ties go by hash, so all sets have one order. Of sets x and y, x no smaller,
    similarity t means an intersection of at least t|x| and of at least 2t/(1 + t)|y|. If a is the larger bound,
    the first |x| - a + 1 of x and the first |y| - a + 1 of y share an n-gram.
    """
    order = np.lexsort((grams, counts[places(grams)]))
    looked, found = (len(grams) - int(np.ceil(part * len(grams) - 1e-6)) + 1 for part in (threshold, 2 * threshold / (1 + threshold)))
    return grams[order[: min(looked, len(grams))]], min(found, len(grams))


def prefix_pairs(threshold: float):
    """A task for rows (gram, probe, set_key, n_grams) sorted by the first two, so those by which a set is found come first."""

    @lean
    def task(batches):
        gram, members, large = None, [], False

        def pairs():
            if large:
                return []
            # a pair found both ways round comes twice, as it does from several n-grams
            return [(x, y, False) for x, _, n in members for y, probe, m in members if not probe and x != y and threshold * n - 1e-6 <= m <= n]

        for b in batches:
            g = b.column(0).to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            same = g[1:] == g[:-1]
            near = np.flatnonzero(np.concatenate([[True], same]) | np.concatenate([same, [True]]))
            found = []
            for this, probe, key, n in zip(g[near].tolist(), *(b.column(c).take(pa.array(near)).to_pylist() for c in (1, 2, 3)), strict=True):
                if this != gram:
                    found += pairs()
                    gram, members, large = this, [], False
                if large:
                    found.append((key, members[0][0], True))
                elif members or not probe:  # a run that begins with a probe holds no set to be found
                    members.append((key, probe, n))
                    if len(members) > LARGE_BUCKET:
                        large = True
                        found += [(x, members[0][0], True) for x, _, _ in members[1:]]
            yield batch_of(found, _PAIRS)
        yield batch_of(pairs(), _PAIRS)

    return task


@lean
def count_places(batches):
    """How often the n-grams of a task's sets have each place: one row for each place they have."""
    counts = None
    for b in batches:
        grams = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
        counts = np.zeros(1 << COUNT_BITS, np.int64) if counts is None else counts
        counts += np.bincount(places(grams), minlength=1 << COUNT_BITS)
    if counts is not None:
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(counts[at[k : k + (1 << 16)]])], schema=arrow_schema(_COUNTS))


def prefix_matches(grams: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, large) for the sets of a written table (set_key, grams): pairs that share an n-gram of their prefixes, and ties.

    The order of n-grams comes from counts over all rows in 2**COUNT_BITS places. Any order gives all pairs; a rarer
    first order gives few others. Only places of more than LARGE_BUCKET n-grams are told apart, as no others make large keys.
    """
    spark = grams.sparkSession
    counted = grams.select("grams").mapInArrow(count_places, _COUNTS).groupBy("place").agg(F.sum("n").alias("n")).filter(F.col("n") > LARGE_BUCKET)
    frequent = counted.toArrow()  # 2**COUNT_BITS rows at most, whatever the input
    shared = spark.sparkContext.broadcast((frequent.column(0).to_numpy().astype(np.uint32), np.minimum(frequent.column(1).to_numpy(), 0xFFFFFFFF).astype(np.uint32)))

    @lean
    def prefix_rows(batches):
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        at, n = shared.value
        counts[at] = n
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                chosen = [prefixes(x, counts, threshold) for x in sets]
                sizes = [len(c) for c, _ in chosen]
                if not sum(sizes):
                    continue
                row = np.repeat(np.arange(len(sets)), sizes)
                probe = np.concatenate([np.arange(len(c)) >= found for c, found in chosen])
                lengths = np.repeat(np.array([len(x) for x in sets], np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c for c, _ in chosen]).view(np.int64)), pa.array(probe), part.column(0).take(pa.array(row)), pa.array(lengths)], schema=arrow_schema(_PREFIXES))

    keyed = grams.select("set_key", "grams").mapInArrow(prefix_rows, _PREFIXES)
    return keyed.repartition(shuffle_partitions(spark), "gram").sortWithinPartitions("gram", "probe").mapInArrow(prefix_pairs(threshold), _PAIRS)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of 0/1 matrices over the values both sides hold."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left])
    sides, out = [], np.zeros((len(left), len(right)), np.float32)
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, owner in sides:
        at = np.searchsorted(shared, values)
        hit = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        placed.append((at[hit][order], owner[hit][order]))
    for k in range(0, len(shared), 4096):
        m = []
        for (at, owner), n in zip(placed, out.shape, strict=True):
            i, j = np.searchsorted(at, [k, k + 4096])
            dense = np.zeros((n, min(4096, len(shared) - k)), np.float32)
            dense[owner[i:j], at[i:j] - k] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


@lean
def verify_blocks(batches, threshold: float, needed: list[tuple[int, int]]):
    """For rows (cluster, i, j, block, set_key, copies, grams, signature) sorted by the first three: exact links within each run."""
    for (_, i, j), rows in runs(batches, 3):
        first = {}
        for block, key, copies, grams, signed in zip(*(rows.column(c).to_pylist() for c in range(3, 8)), strict=True):
            first.setdefault(key, (block, copies, np.frombuffer(grams, np.uint64), np.frombuffer(signed, np.uint32)))
        left = [k for k, v in first.items() if v[0] == i]
        right = left if i == j else [k for k, v in first.items() if v[0] == j]
        if not left or not right:
            continue
        alive = may_link(*(np.stack([first[k][3] for k in side]) for side in (left, right)), needed)
        if i == j:
            np.fill_diagonal(alive, False)
        some, others = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(some):
            continue
        left, right = [left[k] for k in some], [right[k] for k in others]
        both = overlaps([first[k][2] for k in left], [first[k][2] for k in right])
        sizes = [np.array([len(first[k][2]) for k in side]) for side in (left, right)]
        union = sizes[0][:, None] + sizes[1][None, :] - both
        linked = (both >= threshold * union - 1e-9) & alive[np.ix_(some, others)]
        copies = [np.array([first[k][1] for k in side]) for side in (left, right)]
        counts = dict(zip(left, (linked @ copies[1]).tolist(), strict=True))
        if i != j:
            counts |= dict(zip(right, (copies[0] @ linked).tolist(), strict=True))
        place = {k: n for n, k in enumerate(dict.fromkeys([*left, *right]))}
        all_keys = list(place)
        x, y = np.nonzero(linked)
        roots = roots_of(len(all_keys), ((place[left[p]], place[right[q]]) for p, q in zip(x.tolist(), y.tolist(), strict=True)))
        yield batch_of([(k, all_keys[r], counts[k]) for k, r in zip(all_keys, roots, strict=True) if counts.get(k)], LINKS)


def linked_classes(docs: DataFrame, n: int, threshold: float, tolerance: float, id_col: str, text_col: str, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, set_key, signature) of docs, and (set_key, rep, copies, n_links, component) of each set.

    rep is the least (missing, doc_id, text_hash) of a set's rows, missing saying that the id is null.
    """
    spark = docs.sparkSession
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    @lean
    def sets(batches):
        hashes = WordHashes()
        for b in batches:
            keys, signatures, sizes = [], [], []
            for text in text_bytes(b, "text"):
                grams = ngram_set(text, n, hashes)
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                signatures.append(signature(grams).tobytes() if len(grams) else None)
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int64())], schema=arrow_schema(_SETS))

    @lean
    def bands(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, HASHES))
            keys = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), found.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), keys], schema=arrow_schema(_BANDS))

    needed = least_matches(threshold, tolerance)

    @lean
    def prune(batches):
        for b in batches:
            if not b.num_rows:
                continue
            a, z = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in (2, 3))
            alive = pa.array(survivors(a, z, needed))
            yield pa.RecordBatch.from_arrays([b.column(0).take(alive), b.column(1).take(alive)], names=["a", "b"])

    rows = written(rows_in.mapInArrow(sets, _SETS))
    classes = written(rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("n_grams").alias("n_grams")))
    banded = classes.select("set_key", "signature").mapInArrow(bands, _BANDS)
    found = written(banded.repartition(shuffle_partitions(spark), "band").sortWithinPartitions("band").mapInArrow(bucket_pairs, _PAIRS))

    @lean
    def regram(batches, signed=False):
        """Appends the n-grams to rows (set_key, ..., text), and their signature if asked for, and leaves out those of another text of the id and hash."""
        hashes = WordHashes()
        for b in batches:
            grams = [ngram_set(t, n, hashes) for t in text_bytes(b, "text")]
            good = [i for i, (g, key) in enumerate(zip(grams, b.column(0).to_pylist(), strict=True)) if xxhash.xxh3_128_digest(g.tobytes()) == key]
            kept = b.take(pa.array(good, pa.int64()))
            columns = {"grams": [grams[i].tobytes() for i in good]} | ({"signature": [signature(grams[i]).tobytes() for i in good]} if signed else {})
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *(pa.array(c, pa.binary()) for c in columns.values())], names=[*b.schema.names[:-1], *columns])

    def with_grams(members: DataFrame, *columns: str, signed: bool = False) -> DataFrame:
        """Rows (set_key, *columns, grams) of a written table that has rep_id and rep_hash too; with their signature if asked for,
        made in the same task: a second step in Python would take a second worker for each task."""
        texts = rows_in.join(if_small(members, broadcast_rows), rows_in["doc_id"].eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
        chosen = members.select("set_key", *columns)
        schema = T.StructType([*chosen.schema.fields, _GRAMS["grams"], *([_SETS["signature"]] if signed else [])])
        return texts.select(*chosen.columns, "text").mapInArrow(lambda batches: regram(batches, signed), schema)

    reps = [F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")]
    crowded = found.filter("large").select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    crowded = written(crowded.join(classes, "set_key").select("set_key", *reps))
    ties = found.filter("large").select("a", "b").limit(0)
    found = found.filter("NOT large").select("a", "b")
    if not crowded.isEmpty():
        # a rep's id and text may stand in several rows
        matched = written(prefix_matches(written(with_grams(crowded).dropDuplicates(["set_key"])), threshold))
        found = found.union(matched.filter("NOT large").select("a", "b"))
        ties = matched.filter("large").select("a", "b").distinct()
    signatures = classes.select("set_key", "signature")
    pairs = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(signatures.select(F.col("set_key").alias(side), F.col("signature").alias(f"s{side}")), side)
    close = pairs.select("a", "b", "sa", "sb").mapInArrow(prune, "a binary, b binary")
    candidates = connected_components(close.union(ties))
    clustered = written(candidates.select(F.col("node").alias("set_key"), F.col("component").alias("cluster")))
    placed = written(clustered.join(classes.select("set_key", "rep", "copies", "n_grams"), "set_key"))
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n_grams") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("blocks")
    members = written(with_totals(placed, "cluster", blocks).select("set_key", "cluster", "blocks", "copies", *reps))
    grams = with_grams(members, "cluster", "blocks", "copies", signed=True)
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    dealt = grams.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_key", "copies", "grams", "signature")
    dealt = dealt.repartition(shuffle_partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = written(dealt.mapInArrow(lambda batches: verify_blocks(batches, threshold, needed), LINKS))
    joined = connected_components(links.select(F.col("set_key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("set_key"), "component")
    linked = links.groupBy("set_key").agg(F.sum("n_links").alias("n_links"))
    per_class = classes.select("set_key", "rep", "copies").join(linked, "set_key", "left").join(joined, "set_key", "left")
    return rows, written(per_class.withColumn("component", F.coalesce("component", "set_key")))


def ngram_links(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, kept.

    Rows link if the Jaccard similarity of their n-gram sets is at least threshold; n_links counts the
    other rows linked directly. class_id is the least doc_id reachable by links, itself included; kept
    says that it is the row's own (so of repeated rows of one id all are; drop_near_duplicates decides row by row). Rows without
    words link with nothing. Null ids: such rows count as links, are never a class's id while it has
    another, and are kept if it has none.
    """
    rows, per_class = linked_classes(docs, n, threshold, tolerance, id_col, text_col, broadcast_rows)
    final = with_totals(per_class, "component", F.min("rep.doc_id").alias("class_id")).select("set_key", "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "set_key").join(final, "set_key", "left")
    class_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """docs with one row of each class of ngram_links: that of the least id (null last), then of the least hash of its text.

    Rows alike in id and text count one by one too: of those that are their class's first, the least by all
    columns stays. Rows without words all stay. Columns must have an order.
    """
    rows, per_class = linked_classes(docs, n, threshold, tolerance, id_col, text_col, min(broadcast_rows, 200_000))
    first = with_totals(per_class, "component", F.min("rep").alias("first")).select("set_key", "first")
    keys = rows.filter("set_key IS NOT NULL").groupBy("doc_id", "text_hash", "set_key").agg(F.count("*").alias("rows")).join(first, "set_key")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    key = [F.col("doc_id").alias("id__"), F.col("text_hash").alias("hash__")]
    gone = written(keys.filter(~stays | (F.col("rows") > 1)).select(*key, stays.alias("stays__")))

    def same_row(table: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(table["id__"]) & (F.xxhash64(docs[text_col]) == table["hash__"])

    left = docs.join(table := if_small(gone, broadcast_rows), same_row(table), "left_anti")
    repeated = gone.filter("stays__")
    if repeated.isEmpty():
        return left
    some = docs.join(table := if_small(repeated, broadcast_rows), same_row(table)).groupBy("id__", "hash__").agg(F.min(F.struct(*docs.columns)).alias("row__"))
    return left.unionByName(some.select("row__.*"))
