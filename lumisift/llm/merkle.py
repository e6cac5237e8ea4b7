"""Merkle manifest of a table: a tree of digests for each group of rows, a tree over the groups' roots, and proofs of all rows.

Rows become leaves, and every ARITY consecutive nodes of a level (fewer at its end) become their hash, until one is left.

1. Leaves are ordered by group and id in range partitions and packed, up to CHUNK of one group at a time. A chunk is a
   leaf partition: no other leaf is looked at where it is worked on.
2. A chunk hashes what is complete inside it. Nodes whose siblings lie in other chunks stay open; open nodes of neighbouring
   partitions are joined FAN partitions at a time, then FAN times FAN, so that no task gets more than a few for each partition.
3. Octopus multiproof: a chunk works out the least set of node coordinates that its leaves' proofs need and that its own
   leaves don't give, two at each end of each level at most. They are fetched in one join for all chunks. With them the
   chunk derives the interior nodes its leaves share, once, and spells out each leaf's proof.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, if_small, lean, runs, shuffle_partitions, written

ARITY, CHUNK, FAN = 3, 2187, 16
_NODE = [T.StructField("level", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("digest", T.BinaryType())]
_NODES = T.StructType([T.StructField("tree", T.StringType()), T.StructField("total", T.LongType()), T.StructField("part", T.IntegerType()), *_NODE, T.StructField("new", T.BooleanType()), T.StructField("open", T.BooleanType()), T.StructField("top", T.BooleanType())])
_WANTED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("tree", T.StringType()), *_NODE[:2]])
_STEPS = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def field(value: Column) -> Column:
    """A value as a leaf has it: '-' if null, else its number of UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def joined_hash(parts: list[bytes]) -> bytes:
    """Hash of digests in lower-case hex, as hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def missing(low: int, high: int, total: int) -> list[tuple[int, int]]:
    """Coordinates (level, idx) that the proofs of leaves low..high-1 need and these leaves don't give, in a tree of so many leaves."""
    out, level = [], 0
    while total > 1:
        begin, end = low // ARITY * ARITY, min(total, ((high - 1) // ARITY + 1) * ARITY)
        out += [(level, k) for k in (*range(begin, low), *range(high, end))]
        low, high, total, level = begin // ARITY, -(-end // ARITY), -(-total // ARITY), level + 1
    return out


def climb(known: dict[int, dict[int, bytes]], total: int) -> tuple[list[tuple[int, int, bytes]], set[tuple[int, int]]]:
    """The nodes that follow from those known (level -> idx -> digest), and the coordinates of known ones or new ones that are in no complete family."""
    new, lone, level = [], set(), 0
    known = {k: dict(v) for k, v in known.items()}
    while True:
        own = known.get(level, {})
        if total == 1:
            return new, lone | {(level, k) for k in own}
        families: dict[int, list[int]] = {}
        for k in sorted(own):
            families.setdefault(k // ARITY, []).append(k)
        for parent, members in families.items():
            if len(members) == min(ARITY, total - parent * ARITY):
                digest = joined_hash([own[k] for k in members])
                known.setdefault(level + 1, {})[parent] = digest
                new.append((level + 1, parent, digest))
            else:
                lone |= {(level, k) for k in members}
        level, total = level + 1, -(-total // ARITY)


def _hexed(raw: bytes) -> list[bytes]:
    text = raw.hex().encode()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def packed(leaves: DataFrame) -> DataFrame:
    """leaves (tree, item, leaf, altered) by tree, item and leaf, in chunks (part, tree, chunk, first, n, items, leaves, altered).

    first counts from the partition's first leaf of the tree. Rows that are alike in all of these columns are dealt
    by chance, which no result shows.
    """
    n = shuffle_partitions(leaves.sparkSession)
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("tree", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("items", T.ArrayType(leaves.schema["item"].dataType)), T.StructField("leaves", T.BinaryType()), T.StructField("altered", T.ArrayType(T.BinaryType())),
    ])
    to = arrow_schema(schema)

    @lean
    def run(batches):
        from pyspark import TaskContext

        part, number, first, held, tree = TaskContext.get().partitionId(), 0, 0, [], None

        def closed():
            rows = list(zip(*held, strict=True))
            values = (part, tree, number, first, len(held), rows[0], b"".join(rows[1]), rows[2])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, to, strict=True)], schema=to)

        for b in batches:
            for this, *row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (this != tree or len(held) == CHUNK):
                    yield closed()
                    number, first, held = number + 1, first + len(held) if this == tree else 0, []
                tree = this
                held.append(row)
        if held:
            yield closed()

    columns = ["tree", "item", "leaf", "altered"]
    dealt = leaves.select(*columns).repartitionByRange(n, "tree", "item", "leaf", F.rand(7))
    return dealt.sortWithinPartitions("tree", "item", "leaf", "altered").mapInArrow(run, schema)


def placed(chunks: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """chunks with at, the place of their first leaf in its tree, and total, the leaves of the tree."""
    counts = chunks.groupBy("tree", "part").agg(F.sum("n").alias("leaves_here"))
    # a tree has one row for each range partition at most
    by_tree = Window.partitionBy("tree")
    before = F.sum("leaves_here").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("leaves_here").over(by_tree).alias("total")))
    return chunks.join(if_small(bases, broadcast_rows), ["tree", "part"]).withColumn("at", F.col("first") + F.col("base")).drop("base", "first")


def tree_nodes(chunks: DataFrame) -> DataFrame:
    """The nodes (tree, level, idx, digest, top) that lie on the edges of chunks, and all above them."""
    to = arrow_schema(_NODES)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(to)], schema=to)

    def climbed(tree, total, part, known, given):
        new, lone = climb(known, total)
        nodes = [(*n, True) for n in new] + [(level, k, digest, False) for level, own in known.items() for k, digest in own.items()]
        height = next(h for h in range(64) if -(-total // ARITY**h) == 1)
        return [(tree, total, part, level, k, digest, fresh, (level, k) in lone, level == height) for level, k, digest, fresh in nodes if given(level, k, (level, k) in lone)]

    @lean
    def inside(batches):
        for b in batches:
            out = []
            for tree, part, total, at, raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                out += climbed(tree, total, part, {0: dict(enumerate(_hexed(raw), at))}, lambda level, k, open: open)
            yield batch(out)

    @lean
    def across(batches):
        for (tree, part), rows in runs(batches, 2):
            known: dict[int, dict[int, bytes]] = {}
            total, level, idx, digest = (rows.column(k).to_pylist() for k in range(2, 6))
            for at, k, d in zip(level, idx, digest, strict=True):
                known.setdefault(at, {})[k] = d
            yield batch(climbed(tree, total[0], part, known, lambda level, k, open: True))

    n = shuffle_partitions(chunks.sparkSession)
    last = written(chunks.select("tree", "part", "total", "at", "leaves").mapInArrow(inside, _NODES))
    found, span = last, 1
    while True:
        wide = F.floor(F.col("part") / span).cast("int")
        dealt = last.filter("open").select("tree", wide.alias("part"), "total", "level", "idx", "digest").repartition(n, "tree", "part").sortWithinPartitions("tree", "part", "level", "idx")
        last = written(dealt.mapInArrow(across, _NODES))
        found = found.union(last.filter("new"))
        if span >= n:
            return found.select("tree", "level", "idx", "digest", "top")
        last, span = last.withColumn("part", F.col("part") * span), min(span * FAN, n)


def fetched(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, chunk, nodes): what each chunk's proofs need of other chunks, a few nodes for each level."""
    to = arrow_schema(_WANTED)

    @lean
    def wanted(batches):
        for b in batches:
            rows = [(part, chunk, tree, *m) for part, chunk, tree, at, n, total in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True) for m in missing(at, at + n, total)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(to)], schema=to)

    want = chunks.select("part", "chunk", "tree", "at", "n", "total").mapInArrow(wanted, _WANTED)
    got = want.join(nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    return got.groupBy("part", "chunk").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("nodes"))


def steps_of(leaves: list[bytes], at: int, total: int, nodes: list[tuple[int, int, bytes]]) -> list[list[tuple[bytes, bytes]]]:
    """For each leaf of a chunk the way to its tree's root: the siblings before and behind it, level by level."""
    given = {(level, k): d for level, k, d in nodes}
    families, own, low, level = [], leaves, at, 0
    while total > 1:
        begin, end = low // ARITY * ARITY, min(total, ((low + len(own) - 1) // ARITY + 1) * ARITY)
        row = [*(given[level, k] for k in range(begin, low)), *own, *(given[level, k] for k in range(low + len(own), end))]
        own = [joined_hash(row[k : k + ARITY]) for k in range(0, len(row), ARITY)]
        families.append([(b"".join(row[k // ARITY * ARITY : k]), b"".join(row[k + 1 : (k // ARITY + 1) * ARITY])) for k in range(len(row))])
        low, total, level = begin // ARITY, -(-total // ARITY), level + 1
    above: list[list[tuple[bytes, bytes]]] = []  # the ways of a level's nodes, from the chunk's first on
    for at_level in range(len(families) - 1, -1, -1):
        first = at // ARITY**at_level % ARITY
        above = [[step, *(above[k // ARITY] if at_level + 1 < len(families) else [])] for k, step in enumerate(families[at_level][first:], first)]
    return above if families else [[] for _ in leaves]


def fold(digest: bytes, steps) -> bytes:
    for before, after in steps:
        digest = joined_hash([before, digest, after])
    return digest


def _expanded(chunks: DataFrame, got: DataFrame, columns: list[str], schema: T.StructType, row_of) -> DataFrame:
    """A row for each leaf, row_of(item, leaf, altered, steps, values of columns)."""
    to = arrow_schema(schema)

    @lean
    def run(batches):
        for b in batches:
            out = []
            for items, raw, altered, at, total, nodes, *more in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                leaves = _hexed(raw)
                steps = steps_of(leaves, at, total, [(x["level"], x["idx"], x["digest"]) for x in nodes or ()])
                out += [row_of(item, leaf, a, s, more) for item, leaf, a, s in zip(items, leaves, altered, steps, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(to)], schema=to)

    return chunks.join(got, ["part", "chunk"], "left").select("items", "leaves", "altered", "at", "total", "nodes", *columns).mapInArrow(run, schema)


def _tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of the leaves, what each fetches, and (tree, digest) of the roots."""
    chunks = placed(written(packed(leaves)))
    nodes = written(tree_nodes(chunks))
    return chunks, fetched(chunks, nodes), nodes.filter("top").select("tree", "digest")


def manifest(table: DataFrame, values: list[str], id_col: str = "doc_id", tree_col: str = "source", changed: tuple[str, Column] | None = None, changed_if: Column | None = None, proofs: bool = False, broadcast_rows: int = 20_000) -> DataFrame:
    """One row per row of table: item (its id), leaf, subroot, root, proof_sha256, folded_root, verified; with proofs also
    proof, an array of (before, after) for each level, siblings joined in hex.

    leaf is the hash of `values`; a tree's leaves ascend by id (nulls first) and leaf, trees by tree_col (null first,
    bytewise). folded_root is what the row's proof makes of its leaf, or of the leaf of the row as it is with `changed`
    (column name, new value) where changed_if holds; verified says that it is the root. Repeated rows are leaves of
    their own. A table without rows has no root and gives no rows; columns not named are not read.
    """
    leaf = leaf_digest(*(F.col(c) for c in values))
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed_if & ~F.col(changed[0]).eqNullSafe(changed[1]), leaf_digest(*(changed[1] if c == changed[0] else F.col(c) for c in values)))
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col)), F.lit(""))  # null before the empty string
    leaves = table.select(tree.alias("tree"), F.col(id_col).cast("long").alias("item"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("altered"))
    leaves = written(leaves)  # range partitions look at their rows twice
    chunks, got, subroots = _tree(leaves)
    roots = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("item"), F.unhex(F.col("digest").cast("string")).alias("leaf"), F.lit(None).cast("binary").alias("altered"))
    over, over_got, top = _tree(roots)
    hexed, text = T.StringType(), lambda x: x.decode()
    root = [bytes(r["digest"]).decode() for r in top.collect()]  # one row
    of_tree = T.StructType([T.StructField("tree", hexed), T.StructField("subroot", hexed), T.StructField("above", _STEPS)])
    ways = _expanded(over, over_got, [], of_tree, lambda item, leaf, altered, steps, more: (item, text(leaf), [{"before": text(a), "after": text(z)} for a, z in steps]))
    schema = T.StructType([T.StructField("item", T.LongType()), *(T.StructField(n, hexed) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType()), *([T.StructField("proof", _STEPS)] if proofs else [])])

    def proved(item, leaf, altered, steps, more):
        steps = [*steps, *((s["before"].encode(), s["after"].encode()) for s in more[1])]
        folded = fold(leaf if altered is None else altered.hex().encode(), steps).decode()
        way = [[{"before": text(a), "after": text(z)} for a, z in steps]] if proofs else []
        return (item, text(leaf), more[0], root[0], hashlib.sha256(b"".join(a + z for a, z in steps)).hexdigest(), folded, folded == root[0], *way)

    return _expanded(chunks.join(if_small(written(ways), broadcast_rows), "tree"), got, ["subroot", "above"], schema, proved)
