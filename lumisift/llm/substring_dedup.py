"""Removal of long byte strings that stand more than once, by merged Burrows-Wheeler transforms.

Every `length`-byte window has a canonical anchor, the least of its k-gram hashes; equal windows have equal
anchors at equal offsets. So windows are dealt by anchor, and only anchors that stand twice matter:

1. An anchor's windows form one stretch of text (a context). Equal contexts of an anchor are repeated
   whole. Only anchors with two or more different contexts go on, each context once.
2. Contexts are cut into shards. A shard's Burrows-Wheeler transform lists, over symbols of up to STEP
   bytes, what stands before each of its windows' suffixes in suffix order. The shards' transforms are
   merged by refining their interleave: the merged order by h symbols, read through the transforms and
   dealt stably by the symbols read, is the order by h + 1. No suffix is sorted again. Neighbours part in
   the round that reads their last difference; those that part in no round have a common prefix of all
   `length` bytes, and runs of them are the repeated intervals.
3. An anchor with more than LARGE contexts is dealt again by narrower ranges of its windows, down to
   single windows, so that no anchor has to fit in one task.

Distinct texts could only be taken for equal by two 64-bit hashes of unrelated bytes agreeing at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, extended, fresh, if_small, lean, shuffle_partitions, text_bytes, written

GRAM, STEP = 64, 40
LARGE = 1000
MERGE_BYTES, SHARD_BYTES = 1 << 20, 1 << 17
_PLACE = (1 << 28) - 1
#: Longer texts are looked at in pieces of so many windows, which overlap so that no window is lost.
PIECE = 1 << 22
_L = T.LongType()
_ANCHORS = T.StructType([T.StructField(n, _L) for n in ("gram", "context", "doc_id", "text_hash")] + [T.StructField(n, T.IntegerType()) for n in ("start", "windows", "anchor")])
_SNIPPETS = T.StructType([T.StructField("gram", _L), T.StructField("context", _L), T.StructField("snippet", T.BinaryType())])
_BYTE_NAMES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling; the last places' grams are cut short."""
    h = _BYTE_NAMES[raw]
    span = 1
    while span < GRAM:
        later = np.zeros_like(h)
        later[:-span] = h[span:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + later
        span *= 2
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    m, span = values, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def find_anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For each anchor of the texts: text number, first window, number of windows, anchor's place, gram hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = gram_hashes(raw)
    placed = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    anchor = (window_minima(placed, length - GRAM + 1)[: len(raw) - length + 1] & np.uint64(_PLACE)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    ends = np.cumsum(sizes)
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= ends[owner])
    if not len(inside):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    a, o = anchor[inside], owner[inside]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (o[1:] != o[:-1])]))
    windows = np.diff(np.append(new, len(inside)))
    base = ends[o[new]] - sizes[o[new]]
    return o[new], inside[new] - base, windows, a[new] - base, h[a[new]]


def _hash64(raw: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=seed) - (1 << 63)


def _groups(texts: list[bytes], at_once: int = 2_000_000):
    """Consecutive texts of together about at_once bytes: (first number, texts)."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= at_once:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def pieces_of(texts: list[bytes], length: int) -> tuple[list[int], list[int], list[bytes]]:
    """The texts, long ones in pieces: text number, first byte and bytes of each piece. Each window lies in one piece."""
    found = [(k, at, t[at : at + PIECE + length - 1]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), PIECE)]
    return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


def anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """A row for each anchor of each piece of each text (columns doc_id, text_hash, text)."""

    @lean
    def run(batches):
        for b in batches:
            whole, begin, texts = pieces_of(text_bytes(b, "text"), length)
            ids, hashes = (b.column(c).take(pa.array(whole, pa.int64())).to_pylist() for c in (0, 1))
            for first, some in _groups(texts):
                owner, start, windows, anchor, gram = find_anchors(some, length)
                own = owner.tolist()
                base = np.array(begin, np.int64)[first + owner]
                context = [_hash64(some[o][s : s + w + length - 1], a - s) for o, s, w, a in zip(own, start.tolist(), windows.tolist(), anchor.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context, pa.int64()), pa.array([ids[first + o] for o in own], pa.int64()), pa.array([hashes[first + o] for o in own], pa.int64()), pa.array(start + base, pa.int32()), pa.array(windows, pa.int32()), pa.array(anchor + base, pa.int32())], schema=arrow_schema(_ANCHORS))

    return docs.mapInArrow(run, _ANCHORS)


def _with_lists(docs: DataFrame, rows: DataFrame, columns: list[str], broadcast_rows: int, how: str) -> DataFrame:
    """docs with `places`: of each text, the given columns of its rows. A list is bounded by its text."""
    lists = rows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*columns)).alias("places"))
    lists = if_small(written(lists.withColumnsRenamed({"doc_id": "doc_id__", "text_hash": "text_hash__"})), broadcast_rows)
    return docs.join(lists, docs["doc_id"].eqNullSafe(F.col("doc_id__")) & (docs["text_hash"] == F.col("text_hash__")), how).drop("doc_id__", "text_hash__")


def narrower(docs: DataFrame, rows: DataFrame, span: int, length: int, broadcast_rows: int) -> DataFrame:
    """The windows of rows, dealt by ranges of `span` windows at equal distances from the anchor, as new anchors.

    All windows of a range hold its core, the bytes from its last start to its first start's end, also
    where the anchor has only part of the range; the core's hash takes the gram's place.
    """

    @lean
    def run(batches):
        for b in batches:
            out = []
            for doc_id, text_hash, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b, "text"), b.column(3).to_pylist(), strict=True):
                for p in places:
                    start, stop, anchor = p["start"], p["start"] + p["windows"], p["anchor"]
                    while start < stop:
                        cell = (start - anchor) // span
                        first = anchor + cell * span
                        end = min(stop, first + span)
                        core = _hash64(text[first + span - 1 : first + length], cell & 0xFFFFFFFF)
                        out.append((core, _hash64(text[start : end + length - 1], start - first), doc_id, text_hash, start, end - start, first))
                        start = end
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow_schema(_ANCHORS))], schema=arrow_schema(_ANCHORS))

    found = _with_lists(docs, rows, ["start", "windows", "anchor"], broadcast_rows, "inner")
    return found.select("doc_id", "text_hash", "text", "places").mapInArrow(run, _ANCHORS)


def snippets_of(docs: DataFrame, rows: DataFrame, length: int, broadcast_rows: int) -> DataFrame:
    """The text under each context of rows (gram, context, doc_id, text_hash, start, windows), one place each."""

    @lean
    def run(batches):
        for b in batches:
            out = {}
            for text, places in zip(text_bytes(b, "text"), b.column(1).to_pylist(), strict=True):
                out |= {(p["gram"], p["context"]): text[p["start"] : p["start"] + p["windows"] + length - 1] for p in places}
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(out.values(), pa.binary())], schema=arrow_schema(_SNIPPETS))

    found = _with_lists(docs, rows, ["gram", "context", "start", "windows"], broadcast_rows, "inner")
    return found.select("text", "places").mapInArrow(run, _SNIPPETS)


def _radix(values: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers below 2**32; 16 bits a pass, which numpy sorts by counting."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def symbol_size(length: int) -> int:
    """Bytes of a symbol: the largest multiple of 8 up to STEP that divides the length."""
    return max(k for k in range(8, STEP + 1, 8) if length % k == 0)


def symbols_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the joined texts the rank of the `size` bytes from there among all such, and the texts' starts.

    Ranks of 8 bytes are joined to ranks of 16, and so on; the last pair may overlap. What reaches over a
    text's end is never looked at.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    wide = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        wide = (wide << np.uint64(8)) | raw[k : len(raw) - 8 + k]
    rank, have = np.unique(wide, return_inverse=True)[1].astype(np.uint64), 8
    while have < size:
        more = min(have, size - have)
        later = np.zeros_like(rank)
        later[:-more] = rank[more:]
        rank = np.unique((rank << np.uint64(32)) | later, return_inverse=True)[1].astype(np.uint64)
        have += more
    return rank.astype(np.int64), np.cumsum(lengths) - lengths


def shard_transform(symbols: np.ndarray, starts: np.ndarray, size: int, rounds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The shard's transform, layer by layer, and the starts of its windows in order.

    Layer t lists, in the order of their first t symbols, the windows' suffixes of t symbols by the symbol
    before each; dealing them stably by it gives the order of the next layer.
    """
    rows, layers = starts + size * rounds, []
    for _ in range(rounds):
        rows = rows - size
        layers.append(symbols[rows])
        order = _radix(layers[-1])
        rows = rows[order]
    return layers, rows


def merge_transforms(shards: list[list[np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards: for each merged row its shard, and its block; rows of one block have all symbols in common.

    Each round reads the shards' transforms in the present interleave and deals its rows by the symbols
    read. A shard's rows keep their own order, so the interleave alone says whose row comes next, and no
    suffix is compared or sorted again.
    """
    sizes = [len(layers[0]) if layers else 0 for layers in shards]
    n = sum(sizes)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    block = np.zeros(n, np.int64)
    for depth in range(rounds):
        row = np.empty(n, np.int64)
        row[np.argsort(shard, kind="stable")] = np.arange(n)
        read = np.concatenate([layers[depth] for layers in shards])[row]
        order = _radix(read)
        shard, read, before = shard[order], read[order], block[order]
        parted = (read[1:] != read[:-1]) | (before[1:] != before[:-1])
        block = np.concatenate([[0], np.cumsum(parted)])[:n]
    return shard, block


def repeated_windows(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text the ranges [first, last) of starts of length-byte windows that stand more than once in the texts."""
    size = symbol_size(length)
    rounds = length // size
    symbols, base = symbols_of(texts, size)
    windows = np.maximum(np.array([len(t) for t in texts], np.int64) - length + 1, 0)
    shard_of = base // SHARD_BYTES
    owner = np.repeat(np.arange(len(texts)), windows)
    starts = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    cuts = np.flatnonzero(np.diff(shard_of[owner], prepend=-1, append=-1))
    built = [shard_transform(symbols, starts[a:z], size, rounds) for a, z in zip(cuts, cuts[1:], strict=False)]
    found = np.zeros(len(symbols), bool)
    if built:
        shard, block = merge_transforms([layers for layers, _ in built], rounds)
        row = np.empty(len(shard), np.int64)
        row[np.argsort(shard, kind="stable")] = np.arange(len(shard))
        place = np.concatenate([p for _, p in built])[row]
        found[place] = np.bincount(block)[block] >= 2
    out = []
    for first, n in zip(base.tolist(), windows.tolist(), strict=True):
        edges = np.flatnonzero(np.diff(found[first : first + n].astype(np.int8), prepend=0, append=0))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def merged_ranges(snippets: DataFrame, length: int) -> DataFrame:
    """Ranges (gram, context, first, last) of repeated windows, counted from each context's first window."""
    schema = T.StructType([*_SNIPPETS.fields[:2], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    @lean
    def run(batches):
        keys, texts, size = [], [], 0

        def merged():
            found = [(*k, a, z) for k, ranges in zip(keys, repeated_windows(texts, length) if texts else [], strict=True) for a, z in ranges]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(arrow_schema(schema))], schema=arrow_schema(schema))

        for b in batches:
            for gram, context, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if size >= MERGE_BYTES and gram != keys[-1][0]:
                    yield merged()
                    keys, texts, size = [], [], 0
                keys.append((gram, context))
                texts.append(text)
                size += len(text)
        yield merged()

    dealt = snippets.repartition(shuffle_partitions(snippets.sparkSession), "gram").sortWithinPartitions("gram", "context")
    return dealt.mapInArrow(run, schema)


def repeated_stretches(docs: DataFrame, length: int, large: int = LARGE, broadcast_rows: int = 10_000) -> DataFrame:
    """(doc_id, text_hash, start, stop) for stretches of texts all covered by repeated windows; they may overlap."""
    rows, parts = written(anchors_of(docs, length)), []
    for span in (None, 16, 1):
        # written, so that the join has plain shuffles on both sides and a gram that very many windows share can be split
        twice = written(rows.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
        kept = written(rows.join(twice, "gram"))
        contexts = written(kept.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "start", "windows")).alias("place")))
        whole = contexts.filter("n > 1").select("gram", "context")
        parts.append(kept.join(whole, ["gram", "context"]).select("doc_id", "text_hash", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop")))
        grams = written(contexts.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1"))
        chosen = contexts.join(grams.filter(F.col("contexts") <= large).select("gram"), "gram").select("gram", "context", "place.*")
        ranges = written(merged_ranges(snippets_of(docs, chosen, length, broadcast_rows), length))
        parts.append(kept.join(ranges, ["gram", "context"]).select("doc_id", "text_hash", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + (length - 1)).alias("stop")))
        hot = grams.filter(F.col("contexts") > large).select("gram")
        if span == 1 or hot.isEmpty():
            break
        rows = written(narrower(docs, kept.join(hot, "gram"), 16 if span is None else 1, length, broadcast_rows))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def drop_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, broadcast_rows: int = 10_000) -> DataFrame:
    """docs with column kept_bytes (the text's remaining bytes), n_bytes, n_removed and n_spans.

    A byte goes if any `length`-byte string that covers it starts at another place too, of its own or
    another row's text. Null texts are empty. Repeated rows are texts like others, so from length bytes on
    nothing of them is left. length is a multiple of 8 and at least GRAM. New columns whose names are
    taken get leading underscores.
    """
    if length % 8 or length < GRAM:
        raise ValueError(f"length must be a multiple of 8, at least {GRAM}")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    stretches = written(repeated_stretches(keyed, length, large, broadcast_rows).distinct())
    source = docs.withColumns({"doc_id__": F.col(id_col).cast("long"), "text_hash__": F.xxhash64(F.coalesce(text_col, F.lit("")))})
    lists = if_small(written(stretches.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("places__"))), broadcast_rows)
    joined = source.join(lists, F.col("doc_id__").eqNullSafe(lists["doc_id"]) & (F.col("text_hash__") == lists["text_hash"]), "left").select(*(source[c] for c in docs.columns), "places__")
    schema = extended(docs, T.StructType([T.StructField(fresh(docs, "kept_bytes"), T.BinaryType()), *(T.StructField(fresh(docs, n), _L) for n in ("n_bytes", "n_removed", "n_spans"))]))
    to, at = arrow_schema(schema), docs.columns.index(text_col)

    @lean
    def cut(batches):
        for b in batches:
            kept, counts = [], []
            for text, places in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                text, parts, done, spans, removed = text or b"", [], 0, 0, 0
                for start, stop in sorted((p["start"], p["stop"]) for p in places or ()):
                    if start > done or not spans:
                        parts.append(text[done:start])
                        spans += 1
                        done = start
                    if stop > done:
                        removed += stop - done
                        done = stop
                parts.append(text[done:])
                kept.append(b"".join(parts))
                counts.append((len(text), removed, spans))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.binary()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))], schema=to)

    return joined.mapInArrow(cut, schema)
