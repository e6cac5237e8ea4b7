"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, phrases into phrases of the next level, and so on. Each level first
takes runs of one symbol together, then colours the symbols by deterministic coin tossing: a symbol's
label is the lowest bit in which it differs from its left neighbour, and that bit's value; a few rounds
leave at most six labels, which are brought down to three. Phrases begin at local maxima of the colours,
so a symbol's phrase depends on a few neighbours only, and equal substrings have the same phrases inside,
wherever they stand. A phrase is named by a hash of its symbols.

The fingerprint keeps, of all phrase names from LEVEL up, the least in each of SLOTS hash classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, extended, fresh, lean, shuffle_partitions, text_bytes

SLOTS, LEVEL = 64, 3
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE_NAMES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _take_runs(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol within a text become one symbol, named by symbol and run length; others stay."""
    new = np.concatenate([[True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])])
    if new.all():
        return names, owner
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(names))).astype(np.uint64)
    kept = names[start]
    return np.where(length > 1, _mix(kept + length * np.uint64(0x9E3779B97F4A7C15)), kept), owner[start]


def colours(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each symbol, different from its neighbours' in the same text; first marks the texts' first symbols.

    Neighbouring symbols must differ.
    """
    left = np.empty_like(names)
    left[1:] = names[:-1]
    differ = names ^ left
    differ[first] = 1  # the first symbol of a text shows its lowest bit
    low = differ & (~differ + np.uint64(1))
    label = (2 * np.bitwise_count(low - np.uint64(1)) + ((names & low) != 0)).astype(np.uint8)
    for _ in range(3):  # 128 labels to 14, to 8, to 6
        differ = np.empty_like(label)
        differ[1:] = label[1:] ^ label[:-1]
        differ[first] = 1
        low = differ & (~differ + np.uint8(1))
        label = (2 * np.bitwise_count(low - np.uint8(1)) + ((label & low) != 0)).astype(np.uint8)
    last = np.append(first[1:], True)
    for colour in (5, 4, 3):
        at = np.flatnonzero(label == colour)
        before = np.where(first[at], 9, label[at - 1])
        after = np.where(last[at], 9, label[np.minimum(at + 1, len(label) - 1)])
        free = np.zeros(len(at), np.uint8)
        for _ in range(2):
            free += (free == before) | (free == after)
        label[at] = free
    return label


def next_level(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names and the texts they stand in."""
    names, owner = _take_runs(names, owner)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    colour = colours(names, first)
    begins = first.copy()
    inner = (colour[1:-1] > colour[:-2]) & (colour[1:-1] > colour[2:]) & ~first[1:-1] & ~first[2:]
    begins[1:-1] |= inner
    start = np.flatnonzero(begins)
    place = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
    spread = _mix(names + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return _mix(np.add.reduceat(spread, start)), owner[start]


def signatures(texts: list[bytes]) -> np.ndarray:
    """(texts, SLOTS) least phrase names; EMPTY where a class has none. A text too short for LEVEL gives its top phrases."""
    out = np.full((len(texts), SLOTS), EMPTY)
    sizes = np.array([len(t) for t in texts], np.int64)
    names = _BYTE_NAMES[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    level = 0
    while len(names):
        per_text = np.bincount(owner, minlength=len(texts))
        if level >= LEVEL:
            use = np.ones(len(names), bool)
        else:
            use = (per_text == 1)[owner]  # its last phrase, if the text ends below LEVEL
        slot = (names[use] & np.uint64(SLOTS - 1)).astype(np.int64)
        np.minimum.at(out, (owner[use], slot), names[use])
        grows = (per_text > 1)[owner]
        names, owner = names[grows], owner[grows]
        if len(names):
            names, owner = next_level(names, owner)
        level += 1
    return out


def as_text(signature: np.ndarray) -> str:
    """Four hexadecimal digits for each slot, ffff where it is empty."""
    short = ((signature >> np.uint64(6)) & np.uint64(0xFFFF)).astype(np.uint32)
    short = np.where(signature == EMPTY, 0xFFFF, np.minimum(short, 0xFFFE))
    return short.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of slots with the same name, of those filled in either; 1 for two empty texts. Rows against rows."""
    filled = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def in_groups(texts: list[bytes], at_once: int = 2_000_000) -> np.ndarray:
    """signatures() of many texts, at_once bytes or one text at a time."""
    found, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= at_once:
            found.append(signatures(held))
            held, size = [], 0
    return np.concatenate([*found, signatures(held)])


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with column fingerprint; null texts have that of the empty text. Narrow: no shuffle."""
    schema = extended(docs, T.StructType([T.StructField(fresh(docs, "fingerprint"), T.StringType())]))
    to, at = arrow_schema(schema), docs.columns.index(text_col)

    @lean
    def run(batches):
        for b in batches:
            found = in_groups([x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([as_text(s) for s in found], pa.string())], schema=to)

    return docs.mapInArrow(run, schema)


_EDITS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])


def edited_text(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first characters of the following one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of its edited text and that of the next document, in descending order of id.

    After the last comes the first. Null ids come last; rows of one id stand in the order of a hash of
    their texts. Null texts are empty. The ids are cut into blocks at some of them; a block's neighbour
    gets one more copy of its first document, so texts are shuffled once and no task sees more than
    its blocks.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("place"), F.col(text_col).alias("text"))
    shares = [k / (4 * partitions) for k in range(1, 4 * partitions)]
    edges, highest = rows.agg(F.percentile_approx("place", shares, 10_000), F.max("place")).first()
    edges = np.array(sorted(set(edges or ())), np.int64)

    @F.pandas_udf("array<int>")
    def blocks(place):
        import pandas as pd

        ids = place.to_numpy()
        own = np.searchsorted(edges, ids, "left")
        # an edge is the largest id of its block, whose document follows the last of the block above
        more = np.isin(ids, edges)
        return pd.Series([[o] + [-o - 2] * bool(m) + [-1] * (i == highest) for o, m, i in zip(own.tolist(), more.tolist(), ids.tolist(), strict=True)])

    # a negative number -b - 1 is a copy for block b that only follows
    dealt = rows.withColumn("to", F.explode(blocks("place"))).withColumn("late", (F.col("to") < 0).cast("int")).withColumn("block", F.when(F.col("to") < 0, -F.col("to") - 1).otherwise(F.col("to")))
    dealt = dealt.select("block", "late", "doc_id", "place", "text").repartition(partitions, "block").sortWithinPartitions("block", "late", F.col("place").desc(), F.xxhash64("text"))
    to = arrow_schema(_EDITS)

    def compared(ids, texts):
        """A row for each text but the last, which only follows."""
        decoded = [t.decode("utf-8", "replace") for t in texts]
        edited = [edited_text(a, b).encode("utf-8", "replace") for a, b in zip(decoded, decoded[1:], strict=False)]
        own, other = in_groups(texts), in_groups(edited)
        n = len(edited)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in decoded[:n]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array([as_text(s) for s in own[:n]]), pa.array([as_text(s) for s in other[:n]]), pa.array(likeness(own[:n], other[:n])), pa.array(likeness(own[:n], own[1:]))], schema=to
        )

    @lean
    def run(batches):
        block, late, ids, texts, size = None, False, [], [], 0
        for b in batches:
            for this, is_late, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), text_bytes(b, "text"), strict=True):
                if this != block:
                    if len(texts) > 1:
                        yield compared(ids, texts)
                    block, late, ids, texts, size = this, False, [], [], 0
                if late:  # of the rows that only follow, the first does
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                late = bool(is_late)
                if size >= 2_000_000 and len(texts) > 1:
                    yield compared(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield compared(ids, texts)

    return dealt.mapInArrow(run, _EDITS)
