"""Line deduplication: lines whose normalised form stands in many documents are dropped everywhere.

Lines are exploded, normalised and hashed where the text is read; only (hash, count) rows are
shuffled, summed per task first. Texts are not shuffled as long as the set of frequent hashes has at
most `broadcast_keys` entries; beyond that the frequent hashes reach the texts by joins.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, extended, fresh, lean, text_bytes, written

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_COUNTS = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("n", T.LongType())])
_PAIRS = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField("h", T.BinaryType())])


def line_key(line: bytes) -> bytes:
    """Blanks stripped at both ends, A-Z lower-cased; other bytes as they are."""
    return line.strip(BLANKS).lower()


def _hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 128-bit hash for each line; None for lines whose key is too short ever to be dropped."""
    keys = [line_key(x) for x in text.split(b"\n")]
    long_enough = (lambda k: len(k) >= min_chars) if min_chars <= 1 else (lambda k: len(k.decode("utf-8", "replace")) >= min_chars)
    return [xxhash.xxh3_128_digest(k) if long_enough(k) else None for k in keys]


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """One row per line hash `h` that stands in at least min_docs rows of docs, with that number `n`."""
    to = arrow_schema(_COUNTS)

    @lean
    def count(batches):
        for b in batches:
            found = Counter()
            for text in text_bytes(b, "text"):
                found.update(h for h in set(_hashes(text, min_chars)) if h is not None)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], schema=to)

    lines = docs.select(F.col(text_col).alias("text")).mapInArrow(count, _COUNTS)
    return lines.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", broadcast_keys: int = 400_000) -> DataFrame:
    """docs with its frequent lines gone, and columns n_lines (before) and n_dropped.

    A row counts as a document, so repeated rows count as often as they stand there. Null and empty
    texts are one empty line and stay as they are; keys of fewer than min_chars code points are never
    dropped. If docs has columns n_lines or n_dropped, the new ones get leading underscores. An empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    frequent = written(frequent_lines(docs, min_docs, min_chars, text_col).select("h"))
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    extra = T.StructType([T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    n_frequent = frequent.count()  # the checked size of what is broadcast

    if n_frequent <= broadcast_keys:
        drop = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.collect()))
        source, own = docs, None
    else:
        drop, own = None, fresh(docs, "own_frequent")
        source = _with_own_frequent(docs, frequent, min_chars, text_col, own)
    schema = extended(docs, extra)
    to, at = arrow_schema(schema), docs.columns.index(text_col)

    @lean
    def cut(batches):
        for b in batches:
            whole, counts, dropped, out = b.column(at).cast(pa.binary()).to_pylist(), [], [], []
            owns = b.column(b.num_columns - 1).to_pylist() if own else None
            for i, text in enumerate(whole):
                gone = drop.value if drop else frozenset(owns[i] or ())
                lines = (text or b"").split(b"\n")
                kept = [x for x, h in zip(lines, _hashes(text or b"", min_chars), strict=True) if h is None or h not in gone] if gone else lines
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
                out.append(text if len(kept) == len(lines) else b"\n".join(kept))
            columns = list(b.columns[: len(schema) - 2])
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], schema=to)

    return source.mapInArrow(cut, schema)


def _with_own_frequent(docs: DataFrame, frequent: DataFrame, min_chars: int, text_col: str, own: str) -> DataFrame:
    """docs and, last, the frequent hashes of its own lines; equal texts have equal lists, so the list joins by a hash of the text."""
    to = arrow_schema(_PAIRS)

    @lean
    def pairs(batches):
        for b in batches:
            rows = [(xxhash.xxh3_128_digest(t), h) for t in set(text_bytes(b, "text")) for h in set(_hashes(t, min_chars)) if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], schema=to)

    @lean
    def key(batches):
        for b in batches:
            keys = [xxhash.xxh3_128_digest(t) for t in text_bytes(b, text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], schema=keyed_to)

    name = fresh(docs, "text_key")
    keyed_schema = extended(docs, T.StructType([T.StructField(name, T.BinaryType())]))
    keyed_to = arrow_schema(keyed_schema)
    lists = docs.select(F.col(text_col).alias("text")).mapInArrow(pairs, _PAIRS).distinct().join(frequent, "h").groupBy("text_key").agg(F.collect_list("h").alias(own))
    joined = docs.mapInArrow(key, keyed_schema).join(lists.withColumnRenamed("text_key", name), name, "left")
    return joined.select(*docs.columns, own)
