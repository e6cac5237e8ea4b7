"""Packing along a space-filling curve: neighbouring documents share sequences, and nothing but the last few is padded.

A document's token counts are hashed into DIMS signed sums (a sparse random projection), scaled by
the corpus's mean and spread, and turned into a Hilbert key. Documents in key order form one stream of
ids, cut every `length` ids; the rest at the stream's end is cut into powers of two, which need no
padding. Where a document's ids lie follows from sums of counts alone: keys and counts are range-sorted without the ids, and
a document's place is the sum of the counts before it. A key that very many documents share spreads over several ranges.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, lean, running_total, text_bytes, written
from lumisift.llm.tokens import default_tokenizer_path, encoded, tokenizer

DIMS, BITS = 3, 6
_TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("row_hash", T.LongType()), T.StructField("row", T.LongType()), *(T.StructField(f"p{d}", T.DoubleType()) for d in range(DIMS))])
_PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def token_signs(n: int) -> np.ndarray:
    """For each token id a hashed +1 or -1 in each dimension."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return np.stack([((x >> np.uint64(7 * d)) & np.uint64(1)).astype(np.float64) * 2 - 1 for d in range(DIMS)], 1)


def project(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The document's log-scaled token counts, of unit length, projected to DIMS."""
    tokens, n = np.unique(ids, return_counts=True)
    weight = np.log1p(n)
    return weight @ signs[tokens % len(signs)] / np.sqrt(weight @ weight)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n, dims), each coordinate below 2**bits.

    Skilling's transform (2004): from the top bit down, a coordinate's bit tells whether the lower bits
    of the first coordinate are inverted or exchanged with its own; then a Gray decode.
    """
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for d in range(len(x)):
            inverts = (x[d] >> b) & 1 == 1
            swap = np.where(inverts, 0, (x[0] ^ x[d]) & lower)
            x[0] = np.where(inverts, x[0] ^ lower, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flips = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << 1) | (((x[d] ^ flips) >> b) & 1)
    return key


def id_kind(vocabulary: int) -> str:
    """Two bytes an id where they suffice, for what is written and shuffled."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, end_id: int, words_kept: int | None = None) -> DataFrame:
    to = arrow_schema(_TOKENS)

    @lean
    def encode(batches):
        import xxhash
        from pyspark import TaskContext

        words, row = tokenizer(path, words_kept), TaskContext.get().partitionId() << 40
        signs, kind = token_signs(words.n_ids), id_kind(words.n_ids)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                texts = text_bytes(some, "text")
                ids = list(encoded(words, texts, end_id))
                places = np.array([project(x, signs) for x in ids])
                hashes = pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in texts], pa.int64())
                rows = pa.array(np.arange(row, row + len(ids)))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), hashes, rows, *(pa.array(places[:, d]) for d in range(DIMS))], schema=to)
        if words_kept:
            words.forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _TOKENS)


def _with_cells(tokens: DataFrame) -> DataFrame:
    """Adds cell: the Hilbert key, scaled by the whole corpus."""
    stats = tokens.agg(*(f(f"p{d}").alias(f"{n}{d}") for d in range(DIMS) for n, f in (("mean", F.avg), ("spread", F.stddev_pop)))).first()
    # rounded, so that sums in another order give the same keys
    mean = np.array([round(stats[f"mean{d}"] or 0.0, 6) for d in range(DIMS)])
    spread = np.array([round(stats[f"spread{d}"] or 1.0, 6) for d in range(DIMS)])

    @F.pandas_udf("long")
    def key(*columns):
        import pandas as pd

        z = (np.stack([c.to_numpy() for c in columns], 1) - mean) / np.where(spread > 1e-12, spread, 1.0)
        spots = np.floor((1 / (1 + np.exp(-1.702 * z))) * (1 << BITS)).clip(0, (1 << BITS) - 1)  # near a normal's ranks
        return pd.Series(hilbert_key(spots.astype(np.int64), BITS))

    return tokens.withColumn("cell", key(*(F.col(f"p{d}") for d in range(DIMS))))


def pack(docs: DataFrame, length: int = 4096, tokenizer_path: str | None = None, end_id: int = 2, words_kept: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids end with end_id (all there is of a null or empty text); repeated rows are
    packed once each, and null ids are kept. Sequences hold `length` ids, a power of two; only the
    stream's tail is shorter, in sequences of smaller powers of two. An empty table gives no pieces.
    words_kept bounds the words a worker remembers, and has it forget them after a task: that costs time and
    saves memory, the ids are the same.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    path = tokenizer_path or default_tokenizer_path()
    kind = id_kind(tokenizer(path).n_ids)
    tokens = written(tokenized(docs, path, end_id, words_kept))
    celled = written(_with_cells(tokens.drop("ids")).select("cell", "doc_id", "row_hash", "row", "n_tokens"))
    total = celled.agg(F.sum("n_tokens")).first()[0] or 0
    # equal rows are alike, so their order does not matter
    placed = running_total(celled, [F.col("cell"), F.col("doc_id"), F.col("row_hash"), F.col("row")], "n_tokens", "at")
    rows = tokens.select("row", "ids").join(placed.select("row", "doc_id", "at"), "row").select("doc_id", "ids", "at")
    to = arrow_schema(_PIECES)
    full, tail = divmod(total, length)
    tail_ends = full * length + np.cumsum([1 << b for b in range(length.bit_length() - 1, -1, -1) if tail >> b & 1]).astype(np.int64)

    @lean
    def cut(batches):
        for b in batches:
            found = []
            for doc_id, raw, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    here = at + start
                    if here < full * length:
                        sequence, begin, end = here // length, here // length * length, (here // length + 1) * length
                    else:
                        k = int(np.searchsorted(tail_ends, here, "right"))
                        sequence, begin, end = full + k, int(tail_ends[k - 1]) if k else full * length, int(tail_ends[k])
                    stop = min(n, start + end - here)
                    found.append((doc_id, start, stop - start, zlib.crc32(ids[start:stop]), n, sequence, here - begin))
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(len(_PIECES))], schema=to)

    return rows.mapInArrow(cut, _PIECES)
