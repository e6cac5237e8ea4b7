"""Token files: ids in patched frame-of-reference blocks, with an index of block starts.

A file holds whole documents. Its ids are cut into blocks of BLOCK; a block stores its minimum, and
each id's distance from it in as many bits as the block's percentile of distances needs. The high
bits of larger distances stand in the block's exception list. The index holds where each block
starts, so any range of ids is read by unpacking only its blocks.

Layout, little-endian: magic, version, block size, n_docs, n_ids, n_blocks, ids before this file in
its part (int64 each); per document id, null mark and length; per block minimum (u4), bit width (u1),
number of exceptions (u2) and start (u8); then the blocks: packed bits, exception places (u1),
exception high bits (u4).

Files are rows of a table (part, file, n_ids, payload) in Parquet, so they lie in any store Spark
reaches and are committed with the task that wrote them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, lean, shuffle_partitions, small_table, text_bytes, written
from lumisift.llm.tokens import default_tokenizer_path, encoded, tokenizer

MAGIC, VERSION, BLOCK, PERCENTILE = 0x31524F46504B4F54, 1, 256, 90
IDS_PER_FILE = 1 << 20
_HEAD = 7 * 8


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Minimum, width, number of exceptions and start of each block, and the blocks' bytes."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        none = np.zeros(0, np.int64)
        return none, none, none, none, b""
    padded = np.full(n_blocks * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    blocks = padded.reshape(n_blocks, BLOCK)
    low = blocks.min(1)
    far = blocks - low[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    edge = np.partition(far, at, axis=1)[:, at]
    width = np.ceil(np.log2(edge.astype(np.float64) + 1)).astype(np.int64)
    high = far >> width[:, None].astype(np.uint32)
    n_high = np.count_nonzero(high, axis=1)
    bytes_packed = width * (BLOCK // 8)
    start = _starts(bytes_packed + 5 * n_high)
    out = np.zeros(int((bytes_packed + 5 * n_high).sum()), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if not w:
            continue
        for k in range(0, len(rows), 512):  # bounds the unpacked bits in memory
            some = rows[k : k + 512]
            bits = ((far[some][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
            out[start[some][:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(high)
    nth = np.arange(len(block)) - _starts(n_high)[block]
    first = start[block] + bytes_packed[block]
    out[first + nth] = place
    highs = high[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(first + n_high[block] + 4 * nth)[:, None] + np.arange(4)] = highs
    return low, width, n_high, start, out.tobytes()


def unpack_blocks(low, width, n_high, start, raw: np.ndarray) -> np.ndarray:
    """The ids of the given blocks; raw is the byte area the starts count from."""
    out = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if not w:
            continue
        for k in range(0, len(rows), 512):
            some = rows[k : k + 512]
            packed = raw[start[some][:, None] + np.arange(w * (BLOCK // 8))]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
            values = np.zeros((len(some), BLOCK), np.uint32)
            for bit in range(int(w)):
                values |= bits[:, :, bit].astype(np.uint32) << np.uint32(bit)
            out[some] = values
    block = np.repeat(np.arange(len(low)), n_high)
    nth = np.arange(len(block)) - _starts(n_high)[block]
    first = start[block] + width[block] * (BLOCK // 8)
    place = raw[first + nth]
    highs = np.ascontiguousarray(raw[(first + n_high[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    out[block, place] |= highs << width[block].astype(np.uint32)
    return (out + low.astype(np.uint32)[:, None]).ravel()


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    low, width, n_high, start, body = pack_blocks(ids)
    head = np.array([MAGIC, VERSION, BLOCK, len(doc_ids), len(ids), len(low), before], "<i8").tobytes()
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    missing = np.array([d is None for d in doc_ids], "u1").tobytes()
    return b"".join([head, known, missing, np.array(lengths, "<i8").tobytes(), low.astype("<u4").tobytes(), width.astype("u1").tobytes(), n_high.astype("<u2").tobytes(), start.astype("<i8").tobytes(), body])


class TokenFile:
    """Reads a token file: its directory at once, its ids block by block."""

    def __init__(self, payload: bytes):
        magic, version, block, n_docs, self.n_ids, n_blocks, self.before = np.frombuffer(payload, "<i8", 7).tolist()
        if (magic, version, block) != (MAGIC, VERSION, BLOCK):
            raise ValueError("not a token file of this version")
        at = _HEAD

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, n, at)
            at += found.nbytes
            return found

        known, missing, self.lengths = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [None if m else d for d, m in zip(known.tolist(), missing.tolist(), strict=True)]
        self.low, self.width, self.n_high = take("<u4", n_blocks), take("u1", n_blocks).astype(np.int64), take("<u2", n_blocks).astype(np.int64)
        self.start, self.raw = take("<i8", n_blocks), np.frombuffer(payload, np.uint8, offset=at) if at < len(payload) else np.zeros(0, np.uint8)

    def read(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first..last-1 of the file; unpacks only the blocks they lie in."""
        last = self.n_ids if last is None else last
        if last <= first:
            return np.zeros(0, np.uint32)
        some = slice(first // BLOCK, -(-last // BLOCK))
        ids = unpack_blocks(self.low[some], self.width[some], self.n_high[some], self.start[some], self.raw)
        return ids[first - some.start * BLOCK : last - some.start * BLOCK]


_FILES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("payload", T.BinaryType())])
_DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType())])


def write_token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Token files of docs in ascending id order, as a table (part, file, n_ids, payload).

    Each document's ids end with end_id, which is all there is of null and empty texts. Null ids come
    first; rows of one id stand in the order of a hash of their texts. A file is closed at ids_per_file
    ids or more, so a longer document has a file of its own. Other columns are not read.
    """
    path = tokenizer_path or default_tokenizer_path()
    to = arrow_schema(_FILES)

    @lean
    def encode(batches):
        from pyspark import TaskContext

        words, part, seen, n_files = tokenizer(path), TaskContext.get().partitionId(), 0, 0
        doc_ids, held = [], []

        def closed():
            nonlocal seen, n_files, doc_ids, held
            lengths = [len(x) for x in held]
            ids = np.concatenate(held)
            payload = write_file(doc_ids, lengths, ids, seen)
            seen, n_files, doc_ids, held = seen + len(ids), n_files + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_files - 1], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], schema=to)

        size = 0
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoded(words, text_bytes(b, "text"), end_id), strict=True):
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= ids_per_file:
                    yield closed()
                    size = 0
        if held:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    return rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(encode, _FILES)


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    to = arrow_schema(_DOCS)

    @lean
    def decode(batches):
        for b in batches:
            for part, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = TokenFile(payload.as_py())
                raw, ends = f.read().astype("<u4").tobytes(), np.cumsum(f.lengths)
                starts = ends - f.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(starts + f.before), pa.array(f.lengths), pa.array(crcs, pa.int64()), pa.array(np.full(len(crcs), part, np.int32))], schema=to)

    local = files.select("part", "payload").mapInArrow(decode, _DOCS)
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).collect()  # one number per range partition
    base, bases = 0, []
    for part, n in sorted((r["part"], r["n_ids"]) for r in per_part):
        bases.append((part, base))
        base += n
    before = small_table(files.sparkSession, bases, "part int, base long")
    return local.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files_round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes docs as token files to the shared folder and reports on each document as read back from them."""
    return read_token_files(written(write_token_files(docs, tokenizer_path, end_id)))
