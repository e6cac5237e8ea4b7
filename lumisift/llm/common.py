"""Plumbing the text operators share: scratch tables, running totals, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.sources.tables import scratch_dir, shuffle_partitions, small_table, table, written  # noqa: F401

ROWS_PER_BATCH, BYTES_PER_BATCH = 2000, 4 << 20


def long_rows(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes: texts are long rows, and each task and its Python worker hold
    a batch several times over. Plans read the settings when they run, so they stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def lean(task):
    """An Arrow task that gives its memory back at its end: Python workers are kept for later tasks, also of other stages."""

    @wraps(task)
    def run(*arguments):
        yield from task(*arguments)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def arrow_column(returns):
    """A column function of Arrow arrays, batch by batch: only its arguments go to Python, and only its result comes back."""

    def made(task):
        return F.arrow_udf(lean(task), returns)

    return made


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The named text column as UTF-8 bytes, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def extended(df: DataFrame, extra: T.StructType) -> T.StructType:
    return T.StructType([*df.schema.fields, *extra.fields])


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def running_total(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one in the given order.

    Range partitions are summed in their own tasks; one number per partition goes through the driver.
    The order should be total (ties are dealt in any order). Null values count as 0.
    """
    n = shuffle_partitions(df.sparkSession)
    part = fresh(df, "part")
    schema = extended(df, T.StructType([T.StructField(out, T.LongType()), T.StructField(part, T.IntegerType())]))
    to = arrow_schema(schema)
    at = df.columns.index(value)

    @lean
    def scan(batches):
        from pyspark import TaskContext

        k, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(v) + seen
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - v), pa.array(np.full(len(v), k, np.int32))], schema=to)
            seen = int(upto[-1]) if len(v) else seen

    local = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(scan, schema))
    return with_bases(local, part, value, out).drop(part)


def with_bases(local: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Adds to `out` the totals of `value` in all partitions numbered below the row's own."""
    totals = sorted((r[0], r[1] or 0) for r in local.groupBy(part).agg(F.sum(value)).collect())
    base, rows = 0, []
    for k, total in totals:
        rows.append((k, base))
        base += total
    bases = small_table(local.sparkSession, rows, f"{part} int, base__ long")
    # one row per range partition, a number that the job itself sets
    return local.join(F.broadcast(bases), part).withColumn(out, F.col(out) + F.col("base__")).drop("base__")


def runs(batches, keys: int):
    """Of batches sorted by their first `keys` columns: (key, rows as an Arrow table) for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        heads = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        starts = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
        for a, z in zip(starts, starts[1:], strict=False):
            if held and heads[a] != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = heads[a]
            held.append(b.slice(a, z - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


BROADCAST_BYTES = 24 << 20


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast if it has no more than so many rows and its files BROADCAST_BYTES; else joins shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


#: What a block of pair comparisons returns for each of its classes: a class it is tied to, and its links.
LINKS = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("n_links", T.LongType())])


def batch_of(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    to = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to.field(i).type) for i in range(len(to))], schema=to)


def roots_of(n: int, edges) -> list[int]:
    """The least node each of n nodes is joined to by the edges."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
