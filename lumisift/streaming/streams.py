"""Scans as streams: new images as they arrive, running counts, and a table of newest results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumisift.operators.review import known_updates, upsert_results
from lumisift.sources.scan import decoded, image_rows, scored_or_failed
from lumisift.sources.tables import listed, make_folder, removed

BUCKETS = 64
#: How often a view of a running scan is brought up to date.
REFRESH = "150 milliseconds"


def scan_stream(spark: SparkSession, root: str, mode: str = "auto", faces: DataFrame | None = None, shown: str | None = None) -> DataFrame:
    """A stream of scored photos and failures (error not null) for the image files that appear below root.

    faces (path, face) is a table, not a stream. Photos with names that streams don't see, and raw photos, come from
    `shown`, the folder that show_photos() fills: call it before each run, or now and then while one runs; what it has brought
    once has one name there, so it comes once, in resumed runs too. Without shown, hidden names are left out and raw
    photos are failures.
    """
    if shown:
        make_folder(spark, shown)
    return scored_or_failed(decoded(image_rows(spark.readStream, spark, root, shown), root), mode, thumbs=False, faces=faces)


def progress_stream(events: DataFrame) -> DataFrame:
    """Running number of events by status; one row of state per status."""
    return events.groupBy("status").agg(F.count("*").alias("photos"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name.removeprefix("version=")) for name in listed(spark, path) if name.startswith("version="))


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in complete mode: each batch is a version of the table; a repeated batch writes its version again.

    The version before is kept until the next batch, for its readers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for old in _versions(batch.sparkSession, path):
            if old < batch_id - 1:
                removed(batch.sparkSession, f"{path}/version={old}")

    return write


def _newest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, of those below the given one."""
    found = {}
    for version in _versions(spark, path):
        if below is None or version < below:
            found |= {int(name.removeprefix("bucket=")): version for name in listed(spark, f"{path}/version={version}") if name.startswith("bucket=")}
    return found


def read_upserted(spark: SparkSession, path: str, schema: StructType, below: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The table that upsert_sink() keeps below path: each bucket in its newest version, without what remove_paths() has taken out."""
    parts = [f"{path}/version={v}/bucket={b}" for b, v in _newest(spark, path, below).items() if buckets is None or b in buckets]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*parts)
    if not listed(spark, f"{path}/gone"):
        return rows
    return rows.join(spark.read.schema("path string").parquet(f"{path}/gone").distinct(), "path", "left_anti").select(*rows.columns)


def remove_paths(path: str, gone: DataFrame) -> None:
    """Takes photos (path) out of the table that upsert_sink() keeps: readers see them no more, nor any later update of them.

    The next batch that touches their buckets drops their rows too. Removing a photo twice does nothing more.
    """
    gone.select("path").distinct().write.mode("append").parquet(f"{path}/gone")


def upsert_sink(path: str, version: str = "seq", only_known: bool = False, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch into the table below path, the highest `version` of each photo winning.

    Photos are dealt to buckets by a hash of their path; a batch reads and writes only the buckets it
    touches, each as a new version, so a repeated batch finds the old ones untouched. Versions older than a
    bucket's last two go. only_known drops updates of paths the table does not hold, after the first batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
        rows = batch.persist()
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # at most `buckets` numbers
        new = upsert_results(rows, rows.limit(0), version)
        if batch_id > 0:
            old = read_upserted(spark, path, batch.schema, batch_id, touched)
            new = upsert_results(old, known_updates(new, old) if only_known else new, version)
        new.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")
        rows.unpersist()
        before = _newest(spark, path, batch_id)
        for old in _versions(spark, path):
            if old < batch_id:
                for b in [int(n.removeprefix("bucket=")) for n in listed(spark, f"{path}/version={old}") if n.startswith("bucket=")]:
                    if old < before.get(b, old):
                        removed(spark, f"{path}/version={old}/bucket={b}")

    return write


def last_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The number of the last batch that a stream with this checkpoint has finished; None if it has finished none."""
    return max((int(name) for name in listed(spark, f"{checkpoint}/commits") if name.isdigit()), default=None)


def started(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str = REFRESH) -> StreamingQuery:
    """The stream, running until it is stopped, with a batch at most every so often if there is anything new."""
    return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int | None:
    """Runs the stream over what is there and ends; a stopped run goes on from its checkpoint. Returns last_batch()."""
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last_batch(stream.sparkSession, checkpoint)


def forget(spark: SparkSession, *folders: str) -> None:
    """Clears the tables and checkpoints of a scan before a new one begins."""
    for folder in folders:
        removed(spark, folder)
