"""Tables: the given ones, and scratch tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LOCAL_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir or set by setCheckpointDir(); a temporary one only where there is neither, in local mode."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL_SCRATCH.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lumisift-"))


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = f"{scratch_dir(df.sparkSession)}/lumisift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's, given as Arrow: for plain ones executors would keep Python workers of another kind."""
    kind = T.StructType.fromDDL(schema)
    to = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(to)], schema=to), kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is not there."""
    where, files = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []


def removed(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


def _uri(where) -> str:
    """A Hadoop path as Spark's image source names it: encoded, local ones with three slashes."""
    return re.sub("^file:/(?!/)", "file:///", where.toUri().toString())


def qualified(spark: SparkSession, path: str) -> tuple[str, str]:
    """The path with its scheme and without a slash at its end, plain and encoded as a URI."""
    where, files = _file_system(spark, path)
    where = files.makeQualified(where)
    return where.toString().rstrip("/"), _uri(where).rstrip("/")


def make_folder(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.mkdirs(where)
