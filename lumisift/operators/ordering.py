"""Places in a total order over all rows, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumisift.sources.tables import shuffle_partitions, small_table, written


def global_rank(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with `out`: 1 for the first row in the order, and so on. The order should be total.

    Range partitions are numbered by their own tasks; one count per partition goes through the driver.
    """
    n, taken = shuffle_partitions(df.sparkSession), {c.lower() for c in df.columns}
    part, base = (next(c for k in range(len(taken) + 1) if (c := "_" * k + name) not in taken) for name in ("part__", "base__"))
    parted = written(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    counts = sorted((r["part"], r["n"]) for r in parted.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for number, count in counts:
        rows.append((number, before))
        before += count
    bases = small_table(df.sparkSession, rows, f"{part} int, {base} long")
    ranked = parted.withColumn(out, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    # as many rows as there are range partitions
    return ranked.join(F.broadcast(bases), part).withColumn(out, (F.col(out) + F.col(base)).cast("long")).drop(part, base)
