"""Places and running sums of rows in an order, with no task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokloom.session import save


def numbered(df: DataFrame, by: str | None, order: list[str], amount: str | None = None) -> DataFrame:
    """The rows of ``df``, a saved table, with ``r``, the place from 0 of each among the rows of its ``by``, an integer of few values, in order of ``order``, nulls last, or of all rows where ``by`` is None;
    with ``amount``, ``before`` is the sum of that column over all rows before. Rows equal in all of these columns are in any order.

    Rows are partitioned by ranges of (by, order, chance) and counted inside each partition as they pass, so that no value of ``by`` or ``order``, however frequent, is one task.
    What goes before each partition is a table of one row for each partition and value of ``by`` in it, as many as partitions and values at most; this is broadcast.
    """
    names = df.columns
    if by is None:
        df, by = df.withColumn("_g", F.lit(0)), "_g"
    by_order = [F.col(by).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in order)]
    spread = df.withColumn("_s", F.rand(0)).repartitionByRange(*by_order, F.col("_s")).drop("_s").sortWithinPartitions(*by_order).withColumn("_p", F.spark_partition_id())
    at, sums = spread.columns.index(by), spread.columns.index(amount) if amount else None
    schema = T.StructType([*spread.schema, T.StructField("r", T.LongType()), T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            k, place = b.column(at).to_numpy(), np.arange(b.num_rows)
            new = np.r_[k[0] != last, k[1:] != k[:-1]]
            start = np.maximum.accumulate(np.where(new, place, -1))
            r = np.where(start >= 0, place - start, place + count)
            last, count = k[-1], int(r[-1]) + 1
            n = b.column(sums).to_numpy().astype(np.int64) if amount else np.zeros(len(k), np.int64)
            ends = total + np.cumsum(n)
            total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.astype(np.int64)), pa.array(ends - n)], names=schema.names)

    rows = save(spread.mapInArrow(run, schema), "numbered")
    parts = rows.groupBy("_p", by).agg(F.count(F.lit(1)).alias("_c"), F.sum(amount or F.lit(0)).alias("_a"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums_before = parts.groupBy("_p").agg(F.sum("_a").alias("_a")).withColumn("_a", F.coalesce(F.sum("_a").over(earlier), F.lit(0)))
    places = parts.select("_p", by, F.coalesce(F.sum("_c").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    out = rows.join(F.broadcast(places.join(sums_before, "_p")), ["_p", by])
    out = out.select(*names, (F.col("r") + F.col("_c")).alias("r"), (F.col("before") + F.col("_a")).alias("before"))
    return out if amount else out.drop("before")
