"""Running totals over any number of rows of a key, by range partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from cellstrata.plans.lineage import cut, small, written


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` (whole numbers) over the rows of the same ``by`` that come earlier in ``order``.

    Rows are range partitioned by key and order, so a key with very many rows
    spans tasks. Each partition adds up in one pass; what a key has in earlier
    partitions is a window over one row for each key and partition. Nothing is
    shuffled by key alone. Rows of equal key and order are told apart in no
    fixed way.
    """
    keys = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(n)
            more = [pa.array(np.full(len(n), part, np.int32)), pa.array(total + run - n)]
            total += int(run[-1]) if len(n) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__part", "__run"])

    schema = T.StructType([*ranged.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__run", T.LongType())])
    ranged = written(ranged.mapInArrow(add, schema), "running")
    starts = ranged.groupBy(*by, "__part").agg(F.min("__run").alias("__first"), F.sum(value).alias("__own"))
    earlier = F.coalesce(F.sum("__own").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(cut(starts.select(*by, "__part", (earlier - F.col("__first")).alias("__shift"))))
    return ranged.join(starts, [*by, "__part"]).withColumn(into, (F.col("__run") + F.col("__shift")).cast("long")).drop("__part", "__run", "__shift")
