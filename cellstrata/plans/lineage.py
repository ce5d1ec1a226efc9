"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Names that may become columns, and rows of a few numbers that may be broadcast.
MAX_COLUMNS, MAX_BROADCAST = 5_000, 1_000_000
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    It is the folder that ``spark.checkpoint.dir`` names. Only where that is
    unset and the master is local a temporary folder is made; on a cluster other
    machines would not see it, so there it is an error.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here is None:
        here = spark.conf.get("spark.checkpoint.dir", None)
        if not here:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            here = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(here)
        here = sc.getCheckpointDir()
    return here


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small frames that a loop reads again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write as Parquet in the shared folder and read again.

    Columnar and compressed, so the choice for wide or large frames.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, a cut or written frame of a few short columns, to be broadcast if it has at most ``MAX_BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def large(df: DataFrame) -> DataFrame:
    """``df``, a frame that grows with the input, to be joined by sort and merge.

    Sizes are estimated from those of files, and files of few bytes may hold so
    many rows that a hash table of them would be large on the driver and in every task.
    """
    return df.hint("merge")


def distinct_names(df: DataFrame, column: str) -> list[str]:
    """Distinct values, in order, that are to become columns; more than ``MAX_COLUMNS`` of them raise."""
    names = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_COLUMNS} values; choose a panel, or keep the rows long")
    return sorted(names)


@contextmanager
def batches_of(spark: SparkSession, rows: int = 1000, megabytes: int = 8) -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for the actions inside; the session's own bounds hold again afterwards.

    A single row may be larger. Only jobs that start inside are bounded, not those of frames that are returned.
    """
    before = {k: spark.conf.get(k) for k in (_ROWS, _BYTES)}
    for key, most in ((_ROWS, rows), (_BYTES, megabytes << 20)):
        own = int(before[key].rstrip("b"))
        spark.conf.set(key, min(most, own) if own > 0 else most)
    try:
        yield
    finally:
        for key, own in before.items():
            spark.conf.set(key, own)
