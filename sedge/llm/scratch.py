"""Intermediate tables in the shared folder that the cluster names.

Iterative operators cut their lineage by writing a Parquet table below
`spark.checkpoint.dir`, which every executor and the driver can reach.  A lost
executor then costs at most the tasks that it was running.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_path

#: Ids up to this number may be broadcast (8 bytes each, 32 MB); beyond it the
#: join is left to a shuffle.
MAX_BROADCAST_IDS = 4_000_000
#: The same for narrow rows of a few strings (some 200 bytes each, 20 MB).
MAX_BROADCAST_ROWS = 100_000


#: Whole texts go to Python in batches of so many rows and bytes at most; the
#: defaults would hold tens of megabytes of text several times over in a task.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to ours where they are larger.

    The setting stays: plans are run after the operator has returned them.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and return a reader of the written table."""
    spark = df.sparkSession
    path = shared_path(spark, f"sedge-{name}")
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    if (written := _written.get()) is not None:
        written.append(table)
    return table


_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


@contextmanager
def tidied() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete, at the end, the tables that are materialized within, but those handed to `keep`.

    with tidied() as keep:
        result = keep(materialize(operator(rows), "result"))
    """
    outer, written, kept = _written.get(), [], []
    mark = _written.set(written)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _written.reset(mark)
    discard(*(t for t in written if not any(t is k for k in kept)))
    if outer is not None:
        outer.extend(kept)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no plan reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def counted(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A materialized table, marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def semi_reduce(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of `df` whose `key` is in `ids` (one distinct column of that name).

    `n_ids` is the counted size of `ids`: up to MAX_BROADCAST_IDS the ids go to
    the rows, so that wide rows that drop out are never shuffled.
    """
    ids = F.broadcast(ids) if n_ids <= MAX_BROADCAST_IDS else ids
    return df.join(ids, key, "left_semi")


def anti_reduce(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """The counterpart of `semi_reduce`: rows whose `key` is not in `ids`."""
    ids = F.broadcast(ids) if n_ids <= MAX_BROADCAST_IDS else ids
    return df.join(ids, key, "left_anti")
