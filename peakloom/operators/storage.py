"""Tables that are computed once and read several times, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of stored tables by application and name.
_STORED: dict[tuple[str, ...], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; without that setting a temporary one, but on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/peakloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: later reads don't compute it again, and lost executors don't lose it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deals(spark: SparkSession) -> int:
    """The number of tasks that dealt() makes: one more than the shuffle partitions, as Spark drops a repartition that asks for what
    its input has already, and then joins the input's small partitions into a task or two."""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) + 1


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in deals() tasks, for rows of few bytes and much work.

    Adaptive execution sizes tasks by bytes, so it would join such rows into one or two tasks; an explicit number it leaves alone.
    """
    return df.repartition(deals(df.sparkSession), *keys)


def tasks_for(df: DataFrame, rows: int) -> int:
    """The number of tasks by which one has some `rows` rows of df, the shuffle partitions at least: with a fixed number, what a task
    holds grows with its input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def bounded_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Hint a broadcast of df only if a count shows at most `rows` rows; otherwise leave it to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """Hint that df meets the other side of its next join by a shuffle.

    Adaptive execution sizes a broadcast by compressed bytes: a million grid points or matched lines of a few whole numbers are less than
    its threshold, and take some hundred MB as rows and hash table of the driver.
    """
    return df.hint("merge")


def stored(spark: SparkSession, name: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name: built and written on its first use in an application, then read.

    For indexes and rankings that many queries read, such as a ranked library; name holds all that the table depends on.
    """
    key = (spark.sparkContext.applicationId, *name)
    if key not in _STORED:
        df, path = build(), shared_dir(spark)
        df.write.parquet(path)
        _STORED[key] = path, df.schema
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
