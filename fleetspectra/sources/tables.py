"""Tables in, tables out, and stored steps in between."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_table(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """A catalog table by name, or files by path."""
    if "/" in source:
        return spark.read.format(fmt).load(source)
    return spark.table(source)


def read_group_family(
    spark: SparkSession,
    sources: Mapping[object, str | DataFrame],
    tag: str = "sales_group",
    schema: str | None = None,
) -> DataFrame:
    """Same-shaped tables, one per group, as one table with a group column.

    With no sources the result is empty and has the columns of ``schema``.
    """
    parts = []
    for group, source in sources.items():
        df = read_table(spark, source) if isinstance(source, str) else source
        parts.append(df.withColumn(tag, F.lit(group)))
    if not parts:
        if schema is None:
            raise ValueError("no tables, and no schema for an empty result")
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def save_table(
    df: DataFrame,
    name: str,
    fmt: str = "parquet",
    path: str | None = None,
    partition_by: Sequence[str] = (),
) -> None:
    """Replace a table. ``fmt`` may be any format the cluster has, e.g. delta."""
    writer = df.write.format(fmt).mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def layout_signals(
    df: DataFrame, files: int | None = None, key: str = "vin", order: str = "timestamp"
) -> DataFrame:
    """Rows of a vehicle side by side and in time order, in even files.

    Ranges over vehicle and time split a vehicle that would not fit one file,
    which hashing the vehicle cannot; and files that cover few vehicles and a
    stretch of time are skipped when a query filters on either.

    Without ``files`` there are as many as shuffle partitions, and Spark joins
    those below its advisory size. Finding the ranges samples the rows in a
    pass of its own, so pass a table or stored step, not a long plan.
    """
    parts = [files] if files else []
    return df.repartitionByRange(*parts, key, order).sortWithinPartitions(key, order)


def save_signals(
    df: DataFrame,
    name: str,
    files: int | None = None,
    key: str = "vin",
    order: str = "timestamp",
    fmt: str = "parquet",
    path: str | None = None,
) -> None:
    """Write a signal extract in the layout of ``layout_signals``."""
    save_table(layout_signals(df, files, key, order), name, fmt, path)


def save_bucketed(
    df: DataFrame,
    name: str,
    buckets: int,
    key: str = "vin",
    sort_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    path: str | None = None,
) -> None:
    """Replace a table dealt to buckets by vehicle and sorted within them.

    Joins by vehicle with tables of as many buckets, aggregations and windows by vehicle then start from the files
    without a shuffle. The rows are dealt before they are written, so each bucket is one file (per partition).
    Buckets cannot be split: choose their number so that the largest vehicle fits a task, and no smaller than
    ``spark.sql.shuffle.partitions``, or a join shuffles both sides to that number.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.format(fmt).mode("overwrite").bucketBy(buckets, key).sortBy(key, *sort_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local session without one gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetspectra-")


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Write a result that is read several times, and read it back.

    Later steps then start from files of known size instead of computing the
    result again, also after an executor is lost.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fleetspectra-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
