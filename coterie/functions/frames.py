"""DataFrame helpers: settled intermediate tables, distributed ranking."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_dir: dict[str, str] = {}
#: By application: the folder of the step that runs, and that of the step before the next one.
_step_open: dict[str, str] = {}
_step_last: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it.

    Only a local master may go without the setting; a cluster run stops here
    because a folder of one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_dir:
        _local_dir[app] = tempfile.mkdtemp(prefix="coterie-")
    return _local_dir[app]


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _app_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark).rstrip('/')}/coterie/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A fresh path below this application's part of the shared folder, in the folder of the step that runs."""
    folder = _step_open.get(spark.sparkContext.applicationId) or _app_dir(spark)
    return f"{folder}/{uuid.uuid4().hex}"


@contextmanager
def step_folder(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside go to a folder of their own, which the next step of the application deletes.

    So a step's result must have been written before the next one begins.
    """
    app = spark.sparkContext.applicationId
    forget_step(spark)
    _step_last[app] = _step_open[app] = f"{_app_dir(spark)}/{uuid.uuid4().hex}"
    try:
        yield
    finally:
        del _step_open[app]


def forget_step(spark: SparkSession) -> None:
    """Delete what the last step has settled."""
    last = _step_last.pop(spark.sparkContext.applicationId, None)
    if last:
        forget(spark, last)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a settled table or folder; frames read from it end with it."""
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds; none if it is not there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in system.listStatus(folder)] if system.exists(folder) else []


def forget_settled(spark: SparkSession) -> None:
    """Delete every table this application has settled; frames read from them end with it."""
    forget(spark, _app_dir(spark))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number rows 1..n in the given order without sending them to one task.

    A range sort numbers rows inside each partition; only the row counts of the
    partitions are added up in one place.
    """
    shift = 33
    ordered = settle(df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__pid", F.shiftright("__mid", shift))
    counts = ordered.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    low = F.col("__mid").bitwiseAND(F.lit((1 << shift) - 1))
    return (
        ordered.join(offsets, "__pid")
        .withColumn(name, F.col("__offset") + low + 1)
        .drop("__pid", "__mid", "__offset")
    )


def first_ids(df: DataFrame, limit: int) -> DataFrame:
    """The rows of the first ids in id order; only the narrow ids are ranked, in as many tasks as they need."""
    last = scalar_of(ranked(df.select("id"), [F.col("id")]).where(F.col("rank") == limit), F.max("id"))
    return df.where(F.coalesce(F.col("id") <= last, last.isNull()))


def scalar_of(df: DataFrame, value: Column) -> Column:
    """A one-value aggregate as a scalar subquery column."""
    return df.agg(value.alias("v")).scalar()


def bounded_names(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct texts of a vocabulary column.

    Refuses more names than Spark lets a pivot have, so the list stays small.
    """
    bound = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    names = df.select(F.col(column).alias("name")).distinct().limit(bound + 1).collect()
    if len(names) > bound:
        raise ValueError(f"more than {bound} names; raise spark.sql.pivotMaxValues or narrow the input")
    return sorted(r["name"] for r in names)
