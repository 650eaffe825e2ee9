"""Opening inputs: Parquet folders, catalog tables, SQL text and JDBC tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def read_source(
    spark: SparkSession,
    location: str,
    kind: str = "parquet",
    columns: Sequence[str] = ("*",),
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A source by location; `kind` is parquet, orc, csv, json, table, sql or jdbc.

    For `jdbc` the location is the table and the options hold url, driver and,
    for parallel reads, partitionColumn, lowerBound, upperBound, numPartitions.
    """
    options = dict(options or {})
    if kind == "table":
        df = spark.table(location)
    elif kind == "sql":
        df = spark.sql(location)
    elif kind == "jdbc":
        df = spark.read.format("jdbc").options(dbtable=location, **options).load()
    else:
        df = spark.read.format(kind).options(**options).load(location)
    return df if list(columns) == ["*"] else df.select(*columns)
