"""The isolate data model stated on the star-schema tables used for checks.

An order is an isolate, the part types on it are its tests, the return flag is
the test status, the market segment is the serotype.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_YEAR = 1998

# The columns read, so that opening a table needs no look at its files.
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_returnflag string",
    "part": "p_partkey long, p_type string",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "user_id long, event_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id, drug, class, status`, one row per tested part type on an order line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    kind = F.col("p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("id"),
        kind.alias("drug"),
        F.when(kind.isin("SMALL", "MEDIUM", "LARGE"), "SIZE")
        .when(kind.isin("ECONOMY", "STANDARD"), "GRADE")
        .otherwise("PROMO")
        .alias("class"),
        F.when(F.col("l_returnflag") == "R", "resistant")
        .when(F.col("l_returnflag") == "A", "intermediate")
        .otherwise("susceptible")
        .alias("status"),
    )


def isolates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id, serotype, year, data_source, cohort`, one row per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("c_mktsegment").alias("serotype"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderpriority").alias("data_source"),
            F.col("r_name").alias("cohort"),
        )
    )


def isolate_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long view: distinct tests with the isolate's attributes repeated.

    The tests are reduced per id before the join, which both bounds a hot id and
    leaves the rows partitioned for the join and for any later grouping by id.
    """
    panel = tests(spark, sf_dir).groupBy("id").agg(F.collect_set(F.struct("drug", "class", "status")).alias("tests"))
    return panel.join(isolates(spark, sf_dir), "id").select(
        "id", "serotype", "year", "data_source", "cohort", F.inline("tests")
    )


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two sources that share the id; the isolate table is the entity."""
    return {"isolates": isolates(spark, sf_dir), "tests": tests(spark, sf_dir)}


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`id, event_type`: a complementary source, reached through the ordering customer."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(events, F.col("o_custkey") == F.col("user_id")).select(
        F.col("o_orderkey").alias("id"), "event_type"
    )
