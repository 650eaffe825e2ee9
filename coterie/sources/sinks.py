"""Result tables, partitioned by run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import settle


def write_run(df: DataFrame, path: str, run_id: str | None = None, clean: bool = False) -> None:
    """Write a result table partitioned by `run_id`.

    Runs already in the frame replace themselves only; `clean` removes all
    earlier runs.
    """
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
    writer = df.write.mode("overwrite").partitionBy("run_id")
    if not clean:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def with_metadata(df: DataFrame, metadata: Mapping[str, object]) -> DataFrame:
    """Run-level values as constant columns."""
    for name, value in metadata.items():
        df = df.withColumn(name, F.lit(value))
    return df


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules as recorded: text of the rule and all measures, null where not computed."""
    for c in ("real_support", "real_lift"):
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(None).cast("double"))
    if "cluster" not in rules.columns:
        rules = rules.withColumn("cluster", F.lit(""))
    return rules.withColumn("association", C.rule_text(F.col("antecedent"), F.col("consequent"))).withColumn(
        "status", F.lit("provisional")
    )


def update_rule(spark: SparkSession, path: str, run_id: str, rule_id: str, field: str, value: object) -> None:
    """Change one field of one rule by rewriting its run."""
    rows = read_run(spark, path, run_id)
    kind = dict(rows.dtypes)[field]
    changed = rows.withColumn(
        field, F.when(F.col("rule_id") == rule_id, F.lit(value).cast(kind)).otherwise(F.col(field))
    )
    write_run(settle(changed), path)


def delete_runs(spark: SparkSession, path: str) -> None:
    """Empty a result table, keeping its schema."""
    rows = read_run(spark, path)
    settle(rows.limit(0)).write.mode("overwrite").parquet(path)


def graphml_lines(edges: DataFrame) -> DataFrame:
    """`value`: lines of a GraphML document, ordered by part then name.

    Written with `write.text`, the files in name order are the document.
    """
    spark = edges.sparkSession

    def escaped(c: str):
        text = F.col(c)
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(old), F.lit(new))
        return text

    head = "\n".join(
        [
            "<?xml version='1.0' encoding='utf-8'?>",
            '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
            '  <key id="weight" for="edge" attr.name="weight" attr.type="double" />',
            '  <graph edgedefault="undirected">',
        ]
    )
    ends = spark.createDataFrame([(0, "", head), (3, "", "  </graph>\n</graphml>")], "part int, name string, value string")
    node = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    nodes = node.select(F.lit(1).alias("part"), F.col("n").alias("name"), F.format_string('    <node id="%s" />', escaped("n")).alias("value"))
    links = edges.select(
        F.lit(2).alias("part"),
        F.concat_ws(" ", "src", "dst").alias("name"),
        F.format_string(
            '    <edge source="%s" target="%s"><data key="weight">%s</data></edge>',
            escaped("src"), escaped("dst"), F.col("lift").cast("string"),
        ).alias("value"),
    )
    return ends.unionByName(nodes).unionByName(links).orderBy("part", "name").select("value")


def write_graphml(edges: DataFrame, path: str) -> None:
    graphml_lines(edges).write.mode("overwrite").text(path)
