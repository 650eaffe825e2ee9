"""Summary reports that compare groups and periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions import columns as C

# Fixed values of the report rules.
BETA_LACTAMS = ("Cephalosporins", "Penicillins", "Beta lactam", "Carbapenems")
BETA_LACTAM = "Beta lactam"
QUALIFY = {"real_support": 0.1, "support": 0.05, "confidence": 0.8, "lift": 1.5}
MARKS = {"real_support": 25.0, "confidence": 10.0, "lift": 25.0}
MULTI_CLASSES = 2


def period(year: Column, split: int, before: str, after: str) -> Column:
    return F.when(year < split, before).otherwise(after)


def merged_class(cls: Column, family: Sequence[str] = BETA_LACTAMS, name: str = BETA_LACTAM) -> Column:
    """The class, classes of the family as one; compared without case."""
    return F.when(F.lower(cls).isin([c.lower() for c in family]), name).otherwise(cls)


def resistance_ratio(
    view: DataFrame,
    split: int,
    focus_serotype: str,
    before: str | None = None,
    after: str | None = None,
    other: str | None = None,
    family: Sequence[str] = BETA_LACTAMS,
    name_of_family: str = BETA_LACTAM,
    more_than: int = MULTI_CLASSES,
    positive: str = C.POSITIVE,
) -> DataFrame:
    """Share of isolates resistant to more than two classes, by serotype group and period.

    One grouping by isolate and one by group; a null class counts as a class.
    Groups without such isolates are left out. Serotypes, classes and statuses compare
    without case, and the focused group is named as `focus_serotype` is written. Labels
    follow from the arguments unless given: `Before2012`, `After2012`, `Non-Dublin`.
    """
    before, after = before or f"Before{split}", after or f"After{split}"
    sero = F.when(F.lower("serotype") == focus_serotype.lower(), focus_serotype).otherwise(other or f"Non-{focus_serotype}")
    cls = F.struct(F.lower(merged_class(F.col("class"), family, name_of_family)).alias("c"))
    per_id = (
        view.select(
            "id",
            sero.alias("serotype"),
            period(F.col("year"), split, before, after).alias("period"),
            F.when(F.lower("status") == positive.lower(), cls).alias("c"),
        )
        .groupBy("id", "serotype", "period")
        .agg(F.size(F.collect_set("c")).alias("classes"))
    )
    return (
        per_id.groupBy("serotype", "period")
        .agg(F.count_if(F.col("classes") > more_than).alias("multi_resistant"), F.count("*").alias("total"))
        .where("multi_resistant > 0")
        .withColumn("ratio", F.col("multi_resistant") * 100.0 / F.col("total"))
        .orderBy("serotype", F.desc("period"))
    )


def serotype_share(view: DataFrame, serotypes: Sequence[str], intervals: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Isolates of the given serotypes and their percentage, by interval of years.

    Years outside every interval form the null interval. Serotypes compare without case.
    """
    bucket = F.coalesce(*[F.when(F.lower("serotype") == s.lower(), s) for s in serotypes], F.lit("Other"))
    interval = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(intervals.items())):
        interval = F.when(F.col("year").between(lo, hi), name).otherwise(interval)
    distinct = view.select("id", bucket.alias("serotype"), interval.alias("interval")).distinct()
    counts = [F.count_if(F.col("serotype") == s).alias(s) for s in serotypes]
    out = distinct.groupBy("interval").agg(*counts, F.count("*").alias("total"))
    for s in serotypes:
        out = out.withColumn(f"{s}_pct", F.col(s) * 100.0 / F.col("total"))
    return out


def recorded(rules: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rules that have attribute rows."""
    return rules.join(attributes.select("rule_id"), "rule_id", "left_semi")


def _qualified(prefix: str, limits: Mapping[str, float]) -> Column:
    out = F.lit(True)
    for m, t in limits.items():
        out = out & (F.col(f"{prefix}_{m}") >= t)
    return F.coalesce(out, F.lit(False))


def rule_change(before: DataFrame, after: DataFrame, limits: Mapping[str, float] = QUALIFY) -> DataFrame:
    """Rules met in both periods that qualify in one of them, with percent changes.

    Inputs hold `rule_id, association` and the measures. Both directions come
    from one join.
    """
    measures = ("real_support", "support", "confidence", "lift")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("association", F.col("rule_id").alias(f"{name}_rule_id"),
                         *[F.col(m).alias(f"{name}_{m}") for m in measures])

    joined = side(before, "before").join(side(after, "after"), "association")
    kept = joined.where(_qualified("before", limits) | _qualified("after", limits))
    for m, mark in MARKS.items():
        change = C.percent_change(F.col(f"before_{m}"), F.col(f"after_{m}"))
        kept = kept.withColumn(f"{m}_change", change).withColumn(f"{m}_mark", C.marked_percent(change, mark))
    return kept


def rule_types(attributes: DataFrame, classes: DataFrame, family: Sequence[str] = BETA_LACTAMS) -> DataFrame:
    """`rule_id, rule_type`: whether the tests of a rule come from more than one class, compared without case."""
    dim = classes.select(F.col("drug").alias("attr"), F.lower(merged_class(F.col("class"), family)).alias("class"))
    return (
        attributes.join(dim, "attr", "left")
        .groupBy("rule_id")
        .agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
        .select("rule_id", F.when(F.col("hi").isNull() | (F.col("hi") == F.col("lo")), "Intra_Class").otherwise("Cross_Class").alias("rule_type"))
    )


def rule_change_report(
    changes: DataFrame, types: DataFrame, about: str = "serotype", suffix: str = ":resistant"
) -> DataFrame:
    """Rules about the given text whose support changed markedly while the lift did not."""
    typed = changes.join(types, changes.before_rule_id == types.rule_id).withColumn(
        "association", F.replace(F.col("association"), F.lit(suffix), F.lit(""))
    )
    kept = typed.where(
        C.contains_text(F.col("association"), about)
        & F.contains(F.col("real_support_mark"), F.lit("* "))
        & ~F.contains(F.col("lift_mark"), F.lit("* "))
    )
    shown = [f"{p}_{m}" for m in ("real_support", "confidence", "lift") for p in ("before", "after")]
    shown += [f"{m}_mark" for m in ("real_support", "confidence", "lift")]
    return kept.groupBy("rule_type", "association").agg(*[F.max(c).alias(c) for c in shown])


def network_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Community and centrality of each node in both periods; inputs hold `node, community, degree_centrality`."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("node", F.col("community").alias(f"community_{name}"),
                         F.col("degree_centrality").alias(f"centrality_{name}"))

    joined = side(before, "before").join(side(after, "after"), "node", "full_outer")
    return joined.distinct().orderBy("community_before", "community_after", "node")
