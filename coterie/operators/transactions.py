"""Transactions, baskets and feature rows derived from panels without a shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import first_ids, scalar_of

MIN_TRANSACTIONS = 20
EMPTY_CELL_THRESHOLD = 0.999


def train(panel: DataFrame) -> DataFrame:
    return panel.where(~F.col("is_test"))


def test(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("is_test"))


def complete(panel: DataFrame) -> DataFrame:
    """Training panels with at least one test of any status."""
    return train(panel).where(F.size("target") > 0)


def transactions(panel: DataFrame) -> DataFrame:
    """`id, target map, other map of lists` of the given panels."""
    names = F.array_distinct(F.transform("other", lambda x: x["attr"]))
    lists = F.transform(
        names,
        lambda a: F.struct(
            a.alias("attr"),
            F.transform(F.filter("other", lambda x: x["attr"] == a), lambda x: x["value"]).alias("values"),
        ),
    )
    return panel.select(
        "id", F.map_from_entries("target").alias("target"), F.map_from_entries(lists).alias("other"), "is_test"
    )


def _items(entries: str | Column) -> Column:
    return F.transform(entries, lambda x: C.item(x["attr"], x["value"]))


def focused(focus: Sequence[str]) -> Column:
    """Target entries whose status is of interest; an empty focus keeps all."""
    if not focus:
        return F.col("target")
    return F.filter("target", lambda x: x["value"].isin(*focus))


def baskets(panel: DataFrame, focus: Sequence[str] = C.FOCUS) -> DataFrame:
    """`id, items`: focused tests and all other values, empty baskets dropped."""
    items = F.array_distinct(F.concat(_items(focused(focus)), _items("other")))
    return train(panel).select("id", items.alias("items")).where(F.size("items") > 0)


def empty_cell_filter(df: DataFrame, threshold: float = EMPTY_CELL_THRESHOLD) -> DataFrame:
    """Keep baskets whose share of the longest basket, plus the threshold, reaches 1."""
    longest = scalar_of(df, F.greatest(F.max(F.size("items")), F.lit(1)))
    return df.where(F.size("items") / longest + F.lit(threshold) >= 1)


def capped_baskets(df: DataFrame, limit: int) -> DataFrame:
    """The first baskets in id order."""
    return first_ids(df, limit)


def profiles(panel: DataFrame) -> DataFrame:
    """Complete transactions reduced to distinct panels with their number `n`."""
    return (
        complete(panel)
        .groupBy("target", "other")
        .agg(F.count("*").alias("n"))
        .withColumn("items", F.sort_array(F.array_distinct(F.concat(_items("target"), _items("other")))))
        .withColumn(
            "attrs",
            F.array_distinct(
                F.concat(F.transform("target", lambda x: x["attr"]), F.transform("other", lambda x: x["attr"]))
            ),
        )
    )


def alike(panel: DataFrame) -> DataFrame:
    """Panels reduced to distinct ones with their number `n`, training and test ids apart."""
    return panel.groupBy("is_test", "target", "other").agg(F.count("*").alias("n"))


# ---- numeric features -------------------------------------------------------


def _cell(feature: Column, value: Column) -> Column:
    return F.struct(feature.alias("feature"), value.cast("double").alias("value"))


def _other_features(codes: Mapping[str, Mapping[str, int]], domains: Mapping[str, Sequence[str]]) -> Column:
    """Numeric cells of the other attributes.

    A single value is a number, an ordinal code or an indicator; several values
    of one attribute are always indicators. A declared domain also states the
    zeros of its indicators.
    """
    names = F.transform("other", lambda x: x["attr"])

    def several(x: Column) -> Column:
        return F.size(F.filter(names, lambda a: a == x["attr"])) > 1

    def feature_cell(x: Column) -> Column:
        code = C.numeric_code(x["attr"], x["value"], codes)
        code = F.when(~several(x) & ~x["attr"].isin(*domains) if domains else ~several(x), code)
        indicator = F.concat(x["attr"], F.lit("("), x["value"], F.lit(")"))
        return _cell(F.when(code.isNull(), indicator).otherwise(x["attr"]), F.coalesce(code, F.lit(1.0)))

    cells = F.transform("other", feature_cell)
    def zero_cell(attr: str, value: str) -> Column:
        there = F.exists("other", lambda x: (x["attr"] == attr) & (x["value"] == value))
        return F.when(F.array_contains(names, attr) & ~there, _cell(F.lit(f"{attr}({value})"), F.lit(0.0)))

    zeros = [zero_cell(attr, value) for attr, values in domains.items() for value in values]
    return F.concat(cells, F.filter(F.array(*zeros), lambda z: z.isNotNull())) if zeros else cells


def _target_features(for_test: bool) -> Column:
    def coded(x: Column) -> Column:
        code = F.coalesce(C.number(x["value"]), C.first_match(x["value"], C.STATUS_CODES).cast("double"))
        if for_test:
            return F.when(code.isNotNull(), _cell(x["attr"], code))
        indicator = F.concat(x["attr"], F.lit("("), x["value"], F.lit(")"))
        return _cell(F.when(code.isNull(), indicator).otherwise(x["attr"]), F.coalesce(code, F.lit(1.0)))

    return F.filter(F.transform("target", coded), lambda z: z.isNotNull())


def labelled_rows(
    panel: DataFrame,
    focus: Sequence[str] = C.FOCUS,
    domains: Mapping[str, Sequence[str]] | None = None,
    codes: Mapping[str, Mapping[str, int]] = C.ORDINAL_CODES,
    for_test: bool = False,
) -> DataFrame:
    """`id, label_attr, label, features`: one row per label target of a panel; of `alike` panels `n` in place of the id.

    Training rows take the focused statuses as labels, test rows every status.
    The label's own column never is one of its features.
    """
    rows = (test(panel) if for_test else train(panel)).where(F.size("target") > 0)
    key = "n" if "n" in panel.columns else "id"
    rows = rows.select(
        key,
        (F.col("target") if for_test else focused(focus)).alias("labels"),
        F.concat(_other_features(codes, domains or {}), _target_features(for_test)).alias("cells"),
    )
    rows = rows.select(key, "cells", F.explode("labels").alias("l"))
    # The label's test appears as `attr`, or as `attr(value)` when it has no code.
    own = F.filter(
        "cells",
        lambda z: (z["feature"] != F.col("l.attr"))
        & (z["feature"] != F.concat(F.col("l.attr"), F.lit("("), F.col("l.value"), F.lit(")"))),
    )
    return rows.select(key, F.col("l.attr").alias("label_attr"), C.item(F.col("l.attr"), F.col("l.value")).alias("label"), own.alias("features"))


def feature_rows(rows: DataFrame) -> DataFrame:
    """Long form `id, label, feature, value` of labelled rows."""
    return rows.select("id", "label", F.inline("features"))
