"""Entity panels: one row per transaction id, built from any number of long sources.

A source is a long table that shares the id column. Sources are stacked and
grouped by id once; each column keeps its distinct values in a set that is
combined before the shuffle, so a hot id costs no more than its vocabulary.
Everything later (long observations, transactions, baskets, profiles) is derived
from the panel without another shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import first_ids, settle

PREFIX = "attr__"
#: So many ids in scope are sent to every task at most; beyond, rows out of scope are dropped after the grouping.
SCOPE_IDS = 500_000


@dataclass(frozen=True)
class PanelSpec:
    """How to read transactions from the sources."""

    id_col: str = "id"
    target: str = "drug"
    status: str = "status"
    excluded: tuple[str, ...] = ()
    meta: tuple[str, ...] = ()
    reserved: tuple[str, ...] = C.RESERVED
    columns: Mapping[str, Sequence[str]] = field(default_factory=dict)
    entity: str | None = None
    condition: str = ""
    condition_is_per_id: bool = False
    cohorts: tuple[str, ...] = ()
    cohort_col: str = "cohort"
    #: Named row conditions on the entity: one panel then serves several runs, see `slice_of`.
    slices: Mapping[str, str] = field(default_factory=dict)
    holdout_condition: str = ""
    holdout_fraction: float = 0.0
    holdout_seed: int = 4
    limit: int | None = None


def attribute_columns(df: DataFrame, spec: PanelSpec, name: str) -> list[str]:
    """Columns of a source that become attributes."""
    wanted = list(spec.columns.get(name, ["*"]))
    names = df.columns if wanted == ["*"] else wanted
    dropped = {c.lower() for c in (spec.id_col, spec.target, *spec.excluded, *spec.meta, *spec.reserved)}
    return [c for c in names if c.lower() not in dropped]


def in_scope(spec: PanelSpec) -> Column:
    """Row predicate of the sampling condition and the cohort list."""
    cond = F.expr(spec.condition) if spec.condition.strip() else F.lit(True)
    if spec.cohorts and tuple(spec.cohorts) != ("All",):
        cond = cond & F.col(spec.cohort_col).isin(*spec.cohorts)
    return F.coalesce(cond, F.lit(False))


def has_scope(spec: PanelSpec) -> bool:
    return bool(spec.condition.strip()) or (bool(spec.cohorts) and tuple(spec.cohorts) != ("All",))


def text_literal(value: str) -> str:
    """A text as a literal of SQL conditions."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def scope_text(spec: PanelSpec) -> str:
    """The row predicate of `in_scope` as a condition text."""
    parts = [f"({spec.condition})"] if spec.condition.strip() else []
    if spec.cohorts and tuple(spec.cohorts) != ("All",):
        parts.append(f"`{spec.cohort_col}` IN ({', '.join(text_literal(c) for c in spec.cohorts)})")
    return " AND ".join(parts) or "true"


def _row_slices(spec: PanelSpec) -> Column:
    """Names of the slices whose condition a row of the entity meets."""
    names = [F.when(F.expr(cond), F.lit(name)) for name, cond in spec.slices.items()]
    return F.array_compact(F.array(*names))


def few_in_scope(sources: Mapping[str, DataFrame], spec: PanelSpec, entity: str, bound: int) -> Mapping[str, DataFrame]:
    """The sources with the ids in scope only, if no more than `bound` ids are.

    These ids are written and counted first; so few go to every task, and no other row reaches the
    shuffle. With more ids in scope the sources come back as they are: the scope is tested
    after the grouping, and the panel is the same. Null ids are kept as an id of their own.
    """
    ids = sources[entity].where(in_scope(spec)).select(F.col(spec.id_col).alias("__id")).distinct()
    few = settle(ids.limit(bound + 1))
    if few.count() > bound:
        return sources
    small = F.broadcast(few)
    return {n: df.join(small, df[spec.id_col].eqNullSafe(few["__id"]), "left_semi") for n, df in sources.items()}


def hash_bucket(id_col: Column, seed: int) -> Column:
    """A bucket 0..9999 that depends on the id and seed only."""
    digest = F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000


def _rows(df: DataFrame, spec: PanelSpec, name: str, is_entity: bool) -> DataFrame:
    types = dict(df.dtypes)
    out = [F.col(spec.id_col).alias("id")]
    lower = {c.lower(): c for c in df.columns}
    target, status = lower.get(spec.target.lower()), lower.get(spec.status.lower())
    if target and status:
        attr = C.clean(F.col(target), types[target])
        value = C.clean(F.col(status), types[status])
        # The digit in front sorts the most severe status of a test first.
        mark = F.concat((9 - C.severity_rank(value)).cast("string"), value)
        cell = F.struct(attr.alias("attr"), mark.alias("mark"))
        out.append(F.when(attr.isNotNull() & value.isNotNull(), cell).alias("target"))
    for c in attribute_columns(df, spec, name):
        out.append(C.clean(F.col(c), types[c]).alias(PREFIX + c.lower()))
    if is_entity:
        out.append(in_scope(spec).alias("scope"))
        if spec.slices:
            out.append(F.when(in_scope(spec), _row_slices(spec)).alias("slices"))
        if spec.holdout_condition.strip():
            out.append(F.coalesce(F.expr(spec.holdout_condition), F.lit(False)).alias("held"))
    return df.select(*out)


def _cells(column: str) -> Column:
    """A set of values as sorted (attr, value) entries."""
    name = F.lit(column[len(PREFIX):])
    return F.transform(F.sort_array(column), lambda v: F.struct(name.alias("attr"), v.alias("value")))


def panels(sources: Mapping[str, DataFrame], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """One row per selected id: `id, is_test, target, other`.

    `target` holds one (attr, value) per test, the most severe status winning;
    `other` holds every distinct (attr, value) of the remaining columns. Both
    are sorted by attribute and value. With slices, `slices` lists those that
    any entity row of the id is in; ids in none are left out.
    """
    entity = spec.entity or next(iter(sources))
    if has_scope(spec) and len(sources) > 1:
        sources = few_in_scope(sources, spec, entity, SCOPE_IDS)
    stacked = None
    for name, df in sources.items():
        if name == entity and spec.condition_is_per_id:
            # The caller states that the condition never differs between rows
            # of one id, so it may reach the scan.
            df = df.where(in_scope(spec))
        rows = _rows(df, spec, name, name == entity)
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)

    attrs = [c for c in stacked.columns if c.startswith(PREFIX)]
    sets = [F.collect_set(c).alias(c) for c in attrs]
    if "target" in stacked.columns:
        sets.append(F.collect_set("target").alias("target"))
    flags = [F.bool_or("scope").alias("scope")]
    if spec.holdout_condition.strip():
        flags.append(F.bool_or("held").alias("held"))
    if spec.slices:
        flags.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("slices")))).alias("slices"))
    grouped = stacked.groupBy("id").agg(*flags, *sets).where(F.col("scope"))
    if spec.slices:
        grouped = grouped.where(F.size("slices") > 0)

    if spec.holdout_condition.strip():
        is_test = F.coalesce(F.col("held"), F.lit(False))
    elif spec.holdout_fraction > 0:
        is_test = hash_bucket(F.col("id"), spec.holdout_seed) < F.lit(round(spec.holdout_fraction * 10000))
    else:
        is_test = F.lit(False)

    pair = "struct<attr:string,value:string>"
    if "target" in grouped.columns:
        by_severity = grouped.withColumn("target", F.sort_array("target"))
        first = F.filter(
            "target",
            lambda x, i: ~F.coalesce(F.get(F.col("target"), i - 1)["attr"] == x["attr"], F.lit(False)),
        )
        target = F.transform(
            first, lambda x: F.named_struct(F.lit("attr"), x["attr"], F.lit("value"), F.substring(x["mark"], 2, 1 << 30))
        )
    else:
        by_severity, target = grouped, F.array()
    other = F.concat(*[_cells(c) for c in sorted(attrs)]) if attrs else F.array()
    out = by_severity.select(
        "id",
        is_test.alias("is_test"),
        target.cast(f"array<{pair}>").alias("target"),
        other.cast(f"array<{pair}>").alias("other"),
        *(["slices"] if spec.slices else []),
    )
    return first_ids(out, spec.limit) if spec.limit else out


def slice_of(panel: DataFrame, name: str) -> DataFrame:
    """The panel of one slice: what a panel with the slice's condition would hold."""
    return panel.where(F.array_contains("slices", name)).drop("slices")


def distinct_ids(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Distinct ids of the entity that satisfy condition and cohorts, in order, capped."""
    ids = df.where(in_scope(spec)).select(F.col(spec.id_col).alias("id")).distinct()
    return (first_ids(ids, spec.limit) if spec.limit else ids).orderBy("id")


def observations(panel: DataFrame) -> DataFrame:
    """Long form `id, kind, attr, value`."""

    def tagged(kind: str) -> Column:
        return F.transform(
            kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["attr"].alias("attr"), x["value"].alias("value"))
        )

    return panel.select("id", F.inline(F.concat(tagged("target"), tagged("other"))))


def class_dimension(df: DataFrame) -> DataFrame:
    """One class per target; several classes settle on the largest text."""
    return (
        df.where(F.col("class").isNotNull())
        .select("drug", "class")
        .groupBy("drug")
        .agg(F.max("class").alias("class"))
    )


def variables(sources: Mapping[str, DataFrame], spec: PanelSpec = PanelSpec()) -> DataFrame:
    """`attr, entity`: which source each variable comes from, the last source winning."""
    spark = next(iter(sources.values())).sparkSession
    named: dict[str, str] = {}
    targets = None
    for i, (name, df) in enumerate(sources.items()):
        for c in attribute_columns(df, spec, name):
            named[c.lower()] = name
        lower = {c.lower(): c for c in df.columns}
        if spec.target.lower() in lower and spec.status.lower() in lower:
            found = (
                df.where(F.col(lower[spec.target.lower()]).isNotNull())
                .select(F.col(lower[spec.target.lower()]).cast("string").alias("attr"))
                .groupBy("attr")
                .agg(F.lit(i).alias("place"))
                .withColumn("entity", F.lit(name))
            )
            targets = found if targets is None else targets.unionByName(found)
    fixed = spark.createDataFrame(list(named.items()) or [("", "")], "attr string, entity string").where("attr <> ''")
    if targets is None:
        return fixed
    last = targets.groupBy("attr").agg(F.max_by("entity", "place").alias("entity"))
    return fixed.unionByName(last)
