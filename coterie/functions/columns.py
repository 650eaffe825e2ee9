"""Column expressions: cleaning, items, ordinal codes, text marks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# These decide results and must stay as they are.
EMPTY_TEXTS = ("", "na", "NA")
STATUS_CODES = {"susceptible": 1, "intermediate": 2, "SSD": 2, "resistant": 3}
ORDINAL_CODES = {
    "Gender": {"Female": 1, "Male": 2},
    "AgeGroup": {"Child": 1, "Adult": 18, "Senior": 65},
    "Status": STATUS_CODES,
}
FOCUS = ("resistant", "intermediate")
POSITIVE = "resistant"
RESERVED = ("status", "class", "drug")

# Statuses from least to most severe; SSD and intermediate share a code, so
# their order here only settles which text is reported.
SEVERITY_ORDER = ("susceptible", "SSD", "intermediate", "resistant")

NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def clean(col: Column, data_type: str = "string") -> Column:
    """The value as text, or null where it counts as empty."""
    if data_type in ("double", "float"):
        return F.when(~F.isnan(col), col.cast("string"))
    text = col.cast("string")
    return F.when(~text.isin(*EMPTY_TEXTS), text)


def first_match(col: Column, codes: Mapping[str, object]) -> Column:
    """The code of a text value by exact match, null when it has none."""
    out = None
    for text, code in codes.items():
        out = F.when(col == text, F.lit(code)) if out is None else out.when(col == text, F.lit(code))
    return F.lit(None) if out is None else out


def severity(col: Column) -> Column:
    """Ordinal code of a status; statuses outside the list count 0."""
    return F.coalesce(first_match(col, STATUS_CODES), F.lit(0))


def severity_rank(col: Column) -> Column:
    """Position in the severity order, used to keep one status per test."""
    ranks = {s: i + 1 for i, s in enumerate(SEVERITY_ORDER)}
    return F.coalesce(first_match(col, ranks), F.lit(0))


def number(col: Column) -> Column:
    """Plain decimal text as double, null for any other text."""
    return F.when(col.rlike(NUMBER), col.try_cast("double"))


def numeric_code(name: Column, value: Column, codes: Mapping[str, Mapping[str, int]]) -> Column:
    """Number of a value: the text itself, else the ordinal code of its variable."""
    out = number(value)
    for variable, table in codes.items():
        out = F.coalesce(out, F.when(name == variable, first_match(value, table).cast("double")))
    return out


def item(attr: Column, value: Column) -> Column:
    return F.concat_ws(":", attr, value)


def item_attr(text: Column) -> Column:
    return F.substring_index(text, ":", 1)


def item_value(text: Column) -> Column:
    """Everything after the first colon."""
    return F.when(F.instr(text, ":") > 0, text.substr(F.instr(text, ":") + F.lit(1), F.length(text)))


def recorded_value(text: Column) -> Column:
    """The value of an item as rule attributes record it: without quotes and further colons."""
    return F.regexp_replace(item_value(text), ": ?|['\"]", "")


def key_of(items: Column) -> Column:
    """Canonical text of an item set."""
    return F.array_join(F.sort_array(F.array_distinct(items)), " & ")


def list_text(items: Column, brackets: bool = True) -> Column:
    body = F.array_join(items, ", ")
    return F.concat(F.lit("["), body, F.lit("]")) if brackets else body


def dict_text(entries: Column) -> Column:
    """Text `name: value, name: value` of (name, value) structs."""
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(": ", e["name"], e["value"])), ", ")


def rule_text(antecedent: Column, consequent: Column, arrow: str = " -> ") -> Column:
    return F.concat(list_text(antecedent), F.lit(arrow), list_text(consequent))


def contains_all(items: Column, wanted: Column) -> Column:
    """True if every wanted item is among the items."""
    return F.size(F.array_except(wanted, items)) == 0


def rename(text: Column, changes: Mapping[str, str]) -> Column:
    """Ordered literal substitutions."""
    for old, new in changes.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def contains_text(col: Column, text: str) -> Column:
    """Case-insensitive containment, as the report predicates use it."""
    return F.contains(F.lower(col), F.lit(text.lower()))


def percent_change(before: Column, after: Column) -> Column:
    return F.try_divide((after - before) * F.lit(100.0), before)


def marked_percent(change: Column, limit: float) -> Column:
    """Truncated percentage text, starred beyond the limit."""
    mark = F.when(F.abs(change) > limit, F.lit("* ")).otherwise(F.lit(""))
    return F.concat(mark, change.try_cast("bigint").cast("string"), F.lit(" %"))


def percent_value(text: Column) -> Column:
    """Number of a percentage text such as '12.5 %'."""
    return number(F.regexp_replace(text, "[% ]", ""))


def text_in(col: Column, values: Iterable[str]) -> Column:
    return col.isin(*list(values))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
