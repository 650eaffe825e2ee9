"""Chat formatting: roles drive a finite-state machine, a template gives the marks.

Each role of a `Template` is a state; its `after` lists the states it may follow
("" is the start). A conversation's turns are taken in order of `turn` (ties by
role, then text), checked against the machine, and written as

    open mark, escaped text, end mark

per turn. Characters that begin a mark never stand in an escaped text, so marks
inside texts cannot be taken for the template's, and `read_back` restores every
turn from the formatted text alone.

Defined cases: null text and null role count as empty; a role the template does
not know is written with its own name and makes the conversation invalid; an
empty table gives an empty result; repeated rows are turns of their own; null
`conv_id` is one conversation. Extra columns are ignored. A conversation is one
output row, so its own size bounds the memory of a task, nothing else does.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.llm.columns import bind


@dataclass(frozen=True)
class Role:
    open: str
    after: tuple[str, ...]
    loss: bool = False
    last: bool = True


def _default_roles() -> dict[str, Role]:
    return {
        "system": Role("[SYS] ", ("",), last=False),
        "user": Role("[INST] ", ("", "system", "assistant")),
        "assistant": Role("[/INST] ", ("user", "tool"), loss=True),
        "tool": Role("[TOOL] ", ("assistant",), last=False),
    }


@dataclass(frozen=True)
class Template:
    roles: Mapping[str, Role] = field(default_factory=_default_roles)
    end: str = "</s>"
    #: around the name of a role the template does not know
    other: tuple[str, str] = ("[ROLE=", "]")
    escape: str = "\\"

    def __post_init__(self):
        marks = [*(r.open for r in self.roles.values()), self.end, *self.other]
        opens = [*(r.open for r in self.roles.values()), self.other[0]]
        if not all(marks) or any(m.startswith(self.escape) for m in marks):
            raise ValueError("marks must not be empty or begin with the escape character")
        if any(a != b and b.startswith(a) for a in opens for b in opens) or len(set(opens)) < len(opens):
            raise ValueError("no opening mark may begin another")
        if any(self.end[0] in m for m in opens):
            raise ValueError("the first character of the end mark must not stand in an opening mark")

    @property
    def codes(self) -> list[tuple[str, str]]:
        """Escaped character and code, in the order of escaping."""
        first = sorted({m[0] for m in [*(r.open for r in self.roles.values()), self.end, *self.other]})
        return [(c, f"{self.escape}{i}") for i, c in enumerate([self.escape, *first])]


def escaped(text: Column, template: Template) -> Column:
    for plain, code in template.codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for plain, code in reversed(template.codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _by_role(role: Column, values: Mapping[str, object], other: Column) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(role == name, F.lit(value)) if out is None else out.when(role == name, F.lit(value))
    return other if out is None else out.otherwise(other)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """`conv_id, n_turns, valid, first_bad_turn, segments, formatted`.

    `segments` is an array of (text, loss) whose texts, joined, are `formatted`.
    `first_bad_turn` is the position (from 0) of the first turn the machine does not
    accept, the number of turns if only the last state may not end a conversation,
    else null.
    """
    t = template or Template()
    row = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    steps = F.array(*[F.lit(f"{state}\0{name}") for name, r in t.roles.items() for state in r.after])
    ends = F.array(*[F.lit(name) for name, r in t.roles.items() if r.last])

    def bad(turns: Column) -> Column:
        def refused(turn: Column, i: Column) -> Column:
            state = F.coalesce(F.get(turns, i - 1)["role"], F.lit(""))
            return F.when(~F.array_contains(steps, F.concat(state, F.lit("\0"), turn["role"])), i)

        first = F.array_min(F.transform(turns, refused))
        open_end = F.when(~F.array_contains(ends, F.element_at(turns, -1)["role"]), F.size(turns))
        return F.coalesce(first, open_end)

    def pieces(turn: Column) -> Column:
        name = F.concat(F.lit(t.other[0]), escaped(turn["role"], t), F.lit(t.other[1]))
        opening = _by_role(turn["role"], {n: r.open for n, r in t.roles.items()}, name)
        loss = _by_role(turn["role"], {n: r.loss for n, r in t.roles.items()}, F.lit(False))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(turn["text"], t).alias("text"), loss.alias("loss")),
            F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
        )

    checked = grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        bind(F.col("turns"), bad).cast("long").alias("first_bad_turn"),
        F.flatten(F.transform("turns", pieces)).alias("segments"),
    )
    return checked.select(
        "conv_id",
        "n_turns",
        F.col("first_bad_turn").isNull().alias("valid"),
        "first_bad_turn",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) restored from a formatted conversation."""
    t = template or Template()

    def turn(piece: Column) -> Column:
        def rest(mark: str) -> Column:
            return F.substr(piece, F.lit(len(mark) + 1))

        def known(name: str, r: Role) -> Column:
            return F.struct(F.lit(name).alias("role"), unescaped(rest(r.open), t).alias("text"))

        head, tail = t.other
        body = rest(head)
        at = F.instr(body, tail)
        role = unescaped(F.substr(body, F.lit(1), at - 1), t)
        text = unescaped(F.substr(body, at + len(tail)), t)
        out = None
        for name, r in t.roles.items():
            begins = F.startswith(piece, F.lit(r.open))
            out = F.when(begins, known(name, r)) if out is None else out.when(begins, known(name, r))
        other = F.struct(role.alias("role"), text.alias("text"))
        return other if out is None else out.otherwise(other)

    # the text ends with an end mark, so the last piece is empty
    whole = F.split(formatted, re.escape(t.end))
    return F.transform(F.slice(whole, 1, F.size(whole) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order."""
    t = template or Template()
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescaped(s["text"], t)), "")
