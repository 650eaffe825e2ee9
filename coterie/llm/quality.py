"""Quality rules as a short-circuit cascade.

Every rule is a predicate over a document's measures that says "reject". Rules
run in the order of rejections per cost, both estimated on a sample, and a
document leaves the cascade at the first rule that rejects it. The order changes
the cost, never the verdict.

Defined cases: null or empty text has no words and is rejected by `few_words`;
repeated rows are judged each for itself; an empty table gives an empty result
(and keeps the stated order of the rules, as there is nothing to estimate from);
further columns pass through `kept_documents` unchanged and are not looked at.
Texts are taken whole; a row's own text bounds the memory.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.llm.columns import bind, words_of

#: Words of a repeated window.
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def worded_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return bind(worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside five-word windows that stand in the text twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. Only a text with
    equal windows is sorted to find their places; the places then cover runs of words.
    """

    def window(hashes: Column) -> Callable[[Column], Column]:
        return lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            def equal(p: Column, k: Column) -> Column:
                before, after = F.get(pairs, k - 1)["h"], F.get(pairs, k + 1)["h"]
                return F.coalesce(p["h"] == before, F.lit(False)) | F.coalesce(p["h"] == after, F.lit(False))

            return F.sort_array(F.transform(F.filter(pairs, equal), lambda p: p["i"]))

        def reach(places: Column) -> Column:
            gap = F.transform(places, lambda p, k: F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))
            return F.aggregate(gap, F.lit(0), lambda total, g: total + F.least(g, F.lit(WINDOW)))

        return bind(bind(placed, twice), reach)

    def repeats(windows: Column) -> Column:
        alike = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(alike, F.lit(0)).otherwise(covered(windows))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = bind(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), window(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(bind(windows, repeats)).cast("long")


#: Each measure of a document by name, from its text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: n_words(words),
    "word_chars": lambda text, words: word_chars(words),
    "n_symbols": lambda text, words: n_symbols(text),
    "n_dup_lines": lambda text, words: n_dup_lines(text),
    "n_lines": lambda text, words: F.size(worded_lines(text)).cast("long"),
    "n_repeat_words": lambda text, words: n_repeat_words(words),
}


@dataclass(frozen=True)
class Rule:
    """`rejects` gets a function from a measure's name to its column."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


BASE = ("few_words", "repeated_words")

#: The limits of the first two rules. The others are this library's own.
RULES = (
    Rule("few_words", lambda m: m("n_words") < 10),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 2 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("word_length", lambda m: ~m("word_chars").between(2 * m("n_words"), 25 * m("n_words"))),
)


def _lazy(text: Column, words: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text, words)


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000, seed: int = 7) -> list[Rule]:
    """The rules by rejections per second on a sample of at most `sample_rows` rows.

    The sample is written once; each rule then runs over it alone, twice, and the
    quicker run less the time of a plain scan is its cost. A rule that rejects
    nothing comes last, the cheapest first among such.
    """
    sample = settle(docs.select(docs["text"].alias("text")).sample(0.02, seed).limit(sample_rows))

    def timed(predicate: Column) -> tuple[float, int]:
        spent, hits = [], 0
        for _ in range(2):
            start = time.perf_counter()
            hits = sample.agg(F.coalesce(F.sum(predicate.cast("int")), F.lit(0)).alias("n")).head()["n"]
            spent.append(time.perf_counter() - start)
        return min(spent), hits

    if sample.isEmpty():
        return list(rules)
    text = F.col("text")
    plain, _ = timed(F.length(text) < 0)
    figures = {}
    for r in rules:
        seconds, hits = timed(first_rejection(text, [r]).isNotNull())
        figures[r.name] = (max(seconds - plain, 1e-3), hits)
    return sorted(rules, key=lambda r: (-figures[r.name][1] / figures[r.name][0], figures[r.name][0]))


def cascade(measure: Callable[[str], Column], rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null for a document to keep."""
    out = None
    for r in rules:
        hit = r.rejects(measure)
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def first_rejection(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The cascade as one expression over the text.

    Words are split once, and a rule's measures are computed only if every rule
    before it has let the document pass.
    """
    return bind(words_of(text), lambda words: cascade(_lazy(text, words), rules))


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The documents no rule rejects, with all their columns."""
    order = ordered_rules(docs, rules, sample_rows)
    return docs.filter(first_rejection(docs["text"], order).isNull())


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """`doc_id`, every measure, `base_failed` and `kept`, one row per row."""
    order = ordered_rules(docs, rules, sample_rows)
    text = docs["text"]

    def measures(words: Column) -> Column:
        return F.struct(*[f(text, words).alias(name) for name, f in MEASURES.items()])

    m = docs.select(docs["doc_id"].alias("doc_id"), bind(words_of(text), measures).alias("m")).select("doc_id", "m.*")
    base = cascade(F.col, [r for r in rules if r.name in BASE])
    return (
        m.withColumn("rejected_by", cascade(F.col, order))
        .withColumn("base_failed", base.isNotNull())
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("rejected_by")
    )
