"""License scans by diagonal voting.

Every text's rolling two-word hashes are joined to the places of the same hashes in
the license templates. A match votes for the diagonal "place in the text minus place
in the template". Votes are summed per diagonal; neighbouring diagonals that stand
close together are merged, which bridges inserted or lost words; a merged span is
verified by the share of the template's hashes it has met and by its length.

A phrase template stands in the text where one diagonal has all its votes: these are
the base places. Notice templates need `NOTICE_SHARE` of their votes.

The templates are a fixed list of some hundred hashes, the one side that is broadcast.
Votes are summed in the task that reads a text before anything is shuffled.

Defined cases: null text is empty and has no words; texts are taken whole; rows with
equal `doc_id` are scanned each for itself; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.llm.words import LETTERS, grams, hashed_words

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and their labels, after the published licenses' own words.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
    "the free software foundation": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
    "by the free software foundation": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}

K = 2
NOTICE_SHARE = 0.8
NEIGHBOURS = 2  # diagonals this near are merged


def _template_rows() -> list[tuple[int, int, int, bool, str, int]]:
    rows = []
    for number, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        _, _, hashes = next(hashed_words(pa.array([text]), LETTERS))
        found = grams(hashes, K).astype(np.int64)
        rows += [(int(g), number, at, number < len(PHRASES), label, len(found)) for at, g in enumerate(found)]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        _template_rows(), "gram long, template int, at long, phrase boolean, label string, size int"
    )


def rolling(docs: DataFrame) -> DataFrame:
    """`row, doc_id, place, gram, n_words`: every two-word hash, and one row at place -1 per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for first, bounds, hashes in hashed_words(batch.column("text"), LETTERS):
                count = np.diff(bounds)
                here = np.arange(first, first + len(count))
                of = np.repeat(here, count)
                place = np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], count)
                full = np.flatnonzero(place + K <= np.repeat(count, count))
                gram = grams(hashes, K)[full].astype(np.int64)
                of = np.concatenate([of[full], here])
                none = np.zeros(len(here), np.int64)
                yield pa.record_batch(
                    [
                        pa.array(of + row),
                        ids.take(pa.array(of)),
                        pa.array(np.concatenate([place[full], none - 1])),
                        pa.array(np.concatenate([gram, none])),
                        pa.array(np.concatenate([np.zeros(len(full), np.int64), count])),
                    ],
                    ["row", "doc_id", "place", "gram", "n_words"],
                )
            row += batch.num_rows

    plain = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return plain.mapInArrow(run, "row long, doc_id long, place long, gram long, n_words long")


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`, one row per row."""
    known = templates(docs.sparkSession)
    all_grams = rolling(docs)
    met = all_grams.join(F.broadcast(known), "gram", "left").filter(F.col("template").isNotNull() | (F.col("place") < 0))
    # a document's own row may meet a template's hash by chance: it never votes
    vote = F.when(F.col("place") >= 0, F.col("template"))
    votes = met.groupBy("row", "doc_id", vote.alias("template"), F.when(vote.isNotNull(), F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count(vote).alias("votes"),
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        F.max("n_words").alias("n_words"),
        F.first("phrase").alias("phrase"),
        F.first("label").alias("label"),
        F.first("size").alias("size"),
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(line) <= NEIGHBOURS) & (
        F.abs(F.col("first") - F.lag("last").over(line)) <= F.col("size")
    )
    spans = (
        votes.withColumn("start", F.when(F.col("template").isNull() | F.coalesce(near & ~F.col("phrase"), F.lit(False)), 0).otherwise(1))
        .withColumn("span", F.sum("start").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "doc_id", "template", "span")
        .agg(
            F.sum("votes").alias("votes"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.max("n_words").alias("n_words"),
            F.first("phrase").alias("phrase"),
            F.first("label").alias("label"),
            F.first("size").alias("size"),
        )
    )
    length = F.col("last") - F.col("first") + 1
    share = F.least(F.lit(1.0), F.col("votes") / F.greatest(F.col("size"), length))
    base = F.col("phrase") & (F.col("votes") == F.col("size"))
    noticed = ~F.col("phrase") & (share >= NOTICE_SHARE)
    found = spans.select(
        "row",
        "doc_id",
        F.when(F.col("template").isNull(), F.col("n_words")).alias("n_words"),
        F.when(base, F.col("first")).alias("base"),
        F.when(base, F.col("label")).alias("base_label"),
        F.when(base | noticed, F.col("label")).alias("found_label"),
        F.when(base, F.lit(1.0)).when(F.col("template").isNotNull(), share).otherwise(F.lit(0.0)).alias("share"),
    )

    def joined(column: str):
        return F.array_join(F.sort_array(F.collect_set(column)), ",")

    return found.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count("base").alias("n_base"),
        F.min("base").alias("first_word"),
        F.max("base").alias("last_word"),
        joined("base_label").alias("base_labels"),
        joined("found_label").alias("labels"),
        F.max("share").alias("score"),
    ).drop("row")
