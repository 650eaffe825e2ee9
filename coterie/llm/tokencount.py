"""Token counts, with huge texts encoded in overlapping chunks.

A text of at most `chunk` characters is encoded whole. A longer one is cut into blocks of
that size, and each block is encoded on its own, with offsets, behind a lead: the `overlap`
characters before it. Blocks are rows, so the blocks of one text are spread over tasks.

Two neighbours are spliced behind a token that both have at the same place with the same
id: tokens up to it are the left block's, those behind it the right one's. Such a token
proves the splice where the character behind it cannot join with what precedes it in
normal form C (no block's normal form then reaches across), it does not touch the left
block's end, and either

- it ends a word: words are cut from left to right, so from there on both blocks cut alike, or
- it lies within a word that holds letters only, or ASCII marks only, on both sides: such a
  word reaches to the end of its run, and a row of tokens is what the merges give if and
  only if each neighbouring pair is; each pair of the spliced row is one of either block.

Special strings are shorter than any overlap, so a block's edge cuts none that its
neighbour does not see whole, and a token that overlaps one is in one block only.

Where no common token proves a splice, the lead is widened to `chunk / 16` characters; where that
fails as well, the two neighbours become one block that begins where the left one did, and
all is tried again for that text. The last resort is the text as a whole, so every count is
exactly that of the whole text. The number of tokens is the sum over blocks less
what the splices drop on either side: additions only, no text is gathered again.

The first pass writes the counts of ordinary texts and the blocks of long ones to the shared folder,
so later rounds read blocks only and a lost executor costs its tasks.

Defined cases: a null text counts as empty (no bytes, no tokens); special strings in a text
are their own tokens; repeated rows and repeated or null ids are counted row by row; an
empty table gives an empty result; further columns are ignored. A single row's text is
bounded by what Spark puts in a row.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.llm import bpe
from coterie.llm.memory import lean

CHUNK = 65_536
OVERLAP = 256
LIMIT = 2048

_FIRST = "key long, doc_id long, n_bytes long, n_tokens long, block int, start long, lead string, text string, more boolean"
_ENDS = "key long, cut int, side string, at long, id int, n long"


def joins_before(c: str) -> bool:
    """True if normal form C may join or reorder a character with what precedes it."""
    if c < "̀":
        return False
    return unicodedata.combining(c) != 0 or c in _seconds() or unicodedata.category(c) == "Cn"


@cache
def _seconds() -> frozenset[str]:
    """Characters that stand second in a canonical pair, and the later letters of Hangul syllables."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0xC0, 0x30000))
    seconds = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in range(0x1160, 0x1200)})


class Splicer:
    """Encodes blocks and finds the tokens behind which they may be spliced."""

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(content.decode())
        self._library.no_truncation()
        self._library.no_padding()
        data = json.loads(content)
        names = {i: name for name, i in data["model"]["vocab"].items()}
        special = {t["id"] for t in data["added_tokens"]}
        self._ends = np.zeros(max([*names, *special]) + 1, bool)
        self._ends[[i for i, name in names.items() if i in special or name.endswith(bpe.WORD_END)]] = True
        self._ends[list(special)] = True

    def encode(self, text: str, lead: int, tail: int) -> tuple[int, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The number of tokens; provable tokens in the first `lead` and in the last `tail` characters.

        Each as (end, id, tokens to drop on this side if spliced behind it).
        """
        got = self._library.encode(text, add_special_tokens=False)
        ids, spans, words = got.ids, got.offsets, got.word_ids
        starts = [a for a, _ in spans]
        pure: dict[int, bool] = {}

        def one_run(word: int | None, k: int) -> bool:
            if word is None:
                return False
            if word not in pure:
                first = last = k
                while first and words[first - 1] == word:
                    first -= 1
                while last + 1 < len(words) and words[last + 1] == word:
                    last += 1
                run = text[spans[first][0] : spans[last][1]]
                letters = run.isalpha() and len(run.lower()) == len(run)
                pure[word] = letters or run.isascii() and not any(c.isalnum() or c.isspace() for c in run)
            return pure[word]

        def provable(k: int) -> bool:
            end = spans[k][1]
            if end >= len(text) or k + 1 < len(ids) and spans[k + 1][0] < end or joins_before(text[end]):
                return False
            return bool(self._ends[ids[k]]) or one_run(words[k], k)

        head = [(spans[k][1], ids[k], k + 1) for k in range(bisect.bisect_left(starts, lead)) if spans[k][1] <= lead and provable(k)]
        low = bisect.bisect_left(starts, len(text) - tail) if tail else len(ids)
        rest = [(spans[k][1], ids[k], len(ids) - k - 1) for k in range(low, len(ids)) if provable(k)]
        return len(ids), head, rest


def _first_pass(docs: DataFrame, path: str | None, chunk: int) -> DataFrame:
    """Counts of ordinary texts, blocks of long ones."""
    vocabulary = bpe.Vocabulary(docs.sparkSession, path, bpe.LibraryCoder)
    names = [f.split(" ")[0] for f in _FIRST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def rows(*columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
            texts = list(bpe.texts(batch))
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            counts = [len(i) for i in coder.encode_all(texts[k] for k in short)]
            none = [None] * len(short)
            yield rows([keys[k] for k in short], [ids[k] for k in short], [sizes[k] for k in short], counts, none, none, none, none, none)
            for k, text in enumerate(texts):
                for block, at in enumerate(range(0, len(text), chunk) if len(text) > chunk else ()):
                    lead = text[max(0, at - chunk // 16) : at]
                    more = at + chunk < len(text)
                    yield rows([keys[k]], [ids[k]], [sizes[k]], [None], [block], [at], [lead], [text[at : at + chunk]], [more])

    keyed = docs.select(F.monotonically_increasing_id().alias("key"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return keyed.mapInArrow(lean(run), _FIRST)


def _measured(pieces: DataFrame, path: str | None) -> DataFrame:
    """A row with the number of tokens per piece (`side` null) and one per provable token near a cut."""
    vocabulary = bpe.Vocabulary(pieces.sparkSession, path, Splicer)
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splicer = vocabulary.coder()
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                n, head, rest = splicer.encode(r["text"], r["lead"], r["tail"])
                base = r["start"] - r["lead"]
                out = [(r["key"], r["last"], None, None, None, n)]
                out += [(r["key"], r["first"] - 1, "right", base + end, i, drop) for end, i, drop in head]
                out += [(r["key"], r["last"], "left", base + end, i, drop) for end, i, drop in rest]
                columns = zip(*out, strict=True)
                names = ["key", "cut", "side", "at", "id", "n"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    # a piece a batch row at a time: a text is never held twice
    return pieces.mapInArrow(lean(run), _ENDS)


def _pieces(blocks: DataFrame, cuts: DataFrame | None, overlap: int) -> DataFrame:
    """`key, first, last, start, lead, tail, text`: blocks behind their leads, joined where a cut was given up.

    `cuts` has the width of each cut between two blocks, 0 where they are one piece.
    """
    if cuts is None:
        lead = F.when(F.col("block") > 0, F.least(F.lit(overlap), F.length("lead"))).otherwise(0)
        return blocks.select(
            "key",
            F.col("block").alias("first"),
            F.col("block").alias("last"),
            "start",
            lead.alias("lead"),
            F.when(F.col("more"), F.lit(overlap)).otherwise(0).alias("tail"),
            F.concat(F.right("lead", lead), "text").alias("text"),
        )
    before = cuts.select("key", (F.col("cut") + 1).alias("block"), F.col("width").alias("before"))
    after = cuts.select("key", F.col("cut").alias("block"), F.col("width").alias("after"))
    held = blocks.join(before, ["key", "block"], "left").join(after, ["key", "block"], "left")
    in_text = Window.partitionBy("key").orderBy("block")
    places = held.select("key", "block", F.sum(F.when(F.col("before") == 0, 0).otherwise(1)).over(in_text).alias("piece"))
    parts = F.sort_array(F.collect_list(F.struct("block", "start", "before", "after", "lead", "text")))
    whole = held.join(places, ["key", "block"]).groupBy("key", "piece").agg(parts.alias("parts"))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    whole = whole.withColumn("lead", F.coalesce(F.least(first["before"], F.length(first["lead"])), F.lit(0)))
    return whole.select(
        "key",
        first["block"].alias("first"),
        last["block"].alias("last"),
        first["start"].alias("start"),
        "lead",
        F.coalesce(last["after"], F.lit(0)).alias("tail"),
        F.concat(F.right(first["lead"], F.col("lead")), F.array_join(F.col("parts")["text"], "")).alias("text"),
    )


def _spliced(ends: DataFrame) -> DataFrame:
    """`key, cut, dropped`: the first proven splice of each cut."""

    def side(name: str) -> DataFrame:
        return ends.filter(F.col("side") == name).select("key", "cut", "at", "id", F.col("n").alias(name))

    common = side("left").join(side("right"), ["key", "cut", "at", "id"])
    return common.groupBy("key", "cut").agg(F.min_by(F.col("left") + F.col("right"), "at").alias("dropped"))


def _long_counts(blocks: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame | None:
    """`key, n_tokens` of the texts that were cut."""
    done: DataFrame | None = None
    # `width` of each cut: characters of the lead; 0 where both sides became one piece
    open_cuts = blocks.filter("more").select("key", F.col("block").alias("cut"), F.lit(overlap).alias("width"))
    rounds = 0
    while True:
        pieces = _pieces(blocks, open_cuts if rounds else None, overlap)
        ends = settle(_measured(pieces.repartition("key", "first"), path))
        spliced = settle(_spliced(ends))
        failed = settle(open_cuts.filter("width > 0").join(spliced, ["key", "cut"], "left_anti"))
        total = ends.filter(F.col("side").isNull()).select("key", "n")
        total = total.unionByName(spliced.select("key", (-F.col("dropped")).alias("n")))
        again = failed.select("key").distinct()
        counts = total.join(again, "key", "left_anti").groupBy("key").agg(F.sum("n").alias("n_tokens"))
        done = counts if done is None else done.unionByName(counts)
        if failed.isEmpty():
            return done
        wider = F.when(F.col("width") < chunk // 16, chunk // 16).otherwise(0)
        kept = open_cuts.join(again, "key", "left_semi").join(failed.select("key", "cut", F.lit(True).alias("bad")), ["key", "cut"], "left")
        open_cuts = settle(kept.select("key", "cut", F.when(F.col("bad"), wider).otherwise(F.col("width")).cast("int").alias("width")))
        blocks = blocks.join(again, "key", "left_semi")
        rounds += 1


def count_tokens(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of every row; see the module's text."""
    if not 32 <= overlap <= chunk // 16:
        raise ValueError("the overlap must have 32 characters or more, and a sixteenth of a chunk at most")
    first = settle(_first_pass(docs, path, chunk))
    blocks = first.filter(F.col("block").isNotNull())
    over: Column = (F.col("n_tokens") > limit).alias("over_limit")
    short = first.filter(F.col("block").isNull()).select("doc_id", "n_bytes", "n_tokens", over)
    if blocks.isEmpty():
        return short
    counts = _long_counts(blocks.select("key", "block", "start", "lead", "text", "more"), path, chunk, overlap)
    long = blocks.filter("block = 0").select("key", "doc_id", "n_bytes").join(counts, "key")
    return short.unionByName(long.select("doc_id", "n_bytes", "n_tokens", over))
