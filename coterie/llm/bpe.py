"""BPE encoding and decoding.

A word is encoded without replaying merges. An Aho-Corasick automaton over the
vocabulary gives the longest token that starts at each place. From left to right
the longest token is taken if it may follow the token before it; else the next
shorter token is tried, and where none is left the token before is taken back.
Two tokens may follow each other if merging their joined text would give just
these two; that is decided once per pair by walking down both tokens' merges and
kept in a table. Every place is given up at most once, so the work is linear in
the word. The result is exactly that of the merges, because a row of tokens is the
merge result if and only if each neighbouring pair is.

Only tokens that the merges produce from their own text can occur in a result;
others are left out of the automaton.

Decoding lays every token's text in one buffer and finds it by an offset table.

The vocabulary file is read on the driver from the path given, and sent to the
executors; it has a fixed size (about 2 MB). Texts are cut into words a slice at a time
on their bytes, and equal words of a slice, told by a 64-bit hash, are encoded once.
Words are kept in a bounded table per Python worker as well, which changes the speed
only. Texts with special strings, or with characters other than ASCII and letters
below U+0300 (nothing there joins with what precedes it), take the plain way word by
word.

Defined cases: null text counts as empty and has no ids; special strings in a
text become their ids; repeated rows are encoded each for itself; an empty table
gives an empty result; further columns are ignored. Texts are taken whole. Very
long texts are spelled out in slices.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from coterie.llm.memory import lean
from coterie.llm.words import hashes_of

#: The vocabulary's splitting pattern and its mark for a word's end.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WORD_END = "</w>"

_END = "Ā"
_SLICE = 1 << 20
_SLICE_BYTES = 1 << 20
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
#: Class of each byte in the texts that are cut on their bytes; there, bytes above 0x7F belong to letters.
_CLASS = np.array(
    [
        _SPACE if b == 32 or 9 <= b <= 13 else _LETTER if b >= 128 or chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
        for b in range(256)
    ],
    np.uint8,
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_names() -> dict[str, str]:
    """The vocabulary's printable name of each byte, by the byte as a character."""
    plain = {c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255}
    names, spare = {}, 256
    for c in range(256):
        names[chr(c)] = chr(c) if c in plain else chr(spare)
        spare += c not in plain
    return names


class _Words(dict):
    """Encoded words, filled on demand and emptied when it has grown to its bound."""

    def __init__(self, encode, bound: int):
        super().__init__()
        self._encode, self._bound = encode, bound

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        if len(self) >= self._bound:
            self.clear()
        self[word] = ids
        return ids


class Coder:
    """Encodes and decodes with one vocabulary; see the module's text."""

    def __init__(self, content: bytes, bound: int = 250_000):
        data = json.loads(content)
        kind = [n["type"] for n in data["normalizer"]["normalizers"]]
        if data["model"]["type"] != "BPE" or data["model"].get("end_of_word_suffix") != WORD_END or kind != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the vocabulary file must be of the kind with word ends and lower case")
        self._content, self._library = content, None
        self._assigned: set[str] = set()
        self._simple = {c for c in map(chr, range(0x300)) if c.isascii() or regex.match(r"\p{L}", c) and regex.fullmatch(r"\p{L}", c.lower())}
        vocab: dict[str, int] = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self._special = special
        self._special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
        self._names = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for name, i in [*vocab.items(), *special.items()]:
            self._names[i] = name
        byte_of = {name: byte for byte, name in _byte_names().items()}

        def spelled(name: str) -> str:
            ends = name.endswith(WORD_END) and name != WORD_END
            body = name.removesuffix(WORD_END) if ends else name
            return "".join(byte_of[c] for c in body) + _END * ends

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self._text = {i: spelled(name) for name, i in vocab.items()}
        self._rank: dict[int, int] = {}  # of merged tokens; single bytes have none
        self._halves: dict[int, tuple[int, int]] = {}
        self._merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            i, pair = vocab[a + b], (vocab[a], vocab[b])
            if i not in self._rank:
                self._rank[i], self._halves[i] = rank, pair
            self._merged[pair] = i
        self._pair_rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(merges)))}
        self._follows: dict[int, bool] = {}
        self._single = {t: i for i, t in self._text.items() if i not in self._rank}
        self._automaton = ahocorasick.Automaton()
        self._length: dict[int, int] = {}
        own = {}
        for i, text in self._text.items():
            if self._by_merges(text) == [i]:
                own[text] = i
                self._length[i] = len(text)
                self._automaton.add_word(text, (len(text), i))
        self._automaton.make_automaton()
        self._own, self._widest = own, max(map(len, own))
        self._shorter: dict[int, int] = {}
        for text, i in own.items():
            cut = len(text) - 1
            while cut and text[:cut] not in own:
                cut -= 1
            self._shorter[i] = own[text[:cut]] if cut else -1
        self._packed = [struct.pack("<I", i) for i in range(len(self._names))]
        self._words = _Words(self._encode_word, bound // 4)
        self._chunks = _Words(self._encode_chunk, bound // 4)
        self._bound = bound
        self._recent: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self.width = 2 if len(self._names) <= 1 << 16 else 4
        self._spelling = _Spelling(self._names)
        self._decimals = _Spelling([str(i) for i in range(len(self._names))])

    def _by_merges(self, text: str) -> list[int]:
        """Merges replayed one by one; used once per vocabulary entry."""
        ids = []
        for k, c in enumerate(text):
            if c != _END:
                ids.append(self._single[c + _END if text[k + 1 : k + 2] == _END else c])
        while len(ids) > 1:
            rank, at = min((self._pair_rank.get(p, len(self._pair_rank) + 1), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if rank > len(self._pair_rank):
                break
            ids[at : at + 2] = [self._merged[ids[at], ids[at + 1]]]
        return ids

    def _may_follow(self, left: int, right: int) -> bool:
        """True if merging the joined text of both tokens gives just these two.

        No merge may join the right edge of the left token with the left edge of
        the right one before both edges are inside a larger token. Of the two
        tokens the one made by the later merge is opened first.
        """
        never = len(self._pair_rank) + 1
        left_until = right_until = never  # rank of the merge that hides this edge
        while True:
            joined = self._pair_rank.get((left, right))
            if joined is not None:
                # the merge of the left pair goes first where ranks are equal
                if joined < right_until and joined < left_until or joined == right_until and joined < left_until:
                    return False
            made_left, made_right = self._rank.get(left, -1), self._rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left_until, left = made_left, self._halves[left][1]
            elif made_right > made_left:
                right_until, right = made_right, self._halves[right][0]
            else:
                # equal merges: the left one is done first, so open the right one
                right_until, right = made_right, self._halves[right][0]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        fits = self._follows.get(key)
        if fits is None:
            if len(self._follows) >= 300_000:
                self._follows.clear()
            fits = self._follows[key] = self._may_follow(left, right)
        return fits

    def _encode_word(self, word: str) -> bytes:
        """Ids of one lower-case word, as little-endian 32-bit numbers."""
        text = (word if word.isascii() else word.encode().decode("latin-1")) + _END
        known = self._follows
        # longest matches from left to right; often each may follow the one before
        at, before, out = 0, -1, []
        for _, (length, token) in self._automaton.iter_long(text):
            if before >= 0 and not (known.get(before << 32 | token) or self._fits(before, token)):
                self._backtrack(text, out, at, self._shorter[token])
                break
            out.append(token)
            at += length
            before = token
        else:
            if at < len(text):  # the word's end alone is no token
                self._backtrack(text, out, at, -1)
        return b"".join([self._packed[t] for t in out])

    def _longest(self, text: str, at: int) -> int:
        for to in range(min(len(text), at + self._widest), at, -1):
            token = self._own.get(text[at:to])
            if token is not None:
                return token
        return -1

    def _backtrack(self, text: str, out: list[int], at: int, token: int) -> None:
        """Complete `out`, which covers the text up to `at`; `token` is the next to try there."""
        size = len(text)
        length_of, shorter, known = self._length, self._shorter, self._follows
        closed = set()
        while at < size:
            while token >= 0:
                if at + length_of[token] not in closed and (
                    not out or known.get(out[-1] << 32 | token) or self._fits(out[-1], token)
                ):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length_of[token]
                token = self._longest(text, at)
            else:
                closed.add(at)
                token = out.pop()
                at -= length_of[token]
                token = shorter[token]

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of text without white space."""
        if "<|" in chunk and any(s in chunk for s in self._special):
            parts = self._special_split.split(chunk)
            return b"".join(
                self._packed[self._special[p]] if p in self._special else self._plain(p) for p in parts if p
            )
        return self._plain(chunk)

    def _plain(self, chunk: str) -> bytes:
        if chunk.isascii():
            chunk = chunk.lower()
            if chunk.isalpha():
                return self._words[chunk]
            if chunk[:-1].isalpha():  # a letter word and one mark
                return self._words[chunk[:-1]] + self._words[chunk[-1]]
        elif not self._assigned.issuperset(chunk) and not self._all_assigned(chunk):
            return b"".join(map(self._words.__getitem__, self._newer(chunk)))
        else:
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return b"".join(map(self._words.__getitem__, SPLIT.findall(chunk)))

    def _all_assigned(self, chunk: str) -> bool:
        self._assigned.update(c for c in chunk if unicodedata.category(c) != "Cn")
        return self._assigned.issuperset(chunk)

    def _newer(self, chunk: str) -> list[str]:
        """Words of text with characters that this Python's Unicode tables lack, by the library's newer ones."""
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_str(self._content.decode())
        byte_of = {name: ord(byte) for byte, name in _byte_names().items()}
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))
        return [bytes(byte_of[c] for c in w).decode() for w, _ in words]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit numbers."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            chunks = regex.split(r"\p{White_Space}+", text)  # str.split() takes these four for white space too
            return b"".join(self._chunks[c] for c in chunks if c)
        return b"".join(map(self._chunks.__getitem__, text.split()))

    def encode_all(self, values: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        held: list[str] = []
        size = 0
        for text in values:
            if (text.isascii() or self._simple.issuperset(text)) and "<|" not in text and len(text) <= _SLICE_BYTES:
                held.append(text)
                size += len(text)
                if size >= _SLICE_BYTES:
                    yield from self._encode_slice(held)
                    held, size = [], 0
            else:
                yield from self._encode_slice(held)
                held, size = [], 0
                yield np.frombuffer(self.encode(text), "<u4")
        yield from self._encode_slice(held)

    def _of_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit of text, kept in two bounded tables: a full one is held until the next is full."""
        recent, before = self._recent, self._before
        found = [recent.get(u) for u in units]
        missing = [k for k, f in enumerate(found) if f is None]
        unknown = []
        for k in missing:
            found[k] = before.get(units[k])
            if found[k] is None:
                unknown.append(k)
        for k, ids in zip(unknown, self._encode_units([units[k] for k in unknown]), strict=True):
            found[k] = ids
        if len(recent) + len(missing) > self._bound:
            self._before, self._recent = recent, {}
        self._recent.update((units[k], found[k]) for k in missing)
        return found

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of units that are in no table."""
        return [self._encode_unit(u) for u in units]

    def _encode_unit(self, unit: str) -> bytes:
        return self._encode_word(unit) if unit.isascii() and unit.isalpha() else self._plain(unit)

    def _encode_slice(self, values: list[str]) -> Iterator[np.ndarray]:
        """Ids of each of some texts without special strings, whose characters are all simple."""
        raw = [t.encode() for t in values]
        blob = b"".join(raw)
        data = np.frombuffer(blob, np.uint8)
        offsets = np.cumsum([0, *map(len, raw)])
        kind = _CLASS[data]
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            cut[offsets] = True
            # an apostrophe that starts a run of marks and precedes a letter stays with it: 's, 't and so on
            lone = np.flatnonzero((data[:-1] == ord("'")) & cut[:-2] & (kind[1:] == _LETTER))
            cut[lone + 1] = False
            cut[offsets] = True
        bounds = np.flatnonzero(cut)
        words = np.flatnonzero(kind[bounds[:-1]] != _SPACE)
        starts, ends = bounds[words], bounds[words + 1]
        _, first, which = np.unique(hashes_of(data, starts, ends), return_index=True, return_inverse=True)
        folded = blob.lower()
        found = self._of_units([folded[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        each = np.array([len(f) // 4 for f in found], np.int64)
        ids = np.frombuffer(b"".join(found), "<u4")
        count = each[which]
        stop = np.cumsum(count)
        at = np.repeat((np.cumsum(each) - each)[which] - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)
        out = ids[at]
        upto = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            yield out[a:b]

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of the decoded text, in slices."""
        return self._spelling.of(ids)

    def decimal(self, ids: np.ndarray) -> Iterator[bytes]:
        """Decimal ids joined by one space, in slices."""
        return self._decimals.of(ids)


class LibraryCoder(Coder):
    """The same ids, with new words of plain letters merged by the tokenizers library.

    These words are cut already, so the library cuts them at white space only; it keeps no words of its own, as
    each comes once, and leaves out the places of tokens.
    """

    def __init__(self, content: bytes, bound: int = 250_000):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        super().__init__(content, bound)
        model = json.loads(content)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        kept = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges") and v is not None}
        self._tokenizer = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, **kept))
        self._tokenizer.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self._ends = np.array([name.endswith(WORD_END) for name in self._names])

    def _encode_units(self, units: list[str]) -> list[bytes]:
        plain = [u for u in units if u.isalpha()]  # simple letters: one word each
        found: dict[str, bytes] = {}
        for k in range(0, len(plain), 4096):
            words = plain[k : k + 4096]
            text = unicodedata.normalize("NFC", " ".join(words)).lower()
            ids = np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            found.update((w, raw[a:b]) for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True))
        return [found[u] if u in found else self._encode_unit(u) for u in units]


class _Spelling:
    """Texts of ids, each after a space, found by an offset table."""

    def __init__(self, names: list[str]):
        texts = [b" " + n.encode() for n in names]
        self._blob = np.frombuffer(b"".join(texts), np.uint8)
        self._size = np.array([len(t) for t in texts], np.int64)
        self._start = np.concatenate([[0], np.cumsum(self._size)[:-1]])

    def of(self, ids: np.ndarray) -> Iterator[bytes]:
        for k in range(0, len(ids), _SLICE):
            part = ids[k : k + _SLICE]
            size = self._size[part]
            ends = np.cumsum(size)
            at = np.repeat(self._start[part] - ends + size, size)
            at += np.arange(len(at))
            out = self._blob[at].tobytes()
            yield out[1:] if k == 0 else out


_coders: dict[tuple[bytes, type[Coder]], Coder] = {}


class Vocabulary:
    """A vocabulary file's content for the executors; small and of fixed size."""

    def __init__(self, spark: SparkSession, path: str | None = None, kind: type[Coder] = Coder):
        with open(path or default_path(), "rb") as f:
            content = f.read()
        self._key = hashlib.sha256(content).digest(), kind
        self._content = spark.sparkContext.broadcast(content)

    def coder(self) -> Coder:
        """The coder of this Python worker."""
        if self._key not in _coders:
            _coders[self._key] = self._key[1](self._content.value)
        return _coders[self._key]


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    for value in batch.column(column):
        yield value.as_py() or ""


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id, n_tokens, ids`; ids are little-endian 32-bit numbers."""
    vocabulary = Vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            ids = [i.tobytes() for i in coder.encode_all(texts(batch))]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return _narrow(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id, text` of encoded documents."""
    vocabulary = Vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            out = [b"".join(coder.decode(np.frombuffer(i.as_py() or b"", "<u4"))).decode() for i in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded["doc_id"], encoded["ids"]).mapInArrow(lean(run), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256`: each text encoded, then decoded from its ids."""
    vocabulary = Vocabulary(docs.sparkSession, path)

    def digest(parts: Iterator[bytes]) -> str:
        sha = hashlib.sha256()
        for p in parts:
            sha.update(p)
        return sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder()
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in coder.encode_all(texts(batch)):
                counts.append(len(ids))
                ids_sha.append(digest(coder.decimal(ids)))
                text_sha.append(digest(coder.decode(ids)))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _narrow(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"], docs["text"])
