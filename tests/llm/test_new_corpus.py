"""Prefix trie, whitening and token counts against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("coterie.llm")

from pyspark.sql import functions as F  # noqa: E402

from coterie.llm import bpe, jaccard, tokencount, trie, whitening  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"


def signed(digits):
    value = int(digits, 16)
    return value - (1 << 64) if value >= 1 << 63 else value


def brute_trie(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held[c].append((turn is not None, turn or 0, signed(sha[:16]), signed(sha[16:32]), role, text))
    original = {c: [t[4:] for t in sorted(v)] for c, v in held.items()}
    members = defaultdict(list)
    length = {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        turns = original.get(first, [])[:h] + original[c][h:]
        length[c] = len(turns)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[x] for x in children[node]) + own
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if length[c] == len(node)))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(node), parent, len(m), len(children[node]), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def trie_of(spark, rows, **settings):
    turns = spark.createDataFrame(rows, TURNS).withColumn("d", F.lit("x")).withColumn("total", F.lit(1)).repartition(3)
    return sorted(map(tuple, trie.prefix_trie(turns, **settings).collect()), key=str)


def test_trie_against_brute_force(spark):
    rnd = random.Random(2)
    texts = ["", "é", "x", "yy", None, "zzz"]
    rows = [
        (c, t, rnd.choice(["user", "assistant", None]), rnd.choice(texts))
        for c in range(-20, 60) if c % 7 for t in range(rnd.randint(1, 12))
    ]
    rows += [(c, t, "user", "common") for c in range(200, 300) for t in range(9)]
    rows += [(500, None, "a", "b"), (500, None, "a", "c"), (500, 1, "a", "b"), (500, 1, "a", "b"), (None, 1, "a", "b")]
    rows += [(2**63 - 1, 0, "q", "r"), (-(2**63), 0, "q", "r")]
    rows += [(c, t, "u", str(t)) for c in (1000, 1003) for t in range(700)]  # a hot conversation, and one that shares it
    want = brute_trie(rows)
    assert trie_of(spark, rows) == want
    assert trie_of(spark, rows, shard_nodes=20) == want  # cut into shards and an upper tree


def test_trie_of_conversations_cut_over_tasks(spark):
    rows = [(c, t, "u", f"{c // 2} {t}") for c in (5, 6, 7) for t in range(400)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_of(spark, rows, shard_nodes=50) == brute_trie(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_nothing_and_of_one(spark):
    assert trie_of(spark, []) == []
    one = [(5, None, None, None)]
    assert trie_of(spark, one) == brute_trie(one)
    assert len(trie_of(spark, one)) in (1, 2)


def test_ends_that_lie_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 100)
    ends = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 50).cast("int")).alias("d"),
        F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"), F.col("id").alias("conv_id"),
    )
    want = defaultdict(list)
    for i in range(20_000):
        want[7 if i % 3 == 0 else i % 50].append(str(i))
    got = {r["d"]: r["ends_sha256"] for r in trie._hashed_ends(ends.repartition(5)).collect()}
    assert got == {d: hashlib.sha256(",".join(v).encode()).hexdigest() for d, v in want.items()}


def test_slots_are_minimal_and_verified():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(-(1 << 62), 1 << 62, 5000), rnd.integers(0, 3, 5000)
    table = trie.SlotTable(a, b)
    assert sorted(table.slots.tolist()) == list(range(5000))
    assert (table.find(a, b) == table.slots).all()
    assert (table.find(a, b + 3) == -1).all()
    assert len(trie.SlotTable(a[:0], b[:0]).find(a[:2], b[:2])) == 2
    with pytest.raises(ValueError):
        trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_collisions_of_digests_are_seen(spark, monkeypatch):
    """With a hash that collides for the first seeds, a later seed is taken and the result is right."""
    real, seeds = trie._terms, []

    def weak(seed):
        seeds.append(seed)
        x, y = real(seed)
        return (x, y) if seed >= 2 else (F.pmod(x, F.lit(3)).cast("long"), F.lit(0).cast("long"))

    monkeypatch.setattr(trie, "_terms", weak)
    rows = [(c, t, "u", f"{c} {t % 3}") for c in range(0, 40, 5) for t in range(6)]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert max(seeds) >= 2


def whitened(spark, rows, kind="double", **settings):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("rows", F.lit("x")).withColumn("n", F.lit(0))
    return whitening.whiten(df.repartition(3), **settings).toPandas()


def brute_whitening(rows, wanted=32):
    """Ids, deviations and the spaces of the components as projections of rows."""
    x = np.array([np.floor(64 * np.array(v, float)).astype("i8") + 1_000_000 for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    keep = [k for k in range(min(wanted, len(values))) if values[k] > 1e-13 * values[0]]
    return np.square(n * x - sums).sum(axis=1), y @ axes[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


@pytest.mark.parametrize("shape", ["isotropic", "falling", "few rows"])
def test_whitening_against_a_full_decomposition(spark, shape):
    rnd = np.random.default_rng(3)
    n, d = {"isotropic": (400, 12), "falling": (200, 60), "few rows": (9, 20)}[shape]
    x = rnd.standard_normal((n, d)) * (np.geomspace(40, 0.5, d) if shape == "falling" else 3)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    deviations, want, explained = brute_whitening(rows, 10)
    got = whitened(spark, rows, wanted=10).sort_values(["vec_id", "component"])
    assert len(got) == want.size and (got["n"] == n).all()
    assert got["deviation"].to_numpy().reshape(want.shape)[:, 0].tolist() == deviations.tolist()
    mine = got["whitened"].to_numpy().reshape(want.shape)
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(want.shape)[0], explained, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10


def test_whitening_with_equal_deviations(spark):
    rows = [(k, [float(k % 2), float(k // 2 % 2), float(k // 4 % 2), 5.0]) for k in range(8)]
    got = whitened(spark, rows)
    assert len(got) == 24 and got["identity_error"].max() < 1e-12  # the fourth direction holds nothing
    assert np.allclose(got["explained"], 1 / 3)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [1.0]), (7, [1e30, 0.0])]
    good = [(None, [0.0, 1.0]), (8, [2.0, 5.0]), (8, [2.0, 5.0]), (9, [-1.0, 0.5])]
    got = whitened(spark, odd + good)
    assert len(got) == 8 and set(got["n"]) == {4}
    assert sorted(got["vec_id"].fillna(-1)) == [-1, -1, 8, 8, 8, 8, 9, 9]
    assert whitened(spark, odd[:5]).empty and whitened(spark, []).empty
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).empty  # nothing differs


def test_deviations_beyond_a_long_are_null():
    centre = whitening.Centre(2, np.array([0]))
    assert centre.deviations(np.array([[1 << 40], [3]])) == [None, 36]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def hard_texts():
    rnd = random.Random(1)

    def drawn(parts, n):
        return "".join(rnd.choice(parts) for _ in range(n))

    return [
        None, "", "a b c", "a" * 3000, "ab" * 2000, drawn("ab", 4000), drawn("abcdefghij'", 4000), drawn("!?.'-#", 4000),
        drawn("!'s re tll", 3000), "<|endoftext|>" * 400, drawn(["<|endoftext|>", "!", "a", "é", "é", "́", " ", "한", "İ", "Σ", "٣", "漢"], 4000),
        "́" * 2500, "e" + "̣́" * 1500, drawn("漢字仮名交", 4000), "한국" * 2000, drawn("가각", 3000),
        " " * 4000, "x " * 2000, drawn("0123456789", 3000), "Straße İstanbul " * 300, drawn("तमिल ि", 3000),
        "abc" * 900 + "!" * 900 + "abc" * 900, "͸" * 1500 + "a" * 900, drawn("\x1c\x1d ab", 2500), "'" * 2501 + "s" * 1500,
    ]


def test_token_counts_of_hard_texts(spark, library):
    texts = hard_texts()
    rows = [(k if k % 7 else None, x, "k", 3) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, block int")
    want = []
    for k, x in enumerate(texts):
        n = len(library.encode(x or "", add_special_tokens=False).ids)
        want.append((k if k % 7 else None, len((x or "").encode()), n, n > 2048))
    for chunk, overlap in ((512, 32), (2048, 100)):
        got = tokencount.count_tokens(docs, chunk=chunk, overlap=overlap).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_splices_are_proven_and_sum_up(library):
    """Every pair of common provable tokens splices exactly, wherever the text is cut."""
    with open(bpe.default_path(), "rb") as f:
        splicer = tokencount.Splicer(f.read())
    rnd = random.Random(4)
    alphabets = ["ab", "ab '", "!?'s", "aé́ ", "한ᄀ가 ", ["<|endoftext|>", "a", "!", " "], "İΣσ a", "12a "]
    found = 0
    for _ in range(300):
        text = "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(40, 160)))
        whole = library.encode(text, add_special_tokens=False).ids
        cut, lead = rnd.randint(20, len(text) - 1), 20
        n, _, left = splicer.encode(text[:cut], 0, lead)
        m, right, _ = splicer.encode(text[cut - lead :], lead, 0)
        right = {(end + cut - lead, i): drop for end, i, drop in right}
        for end, i, drop in left:
            if (end, i) in right:
                found += 1
                assert n + m - drop - right[end, i] == len(whole)
    assert found > 300


def test_token_counts_over_a_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, chunk=4096).collect()} == want
    assert tokencount.count_tokens(docs.filter("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        tokencount.count_tokens(docs, chunk=100)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 17])
def test_key_filter_drops_no_wanted_row(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    keys = spark.range(0, 60_000, 3).select(F.xxhash64("id").alias("key"))
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("key"))
    kept = {r["id"] for r in jaccard.KeyFilter(keys).passed(rows).collect()}
    assert kept >= set(range(0, 60_000, 3))
    if bits > 1 << 17:
        assert len(kept) < 20_000 + 400
    assert jaccard.KeyFilter(keys.filter("key IS NULL")).passed(rows).count() == 0
