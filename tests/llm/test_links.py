"""All links of the n-gram Jaccard join against brute force."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("coterie.llm")

from coterie.llm import jaccard, links  # noqa: E402


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    count = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                count[i] += 1
                count[j] += 1
    return sorted((rows[i][0] is None, rows[i][0] or 0, len(sets[i]), count[i]) for i in range(len(rows)))


def corpus(seed):
    """Groups of near copies of several sizes, a passage that many share, copies, short, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for size in (2, 5, 16):
        words = rng.choices(vocabulary, k=rng.randint(60, 200))
        for _ in range(size):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            cut = rng.randint(0, len(words) // 6)
            add(" ".join(changed[cut:]))
    for _ in range(15):
        add(" ".join(rng.choices(vocabulary, k=30)) + " " + passage + " " + " ".join(rng.choices(vocabulary, k=30)))
    for text in ("one two", "One  TWO", "one two three four five six", "", None, " \t", passage, passage, passage.upper()):
        add(text)
    rows.append((3, "one two"))
    rows.append((None, passage))
    return rows


@pytest.mark.parametrize("tile", [4, 2048])
def test_every_link_is_found(spark, tile):
    rows = corpus(4)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set_id string").repartition(5)
    out = links.all_links(df, tile)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.n_links) for r in out.counted().collect())
    assert got == brute(rows) and sum(r[3] > 2 for r in got) > 5
    pairs = [(r.a, r.b) for r in out.links.collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_no_documents_no_links(spark):
    out = links.all_links(spark.createDataFrame([], "doc_id long, text string"))
    assert out.links.count() == 0 and out.counted().count() == 0
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
