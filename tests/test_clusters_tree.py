import itertools
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from coterie.functions import blocks
from coterie.functions.frames import settle
from coterie.operators import clusters as K
from coterie.operators import transactions as T
from coterie.operators import tree
from coterie.sources import panels as P


def panel(spark, rows, **options):
    df = spark.createDataFrame(rows, "id int, drug string, status string, s string")
    return P.panels({"v": df}, P.PanelSpec(**options))


def naive_ward(points):
    """`(height, leaves)` of every merge, by joining the closest pair of all pairs each time.

    Exact fractions; equal distances go by the smaller, then the larger of both smallest leaf keys.
    """
    groups = [(key, frozenset([key]), [Fraction(x) * Fraction(w) for x in c], Fraction(w)) for key, c, w in points]
    out = []
    while len(groups) > 1:
        best = min(
            (wa * wb / (wa + wb) * sum((x / wa - y / wb) ** 2 for x, y in zip(a, b, strict=True)), *sorted((ka, kb)))
            for i, (ka, _, a, wa) in enumerate(groups) for kb, _, b, wb in groups[:i]
        )
        (ka, la, a, wa), (_, lb, b, wb) = (next(g for g in groups if g[0] == k) for k in best[1:])
        groups = [g for g in groups if g[0] not in best[1:]] + [(ka, la | lb, [x + y for x, y in zip(a, b, strict=True)], wa + wb)]
        out.append((float(best[0]), la | lb))
    return out


def leaf_sets(merges):
    """`(height, leaves)` of every merge of a log."""
    rows = {r.node: r for r in merges.collect()}

    def leaves(node):
        return leaves(rows[node].left) | leaves(rows[node].right) if node in rows else frozenset([node])

    assert all(r.leaves == len(leaves(n)) for n, r in rows.items())
    return [(r.d2, leaves(n)) for n, r in rows.items()]


def as_points(spark, points):
    return spark.createDataFrame([(k, w, c) for k, c, w in points], "node string, size double, vector array<double>")


def same_tree(got, want):
    got, want = ({leaves: height for height, leaves in x} for x in (got, want))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def drawn_points(kind, n):
    rng = random.Random(4)
    if kind == "spread":
        return [(f"p{i:03}", [rng.random() * 10 for _ in range(3)], float(rng.randint(1, 5))) for i in range(n)]
    # small whole numbers: most distances are tied
    every = rng.sample(list(itertools.product(range(4), repeat=4)), n)
    return [(",".join(map(str, c)), [float(x) for x in c], float(rng.choice([1, 1, 1, 2, 40]))) for c in every]


@pytest.mark.parametrize("kind", ["spread", "tied"])
def test_ward_tree_for_several_block_sizes(spark, kind):
    points = drawn_points(kind, 40)
    want = naive_ward(points)
    df = settle(as_points(spark, points))
    for block in (1000, 22):
        merges = K.ward_merges(df, block)
        same_tree(leaf_sets(merges), want)
    heights = [r.distance for r in K.merge_tree(merges).orderBy("step").collect()]
    assert heights == sorted(heights) and len(heights) == 39
    assigned = K.cut_tree(df, merges, 4).collect()
    assert len(assigned) == 40 and {r.cluster for r in assigned} == {0, 1, 2, 3}


def test_ward_with_far_more_blocks_than_are_looked_at_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(K, "NEAR_BLOCKS", 1)
    points = drawn_points("tied", 16)
    same_tree(leaf_sets(K.ward_merges(as_points(spark, points), 5)), naive_ward(points))


def test_blocks_merge_only_what_is_proven():
    def cluster(key, x, block=0):
        return {"block": block, "key": key, "node": key, "size": 1.0, "leaves": 1, "sums": [x], "height": 0.0, "level": 0}

    block = pd.DataFrame([cluster("a", 0.0), cluster("b", 1.0), cluster("c", 5.0), cluster("d", 6.5)])
    near = pd.DataFrame({"boxes": [[{"least": 1.0, "low": [7.0], "high": [9.0]}]], "cap": [np.inf]})
    out = blocks.merge_within(block, near)
    assert set(out[out["left"].notna()]["node"]) == {"m:b"}  # d may be nearer to the box than to c
    assert sorted(out[out["alive"]]["key"]) == ["a", "c", "d"]
    assert len(blocks.merge_within(block, near.assign(cap=0.1))) == 4
    whole = blocks.merge_within(block, pd.DataFrame())
    assert whole["left"].notna().sum() == 3 and whole["alive"].sum() == 1


def test_ward_separates_plain_groups(spark):
    rows = []
    for i in range(30):
        status = ("resistant", "susceptible")[i % 2]
        rows += [(i, "A", status, "x"), (i, "B", status, "x")]
    p = panel(spark, rows)
    names = K.target_names(p)
    assigned = K.ward_clusters(K.status_vectors(p, names), k=2).collect()
    assert len({(r.label, r.cluster) for r in assigned}) == 2
    assert {r.label for r in assigned} == {"[A, B]", "[All susceptible]"}


def test_one_profile_is_one_cluster(spark):
    p = panel(spark, [(1, "A", "resistant", "x"), (2, "A", "resistant", "x")])
    assert {r.cluster for r in K.ward_clusters(K.status_vectors(p, ["A"])).collect()} == {0}


def test_any_text_may_be_a_name(spark):
    rows = [(i, n, ("resistant", "susceptible")[i % 2], "a.b") for i in range(6) for n in ("x.y", "id", "`q`", "Label", "label")]
    p = panel(spark, rows)
    names = K.target_names(p)
    assert {r.cluster for r in K.ward_clusters(K.status_vectors(p, names), k=2).collect()} == {0, 1}
    base = K.attribute_profiles(p, ["s"])
    assert [r.vector for r in K.indicator_vectors(base, ["sa.b", "none"]).collect()] == [[1.0, 0.0]] * 3


def test_status_profiles(spark):
    p = panel(spark, [(1, "B", "resistant", "x"), (1, "A", "SSD", "x"), (2, "A", "susceptible", "y")])
    got = {r.id: (r.label, r.A, r.B) for r in K.status_profiles(p).collect()}
    assert got == {1: ("[A, B]", 2, 3), 2: ("[All susceptible]", 1, 0)}


def test_attribute_profiles(spark):
    p = panel(spark, [(1, "A", "resistant", "x"), (1, "A", "resistant", "y"), (2, "A", "susceptible", "x"), (3, "B", "intermediate", None)])
    base = K.attribute_profiles(p, ["s"])
    got = {r.id: (r.label, r.indicators) for r in base.collect()}
    assert got == {1: ("[sx, sy]", ["sx", "sy"]), 3: ("[]", [])}
    wide = {r.id: (r.sx, r.sy) for r in K.indicator_columns(base, ["sx", "sy"]).collect()}
    assert wide == {1: (1, 1), 3: (0, 0)}


def test_cluster_profiles_count_labels_across_clusters(spark):
    assigned = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1)], "id int, label string, cluster int")
    meta = spark.createDataFrame(
        [("a", [("s", "x")]), ("a", [("s", "x")]), ("b", [("s", "y")])], "label string, data array<struct<attr:string,value:string>>"
    )
    got = {(r.cluster, r.value): (r.n, r.pct, r.profile_rows) for r in K.cluster_profiles(assigned, meta).collect()}
    assert got == {(0, "x"): (2, 100.0, 2), (1, "x"): (2, 66.67, 3), (1, "y"): (1, 33.33, 3)}
    sizes = {r.cluster: (r.cluster_size, r.labels) for r in K.cluster_sizes(assigned).collect()}
    assert sizes == {0: (1, ["a"]), 1: (2, ["a", "b"])}
    none = K.cluster_profiles(assigned, meta, significance=0.5).where("cluster = 1").collect()
    assert [(r.value, r.n) for r in none] == [("x", 2)]


def test_top_values(spark):
    rows = [(0, "s", f"v{i}", float(10 + i)) for i in range(8)] + [(0, "A", "resistant", 50.0), (0, "A", "susceptible", 50.0), (0, "B", "intermediate", 20.0)]
    df = spark.createDataFrame(rows, "cluster int, attr string, value string, pct double")
    assert [r.entry for r in K.top_values(df, "s").orderBy("place").collect()] == ["v7", "v6", "v5", "v4", "v3"]
    assert [(r.entry, r.pct) for r in K.top_values(df, "drug").orderBy("place").collect()] == [("A", 50.0), ("B", 20.0)]


def test_hamming(spark):
    p = panel(spark, [(1, "A", "resistant", "x"), (1, "B", "resistant", "x"), (2, "A", "susceptible", "x"), (2, "C", "resistant", "x")])
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "id1 int, id2 int")
    got = {(r.id1, r.id2): r.distance for r in K.hamming_pairs(p, pairs).collect()}
    assert got == {(1, 2): 3, (1, 1): 0}


# ---- trees ------------------------------------------------------------------

LABELLED = "id int, label_attr string, label string, features array<struct<feature:string,value:double>>"


def test_modes_and_imputation(spark):
    rows = [
        (1, "L", "L:a", [("f", 1.0)]), (2, "L", "L:a", [("f", 1.0)]), (3, "L", "L:a", [("f", 2.0)]), (4, "L", "L:a", []),
        (5, "L", "L:b", [("f", 5.0)]), (6, "L", "L:b", [("f", 4.0)]), (7, "L", "L:b", []), (8, "L", "L:c", []),
    ]
    df = spark.createDataFrame(rows, LABELLED)
    nulls = tree.feature_nulls(df, 0.4).first()
    assert (nulls.present, nulls.null_share, nulls.kept) == (5, 3 / 8, True)
    assert tree.kept_features(df, 0.3) == []
    got = {r.id: (r.f, r.g) for r in tree.imputed(df, ["f", "g"], tree.imputations(df)).collect()}
    # label a: mode 1; label b: a tie, the smaller; label c: the overall mode; g: nothing known
    assert got[4] == (1.0, 0.0) and got[7] == (4.0, 0.0) and got[8] == (1.0, 0.0) and got[3] == (2.0, 0.0)
    blind = tree.imputed(df, ["f", "g"], tree.imputations(df), label_known=False)
    got = {r.id: (r.f, r.g) for r in blind.collect()}
    assert got[7] == got[8] == got[4] == (1.0, 0.0) and got[3] == (2.0, 0.0)


def test_scoring_does_not_see_the_label(spark):
    rows = [(i, "L", "L:a", [("f", 1.0)]) for i in range(60)] + [(i, "L", "L:b", [("f", 2.0)]) for i in range(60, 100)]
    fitted = tree.fit_tree(spark.createDataFrame(rows, LABELLED), 0.4)
    new = spark.createDataFrame([(200, "L", "L:a", []), (201, "L", "L:b", []), (202, "L", "L:new", [])], LABELLED)
    assert len({r.prediction for r in fitted.predict(new).collect()}) == 1


def test_tree_learns_and_leaves_test_ids_out(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        s = rng.choice("xy")
        rows.append((i, "A", "resistant" if s == "x" else "intermediate", s))
        rows.append((i, "B", rng.choice(["resistant", "susceptible"]), s))
    p = panel(spark, rows, holdout_fraction=0.2)
    rows = settle(T.labelled_rows(p, focus=("resistant", "intermediate"), domains={"s": ["x", "y"]}))
    held = settle(T.labelled_rows(p, domains={"s": ["x", "y"]}, for_test=True))
    assert rows.join(held, "id", "left_semi").count() == 0
    one = rows.where("label_attr = 'A'")
    fitted = tree.fit_tree(one, 0.3)
    assert fitted.accuracy(one) == 1.0
    assert fitted.accuracy(held.where("label_attr = 'A'")) == 1.0
    assert "If (feature" in fitted.text()
    assert fitted.nodes(spark).count() == 3
    assert held.where("label = 'B:susceptible'").count() > 0 and rows.where("label = 'B:susceptible'").count() == 0


def test_depth_search(spark):
    rng = random.Random(1)
    rows = [(i, "A", rng.choice(["resistant", "intermediate"]), rng.choice("xy")) for i in range(400)]
    labelled = settle(T.labelled_rows(panel(spark, rows), domains={"s": ["x", "y"]}))
    model = tree.prune_search(labelled, depths=(2, 3), gains=(0.001,))
    assert len(model.validationMetrics) == 2
