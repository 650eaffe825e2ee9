import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import golden
from coterie.functions.frames import settle
from coterie.operators import network, transactions as T
from coterie.sources import panels as P
from coterie.sources.sinks import graphml_lines

CASES = {
    "before": (golden.BEFORE, golden.NODES_BEFORE, 3, 0.155684),
    "after": (golden.AFTER, golden.NODES_AFTER, 2, 0.157687),
}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, lift double")


@pytest.mark.parametrize("period", CASES)
def test_published_centralities(spark, period):
    text, node_text, _, _ = CASES[period]
    edges = frame(spark, golden.edges(text))
    out = (
        network.degree_centrality(edges).join(network.betweenness(edges), "node").join(network.strength(edges), "node")
    ).collect()
    want = golden.nodes(node_text)
    assert {r.node for r in out} == set(want)
    for r in out:
        degree, between, size = want[r.node]
        assert round(r.degree_centrality, 2) == degree
        assert round(r.betweenness, 2) == between
        assert r.strength == pytest.approx(size, abs=1e-9)


@pytest.mark.parametrize("period", CASES)
def test_greedy_communities(spark, period):
    text, _, count, q = CASES[period]
    edges = frame(spark, golden.edges(text))
    found = network.greedy_communities(edges)
    row = network.modularity(edges, found).first()
    assert row.communities == count
    assert row.modularity == pytest.approx(q, abs=1e-6)


def paths_betweenness(edges):
    """Betweenness by listing every shortest path."""
    nodes = sorted({n for e in edges for n in e[:2]})
    near = {n: set() for n in nodes}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        paths, seen = [[s]], {s}
        while paths and not any(p[-1] == t for p in paths):
            paths = [p + [n] for p in paths for n in near[p[-1]] if n not in seen]
            seen |= {p[-1] for p in paths}
        hits = [p for p in paths if p[-1] == t]
        for p in hits:
            for n in p[1:-1]:
                score[n] += 1 / len(hits)
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness_against_paths(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(12)]
    edges = [(a, b, 1.0) for a, b in itertools.combinations(names, 2) if rng.random() < 0.25]
    edges += [("x", "y", 1.0), ("y", "z", 1.0)]
    got = {r.node: r.betweenness for r in network.betweenness(frame(spark, edges)).collect()}
    want = paths_betweenness(edges)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def two_triangles():
    return [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0)]


def test_clustering_coefficients(spark):
    got = {r.node: (r.triangles, r.clustering) for r in network.clustering_coefficients(frame(spark, two_triangles())).collect()}
    assert got["a"] == (1, 1.0)
    assert got["c"][0] == 1 and got["c"][1] == pytest.approx(1 / 3)
    average = network.average_clustering(frame(spark, two_triangles())).first()[0]
    assert average == pytest.approx((4 * 1 + 2 / 3) / 6)


def test_girvan_newman_cuts_the_bridge(spark):
    out = network.girvan_newman(frame(spark, two_triangles()), max_communities=2).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"]]


def fluids(spark, edges, k):
    df = frame(spark, edges)
    found = network.fluid_communities(df, k)
    rows = found.collect()
    assert sorted(r.node for r in rows) == sorted({n for e in edges for n in e[:2]})
    assert all(r.converged for r in rows)
    assert network.fluid_unsettled(df, found).isEmpty()
    groups = {}
    for r in rows:
        groups.setdefault(r.community, set()).add(r.node)
    return sorted(map(sorted, groups.values()))


def test_fluid_communities(spark):
    assert len(fluids(spark, two_triangles(), 2)) == 2
    cycle = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 1.0)]
    assert len(fluids(spark, cycle, 2)) == 2


def test_fluid_communities_reach_every_component(spark):
    pairs = [("a", "b", 1.0), ("c", "d", 1.0), ("e", "f", 1.0)]
    assert fluids(spark, pairs, 2) == [["a", "b"], ["c", "d"], ["e", "f"]]
    assert len(fluids(spark, [*two_triangles(), ("x", "y", 1.0)], 3)) == 3


def test_neighbours_have_different_colours(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(30)})
    edges = frame(spark, [(a, b, 1.0) for a, b in pairs])
    members = settle(network.graph_nodes(edges))
    got = {r.node: r.colour for r in network.colours(edges, members).collect()}
    assert set(got) == {n for p in pairs for n in p} and all(got[a] != got[b] for a, b in pairs)


def naive_merges(edges):
    """Greedy modularity by trying every pair of communities each time."""
    m = sum(w for *_, w in edges)
    part = {n: n for e in edges for n in e[:2]}
    out = []
    while True:
        k, between = defaultdict(float), defaultdict(float)
        for a, b, w in edges:
            x, y = sorted((part[a], part[b]))
            k[x] += w
            k[y] += w
            between[x, y] += w
        gains = [(-round(w / m - k[x] * k[y] / (2 * m * m), 12), x, y) for (x, y), w in between.items() if x != y]
        best = min(gains, default=(0, "", ""))
        if best[0] >= 0:
            return sorted(out)
        out.append((best[2], best[1], -best[0]))
        part = {n: best[1] if c == best[2] else c for n, c in part.items()}


def test_greedy_merges_against_every_pair(spark):
    rng = random.Random(8)
    for letters in ("abcdefgh", "mnopqr"):  # the second time with two further components
        pairs = sorted({tuple(sorted(rng.sample(letters, 2))) for _ in range(14)})
        edges = [(a, b, float(rng.randint(1, 9))) for a, b in pairs]
        if letters[0] == "m":
            edges += [("a", "b", 2.0), ("b", "c", 3.0), ("a", "c", 2.5), ("x", "y", 1.0), ("y", "z", 1.0)]
        df = settle(frame(spark, edges))
        rows = network.greedy_merges(df, settle(network.graph_nodes(df))).collect()
        got = sorted((r.node, r.into, r.gain) for r in rows)
        want = naive_merges(edges)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert max(r["round"] for r in rows) < len(rows)  # components merge at once


def test_components(spark):
    edges = frame(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)])
    members = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    got = {r.node: r["head"] for r in network.components(edges, members).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_class_partition(spark):
    edges = frame(spark, [("t1", "s:1", 1.0), ("t2", "s:1", 2.0)])
    classes = spark.createDataFrame([("t1", "A"), ("t2", "B")], "drug string, class string")
    got = {r.node: r.community for r in network.class_communities(edges, classes).collect()}
    assert got == {"t1": "A", "t2": "B", "s:1": "no_class"}


def pair_panel(spark):
    rows = [
        (1, "T1", "resistant", "a", "x"), (1, "T2", "resistant", "a", "x"),
        (2, "T1", "resistant", "b", "x"), (2, "T2", "susceptible", "b", "x"),
        (3, "T1", "susceptible", "a", "y"),
        (4, "T2", "resistant", "b", None),
    ]
    view = spark.createDataFrame(rows, "id int, drug string, status string, s string, u string")
    return T.profiles(P.panels({"v": view}))


def test_pair_statistics(spark):
    profiles = pair_panel(spark)
    tt = network.target_target(profiles).collect()
    assert [(r.src, r.dst, r.support, r.lift) for r in tt] == [("T2", "T1", 0.5, 1 * 2 / (1 * 2))]
    ta = {(r.src, r.dst): (r.support, r.lift) for r in network.target_attribute(profiles).collect()}
    assert ta[("T1", "s:a")] == (0.5, 1 * 3 / (2 * 2))
    assert ta[("T1", "u:x")] == (1.0, 2 * 3 / (2 * 2))
    aa = {(r.src, r.dst): (r.support, r.lift) for r in network.attribute_attribute(profiles).collect()}
    assert aa[("u:x", "s:a")] == (pytest.approx(1 / 3), 1 * 3 / (2 * 2))
    assert aa[("u:y", "s:a")] == (pytest.approx(1 / 3), 1 * 3 / (1 * 2))
    assert ("u:y", "s:b") not in aa


def test_bipartite_leaves_same_kind_pairs_out(spark):
    profiles = pair_panel(spark)
    kinds = {r.kind for r in network.co_occurrence(profiles, bipartite=True).collect()}
    assert kinds == {"target_other"}


def test_graphml_document(spark, tmp_path):
    edges = frame(spark, [("a&b", "c", 1.5)])
    graphml_lines(edges).write.text(str(tmp_path / "g"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text.strip().split("\n", 1)[1])
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert [n.get("id") for n in root.iter(f"{ns}node")] == ["a&b", "c"]
    edge = next(root.iter(f"{ns}edge"))
    assert (edge.get("source"), edge.get("target"), float(edge[0].text)) == ("a&b", "c", 1.5)


def test_modularity_of_one_community_is_zero(spark):
    edges = frame(spark, two_triangles())
    one = spark.createDataFrame([(n, 1) for n in "abcdef"], "node string, community int")
    row = network.modularity(edges, one).first()
    assert row.modularity == pytest.approx(0.0, abs=1e-12)
    assert row.communities == 1
    split = one.withColumn("community", F.when(F.col("node") < "d", 1).otherwise(2))
    assert network.modularity(edges, split).first().modularity == pytest.approx(6 / 7 - 2 * 0.25)
