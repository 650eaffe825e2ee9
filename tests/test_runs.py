"""Written results, slices of one panel, pruning paths, rule clusters, parts of sources."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.operators import network, pruning, refine, tree
from coterie.operators.pruning import Node
from coterie.sources import panels as P
from coterie.sources import results

RULES = "rule_id string, lift double"


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULES)


def found(spark, root, run, name="rules"):
    return sorted(tuple(r) for r in results.read_results(spark, root, run)[name].collect())


# ---- results ----------------------------------------------------------------


def test_results_replace_a_run_and_leave_the_others(spark, tmp_path):
    root = str(tmp_path / "out")
    assert results.read_results(spark, root, "a") == {}
    results.write_results(spark, root, "a", {"rules": rules(spark, ("1", 1.0), ("2", 2.0)), "none": rules(spark).limit(0)})
    results.write_results(spark, root, "b", {"rules": rules(spark, ("3", None))})
    old = results.read_results(spark, root, "a")["rules"]
    results.write_results(spark, root, "a", {"rules": rules(spark, ("4", 4.0))})
    assert found(spark, root, "a") == [("4", 4.0)] and found(spark, root, "b") == [("3", None)]
    assert "none" not in results.read_results(spark, root, "a")
    assert old.count() == 2  # a reader of the earlier version goes on
    assert results.vacuum(spark, root) == 1
    assert found(spark, root, "a") == [("4", 4.0)] and found(spark, root, "b") == [("3", None)]
    results.write_results(spark, root, "c", {"rules": rules(spark, ("5", 5.0))}, clean=True)
    assert results.read_results(spark, root, "a") == {} and found(spark, root, "c") == [("5", 5.0)]


def test_an_empty_table_keeps_its_fields(spark, tmp_path):
    root = str(tmp_path / "out")
    results.write_results(spark, root, "a", {"rules": rules(spark, ("1", 1.0)).where("false")})
    back = results.read_results(spark, root, "a")["rules"]
    assert back.count() == 0 and back.columns == ["rule_id", "lift"]


def test_a_failed_write_leaves_what_was_visible(spark, tmp_path):
    root = str(tmp_path / "out")
    results.write_results(spark, root, "a", {"rules": rules(spark, ("1", 1.0)), "edges": rules(spark, ("e", 1.0))})
    bad = rules(spark, ("2", 2.0)).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        results.write_results(spark, root, "a", {"rules": rules(spark, ("9", 9.0)), "edges": bad})
    assert found(spark, root, "a") == [("1", 1.0)] and found(spark, root, "a", "edges") == [("e", 1.0)]


def test_update_and_delete(spark, tmp_path):
    root = str(tmp_path / "out")
    both = {"rules": rules(spark, ("1", 1.0), ("2", 2.0), (None, 3.0)), "edges": rules(spark, ("e", 1.0))}
    results.write_results(spark, root, "a", both)
    results.write_results(spark, root, "b", both)
    results.update_results(spark, root, "a", "rules", F.col("rule_id") == "2", {"lift": 7})
    assert sorted(r.lift for r in results.read_results(spark, root, "a")["rules"].collect()) == [1.0, 3.0, 7.0]
    assert found(spark, root, "a", "edges") == [("e", 1.0)]
    with pytest.raises(ValueError):
        results.update_results(spark, root, "a", "rules", F.lit(True), {"lifft": 7})
    results.delete_results(spark, root, names=["edges"])
    assert set(results.read_results(spark, root, "a")) == set(results.read_results(spark, root, "b")) == {"rules"}
    results.delete_results(spark, root, "a")
    assert results.read_results(spark, root, "a") == {} and "rules" in results.read_results(spark, root, "b")


# ---- slices and scope -------------------------------------------------------


def people(spark):
    rows = [(1, "x", 1999, "A's"), (1, "y", 2001, "B"), (2, "x", 2001, "B"), (3, "z", None, None), (None, "n", 1999, "B")]
    isolates = spark.createDataFrame(rows, "id long, serotype string, year int, cohort string")
    tests = spark.createDataFrame(
        [(1, "T", "resistant"), (2, "T", "susceptible"), (2, "U", "resistant"), (3, "T", "resistant"), (4, "T", "resistant"), (None, "U", "resistant")],
        "id long, drug string, status string",
    )
    return {"isolates": isolates, "tests": tests}


def rows_of(panel):
    return sorted((str(r.id), str(r.target), str(r.other)) for r in panel.collect())


@pytest.mark.parametrize("bound", [0, 100])
def test_few_ids_in_scope_give_the_same_panel(spark, monkeypatch, bound):
    monkeypatch.setattr(P, "SCOPE_IDS", bound)
    panel = P.panels(people(spark), P.PanelSpec(condition="year < 2000"))
    assert [r[0] for r in rows_of(panel)] == ["1", "None"]
    values = {x.value for r in panel.where("id = 1").collect() for x in r.other if x.attr == "serotype"}
    assert values == {"x", "y"}  # rows out of scope still describe an id in scope


def test_slices_equal_panels_of_their_own(spark):
    sources = people(spark)
    slices = {"old": "year < 2000", "new": "year >= 2000", "all": P.scope_text(P.PanelSpec())}
    panel = P.panels(sources, P.PanelSpec(slices=slices))
    for name, condition in slices.items():
        alone = P.panels(sources, P.PanelSpec(condition="" if name == "all" else condition))
        assert rows_of(P.slice_of(panel, name)) == rows_of(alone)
    only = P.panels(sources, P.PanelSpec(slices={"old": "year < 2000"}))
    assert rows_of(only.drop("slices")) == rows_of(P.slice_of(panel, "old"))


def test_scope_as_text_quotes_cohorts(spark):
    spec = P.PanelSpec(cohorts=("A's", "c\\d"))
    panel = P.panels(people(spark), P.PanelSpec(slices={"s": P.scope_text(spec)}))
    assert rows_of(panel.drop("slices")) == rows_of(P.panels(people(spark), spec)) != []


# ---- pruning ----------------------------------------------------------------


def grown(rng, depth, nodes=None):
    """A random tree with counts that add up, numbered from left to right, parents first."""
    nodes = {} if nodes is None else nodes
    me = len(nodes)
    nodes[me] = None
    if depth == 0 or rng.random() < 0.2:
        counts = tuple(float(rng.randint(1, 9)) for _ in range(3))
        nodes[me] = Node(counts, float(np.argmax(counts)))
        return nodes
    left = len(nodes)
    grown(rng, depth - 1, nodes)
    right = len(nodes)
    grown(rng, depth - 1, nodes)
    counts = tuple(a + b for a, b in zip(nodes[left].counts, nodes[right].counts))
    nodes[me] = Node(counts, float(np.argmax(counts)), left, right)
    return nodes


def prunings(nodes, i=0):
    """All sets of leaves a tree can be pruned to."""
    n = nodes[i]
    out = [frozenset([i])]
    if not n.is_leaf:
        out += [a | b for a, b in itertools.product(prunings(nodes, n.left), prunings(nodes, n.right))]
    return out


def test_weakest_links_give_the_cheapest_tree_at_every_alpha():
    rng = random.Random(5)
    for _ in range(25):
        nodes = grown(rng, 3)
        total = sum(nodes[0].counts)
        every = [(sum(pruning.risk_of(nodes[i], total) for i in s), s) for s in prunings(nodes)]
        cuts = pruning.weakest_links(nodes)
        assert len(nodes) == 1 or (cuts[-1].node == 0 and cuts[-1].leaves == 1)
        assert [c.alpha for c in cuts] == sorted(c.alpha for c in cuts)
        for alpha in {c.alpha for c in cuts} | {c.alpha + 1e-6 for c in cuts}:
            if alpha <= 0:
                continue
            least = min(r + alpha * len(s) for r, s in every)
            cheapest = min((len(s), s) for r, s in every if r + alpha * len(s) <= least + 1e-9)[1]
            kept = frozenset(i for i, n in pruning.kept_nodes(nodes, alpha).items() if n.is_leaf)
            assert kept == cheapest


def test_spans_follow_the_cuts(spark):
    nodes = grown(random.Random(8), 4)
    leaves = [i for i in sorted(nodes) if nodes[i].is_leaf]
    spans = pruning.leaf_spans(spark, nodes).collect()
    cuts = pruning.weakest_links(nodes)
    for step in range(len(cuts) + 1):
        kept, ahead, under = set(c.node for c in cuts[:step]), [(0, None)], {}
        while ahead:
            i, top = ahead.pop()
            top = i if top is None and (i in kept or nodes[i].is_leaf) else top
            if nodes[i].is_leaf:
                under[leaves.index(i)] = top
            else:
                ahead += [(nodes[i].left, top), (nodes[i].right, top)]
        got = {s.leaf: s.node for s in spans if s.step <= step and (s.until is None or s.until > step)}
        assert got == under


def test_pruned_tree_scores_as_its_path_says(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        f, g = rng.random(), rng.random()
        label = "L:a" if (f < 0.5) != (rng.random() < 0.2) else "L:b"
        rows.append((i, "L", label, [("f", f), ("g", g)]))
    schema = "id long, label_attr string, label string, features array<struct<feature:string,value:double>>"
    train, held = spark.createDataFrame(rows[:800], schema), spark.createDataFrame(rows[800:], schema)
    fitted = tree.fit_tree(train, 0.5, max_depth=6, min_leaf=5, min_gain=0.0)
    path = fitted.path(held).orderBy("step").collect()
    assert len(path) > 5 and path[-1].leaves == 1 and path[0].hits == round(fitted.accuracy(held) * 400)
    best = fitted.best_alpha(held)
    assert best > 0
    pruned = fitted.pruned(best)
    # alphas repeat where cuts tie: the last step of an alpha is the tree pruned at it
    at = [p for p in path if p.alpha <= best][-1]
    assert round(pruned.accuracy(held) * 400) == at.hits == max(p.hits for p in path)
    nodes = pruned.nodes(spark)
    assert nodes.where("leftChild < 0").count() == at.leaves < path[0].leaves
    assert pruned.text().count("class: ") == at.leaves and "f <= 0." in pruned.text()
    assert pruned.predict(held).count() == 400


# ---- rule clusters ----------------------------------------------------------


def test_state_clusters_settle_on_all_states():
    points = np.array(list(itertools.product((1, 2, 3), repeat=3)))
    weights = np.arange(1, 28)
    label = refine.state_clusters(points, weights, 8)
    assert len(set(label)) == 8
    centres = {c: np.average(points[label == c], axis=0, weights=weights[label == c]) for c in set(label)}
    for p, c in zip(points, label):
        apart = {k: ((p - m) ** 2).sum() for k, m in centres.items()}
        assert apart[c] <= min(apart.values()) + 1e-9
    assert len(set(refine.state_clusters(points[:5], weights[:5], 8))) == 5
    assert len(set(refine.state_clusters(points, weights, 40))) == 27


# ---- sources in parts -------------------------------------------------------


def test_betweenness_does_not_depend_on_the_parts(spark):
    rng = random.Random(2)
    edges = [(f"n{a}", f"n{b}") for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25]
    df = spark.createDataFrame(edges, "src string, dst string")

    def by_node(batch):
        return {r.node: round(r.betweenness, 9) for r in network.betweenness(df, batch).collect()}

    def by_edge(batch):
        return {(r.src, r.dst): round(r.betweenness, 9) for r in network.edge_betweenness(df, batch).collect()}

    assert by_node(3) == by_node(4096) and by_edge(5) == by_edge(4096)
    assert len(by_edge(4096)) == len(edges)


def test_girvan_newman_walks_the_touched_component_only(spark):
    triangles = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x"), ("p", "q")]
    out = network.girvan_newman(spark.createDataFrame(triangles, "src string, dst string"), max_communities=3).collect()
    groups = {}
    for r in out:
        groups.setdefault((r.level, r.community), set()).add(r.node)
    assert {frozenset(g) for g in groups.values()} == {frozenset("abc"), frozenset("xyz"), frozenset("pq")}
