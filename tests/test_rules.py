import itertools
import random

import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.operators import charts, measures, mining, refine, reports, transactions as T
from coterie.plans import pipeline
from coterie.plans.spec import RunSpec
from coterie.sources import panels as P
from coterie.sources import standin

RULE = "antecedent array<string>, consequent array<string>, support double, confidence double, lift double"


def rules(spark, rows):
    df = spark.createDataFrame(rows, RULE)
    return df.withColumn("antecedent_key", F.array_join("antecedent", " & ")).withColumn(
        "consequent_key", F.array_join("consequent", " & ")
    )


def keys(df):
    return {(r.antecedent_key, r.consequent_key) for r in df.collect()}


def baskets(spark, seed=3, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        items = [x for x in "abcdefg" if rng.random() < 0.4]
        if items and rng.random() < 0.5:
            items.append("h" if "a" in items else "i")
        rows.append((i, items))
    return spark.createDataFrame([r for r in rows if r[1]], "id int, items array<string>")


def test_itemsets_and_rules_against_the_model(spark):
    df = baskets(spark)
    sets = mining.frequent_itemsets(df, 0.03)
    model = FPGrowth(itemsCol="items", minSupport=0.03, minConfidence=0.3).fit(df)
    want = {tuple(sorted(r["items"])): r.freq for r in model.freqItemsets.collect()}
    assert {tuple(r["items"]): r.freq for r in sets.collect()} == want
    got = {(tuple(r.antecedent), r.consequent[0]): r for r in mining.association_rules(sets, 0.3).collect()}
    model_rules = model.associationRules.collect()
    assert len(got) == len(model_rules) > 100
    for r in model_rules:
        mine = got[(tuple(sorted(r.antecedent)), r.consequent[0])]
        assert (mine.support, mine.confidence, mine.lift) == pytest.approx((r.support, r.confidence, r.lift))


def test_too_few_baskets_give_no_rules(spark):
    df = baskets(spark, n=15)
    assert mining.association_rules(mining.frequent_itemsets(df, 0.1), 0.1).count() == 0


def test_recorded_counts_of_the_view(spark):
    d = "/root/testdata/sf0.01"
    panel = settle(P.panels({"v": standin.isolate_view(spark, d)}, P.PanelSpec(excluded=("year", "data_source", "cohort"))))
    all_rules = mining.association_rules(mining.frequent_itemsets(T.baskets(panel), 0.005), 0.2)
    assert T.baskets(panel).count() == 14743
    assert (all_rules.count(), all_rules.where("lift > 1").count()) == (509, 429)
    sick = panel.where(F.exists("target", lambda x: x["value"].isin("resistant", "intermediate")))
    sets = mining.frequent_itemsets(T.baskets(sick), 0.005)
    sick_rules = mining.association_rules(sets, 0.2)
    chosen = mining.select_rules(sick_rules, 1.0)
    assert (T.baskets(sick).count(), sets.count(), sick_rules.count(), chosen.count()) == (13918, 557, 526, 305)
    assert refine.prune(chosen).count() == 264


def test_prune_cases(spark):
    rows = [
        (["a"], ["z"], 0.1, 0.5, 2.0),
        (["a", "b"], ["z"], 0.1, 0.5, 1.5),  # lower lift: dominated
        (["a", "c"], ["z"], 0.1, 0.5, 2.0),  # equal lift: dominated
        (["a", "d"], ["z"], 0.1, 0.5, 2.5),  # higher lift: kept
        (["a", "b", "d"], ["z"], 0.1, 0.5, 2.4),  # dominated by a, d two levels on
        (["a", "b"], ["y"], 0.1, 0.5, 1.0),  # other consequent: kept
        (["p", "q", "r"], ["z"], 0.1, 0.5, 1.9),
        (["q"], ["z"], 0.1, 0.5, 1.9),
    ]
    got = keys(refine.prune(rules(spark, rows)))
    assert got == {("a", "z"), ("a & d", "z"), ("a & b", "y"), ("q", "z")}


def greedy_prune(rows):
    kept = []
    for r in rows:
        inside = True
        for c in list(kept):
            if c[1] != r[1]:
                continue
            if set(r[0]) >= set(c[0]):
                if c[4] >= r[4]:
                    inside = False
                    break
            elif set(c[0]) >= set(r[0]) and r[4] >= c[4]:
                kept.remove(c)
        if inside:
            kept.append(r)
    return {(" & ".join(r[0]), r[1][0]) for r in kept}


def test_prune_against_pairwise_comparison(spark):
    rng = random.Random(11)
    rows = []
    for con in ("y", "z"):
        for k in range(1, 6):
            for ant in itertools.combinations("abcdefg", k):
                if rng.random() < 0.6:
                    rows.append((list(ant), [con], 0.1, 0.5, rng.randint(10, 16) / 10))
    rng.shuffle(rows)
    df = rules(spark, rows)
    pruned = refine.prune(df)
    assert keys(pruned) == greedy_prune(rows)
    assert keys(refine.prune(pruned)) == keys(pruned)


def test_combine(spark):
    rows = [(["a"], ["b"], 0.3, 0.9, 2.0), (["a"], ["c"], 0.2, 0.95, 3.0), (["b"], ["c"], 0.5, 0.5, 1.1)]
    df = rules(spark, rows).withColumn("cluster", F.lit("x"))
    got = {r.antecedent_key: r for r in refine.combine(df).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].consequent, got["a"].support, got["a"].confidence, got["a"].lift) == (["b", "c"], 0.2, 0.9, 2.0)
    assert (got["a"].cluster, got["b"].cluster) == ("", "x")


def test_clusters_of_few_rules_are_skipped(spark):
    df = rules(spark, [(["a"], ["b"], 0.3, 0.9, 2.0)])
    out = refine.cluster_rules(df, {"support": 0.1, "confidence": 0.5, "lift": 1.0}).first()
    assert out.cluster == ""


def test_cluster_names_follow_the_mean_measures(spark):
    low = [([f"a{i}"], ["b"], 0.11, 0.55, 1.1) for i in range(6)]
    high = [([f"c{i}"], ["b"], 0.9, 0.95, 5.0) for i in range(6)]
    out = refine.cluster_rules(rules(spark, low + high), {"support": 0.1, "confidence": 0.5, "lift": 1.0})
    got = {r.antecedent_key[0]: r.cluster for r in out.collect()}
    assert got == {"a": "LowSupport_LowConfidence_LowLift", "c": "HighSupport_HighConfidence_HighLift"}


def test_states(spark):
    df = rules(spark, [(["a"], ["b"], s, c, 1.0) for s, c in ((0.149, 0.62), (0.151, 0.63), (0.2, 0.88))])
    out = refine.with_states(df, {"support": 0.1, "confidence": 0.5, "lift": 1.0}).orderBy("support").collect()
    assert [(r.support_state, r.confidence_state) for r in out] == [(1, 1), (2, 2), (3, 3)]


def test_weighted_rows(spark):
    df = rules(spark, [(["A:resistant", "AgeGroup:Adult"], ["b"], 0.031, 0.9, 2.0), (["c"], ["b"], 0.009, 0.9, 2.0)])
    one = refine.weighted_rows(df).collect()
    assert len(one) == 1 and one[0].weight == 3
    assert [(x.feature, x.value) for x in one[0].features] == [("A", 3.0), ("AgeGroup", 18.0)]
    assert refine.weighted_rows(df, repeat=True).count() == 3


def missing_panel(spark):
    """Three tests, the third missing for half of the ids, one id without any test."""
    rows = []
    for i in range(8):
        rows.append((i, "A", "resistant" if i < 6 else "susceptible", "d" if i % 2 else "e"))
        rows.append((i, "B", "resistant" if i < 4 else "susceptible", "d" if i % 2 else "e"))
        if i % 2:
            rows.append((i, "C", "resistant" if i < 4 else "susceptible", "d"))
    rows.append((8, "A", "NA", "d"))
    rows.append((9, "A", None, "d"))
    return P.panels({"v": spark.createDataFrame(rows, "id int, drug string, status string, s string")})


def test_missing_data_measures(spark):
    panel = missing_panel(spark)
    profiles = settle(T.profiles(panel))
    sets = mining.frequent_itemsets(T.baskets(panel), 0.1, min_transactions=1)
    out = measures.rar(settle(mining.association_rules(sets, 0.0)), profiles)
    got = {(r.antecedent_key, r.consequent_key): r for r in out.collect()}
    r = got[("A:resistant", "C:resistant")]
    # ten baskets, eight complete transactions, four complete for the rule
    assert (r.n_baskets, r.n_all, r.n_complete, r.n_x, r.n_y, r.n_xy) == (10, 8, 4, 3, 2, 2)
    assert r.support == pytest.approx(0.2)
    assert r.real_support == pytest.approx(0.2 * 8 / 4)
    assert r.rar_support_exact == pytest.approx(0.5)
    assert r.real_lift == pytest.approx(2 * 4 / (3 * 2))


def brute_counts(panel_rows, rule):
    need = {x.split(":")[0] for x in rule.antecedent + rule.consequent}
    inside = [p for p in panel_rows if need <= {x.split(":")[0] for x in p}]
    x = [set(rule.antecedent) <= p for p in inside]
    y = [set(rule.consequent) <= p for p in inside]
    return len(inside), sum(x), sum(y), sum(a and b for a, b in zip(x, y))


def test_rule_counts_against_a_scan_with_list_values(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        for t in "ABC":
            if rng.random() < 0.6:
                rows.append((i, t, rng.choice(["resistant", "susceptible", "intermediate"]), None, f"s{i % 3}"))
        for g in ("g1", "g2", "g3"):
            if rng.random() < 0.3:
                rows.append((i, None, None, g, f"s{i % 3}"))
    df = spark.createDataFrame(rows, "id int, drug string, status string, gene string, sero string")
    panel = P.panels({"v": df})
    profiles = settle(T.profiles(panel))
    found = settle(mining.association_rules(mining.frequent_itemsets(T.baskets(panel), 0.02), 0.05))
    out = measures.rar(found, profiles).collect()
    scans = [
        {f"{x.attr}:{x.value}" for x in list(r.target) + list(r.other)} for r in T.complete(panel).collect()
    ]
    assert any(sum(i.startswith("gene") for i in r.antecedent) > 1 for r in out)
    for r in out:
        assert (r.n_complete, r.n_x, r.n_y, r.n_xy) == brute_counts(scans, r)
        assert r.real_support >= r.support


def test_rule_counts_with_a_skewed_list_of_attributes(spark, monkeypatch):
    """Nearly all panels have the same attributes; their profiles are met in many parts."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        for t in "ABCD" if i % 10 else "AB":
            rows.append((i, t, rng.choice(["resistant", "susceptible", "intermediate"]), f"s{rng.randint(0, 4)}"))
    panel = P.panels({"v": spark.createDataFrame(rows, "id int, drug string, status string, s string")})
    profiles = settle(T.profiles(panel))
    monkeypatch.setattr(measures, "PART", 10)
    found = settle(mining.association_rules(mining.frequent_itemsets(T.baskets(panel), 0.05), 0.1))
    scans = [{f"{x.attr}:{x.value}" for x in list(r.target) + list(r.other)} for r in T.complete(panel).collect()]
    out = measures.rar(found, profiles).collect()
    assert len(out) > 20
    for r in out:
        assert (r.n_complete, r.n_x, r.n_y, r.n_xy) == brute_counts(scans, r)


def test_attribute_sets_held_by_lists(spark):
    shapes = spark.createDataFrame([(["c", "a", "b"],), (["b"],), ([],), (["a b", "a"],)], "attrs array<string>")
    sets = [["a"], ["a", "b"], ["a", "c"], ["a", "a b"], ["b", "d"], ["b"]]
    wanted = spark.createDataFrame([(x, ["w"]) for x in sets], "rule_attrs array<string>, wanted array<string>")
    got = {(tuple(r.attrs), tuple(r.rule_attrs)) for r in measures.held_sets(shapes, wanted).collect()}
    assert got == {(tuple(s.attrs), tuple(x)) for s in shapes.collect() for x in sets if set(x) <= set(s.attrs)}
    assert measures.held_sets(shapes, wanted.limit(0)).count() == 0


def test_items_may_hold_the_mark_between_items(spark):
    """`p:a & q:b` is one item here, and `p:a` with `q:b` are two; their texts are alike."""
    rows = [(i, ["p:a", "q:b", "r:c"]) for i in range(30)] + [(i, ["p:a & q:b", "r:c"]) for i in range(30, 50)]
    df = spark.createDataFrame(rows, "id int, items array<string>")
    found = mining.association_rules(mining.frequent_itemsets(df, 0.1), 0.0).collect()
    assert len({(tuple(r.antecedent), tuple(r.consequent)) for r in found}) == len(found)
    for r in found:
        have = [set(items) for _, items in rows]
        x, y = set(r.antecedent), set(r.consequent)
        assert r.support * 50 == pytest.approx(sum(x | y <= h for h in have))
        assert r.confidence == pytest.approx(sum(x | y <= h for h in have) / sum(x <= h for h in have))


def test_cross_support_and_plain(spark):
    panel = missing_panel(spark)
    profiles = settle(T.profiles(panel))
    df = rules(spark, [(["A:resistant"], ["B:resistant"], 0.4, 0.5, 1.2), (["x:y"], ["z:w"], 0.1, 0.5, 1.2)])
    got = {r.antecedent_key: r.cross_support for r in measures.cross_support(df, profiles).collect()}
    assert got["A:resistant"] == pytest.approx((4 / 8) / (6 / 8)) and got["x:y"] is None
    plain = measures.real_measures(df, profiles, "none").first()
    assert (plain.real_support, plain.real_lift) == (plain.support, plain.lift)
    assert measures.real_measures(df, profiles, "CROSS").count() == 2


def test_rule_without_complete_transactions_is_dropped(spark):
    profiles = settle(T.profiles(missing_panel(spark)))
    df = rules(spark, [(["nowhere:x"], ["B:resistant"], 0.4, 0.5, 1.2)])
    out = measures.real_measures(df, profiles, "RAR")
    row = out.first()
    assert row.real_support is None and row.real_lift == 1.0
    assert measures.by_real_support(out, 0.0).count() == 0


def test_selection(spark):
    df = rules(spark, [(["a:1"], ["b:1"], 0.1, 0.5, 2.0), (["a:1", "c:1"], ["d:1"], 0.1, 0.5, 1.0), (["c:2"], ["d:1"], 0.1, 0.5, 3.0)])
    assert keys(mining.select_rules(df, 1.0)) == {("a:1", "b:1"), ("c:2", "d:1")}
    assert keys(mining.select_rules(df, 0.5, ["d:1"])) == {("a:1 & c:1", "d:1"), ("c:2", "d:1")}
    assert mining.select_rules(df, 0.5, ["*"]).count() == 3
    assert keys(mining.with_antecedent(df, ["c"])) == {("a:1 & c:1", "d:1"), ("c:2", "d:1")}
    assert keys(mining.one_to_one(df)) == {("a:1", "b:1"), ("c:2", "d:1")}
    assert keys(mining.top_rules(df, 1)) == {("c:2", "d:1")}


# ---- reports ----------------------------------------------------------------

CHANGE = "rule_id string, association string, real_support double, support double, confidence double, lift double"


def test_rule_change_and_summary(spark):
    before = spark.createDataFrame(
        [
            ("b1", "[A:resistant] -> [serotype:x]", 0.2, 0.2, 0.9, 2.0),
            ("b2", "[B:resistant] -> [serotype:x]", 0.0, 0.2, 0.9, 2.0),
            ("b3", "[C:resistant] -> [D:resistant]", 0.2, 0.2, 0.9, 2.0),
            ("b4", "[E:resistant] -> [serotype:x]", 0.01, 0.01, 0.1, 1.0),
        ],
        CHANGE,
    )
    after = spark.createDataFrame(
        [
            ("a1", "[A:resistant] -> [serotype:x]", 0.1, 0.2, 0.95, 2.1),
            ("a2", "[B:resistant] -> [serotype:x]", 0.3, 0.2, 0.9, 2.0),
            ("a3", "[C:resistant] -> [D:resistant]", 0.21, 0.2, 0.5, 4.0),
            ("a4", "[E:resistant] -> [serotype:x]", 0.02, 0.01, 0.1, 1.0),
        ],
        CHANGE,
    )
    changes = reports.rule_change(before, after)
    got = {r.before_rule_id: (r.real_support_mark, r.confidence_mark, r.lift_mark) for r in changes.collect()}
    assert got["b1"] == ("* -50 %", "5 %", "5 %")
    assert got["b2"] == (None, "0 %", "0 %")
    assert got["b3"][1:] == ("* -44 %", "* 100 %")
    assert "b4" not in got
    attributes = spark.createDataFrame([("b1", "A"), ("b1", "serotype"), ("b3", "C"), ("b3", "D")], "rule_id string, attr string")
    classes = spark.createDataFrame([("A", "Penicillins"), ("C", "Penicillins"), ("D", "Tetracyclines")], "drug string, class string")
    types = reports.rule_types(attributes, classes)
    assert {r.rule_id: r.rule_type for r in types.collect()} == {"b1": "Intra_Class", "b3": "Cross_Class"}
    summary = reports.rule_change_report(changes, types).collect()
    assert [(r.rule_type, r.association) for r in summary] == [("Intra_Class", "[A] -> [serotype:x]")]


def test_beta_lactams_are_one_class(spark):
    attributes = spark.createDataFrame([("r", "A"), ("r", "B")], "rule_id string, attr string")
    classes = spark.createDataFrame([("A", "Penicillins"), ("B", "Cephalosporins")], "drug string, class string")
    assert reports.rule_types(attributes, classes).first().rule_type == "Intra_Class"


def test_null_class_counts_as_a_class(spark):
    rows = [(1, "dublin", 2010, c, "resistant") for c in ("X", "Y", None)]
    rows += [(2, "Dublin", 2010, c, "resistant") for c in ("Penicillins", "Cephalosporins", "Y")]
    rows += [(3, "Other", 2013, "X", "resistant"), (4, "dublin", 2010, "X", "susceptible")]
    view = spark.createDataFrame(rows, "id int, serotype string, year int, class string, status string")
    out = reports.resistance_ratio(view, 2012, "dublin").collect()
    assert [(r.serotype, r.period, r.multi_resistant, r.total, r.ratio) for r in out] == [("dublin", "Before2012", 1, 3, 100 / 3)]


def test_reports_compare_without_case(spark):
    rows = [(1, "Dublin", 2010, c, "Resistant") for c in ("X", "Y", "PENICILLINS")]
    rows += [(2, "DUBLIN", 2012, c, "resistant") for c in ("x", "X", "Penicillins", "cephalosporins", "Y")]
    rows += [(3, "dublin", 2012, c, "RESISTANT") for c in ("x", "X", "Penicillins", "cephalosporins")]
    rows += [(4, "Kentucky", 2013, c, "resistant") for c in "XYZ"]
    view = spark.createDataFrame(rows, "id int, serotype string, year int, class string, status string")
    out = reports.resistance_ratio(view, 2011, "Dublin").collect()
    assert {(r.serotype, r.period, r.multi_resistant, r.total) for r in out} == {
        ("Dublin", "Before2011", 1, 1), ("Dublin", "After2011", 1, 2), ("Non-Dublin", "After2011", 1, 1),
    }
    share = reports.serotype_share(view, ["Dublin", "Newport"], {"all": (2010, 2013)}).first()
    assert (share.Dublin, share.Newport, share.total, share.Dublin_pct) == (3, 0, 4, 75.0)
    attributes = spark.createDataFrame([("r", "A"), ("r", "B")], "rule_id string, attr string")
    classes = spark.createDataFrame([("A", "PENICILLINS"), ("B", "carbapenems")], "drug string, class string")
    assert reports.rule_types(attributes, classes).first().rule_type == "Intra_Class"


def test_years_outside_the_intervals(spark):
    view = spark.createDataFrame([(1, "Dublin", 2010), (1, "Dublin", 2010), (2, "Kentucky", 2009)], "id int, serotype string, year int")
    out = reports.serotype_share(view, ["Dublin"], {"2010_2011": (2010, 2011)}).collect()
    assert {(r.interval, r.Dublin, r.total, r.Dublin_pct) for r in out} == {("2010_2011", 1, 1, 100.0), (None, 0, 1, 0.0)}


def test_network_change_names_new_nodes(spark):
    schema = "node string, community string, degree_centrality double"
    before = spark.createDataFrame([("a", "1", 0.5)], schema)
    after = spark.createDataFrame([("a", "2", 0.6), ("b", "1", 0.1)], schema)
    got = {r.node: r for r in reports.network_change(before, after).collect()}
    assert (got["a"].community_before, got["a"].community_after) == ("1", "2")
    assert (got["b"].community_before, got["b"].community_after) == (None, "1")
    assert (got["b"].centrality_before, got["b"].centrality_after) == (None, 0.1)


# ---- chart tables -----------------------------------------------------------


def test_chart_tables(spark):
    df = rules(
        spark,
        [
            (["A:resistant", "s:x"], ["B:resistant"], 0.1, 0.5, 1200.0),
            (["A:intermediate"], ["B:resistant"], 0.1, 0.5, 34.567),
        ],
    )
    changes = {":resistant": "", ":intermediate": ""}
    edges = charts.chart_edges(df, "lift", ["s"], changes)
    assert [(r.ant, r.con, round(r.weight, 3)) for r in edges.collect()] == [("A", "B", 1234.567)]
    assert charts.arrow_labels(edges).first().label == "1234.57"
    classes = spark.createDataFrame([("A", "K")], "drug string, class string")
    named = charts.node_classes(df, classes, hidden=["s"], changes=changes)
    assert {r.node: r["class"] for r in named.collect()} == {"A": "K", "B": "no_class"}
    link = charts.chord_links(edges, named).first()
    assert (link.source, link.target) == ("K_A", "no_class_B")
    assert [tuple(r) for r in charts.chord_nodes(edges, named).collect()] == [("K_A", "A"), ("no_class_B", "B")]
    grouped = charts.node_classes(df, classes, {"left": 1, "right": 2, "odd": 3})
    assert {r.node: r["class"] for r in grouped.collect()}["s:x"] == "s:x"
    assert charts.rules_to_show(df, antecedent="A:").count() == 1
    assert charts.measures(df).orderBy("lift").first().label == "[A:intermediate]->[B:resistant]"


# ---- whole runs -------------------------------------------------------------


def test_run_writes_all_tables(spark):
    d = "/root/testdata/sf0.001"
    spec = RunSpec(
        "r1", P.PanelSpec(excluded=("year", "data_source", "cohort")), support=0.02, real_support=0.01, confidence=0.2,
        lift=1.0, real_measures=True, prune=True, combine=True, network=True, hierarchy=True, analysed_attribute="serotype",
        network_lift=1.0, tree=True, null_threshold=0.6, domains={"serotype": ("BUILDING", "FURNITURE")},
    )
    out = pipeline.run(standin.sources(spark, d), spec, P.class_dimension(standin.tests(spark, d)))
    assert {"rules", "rule_attributes", "chart_edges", "edges", "nodes", "network", "cluster_profiles", "tree_nodes"} <= set(out)
    recorded = out["rules"].collect()
    assert recorded and len({r.antecedent_key for r in recorded}) == len(recorded)
    assert out["rule_attributes"].select("rule_id").distinct().count() == len(recorded)
    assert out["nodes"].where("betweenness is null or community is null").count() == 0
    accuracy = {r.part: r for r in out["tree_accuracy"].collect()}
    assert 0 < accuracy["train"].accuracy <= 1 and out["tree_text"].first().text.startswith("DecisionTree")
    assert out["cluster_sizes"].agg(F.sum("cluster_size")).first()[0] == out["assigned"].count()


def test_cohort_runs_equal_single_runs(spark):
    d = "/root/testdata/sf0.01"
    spec = RunSpec("c", P.PanelSpec(excluded=("year", "data_source")), support=0.05, confidence=0.1, lift=1.0)
    both = pipeline.run_by_cohort(standin.sources(spark, d), spec, ["ASIA", "EUROPE"])
    one = P.panels(standin.sources(spark, d), P.PanelSpec(excluded=("year", "data_source", "cohort"), cohorts=("ASIA",)))
    alone = mining.select_rules(pipeline.mine(one, spec), 1.0)
    assert keys(both.where("cohort = 'ASIA'")) == keys(alone)
