"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions.frames import bounded_names, new_path, scalar_of, settle
from coterie.operators import charts, clusters, measures, mining, network, refine, reports, transactions as T, tree
from coterie.plans import pipeline
from coterie.plans.spec import RunSpec
from coterie.sources import panels as P
from coterie.sources import results, sinks, standin
from coterie.sources.standin import SPLIT_YEAR

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.2
MIN_LIFT = 1.0
REAL_SUPPORT = 0.02
THRESHOLDS = {"support": MIN_SUPPORT, "confidence": MIN_CONFIDENCE, "lift": MIN_LIFT}
CHANGE_LIMITS = {"real_support": 0.03, "support": 0.01, "confidence": 0.2, "lift": 1.0}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
RENAMES = {"serotype:": "", ":resistant": "", ":intermediate": ""}
COHORTS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TREE_NULLS = 0.6
CAPPED_BASKETS = 500
HOLDOUT = 0.25

RULE_ATTRS = ("year", "data_source", "cohort")
NET_ATTRS = ("year", "cohort")


# ---- shared pieces ----------------------------------------------------------


def _panel(spark: SparkSession, d: str, excluded: tuple[str, ...] = RULE_ATTRS, **options) -> DataFrame:
    return P.panels(standin.sources(spark, d), P.PanelSpec(excluded=excluded, **options))


def _itemsets(spark: SparkSession, d: str, **options) -> DataFrame:
    return mining.frequent_itemsets(T.baskets(_panel(spark, d, **options)), MIN_SUPPORT)


def _rules(spark: SparkSession, d: str, **options) -> DataFrame:
    return mining.association_rules(_itemsets(spark, d, **options), MIN_CONFIDENCE)


def _selected(spark: SparkSession, d: str, **options) -> DataFrame:
    return mining.select_rules(_rules(spark, d, **options), MIN_LIFT)


def _profiles(spark: SparkSession, d: str, excluded: tuple[str, ...] = NET_ATTRS, **options) -> DataFrame:
    return settle(T.profiles(_panel(spark, d, excluded, **options)))


def _edges(spark: SparkSession, d: str, bipartite: bool = False, **options) -> DataFrame:
    pairs = network.co_occurrence(_profiles(spark, d, **options), bipartite)
    return settle(network.network_edges(pairs, lift=1.0))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return P.class_dimension(standin.tests(spark, d))


def _joined(entries: str | Column) -> Column:
    return F.array_join(F.sort_array(F.transform(entries, lambda x: C.item(x["attr"], x["value"]))), " & ")


def _shown(rules: DataFrame, *extra: str) -> DataFrame:
    return rules.select(
        "antecedent_key", "consequent_key",
        *[F.round(m, 9).alias(m) for m in ("support", "confidence", "lift")], *extra,
    )


# ---- panels and transactions ------------------------------------------------


def observations_long(spark: SparkSession, d: str) -> DataFrame:
    return P.observations(_panel(spark, d, NET_ATTRS))


def _transaction_text(df: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("target"), lambda e: C.item(e["key"], e["value"]))
    lists = F.transform(
        F.map_entries("other"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.sort_array(e["value"]), "|"))
    )
    return df.select(
        "id", F.array_join(F.sort_array(pairs), " & ").alias("target"), F.array_join(F.sort_array(lists), " & ").alias("other")
    )


def transactions_complete(spark: SparkSession, d: str) -> DataFrame:
    return _transaction_text(T.transactions(T.complete(_panel(spark, d, NET_ATTRS))))


def transactions_complementary(spark: SparkSession, d: str) -> DataFrame:
    sources = {**standin.sources(spark, d), "activity": standin.activity(spark, d)}
    return _transaction_text(T.transactions(T.complete(P.panels(sources, P.PanelSpec(excluded=RULE_ATTRS)))))


def transactions_by_class(spark: SparkSession, d: str) -> DataFrame:
    panel = _panel(spark, d, target="class")
    return T.complete(panel).select("id", _joined("target").alias("target"), _joined("other").alias("other"))


def transactions_single_view(spark: SparkSession, d: str) -> DataFrame:
    spec = P.PanelSpec(excluded=RULE_ATTRS, condition=f"year < {SPLIT_YEAR}", condition_is_per_id=True)
    panel = P.panels({"view": standin.isolate_view(spark, d)}, spec)
    return panel.select("id", _joined("target").alias("target"), _joined("other").alias("other"))


def panel_sampled(spark: SparkSession, d: str) -> DataFrame:
    panel = _panel(spark, d, NET_ATTRS, condition=f"year >= {SPLIT_YEAR}", cohorts=("ASIA", "EUROPE"))
    return panel.select("id", F.size("target").alias("tests"), _joined("other").alias("other"))


def variable_sources(spark: SparkSession, d: str) -> DataFrame:
    return P.variables(standin.sources(spark, d), P.PanelSpec(excluded=RULE_ATTRS))


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return T.baskets(_panel(spark, d)).select("id", C.key_of(F.col("items")).alias("items"))


def baskets_capped(spark: SparkSession, d: str) -> DataFrame:
    """The cap on transactions: the first baskets by id, as many as asked for."""
    kept = T.capped_baskets(T.baskets(_panel(spark, d)), CAPPED_BASKETS)
    return kept.select("id", C.key_of(F.col("items")).alias("items"))


def basket_empty_cell_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = T.empty_cell_filter(T.baskets(_panel(spark, d)), 0.6)
    return kept.select("id", F.size("items").alias("size"))


def holdout_condition(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, holdout_condition="year = 2001").select("id", "is_test")


def holdout_percent(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, holdout_fraction=HOLDOUT).select("id", "is_test")


def distinct_ids_capped(spark: SparkSession, d: str) -> DataFrame:
    spec = P.PanelSpec(condition=f"year < {SPLIT_YEAR}", limit=1000)
    return P.distinct_ids(standin.isolates(spark, d), spec)


def class_dimension(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d)


def ordinal_features(spark: SparkSession, d: str) -> DataFrame:
    return T.feature_rows(T.labelled_rows(_panel(spark, d, ("data_source", "cohort"))))


def indicator_features(spark: SparkSession, d: str) -> DataFrame:
    sources = {**standin.sources(spark, d), "activity": standin.activity(spark, d)}
    panel = P.panels(sources, P.PanelSpec(excluded=RULE_ATTRS))
    return T.feature_rows(T.labelled_rows(panel, domains={"serotype": SEGMENTS}))


# ---- rules ------------------------------------------------------------------


def frequent_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _itemsets(spark, d).select("item_key", F.size("items").alias("size"), "freq", "n_baskets")


def association_rules(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_rules(spark, d))


def rules_topn(spark: SparkSession, d: str) -> DataFrame:
    return _shown(mining.top_rules(_selected(spark, d), 50))


def rules_by_consequent(spark: SparkSession, d: str) -> DataFrame:
    wanted = ("PROMO:resistant", "serotype:BUILDING")
    return _shown(mining.select_rules(_rules(spark, d), MIN_LIFT, wanted))


def rules_by_antecedent(spark: SparkSession, d: str) -> DataFrame:
    return _shown(mining.with_antecedent(_selected(spark, d), ("serotype", "SMALL")))


def rules_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    return _shown(mining.one_to_one(_selected(spark, d)))


def rules_by_cohort(spark: SparkSession, d: str) -> DataFrame:
    spec = RunSpec("cohort", P.PanelSpec(excluded=RULE_ATTRS), support=0.02, confidence=MIN_CONFIDENCE, lift=MIN_LIFT)
    return _shown(pipeline.run_by_cohort(standin.sources(spark, d), spec, COHORTS), "cohort")


def run_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Rules of whole runs by cohort: mined, pruned and numbered in each of two cohorts."""
    spec = RunSpec(
        "run", P.PanelSpec(excluded=("year", "data_source"), cohorts=COHORTS[2:4]), support=0.02, confidence=MIN_CONFIDENCE,
        lift=MIN_LIFT, prune=True, cluster=False, by_cohort=True,
    )
    out = pipeline.run(standin.sources(spark, d), spec, _classes(spark, d))["rules"]
    return _shown(out, "cohort", "rule_id")


def run_configurations(spark: SparkSession, d: str) -> DataFrame:
    """Rules of three runs over one panel, told apart by condition and threshold."""
    def spec(name: str, condition: str, confidence: float) -> RunSpec:
        panel = P.PanelSpec(excluded=RULE_ATTRS, condition=condition)
        return RunSpec(name, panel, support=0.02, confidence=confidence, lift=MIN_LIFT, cluster=False)

    specs = [spec("before", PERIODS["before"], MIN_CONFIDENCE), spec("after", PERIODS["after"], MIN_CONFIDENCE), spec("all", "", 0.3)]
    out = pipeline.run_all(standin.sources(spark, d), specs, _classes(spark, d))
    parts = [_shown(tables["rules"], F.lit(name).alias("run"), "sampling_condition") for name, tables in out.items()]
    return reduce(DataFrame.unionByName, parts)


def _measured(spark: SparkSession, d: str) -> DataFrame:
    panel = settle(_panel(spark, d))
    rules = mining.association_rules(mining.frequent_itemsets(T.baskets(panel), MIN_SUPPORT), MIN_CONFIDENCE)
    return measures.rar(settle(rules), settle(T.profiles(panel)))


def rule_rar_support(spark: SparkSession, d: str) -> DataFrame:
    out = _measured(spark, d)
    shares = [F.round(c, 9).alias(c) for c in ("support", "real_support", "rar_support_exact")]
    return out.select("antecedent_key", "consequent_key", "n_baskets", "n_all", "n_complete", "n_xy", *shares)


def rule_rar_lift(spark: SparkSession, d: str) -> DataFrame:
    out = _measured(spark, d)
    return out.select("antecedent_key", "consequent_key", "n_complete", "n_x", "n_y", "n_xy", F.round("real_lift", 9).alias("real_lift"))


def rule_cross_support(spark: SparkSession, d: str) -> DataFrame:
    panel = settle(_panel(spark, d))
    rules = mining.association_rules(mining.frequent_itemsets(T.baskets(panel), MIN_SUPPORT), MIN_CONFIDENCE)
    out = measures.cross_support(settle(rules), settle(T.profiles(panel)))
    return out.select("antecedent_key", "consequent_key", F.round("cross_support", 9).alias("cross_support"))


def rules_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _shown(refine.prune(_selected(spark, d)))


def rules_combined(spark: SparkSession, d: str) -> DataFrame:
    return _shown(refine.combine(_selected(spark, d)))


def rule_states(spark: SparkSession, d: str) -> DataFrame:
    states = refine.with_states(_selected(spark, d), THRESHOLDS)
    return states.select("antecedent_key", "consequent_key", "support_state", "confidence_state", "lift_state")


def rule_clusters(spark: SparkSession, d: str) -> DataFrame:
    clustered = refine.cluster_rules(settle(_selected(spark, d)), THRESHOLDS)
    return clustered.select("antecedent_key", "consequent_key", "cluster")


def _rule_id(rules: DataFrame) -> DataFrame:
    return rules.withColumn("rule_id", F.concat_ws(" -> ", "antecedent_key", "consequent_key"))


def rule_numbers(spark: SparkSession, d: str) -> DataFrame:
    return refine.number_rules(_selected(spark, d), "run").select("rule_id", "rank", "antecedent_key", "consequent_key")


def rule_attributes(spark: SparkSession, d: str) -> DataFrame:
    spec = P.PanelSpec(excluded=RULE_ATTRS)
    return refine.rule_attributes(_rule_id(_selected(spark, d)), P.variables(standin.sources(spark, d), spec))


def rule_weighted_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = refine.weighted_rows(_selected(spark, d), repeat=True)
    features = F.array_join(
        F.transform("features", lambda x: F.concat_ws("=", x["feature"], F.coalesce(x["value"].cast("int").cast("string"), F.lit("?")))), " & "
    )
    return rows.select("antecedent_key", features.alias("features"), "label", "weight", "copy")


def _run_spec(cluster: bool) -> RunSpec:
    return RunSpec(
        "run", P.PanelSpec(excluded=RULE_ATTRS), support=MIN_SUPPORT, real_support=REAL_SUPPORT,
        confidence=MIN_CONFIDENCE, lift=MIN_LIFT, real_measures=True, prune=True, combine=True, cluster=cluster,
    )


def rules_refined(spark: SparkSession, d: str) -> DataFrame:
    spec = _run_spec(cluster=False)
    panel = settle(P.panels(standin.sources(spark, d), spec.panel))
    _, final = pipeline.refined(pipeline.mine(panel, spec), settle(T.profiles(panel)), spec)
    shown = [F.round(m, 9).alias(m) for m in refine.MEASURES]
    return final.select("rule_id", "antecedent_key", "consequent_key", *shown)


def run_rules(spark: SparkSession, d: str) -> DataFrame:
    spec = _run_spec(cluster=True)
    panel = settle(P.panels(standin.sources(spark, d), spec.panel))
    _, final = pipeline.refined(pipeline.mine(panel, spec), settle(T.profiles(panel)), spec)
    shown = [F.round(m, 9).alias(m) for m in refine.MEASURES]
    return final.select("rule_id", "antecedent_key", "consequent_key", "cluster", *shown)


# ---- network ----------------------------------------------------------------


def _pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst", F.round("support", 9).alias("support"), F.round("lift", 9).alias("lift"))


def net_target_target(spark: SparkSession, d: str) -> DataFrame:
    return _pair_stats(network.target_target(_profiles(spark, d)))


def net_target_attribute(spark: SparkSession, d: str) -> DataFrame:
    return _pair_stats(network.target_attribute(_profiles(spark, d)))


def net_target_attribute_lists(spark: SparkSession, d: str) -> DataFrame:
    sources = {**standin.sources(spark, d), "activity": standin.activity(spark, d)}
    panel = P.panels(sources, P.PanelSpec(excluded=RULE_ATTRS))
    return _pair_stats(network.target_attribute(settle(T.profiles(panel))))


def net_attribute_attribute(spark: SparkSession, d: str) -> DataFrame:
    return _pair_stats(network.attribute_attribute(_profiles(spark, d)))


def net_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("kind", "src", "dst", F.round("support", 9).alias("support"), F.round("lift", 9).alias("lift"))


def net_strength(spark: SparkSession, d: str) -> DataFrame:
    named = network.nodes(_edges(spark, d), _classes(spark, d))
    return named.select("node", "class", "description", F.round("strength", 6).alias("strength"))


def net_degree(spark: SparkSession, d: str) -> DataFrame:
    out = network.degree_centrality(_edges(spark, d))
    return out.select("node", "degree", F.round("degree_centrality", 9).alias("degree_centrality"))


def net_betweenness(spark: SparkSession, d: str) -> DataFrame:
    out = network.betweenness(_edges(spark, d, bipartite=True))
    return out.select("node", F.round("betweenness", 9).alias("betweenness"))


def net_clustering_coefficient(spark: SparkSession, d: str) -> DataFrame:
    out = network.clustering_coefficients(_edges(spark, d))
    return out.select("node", "degree", "triangles", F.round("clustering", 9).alias("clustering"))


def net_average_clustering(spark: SparkSession, d: str) -> DataFrame:
    return network.average_clustering(_edges(spark, d)).select(F.round("average_clustering", 9).alias("average_clustering"))


def net_girvan_newman(spark: SparkSession, d: str) -> DataFrame:
    """The first splits of the network by its busiest edges."""
    return network.girvan_newman(_edges(spark, d, bipartite=True), max_communities=3)


def net_modularity_by_class(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    out = network.modularity(edges, network.class_communities(edges, _classes(spark, d)))
    return out.select(F.round("modularity", 9).alias("modularity"), "communities")


def net_fluid_communities(spark: SparkSession, d: str) -> DataFrame:
    return network.fluid_communities(_edges(spark, d, bipartite=True), k=3)


def net_fluid_checks(spark: SparkSession, d: str) -> DataFrame:
    """What fluid communities must fulfil: all nodes placed, as many fluids as asked for, nothing left to move."""
    edges = _edges(spark, d, bipartite=True)
    found = settle(network.fluid_communities(edges, k=3))
    unsettled = network.fluid_unsettled(edges, found).agg(F.count("*").alias("unsettled"))
    totals = found.agg(F.count("*").alias("nodes"), F.countDistinct("community").alias("communities"), F.bool_and("converged").alias("converged"))
    return totals.withColumn("unsettled", unsettled.scalar())


def net_greedy_merges(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d, bipartite=True)
    merges = network.greedy_merges(edges, settle(network.graph_nodes(edges)))
    return merges.select("node", "into", F.round("gain", 9).alias("gain"))


def net_communities(spark: SparkSession, d: str) -> DataFrame:
    return network.greedy_communities(_edges(spark, d, bipartite=True))


# ---- reports ----------------------------------------------------------------


def report_mdr(spark: SparkSession, d: str) -> DataFrame:
    out = reports.resistance_ratio(standin.isolate_view(spark, d), SPLIT_YEAR, "Building")
    return out.withColumn("ratio", F.round("ratio", 6))


def report_mdr_any_case(spark: SparkSession, d: str) -> DataFrame:
    """The report on texts whose case differs from row to row."""
    view = standin.isolate_view(spark, d)
    for column, every in (("serotype", 2), ("class", 3), ("status", 5)):
        view = view.withColumn(column, F.when(F.col("id") % every == 0, F.initcap(column)).otherwise(F.col(column)))
    out = reports.resistance_ratio(view, SPLIT_YEAR, "Building", family=("SIZE", "Grade"), name_of_family="kind", more_than=1)
    return out.withColumn("ratio", F.round("ratio", 6))


def report_serotype_share(spark: SparkSession, d: str) -> DataFrame:
    shown = ("BUILDING", "FURNITURE", "MACHINERY")
    intervals = {"1996_1997": (1996, 1997), "1998_1999": (1998, 1999)}
    out = reports.serotype_share(standin.isolate_view(spark, d), shown, intervals)
    return out.select("interval", *shown, "total", *[F.round(f"{s}_pct", 6).alias(f"{s}_pct") for s in shown])


PERIODS = {"before": f"year < {SPLIT_YEAR}", "after": f"year >= {SPLIT_YEAR}"}


def _period_rules(panel: DataFrame) -> DataFrame:
    rules = mining.association_rules(mining.frequent_itemsets(T.baskets(panel), MIN_SUPPORT), MIN_CONFIDENCE)
    measured = measures.real_measures(settle(rules), settle(T.profiles(panel)), "RAR")
    return settle(_rule_id(measured).withColumn("association", F.col("rule_id")))


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    panel = settle(_panel(spark, d, slices=PERIODS))
    before, after = (_period_rules(P.slice_of(panel, period)) for period in PERIODS)
    recorded = reports.recorded(before, refine.rule_attributes(before))
    return reports.rule_change(recorded, after, CHANGE_LIMITS), before


def report_rule_change(spark: SparkSession, d: str) -> DataFrame:
    changes, _ = _changes(spark, d)
    names = [f"{p}_{m}" for p in ("before", "after") for m in ("real_support", "support", "confidence", "lift")]
    return changes.select("association", *[F.round(n, 9).alias(n) for n in names], "real_support_mark", "confidence_mark", "lift_mark")


def report_rule_summary(spark: SparkSession, d: str) -> DataFrame:
    changes, before = _changes(spark, d)
    types = reports.rule_types(refine.rule_attributes(before), _classes(spark, d))
    out = reports.rule_change_report(changes, types)
    names = [f"{p}_{m}" for p in ("before", "after") for m in ("real_support", "confidence", "lift")]
    return out.select("rule_type", "association", *[F.round(n, 9).alias(n) for n in names], "real_support_mark", "confidence_mark", "lift_mark")


def report_rule_type(spark: SparkSession, d: str) -> DataFrame:
    attributes = refine.rule_attributes(_rule_id(_selected(spark, d)))
    return reports.rule_types(attributes, _classes(spark, d), ("SIZE", "GRADE"))


def report_network_change(spark: SparkSession, d: str) -> DataFrame:
    classes = _classes(spark, d)

    panel = settle(_panel(spark, d, NET_ATTRS, slices=PERIODS))

    def period(name: str) -> DataFrame:
        pairs = network.co_occurrence(settle(T.profiles(P.slice_of(panel, name))), True)
        edges = settle(network.network_edges(pairs, lift=1.0))
        return network.class_communities(edges, classes).join(network.degree_centrality(edges), "node")

    out = reports.network_change(*(period(name) for name in PERIODS))
    return out.select(
        "node", "community_before", "community_after",
        *[F.round(c, 9).alias(c) for c in ("centrality_before", "centrality_after")],
    )


# ---- results written and read back ------------------------------------------


def sink_rules(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of rules, one of them written again: its first rows are gone, the other run is untouched."""
    root = new_path(spark)
    rules = sinks.rule_table(_rule_id(settle(_selected(spark, d))))
    results.write_results(spark, root, "all", {"rules": rules})
    results.write_results(spark, root, "short", {"rules": rules})
    results.write_results(spark, root, "short", {"rules": rules.where(F.size("antecedent") == 1)})
    back = [results.read_results(spark, root, run)["rules"].withColumn("run", F.lit(run)) for run in ("all", "short")]
    return _shown(reduce(DataFrame.unionByName, back), "run", "association", "status")


def sink_rule_attributes(spark: SparkSession, d: str) -> DataFrame:
    root = new_path(spark)
    results.write_results(spark, root, "run", {"rule_attributes": rule_attributes(spark, d)})
    return results.read_results(spark, root, "run")["rule_attributes"]


def sink_updated_rule(spark: SparkSession, d: str) -> DataFrame:
    """One field of one rule and one field of a group of rules changed in place."""
    root = new_path(spark)
    rules = settle(sinks.rule_table(_rule_id(_selected(spark, d))))
    results.write_results(spark, root, "run", {"rules": rules, "rule_attributes": refine.rule_attributes(rules)})
    first = scalar_of(rules, F.min("rule_id"))
    results.update_results(spark, root, "run", "rules", F.col("rule_id") == first, {"status": "confirmed"})
    results.update_results(spark, root, "run", "rules", F.col("lift") > 1.02, {"cluster": "lifted"})
    back = results.read_results(spark, root, "run")
    sizes = back["rule_attributes"].groupBy("rule_id").agg(F.count("*").alias("items"))
    return back["rules"].join(sizes, "rule_id").select("rule_id", "status", "cluster", "items")


def sink_deleted(spark: SparkSession, d: str) -> DataFrame:
    """What is left after networks were deleted in every run, one run as a whole, and the rest by a clean write."""
    edges, baskets_ = _edges(spark, d, bipartite=True), settle(baskets(spark, d))
    root, seen = new_path(spark), []

    def look(step: str) -> None:
        runs = [r["run_id"] for r in results.visible(spark, root).select("run_id").distinct().collect()]
        for run in sorted(runs):
            for name, df in results.read_results(spark, root, run).items():
                seen.append(df.agg(F.count("*").alias("rows")).select(F.lit(step).alias("step"), F.lit(run).alias("run"), F.lit(name).alias("name"), "rows"))

    for run in ("a", "b"):
        results.write_results(spark, root, run, {"edges": edges, "baskets": baskets_})
    results.delete_results(spark, root, names=["edges"])
    look("networks deleted")
    results.delete_results(spark, root, "a")
    look("run deleted")
    results.write_results(spark, root, "c", {"edges": edges}, clean=True)
    look("clean write")
    return reduce(DataFrame.unionByName, seen)


def sink_network(spark: SparkSession, d: str) -> DataFrame:
    """Header and nodes of a network, written and joined again."""
    edges, classes, root = _edges(spark, d), settle(_classes(spark, d)), new_path(spark)
    nodes = network.nodes(edges, classes).join(network.degree_centrality(edges), "node").withColumn("run_id", F.lit("run"))
    head = network.modularity(edges, network.class_communities(edges, classes))
    head = sinks.with_metadata(head, {"run_id": "run"} | pipeline.data_of_run(standin.sources(spark, d), RunSpec("run")))
    results.write_results(spark, root, "run", {"nodes": nodes, "network": head})
    back = results.read_results(spark, root, "run")
    return back["nodes"].join(back["network"], "run_id").select(
        "run_id", "node", "class", "degree", F.round("degree_centrality", 9).alias("degree_centrality"),
        F.round("strength", 6).alias("strength"), F.round("modularity", 9).alias("modularity"), "communities", "data_sources",
    )


def sink_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Header, clusters with their profile text, and members, written and joined again."""
    assigned, meta = _by_burden(spark, d)
    assigned, root = settle(assigned), new_path(spark)
    sizes = clusters.cluster_sizes(assigned).drop("labels")
    texts = clusters.profile_texts(clusters.cluster_profiles(assigned, meta))
    head = sizes.agg(F.count("*").alias("clusters"))
    tables = {"cluster_analysis": head, "cluster_sizes": sizes.join(texts, "cluster", "left"), "cluster_members": clusters.cluster_members(assigned)}
    results.write_results(spark, root, "run", tables)
    back = results.read_results(spark, root, "run")
    members = back["cluster_members"].groupBy("cluster").agg(F.count("*").alias("labels"))
    total = scalar_of(back["cluster_analysis"], F.max("clusters"))
    return back["cluster_sizes"].join(members, "cluster").withColumn("clusters", total)


def sink_graphml(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a GraphML document, read from its lines."""
    path = new_path(spark)
    sinks.write_graphml(_edges(spark, d), path)
    lines = spark.read.text(path)
    found = [F.regexp_extract("value", pattern, 1).alias(name) for name, pattern in (
        ("src", 'source="([^"]*)"'), ("dst", 'target="([^"]*)"'), ("weight", 'key="weight">([^<]*)<'),
    )]
    return lines.where(F.contains("value", F.lit("<edge "))).select(*found).withColumn("weight", F.round(F.col("weight").cast("double"), 6))


# ---- chart tables -----------------------------------------------------------


def _chart_edges(spark: SparkSession, d: str) -> DataFrame:
    return charts.chart_edges(_selected(spark, d), "lift", (), RENAMES)


def chart_edges(spark: SparkSession, d: str) -> DataFrame:
    out = charts.listed(charts.chart_edges(_selected(spark, d), "lift", ("ECONOMY",), RENAMES))
    return out.select("ant", "con", F.round("weight", 6).alias("weight"))


def chart_grouped_nodes(spark: SparkSession, d: str) -> DataFrame:
    return charts.node_classes(_selected(spark, d), _classes(spark, d), {"left": 4, "right": 3})


def chart_measures(spark: SparkSession, d: str) -> DataFrame:
    out = charts.measures(_selected(spark, d))
    return out.select("label", *[F.round(m, 9).alias(m) for m in ("support", "confidence", "lift")])


def chart_filtered_rules(spark: SparkSession, d: str) -> DataFrame:
    return _shown(charts.rules_to_show(_selected(spark, d), antecedent=":resistant", consequent="M"))


def chart_chord_links(spark: SparkSession, d: str) -> DataFrame:
    rules = settle(_selected(spark, d))
    node_class = charts.node_classes(rules, _classes(spark, d), changes=RENAMES)
    links = charts.chord_links(charts.chart_edges(rules, changes=RENAMES), node_class)
    return links.select("source", "target", F.round("value", 6).alias("value"))


def chart_chord_nodes(spark: SparkSession, d: str) -> DataFrame:
    rules = settle(_selected(spark, d))
    node_class = charts.node_classes(rules, _classes(spark, d), changes=RENAMES)
    return charts.chord_nodes(charts.chart_edges(rules, changes=RENAMES), node_class)


def chart_arrow_labels(spark: SparkSession, d: str) -> DataFrame:
    return charts.arrow_labels(_chart_edges(spark, d))


# ---- clusters ---------------------------------------------------------------


def _complete(spark: SparkSession, d: str) -> DataFrame:
    return T.complete(_panel(spark, d, NET_ATTRS))


def profile_status(spark: SparkSession, d: str) -> DataFrame:
    panel = settle(_complete(spark, d))
    return clusters.status_profiles(panel).drop("other")


def profile_attributes(spark: SparkSession, d: str) -> DataFrame:
    out = clusters.attribute_profiles(_complete(spark, d), ("serotype", "data_source"))
    return clusters.indicator_columns(out, [f"serotype{s}" for s in SEGMENTS])


def cluster_ward(spark: SparkSession, d: str) -> DataFrame:
    panel = settle(_complete(spark, d))
    names = clusters.target_names(panel)
    assigned = clusters.ward_clusters(settle(clusters.status_vectors(panel, names)))
    return clusters.row_share(assigned)


def cluster_merge_tree(spark: SparkSession, d: str) -> DataFrame:
    panel = settle(_complete(spark, d))
    names = clusters.target_names(panel)
    points = settle(clusters.weighted_points(clusters.status_vectors(panel, names)))
    return clusters.merge_tree(clusters.ward_merges(points, block=2048))


def cluster_tree_totals(spark: SparkSession, d: str) -> DataFrame:
    """What every Ward tree must add up to: its heights are the whole sum of squares."""
    panel = settle(_complete(spark, d))
    points = settle(clusters.weighted_points(clusters.status_vectors(panel, clusters.target_names(panel))))
    return clusters.ward_merges(points).agg(
        F.count("*").alias("merges"), F.max("leaves").alias("leaves"), F.max("size").cast("long").alias("size"),
        F.round(F.sum("d2"), 3).alias("sum_of_squares"),
    )


def cluster_attribute_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the attribute profiles, in blocks smaller than their number."""
    base = settle(clusters.attribute_profiles(_complete(spark, d), ("serotype", "data_source")))
    names = bounded_names(base.select(F.explode("indicators").alias("name")), "name")
    points = settle(clusters.weighted_points(clusters.indicator_vectors(base, names)))
    return clusters.merge_tree(clusters.ward_merges(points, block=16)).select(
        "step", F.round("distance", 6).alias("distance"), F.col("size").cast("long").alias("size"), "leaves"
    )


def _by_burden(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A plain assignment: cluster = number of resistant or intermediate tests."""
    burden = F.size(F.filter("target", lambda x: C.severity(x["value"]) > 1))
    rows = settle(_complete(spark, d).select("id", clusters.status_label().alias("label"), burden.alias("cluster"), "other"))
    return rows.select("id", "label", "cluster"), rows.select("label", F.col("other").alias("data"))


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    assigned, _ = _by_burden(spark, d)
    return clusters.cluster_sizes(assigned).select("cluster", "cluster_size", F.size("labels").alias("labels"))


def cluster_profiles(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cluster_profiles(*_by_burden(spark, d))


def cluster_top5(spark: SparkSession, d: str) -> DataFrame:
    return clusters.top_values(clusters.cluster_profiles(*_by_burden(spark, d)), "serotype")


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    panel = settle(_complete(spark, d))
    pairs = panel.select(F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    return clusters.hamming_pairs(panel, pairs)


# ---- trees ------------------------------------------------------------------


def _tree_panel(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d, ("data_source", "cohort"), holdout_fraction=HOLDOUT)


def _tree_rows(spark: SparkSession, d: str, for_test: bool = False) -> DataFrame:
    return T.labelled_rows(_tree_panel(spark, d), domains={"serotype": SEGMENTS}, for_test=for_test)


def _tree_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows, alike ones counted, from one reading of the sources."""
    panel = settle(T.alike(_tree_panel(spark, d)))
    rows, held = (T.labelled_rows(panel, domains={"serotype": SEGMENTS}, for_test=x) for x in (False, True))
    return settle(rows), settle(held)


def _row_totals(rows: DataFrame) -> DataFrame:
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x["value"])
    return rows.select("id", "label", F.size("features").alias("features"), total.alias("total"))


def tree_rows(spark: SparkSession, d: str) -> DataFrame:
    return _row_totals(_tree_rows(spark, d))


def test_rows(spark: SparkSession, d: str) -> DataFrame:
    return _row_totals(_tree_rows(spark, d, for_test=True))


def tree_null_filter(spark: SparkSession, d: str) -> DataFrame:
    out = tree.feature_nulls(settle(_tree_rows(spark, d)), TREE_NULLS)
    return out.select("feature", "present", F.round("null_share", 9).alias("null_share"), "kept")


def tree_imputed(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(_tree_rows(spark, d))
    counts = tree.value_counts(rows)
    names = tree.kept_features(rows, TREE_NULLS, counts)
    table = tree.imputed(rows, names, tree.imputations(rows, counts))
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names]
    return table.select("id", "label", F.inline(F.array(*cells)))


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    alike = T.alike(T.train(_tree_panel(spark, d)))
    rows = settle(T.labelled_rows(alike, domains={"serotype": SEGMENTS}))
    return tree.fit_tree(rows, TREE_NULLS).nodes(spark)


def tree_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows, held = _tree_parts(spark, d)
    return tree.fit_tree(rows, TREE_NULLS).accuracies({"train": rows, "test": held})


def _pruning_path(spark: SparkSession, d: str) -> DataFrame:
    rows, held = _tree_parts(spark, d)
    return tree.fit_tree(rows, TREE_NULLS).path(held)


def tree_pruning_path(spark: SparkSession, d: str) -> DataFrame:
    """The cost-complexity path of the tree, with the accuracy on held-out rows at every step."""
    return _pruning_path(spark, d)


def tree_pruning_end(spark: SparkSession, d: str) -> DataFrame:
    """The last step of the path: one leaf, which has all rows and names the commonest label."""
    path = _pruning_path(spark, d).orderBy(F.desc("step")).limit(1)
    return path.select("leaves", F.round("risk", 9).alias("risk"), "rows", "hits", F.round("accuracy", 9).alias("accuracy"))


REGISTRY: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    report_mdr, report_mdr_any_case, observations_long, transactions_complete, transactions_complementary, transactions_by_class,
    transactions_single_view, panel_sampled, variable_sources, baskets, baskets_capped, basket_empty_cell_filter, holdout_condition,
    holdout_percent, distinct_ids_capped, class_dimension, ordinal_features, indicator_features,
    report_serotype_share, frequent_itemsets, association_rules, rules_topn, rules_by_consequent,
    rules_by_antecedent, rules_one_to_one, rules_by_cohort, rule_rar_support, rule_rar_lift, rule_cross_support,
    rules_pruned, rules_combined, rule_states, rule_clusters, rule_numbers, rule_attributes, rule_weighted_rows,
    rules_refined, run_rules, net_target_target, net_target_attribute, net_target_attribute_lists, net_attribute_attribute,
    net_edges, net_strength, net_degree, net_betweenness, net_clustering_coefficient, net_modularity_by_class,
    net_communities, net_greedy_merges, net_fluid_communities, net_fluid_checks,
    report_rule_change, report_rule_summary, report_rule_type, report_network_change, chart_edges,
    chart_grouped_nodes, chart_measures, chart_filtered_rules, chart_chord_links, chart_chord_nodes,
    chart_arrow_labels, profile_status, profile_attributes, cluster_ward, cluster_merge_tree,
    cluster_tree_totals, cluster_attribute_tree, cluster_sizes,
    cluster_profiles, cluster_top5, hamming_pairs, tree_rows, test_rows, tree_null_filter, tree_imputed,
    tree_nodes, tree_accuracy, tree_pruning_path, tree_pruning_end, run_cohorts, run_configurations, sink_rules,
    sink_rule_attributes, sink_updated_rule, sink_deleted, sink_network, sink_clusters, sink_graphml,
    net_average_clustering, net_girvan_newman,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in REGISTRY}
