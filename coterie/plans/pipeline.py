"""End-to-end runs: panels, rules, charts, network, clusters and tree."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.frames import bounded_names, settle
from coterie.operators import charts, clusters, measures, mining, network, refine, transactions, tree
from coterie.plans.spec import RunSpec
from coterie.sources import panels as P
from coterie.sources.results import write_results
from coterie.sources.sinks import rule_table, with_metadata


def mine(panel: DataFrame, spec: RunSpec) -> DataFrame:
    """Association rules of the panel's baskets."""
    baskets = transactions.empty_cell_filter(transactions.baskets(panel, spec.focus), spec.empty_cell_threshold)
    if spec.transaction_limit:
        baskets = transactions.capped_baskets(baskets, spec.transaction_limit)
    itemsets = mining.frequent_itemsets(baskets, spec.support, spec.min_transactions)
    return mining.association_rules(itemsets, spec.confidence)


def refined(rules: DataFrame, profiles: DataFrame, spec: RunSpec) -> tuple[DataFrame, DataFrame]:
    """Numbered rules, and the rules to record (combined if asked for)."""
    rules = mining.select_rules(rules, spec.lift, spec.consequents)
    rules = mining.top_rules(rules, spec.rules_limit)
    rules = mining.with_antecedent(rules, spec.antecedents)
    if spec.one_to_one:
        rules = mining.one_to_one(rules)
    if spec.real_measures:
        rules = measures.by_real_support(measures.real_measures(settle(rules), profiles, spec.approach), spec.real_support)
    if spec.prune:
        rules = refine.prune(rules)
    numbered = refine.number_rules(rules, spec.run_id)
    if spec.cluster:
        numbered = refine.cluster_rules(numbered, spec.thresholds)
    final = numbered = settle(numbered)
    if spec.combine:
        final = settle(refine.combine(numbered))
        if spec.cluster:
            final = refine.cluster_rules(final, spec.thresholds)
    return numbered, final


def analyse_network(profiles: DataFrame, classes: DataFrame, spec: RunSpec) -> dict[str, DataFrame]:
    """Edges, nodes with centralities and communities, and the modularity."""
    pairs = network.co_occurrence(profiles, spec.bipartite)
    edges = settle(network.network_edges(pairs, spec.network_support, spec.network_lift))
    if edges.isEmpty():
        return {"edges": edges}
    communities = settle(network.greedy_communities(edges))
    nodes = (
        network.nodes(edges, classes)
        .join(network.degree_centrality(edges).drop("degree"), "node")
        .join(network.betweenness(edges), "node")
        .join(communities, "node")
    )
    return {
        "edges": edges.withColumn("run_id", F.lit(spec.run_id)),
        "nodes": nodes.withColumn("run_id", F.lit(spec.run_id)),
        "network": network.modularity(edges, communities).withColumn("run_id", F.lit(spec.run_id)),
    }


def analyse_clusters(panel: DataFrame, spec: RunSpec) -> dict[str, DataFrame]:
    """Cluster of every transaction, cluster sizes, members and profiles."""
    if spec.cluster_attributes:
        base = settle(clusters.attribute_profiles(panel, spec.cluster_attributes))
        names = bounded_names(base.select(F.explode("indicators").alias("name")), "name")
        table = clusters.indicator_vectors(base, names)
        meta = base.select("label", F.col("target").alias("data"))
    else:
        names = clusters.target_names(panel)
        table = settle(clusters.status_vectors(panel, names))
        meta = table.select("label", F.col("other").alias("data"))
    assigned = settle(clusters.ward_clusters(table, spec.clusters))
    profiles = clusters.cluster_profiles(assigned, meta)
    out = {
        "assigned": assigned,
        "cluster_members": clusters.cluster_members(assigned),
        "cluster_sizes": clusters.cluster_sizes(assigned),
        "cluster_profiles": profiles,
    }
    if spec.analysed_attribute:
        out["cluster_top"] = clusters.top_values(profiles, spec.analysed_attribute)
    return {k: v.withColumn("run_id", F.lit(spec.run_id)) for k, v in out.items()}


def data_of_run(sources: Iterable[str], spec: RunSpec) -> dict[str, str]:
    """What the header of an analysis says of its data."""
    return {"data_sources": ", ".join(sources), "sampling_condition": spec.panel.condition}


def run_panel(
    panel: DataFrame,
    sources: Mapping[str, DataFrame],
    spec: RunSpec,
    classes: DataFrame,
    wider: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All result tables of one run over its settled panel; `wider` is the panel with the complementary sources."""
    profiles = settle(transactions.profiles(panel))
    rules = mine(panel, spec)
    numbered, final = refined(rules, profiles, spec)
    shown = charts.rules_to_show(numbered, spec.show_antecedent, spec.show_consequent)
    node_class = charts.node_classes(shown, classes, spec.grouping, spec.hidden, spec.title_changes)
    edges = charts.chart_edges(shown, spec.weight, spec.hidden, spec.title_changes)
    thresholds = spec.thresholds | ({"real_support": spec.real_support} if spec.real_measures else {})
    held = spec.panel.holdout_condition or f"{spec.panel.holdout_fraction} of ids held out"
    data = data_of_run(sources, spec)
    attributes = sorted({c.lower() for name, df in sources.items() for c in P.attribute_columns(df, spec.panel, name)})
    variables = settle(P.variables(sources, spec.panel))
    out = {
        "rules": with_metadata(
            rule_table(final),
            data
            | {
                "correlation_target": spec.panel.target,
                "focus": ", ".join(spec.focus),
                "test_condition": held,
                "interested_antecedent": ", ".join(spec.antecedents) or "All",
                "interested_consequent": ", ".join(spec.consequents) or "All",
                "included_var": ", ".join(attributes),
                "cohorts": ", ".join(spec.panel.cohorts) or "All Cohorts",
                "parameters": ", ".join(f"{k}: {v}" for k, v in thresholds.items()),
            },
        ),
        "rule_attributes": refine.rule_attributes(final, variables),
        "variables": variables,
        "chart_edges": edges,
        "chart_links": charts.chord_links(edges, node_class),
        "chart_measures": charts.measures(shown),
    }
    if spec.network:
        out |= analyse_network(profiles, classes, spec)
        if "network" in out:
            out["network"] = with_metadata(out["network"], data)
    if spec.hierarchy:
        kept = transactions.complete(panel if wider is None else wider)
        out |= analyse_clusters(kept if not kept.isEmpty() else transactions.complete(panel), spec)
        count = out["cluster_sizes"].agg(F.count("*").alias("clusters"))
        out["cluster_analysis"] = with_metadata(count, data).withColumn("run_id", F.lit(spec.run_id))
        texts = clusters.profile_texts(out["cluster_profiles"])
        out["cluster_sizes"] = out["cluster_sizes"].join(texts, "cluster", "left").fillna("", ["analysis"])
    if spec.tree:
        alike = settle(transactions.alike(panel))
        rows = settle(transactions.labelled_rows(alike, spec.focus, spec.domains))
        fitted = tree.fit_tree(rows, spec.null_threshold, ccp_alpha=spec.ccp_alpha)
        held_out = settle(transactions.labelled_rows(alike, spec.focus, spec.domains, for_test=True))
        out["tree_nodes"] = fitted.nodes(panel.sparkSession)
        out["tree_accuracy"] = fitted.accuracies({"train": rows, "test": held_out})
        out["tree_text"] = panel.sparkSession.createDataFrame([(fitted.text(),)], "text string")
    return out


def run(
    sources: Mapping[str, DataFrame],
    spec: RunSpec,
    classes: DataFrame,
    complementary: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All result tables of one run; with `by_cohort`, of a run for each cohort, told apart by `cohort`."""
    if spec.by_cohort:
        return run_cohorts(sources, spec, classes, complementary)
    panel = settle(P.panels(sources, spec.panel))
    wider = settle(P.panels({**sources, **complementary}, spec.panel)) if complementary and spec.hierarchy else None
    return run_panel(panel, sources, spec, classes, wider)


# ---- several runs over one panel --------------------------------------------


def cohort_names(sources: Mapping[str, DataFrame], spec: RunSpec) -> list[str]:
    """The declared cohorts, else all that the entity has."""
    declared = spec.panel.cohorts
    if declared and tuple(declared) != ("All",):
        return list(declared)
    entity = sources[spec.panel.entity or next(iter(sources))]
    column = F.col(spec.panel.cohort_col).cast("string").alias("name")
    return bounded_names(entity.select(column).where("name is not null"), "name")


def cohort_panel(sources: Mapping[str, DataFrame], spec: RunSpec, cohorts: Iterable[str]) -> tuple[P.PanelSpec, DataFrame]:
    """One settled panel with a slice for each cohort: the sources are read and grouped once."""
    column = spec.panel.cohort_col
    sliced = replace(
        spec.panel,
        cohorts=(),
        excluded=(*spec.panel.excluded, column),
        slices={c: f"`{column}` = {P.text_literal(c)}" for c in cohorts},
    )
    return sliced, settle(P.panels(sources, sliced))


def run_by_cohort(
    sources: Mapping[str, DataFrame], spec: RunSpec, cohorts: Iterable[str]
) -> DataFrame:
    """Rules mined for each declared cohort by itself, with a `cohort` column."""
    cohorts = list(cohorts)
    _, panel = cohort_panel(sources, spec, cohorts)
    found = []
    for cohort in cohorts:
        rules = mine(P.slice_of(panel, cohort), spec)
        found.append(mining.select_rules(rules, spec.lift, spec.consequents).withColumn("cohort", F.lit(cohort)))
    return reduce(DataFrame.unionByName, found)


def run_cohorts(
    sources: Mapping[str, DataFrame],
    spec: RunSpec,
    classes: DataFrame,
    complementary: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Every step of a run for each cohort by itself: the tables of `run` with a `cohort` column.

    Rules are numbered in each cohort; their ids carry its name.
    """
    cohorts = cohort_names(sources, spec)
    sliced, panel = cohort_panel(sources, spec, cohorts)
    wide = complementary and spec.hierarchy
    wider = settle(P.panels({**sources, **complementary}, sliced)) if wide else None
    parts: dict[str, list[DataFrame]] = {}
    for cohort in cohorts:
        one = replace(
            spec, run_id=f"{spec.run_id}_{cohort}", by_cohort=False,
            panel=replace(spec.panel, cohorts=(cohort,), excluded=sliced.excluded),
        )
        of_wider = P.slice_of(wider, cohort) if wide else None
        tables = run_panel(P.slice_of(panel, cohort), sources, one, classes, of_wider)
        for name, df in tables.items():
            parts.setdefault(name, []).append(df.withColumn("cohort", F.lit(cohort)))
    return {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs) for name, dfs in parts.items()}


def _shareable(spec: RunSpec) -> P.PanelSpec | None:
    """What runs must agree in to be slices of one panel; None if a run needs a panel of its own."""
    if spec.by_cohort or spec.panel.limit or spec.panel.slices:
        return None
    return replace(spec.panel, condition="", condition_is_per_id=False, cohorts=())


def run_all(
    sources: Mapping[str, DataFrame], specs: Iterable[RunSpec], classes: DataFrame
) -> dict[str, dict[str, DataFrame]]:
    """Every named run over the same sources.

    Runs that differ in condition, cohorts, thresholds or steps only are slices of one
    settled panel, so the sources are read and grouped once for all of them.
    """
    specs, out = list(specs), {}
    groups: list[tuple[P.PanelSpec, list[RunSpec]]] = []
    for spec in specs:
        shared = _shareable(spec)
        if shared is None:
            out[spec.run_id] = run(sources, spec, classes)
            continue
        for known, members in groups:
            if known == shared:
                members.append(spec)
                break
        else:
            groups.append((shared, [spec]))
    for shared, members in groups:
        if len(members) == 1:
            out[members[0].run_id] = run(sources, members[0], classes)
            continue
        slices = {s.run_id: P.scope_text(s.panel) for s in members}
        panel = settle(P.panels(sources, replace(shared, slices=slices)))
        for spec in members:
            out[spec.run_id] = run_panel(P.slice_of(panel, spec.run_id), sources, spec, classes)
    return {s.run_id: out[s.run_id] for s in specs}


def record(root: str, runs: Mapping[str, Mapping[str, DataFrame]], clean: bool = False) -> None:
    """Write each run's tables; all tables of a run become visible at once."""
    for i, (run_id, tables) in enumerate(runs.items()):
        spark = next(iter(tables.values())).sparkSession
        write_results(spark, root, run_id, tables, clean=clean and i == 0)
