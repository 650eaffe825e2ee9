"""Trees over rows that are counted: same results, with work that follows the distinct rows."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from coterie.functions.frames import settle
from coterie.operators import transactions as T
from coterie.operators import tree
from coterie.plans import queries as Q
from coterie.sources import panels as P
from coterie.sources import standin

SEROTYPES = ("AUTOMOBILE", "BUILDING", "FURNITURE")
LABELLED = "id long, label_attr string, label string, features array<struct<feature:string,value:double>>"


@pytest.fixture(scope="module")
def own(spark):
    """Own isolates and tests, most of them alike."""
    rng = random.Random(5)
    isolates, tests = [], []
    for i in range(3000):
        serotype, year = rng.choice(SEROTYPES), rng.choice((1996, 1997))
        isolates.append((i, serotype, year, "x", "y"))
        likely = "resistant" if serotype == "BUILDING" else "intermediate"
        tests.append((i, "A", "c", likely if rng.random() < 0.8 else "resistant"))
        if rng.random() < 0.7:
            tests.append((i, "B", "c", rng.choice(("resistant", "susceptible"))))
    return {
        "isolates": settle(spark.createDataFrame(isolates, "id long, serotype string, year int, data_source string, cohort string")),
        "tests": settle(spark.createDataFrame(tests, "id long, drug string, class string, status string")),
    }


@pytest.fixture
def read(own, monkeypatch):
    """The registered queries on own rows; a list with an entry for each time they take the sources."""
    taken = []
    monkeypatch.setattr(standin, "sources", lambda spark, d: taken.append(d) or own)
    return taken


def single_rows(own, for_test=False):
    spec = P.PanelSpec(excluded=("data_source", "cohort"), holdout_fraction=Q.HOLDOUT)
    return settle(T.labelled_rows(P.panels(own, spec), domains={"serotype": Q.SEGMENTS}, for_test=for_test))


def plain_nodes(rows, **limits):
    """The nodes as Spark fits them on single rows."""
    names = tree.kept_features(rows, Q.TREE_NULLS)
    data = tree.vectors(rows, names, tree.imputations(rows))
    indexer = StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="keep")
    model = Pipeline(stages=[indexer, tree.classifier(**limits)]).fit(data)
    path = f"{Q.new_path(rows.sparkSession)}"
    model.stages[-1].write().save(path)
    return sorted(map(str, rows.sparkSession.read.parquet(f"{path}/data").collect()))


def test_accuracies_count_alike_rows_and_read_the_sources_once(spark, own, read):
    got = {r.part: r for r in Q.tree_accuracy(spark, "own").collect()}
    assert len(read) == 1
    fitted = tree.fit_tree(single_rows(own), Q.TREE_NULLS)
    for part, rows in (("train", single_rows(own)), ("test", single_rows(own, True))):
        hits = fitted.predict(rows).where("prediction = target").count()
        assert (got[part].rows, got[part].accuracy) == (rows.count(), hits / rows.count())


def test_a_fit_reads_distinct_rows(spark, own):
    panel = P.panels(own, P.PanelSpec(excluded=("data_source", "cohort"), holdout_fraction=Q.HOLDOUT))
    rows = T.labelled_rows(T.alike(panel), domains={"serotype": Q.SEGMENTS})
    assert rows.count() < 100 and rows.agg(F.sum("n")).first()[0] == single_rows(own).count() > 1500


@pytest.mark.parametrize("each", (29, 30))
def test_a_leaf_has_its_least_number_of_counted_rows(spark, each):
    rows = [(i, "L", f"L:{x}", [("f", float(x))]) for x in (1, 2) for i in range(each)]
    single = spark.createDataFrame(rows, LABELLED)
    counted = single.groupBy("label", "features").agg(F.count("*").alias("n"))
    assert counted.count() == 2
    nodes = sorted(map(str, tree.fit_tree(counted, Q.TREE_NULLS).nodes(spark).collect()))
    assert len(nodes) == (3 if each == 30 else 1) and nodes == plain_nodes(single)


def test_heavy_rows_are_dealt_evenly(spark):
    data = spark.createDataFrame([("a", 10), ("b", 3), ("c", 1)], "label string, n long")
    got = sorted((r.label, r.n) for r in tree.even_weights(data, 4).collect())
    assert got == [("a", 3), ("a", 3), ("a", 4), ("b", 3), ("c", 1)]


def test_pruning_path_counts_alike_rows_and_reads_the_sources_once(spark, own, read):
    got = Q.tree_pruning_path(spark, "own").orderBy("step").collect()
    assert len(read) == 1
    want = tree.fit_tree(single_rows(own), Q.TREE_NULLS).path(single_rows(own, True)).orderBy("step").collect()
    assert got == want and len(got) > 2 and 0 < got[-1].hits < got[0].hits < got[0].rows


def test_pruning_end_has_all_held_rows_from_one_reading(spark, own, read):
    end = Q.tree_pruning_end(spark, "own").collect()
    assert len(read) == 1 and len(end) == 1
    labels = single_rows(own).groupBy("label").count().orderBy(F.desc("count"), "label").collect()
    held = single_rows(own, True)
    hits = held.where(F.col("label") == labels[0]["label"]).count()
    assert (end[0].leaves, end[0].rows, end[0].hits) == (1, held.count(), hits)
    total = sum(r["count"] for r in labels)
    assert end[0].risk == pytest.approx(1 - sum((r["count"] / total) ** 2 for r in labels), abs=1e-9)


def test_nodes_are_those_of_single_rows(spark, own, read):
    nodes = Q.tree_nodes(spark, "own").collect()
    assert len(nodes) > 2 and sorted(map(str, nodes)) == plain_nodes(single_rows(own))
    assert max(n.rawCount for n in nodes) == single_rows(own).count()


def test_a_fit_takes_counted_rows(spark, own, read, monkeypatch):
    seen = []
    fit = tree.fit_tree
    monkeypatch.setattr(tree, "fit_tree", lambda rows, *a, **b: seen.append(rows.count()) or fit(rows, *a, **b))
    Q.tree_nodes(spark, "own").collect()
    assert seen and seen[0] < 100 < single_rows(own).count()


def test_rows_are_not_shuffled_by_label(spark):
    rng = random.Random(2)
    rows = [(i, "L", f"L:{rng.choice('ab')}", [("f", float(rng.randint(1, 3)))]) for i in range(20000)]
    df = settle(spark.createDataFrame(rows, LABELLED))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        table = tree.imputed(df, ["f"], tree.imputations(df))
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(label" not in plan
        assert table.where("f IS NULL").count() == 0 and table.count() == 20000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_imputed_rows_count_their_values_once(spark, own, read, monkeypatch):
    counted = []
    count = tree.value_counts
    monkeypatch.setattr(tree, "value_counts", lambda rows: counted.append(1) or count(rows))
    got = Q.tree_imputed(spark, "own")
    assert len(counted) == 1 and len(read) == 1
    rows = single_rows(own)
    names = [r.feature for r in tree.feature_nulls(rows, Q.TREE_NULLS).where("kept").collect()]
    assert got.count() == rows.count() * len(names) and got.where("value IS NULL").count() == 0
