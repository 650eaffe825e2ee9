import pytest
from pyspark.sql import functions as F

from coterie.functions import columns as C
from coterie.functions import frames
from coterie.functions.frames import bounded_names, first_ids, ranked, settle, work_dir
from coterie.operators import transactions as T
from coterie.sources import panels as P
from coterie.sources import sinks
from coterie.sources.readers import read_source

SCHEMA = "id int, drug string, status string, class string, serotype string, year int"


def view(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs(entries):
    return [(x.attr, x.value) for x in entries]


def test_most_severe_status_wins(spark):
    rows = [(1, "A", s, "X", "d", 2010) for s in ("susceptible", "resistant", "intermediate", "SSD")]
    rows += [(1, "B", s, "X", "d", 2010) for s in ("SSD", "intermediate", "SSD")]
    rows += [(1, "C", "odd", "X", "d", 2010), (1, "C", "susceptible", "X", "d", 2010)]
    row = P.panels({"v": view(spark, rows)}).first()
    assert pairs(row.target) == [("A", "resistant"), ("B", "intermediate"), ("C", "susceptible")]
    assert pairs(row.other) == [("serotype", "d"), ("year", "2010")]


def test_empty_values(spark):
    df = spark.createDataFrame([("",), ("na",), ("NA",), (None,), (" ",), ("Na",)], "v string")
    assert [r[0] for r in df.select(C.clean(F.col("v"))).collect()] == [None, None, None, None, " ", "Na"]
    nums = spark.createDataFrame([(float("nan"),), (1.5,)], "v double")
    assert [r[0] for r in nums.select(C.clean(F.col("v"), "double")).collect()] == [None, "1.5"]


def test_empty_status_and_attribute_are_left_out(spark):
    rows = [(1, "A", "NA", "X", "d", 2010), (1, "B", "resistant", "X", "na", None)]
    row = P.panels({"v": view(spark, rows)}).first()
    assert pairs(row.target) == [("B", "resistant")]
    assert pairs(row.other) == [("serotype", "d"), ("year", "2010")]


def test_several_values_form_a_set(spark):
    rows = [(1, "A", "resistant", "X", s, 2010) for s in ("b", "a", "b")]
    panel = P.panels({"v": view(spark, rows)}, P.PanelSpec(excluded=("year",)))
    assert pairs(panel.first().other) == [("serotype", "a"), ("serotype", "b")]
    both = T.transactions(panel).first()
    assert both.other == {"serotype": ["a", "b"]} and both.target == {"A": "resistant"}
    basket = T.baskets(panel).first()
    assert basket["items"] == ["A:resistant", "serotype:a", "serotype:b"]


def test_sources_are_merged_by_id(spark):
    one = view(spark, [(1, "A", "resistant", "X", "d", 2010), (2, "A", "susceptible", "X", "e", 2011)])
    two = spark.createDataFrame([(1, "g1"), (1, "g2"), (3, "g9")], "id int, gene string")
    got = {r.id: pairs(r.other) for r in P.panels({"v": one, "g": two}, P.PanelSpec(excluded=("year",))).collect()}
    assert got == {1: [("gene", "g1"), ("gene", "g2"), ("serotype", "d")], 2: [("serotype", "e")]}


def test_chosen_columns_only(spark):
    spec = P.PanelSpec(columns={"v": ["year"]})
    row = P.panels({"v": view(spark, [(1, "A", "resistant", "X", "d", 2010)])}, spec).first()
    assert pairs(row.other) == [("year", "2010")]


def test_condition_keeps_all_rows_of_a_chosen_id(spark):
    rows = [(1, "A", "resistant", "X", "d", 2010), (1, "B", "resistant", "X", "d", 2013), (2, "A", "resistant", "X", "d", 2013)]
    got = P.panels({"v": view(spark, rows)}, P.PanelSpec(condition="year < 2012")).collect()
    assert [r.id for r in got] == [1] and pairs(got[0].target) == [("A", "resistant"), ("B", "resistant")]


def test_class_as_target(spark):
    rows = [(1, "A", "susceptible", "X", "d", 2010), (1, "B", "resistant", "X", "d", 2010), (1, "C", "resistant", None, "d", 2010)]
    row = P.panels({"v": view(spark, rows)}, P.PanelSpec(target="class")).first()
    assert pairs(row.target) == [("X", "resistant")]


def test_holdout_is_stable_and_close_to_its_share(spark):
    df = spark.range(4000).select(F.col("id").cast("int"), F.lit("A").alias("drug"), F.lit("resistant").alias("status"))
    spec = P.PanelSpec(holdout_fraction=0.25)
    a = {r.id for r in T.test(P.panels({"v": df}, spec)).collect()}
    b = {r.id for r in T.test(P.panels({"v": df.repartition(7)}, spec)).collect()}
    assert a == b and 900 < len(a) < 1100


def test_holdout_condition_overrides_share(spark):
    rows = [(i, "A", "resistant", "X", "d", 2010 + i % 2) for i in range(10)]
    spec = P.PanelSpec(holdout_condition="year = 2011", holdout_fraction=0.9)
    panel = P.panels({"v": view(spark, rows)}, spec)
    assert {r.id for r in T.test(panel).collect()} == {1, 3, 5, 7, 9}
    assert {r.id for r in T.train(panel).collect()} == {0, 2, 4, 6, 8}


def test_limit_takes_the_first_ids(spark):
    rows = [(i, "A", "resistant", "X", "d", 2010) for i in range(30)]
    panel = P.panels({"v": view(spark, rows)}, P.PanelSpec(limit=5))
    assert sorted(r.id for r in panel.collect()) == [0, 1, 2, 3, 4]


def test_order_and_partitions_do_not_matter(spark):
    rows = [(i % 50, f"D{i % 7}", ("resistant", "susceptible", "intermediate")[i % 3], "X", f"s{i % 4}", 2010) for i in range(600)]
    a = P.panels({"v": view(spark, rows)}).orderBy("id").collect()
    b = P.panels({"v": view(spark, rows[::-1]).repartition(13)}).orderBy("id").collect()
    assert a == b


def test_a_hot_id_holds_only_its_vocabulary(spark):
    hot = spark.range(200000).select(
        F.lit(1).alias("id"), F.concat(F.lit("D"), F.col("id") % 5).alias("drug"),
        F.when(F.col("id") % 3 == 0, "resistant").otherwise("susceptible").alias("status"),
    )
    row = P.panels({"v": hot}).first()
    assert pairs(row.target) == [(f"D{i}", "resistant") for i in range(5)]


def test_focus_and_empty_baskets(spark):
    df = spark.createDataFrame([(1, "A", "susceptible"), (2, "A", "resistant")], "id int, drug string, status string")
    got = {r.id: r["items"] for r in T.baskets(P.panels({"v": df})).collect()}
    assert got == {2: ["A:resistant"]}
    assert T.complete(P.panels({"v": df})).count() == 2


def test_empty_cell_filter(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, list("abcd"))], "id int, items array<string>")
    assert sorted(r.id for r in T.empty_cell_filter(df, 0.5).collect()) == [2, 3]
    assert T.empty_cell_filter(df).count() == 3


def test_class_dimension_and_variables(spark):
    df = view(spark, [(1, "A", "resistant", "X", "d", 1), (2, "A", "resistant", "Y", "d", 1), (3, "B", "resistant", None, "d", 1)])
    assert {r.drug: r["class"] for r in P.class_dimension(df).collect()} == {"A": "Y"}
    got = {r.attr: r.entity for r in P.variables({"v": df}, P.PanelSpec(excluded=("year",))).collect()}
    assert got == {"A": "v", "B": "v", "serotype": "v"}


def test_numbers_and_codes(spark):
    df = spark.createDataFrame([("1",), ("-2.5",), ("1-2",), ("1.2.3",), (".",), ("x",), ("1e5",)], "v string")
    assert [r[0] for r in df.select(C.number(F.col("v"))).collect()] == [1.0, -2.5, None, None, None, None, None]
    codes = spark.createDataFrame([("AgeGroup", "Adult"), ("AgeGroup", "7"), ("Gender", "Male"), ("z", "Adult")], "a string, v string")
    got = [r[0] for r in codes.select(C.numeric_code(F.col("a"), F.col("v"), C.ORDINAL_CODES)).collect()]
    assert got == [18.0, 7.0, 2.0, None]


def test_item_text(spark):
    df = spark.createDataFrame([("a:b:c",), ("a",)], "t string")
    got = df.select(C.item_attr(F.col("t")), C.item_value(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a", "b:c"), ("a", None)]


def test_percent_texts(spark):
    df = spark.createDataFrame([(0.2, 0.1), (0.1, 0.126), (0.0, 0.5), (0.1, 0.1)], "a double, b double")
    change = C.percent_change(F.col("a"), F.col("b"))
    got = [r[0] for r in df.select(C.marked_percent(change, 25)).collect()]
    assert got == ["* -50 %", "* 26 %", None, "0 %"] or got == ["* -50 %", "* 25 %", None, "0 %"]
    text = spark.createDataFrame([("12.5 %",), ("x",)], "t string")
    assert [r[0] for r in text.select(C.percent_value(F.col("t"))).collect()] == [12.5, None]


def test_labelled_rows(spark):
    rows = [(1, "A", "resistant", "X", "d", 2010), (1, "B", "susceptible", "X", "d", 2010), (1, "C", "intermediate", "X", "d", 2010)]
    panel = P.panels({"v": view(spark, rows)})
    got = {r.label: {x.feature: x.value for x in r.features} for r in T.labelled_rows(panel).collect()}
    assert got == {
        "A:resistant": {"serotype(d)": 1.0, "year": 2010.0, "B": 1.0, "C": 2.0},
        "C:intermediate": {"serotype(d)": 1.0, "year": 2010.0, "A": 3.0, "B": 1.0},
    }
    domain = T.labelled_rows(panel, domains={"serotype": ["d", "e"]}).first().features
    assert {x.feature: x.value for x in domain if "serotype" in x.feature} == {"serotype(d)": 1.0, "serotype(e)": 0.0}


def test_rows_per_list_value_are_indicators(spark):
    rows = [(1, "A", "resistant", "X", s, y) for s in ("d", "e") for y in (1, 2)]
    features = T.labelled_rows(P.panels({"v": view(spark, rows)})).first().features
    assert {x.feature for x in features} == {"serotype(d)", "serotype(e)", "year(1)", "year(2)"}


def test_ranked_numbers_rows_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(9)
    got = ranked(df, [F.desc("v")]).collect()
    assert all(r["rank"] == 1000 - r.v for r in got) and len(got) == 1000


def test_settled_frames_keep_their_rows(spark):
    assert settle(spark.range(10)).count() == 10


class Stub:
    """As much of a session as the folder lookup reads."""

    def __init__(self, settings, master):
        self.conf = settings
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "stub"})


def test_work_folder_follows_the_setting():
    assert work_dir(Stub({"spark.checkpoint.dir": "/shared"}, "yarn")) == "/shared"
    with pytest.raises(ValueError):
        work_dir(Stub({}, "yarn"))
    assert work_dir(Stub({}, "local[2]")) == work_dir(Stub({}, "local[2]"))


def test_vocabulary_bound(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError):
            bounded_names(spark.range(5).select(F.col("id").cast("string").alias("n")), "n")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_run_tables(spark, tmp_path):
    path = str(tmp_path / "rules")
    one = spark.createDataFrame([("r1_1", 0.5), ("r1_2", 0.7)], "rule_id string, support double")
    sinks.write_run(one, path, "r1")
    sinks.write_run(spark.createDataFrame([("r2_1", 0.1)], "rule_id string, support double"), path, "r2")
    assert sinks.read_run(spark, path).count() == 3
    sinks.write_run(one.limit(1), path, "r1")
    assert sinks.read_run(spark, path, "r1").count() == 1 and sinks.read_run(spark, path, "r2").count() == 1
    sinks.update_rule(spark, path, "r2", "r2_1", "support", 0.9)
    assert sinks.read_run(spark, path, "r2").first().support == 0.9
    sinks.write_run(one, path, "r3", clean=True)
    assert {r.run_id for r in sinks.read_run(spark, path).select("run_id").distinct().collect()} == {"r3"}


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(str(tmp_path / "p"))
    assert read_source(spark, str(tmp_path / "p"), columns=("v",)).columns == ["v"]
    spark.read.parquet(str(tmp_path / "p")).createOrReplaceTempView("some_view")
    assert read_source(spark, "some_view", "table").count() == 1
    assert read_source(spark, "select id from some_view", "sql").first().id == 1
    spark.read.parquet(str(tmp_path / "p")).write.csv(str(tmp_path / "c"), header=True)
    assert read_source(spark, str(tmp_path / "c"), "csv", options={"header": "true"}).columns == ["id", "v"]


def test_a_step_deletes_what_the_step_before_has_settled(spark):
    outside = frames.settle(spark.range(3))
    with frames.step_folder(spark):
        first = frames.settle(spark.range(4))
        assert first.count() == 4
    between = frames.settle(spark.range(5))
    with frames.step_folder(spark):
        second = frames.settle(spark.range(6))
        with pytest.raises(Exception):
            first.count()
    assert (outside.count(), between.count(), second.count()) == (3, 5, 6)
    frames.forget_step(spark)
    frames.forget_step(spark)
    with pytest.raises(Exception):
        second.count()
    assert frames.settle(spark.range(2)).count() == 2


def test_first_ids(spark):
    df = spark.createDataFrame([(i // 2, i) for i in range(40)], "id long, v int").repartition(7, "v")
    for limit, want in ((1, 2), (2, 2), (3, 4), (39, 40), (400, 40)):
        kept = first_ids(df, limit)
        assert kept.columns == ["id", "v"] and kept.count() == want
    assert first_ids(df.where("id < 0"), 3).count() == 0
