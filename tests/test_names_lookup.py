"""Golden rows of name rules and ordered lookups."""

from pyspark.sql import functions as F

from shroudlake.functions.lineage import paired
from shroudlake.operators import detect, lookup, names

OPTION = "array<struct<index:int,value:string,text:string>>"


def test_heuristic_names(spark):
    df = spark.createDataFrame([(1, "Dr. Ravi Kumar lives at 12 Green Street near Mumbai"), (2, "Name: Meera Shah"), (3, "Acme Solutions"), (4, "abc"), (5, None)], "id int, text string")
    got = {(r.id, r.type, r.text) for r in names.heuristic_entities(df, ["id"]).collect()}
    assert got == {(1, "name", "Dr. Ravi Kumar"), (1, "location", "12 Green Street"), (1, "location", "Mumbai"), (2, "name", "Meera Shah"), (3, "organization", "Acme Solutions")}


def test_merge_prefers_the_model(spark):
    model = spark.createDataFrame([(1, "name", "Meera Shah", 0.9)], "page_id int, type string, text string, confidence double")
    rules = spark.createDataFrame([(1, 0, "name", "Meera", 0, 0.8), (1, 1, "name", "Ravi Kumar", 9, 0.8), (1, 5, "name", "Ravi", 9, 0.8), (2, 1, "name", "Meera", 0, 0.8)], "page_id int, rule_ord int, type string, text string, start int, confidence double")
    got = sorted((r.page_id, r.text) for r in names.merged_entities(model, rules).collect())
    assert got == [(1, "Meera Shah"), (1, "Ravi Kumar"), (2, "Meera")]


def test_option_lookup(spark):
    options = [(0, "0", "--Select--"), (1, "a", "I"), (2, "b", "II"), (3, "c", "III"), (4, "d", "IV")]
    rows = [("4th semester", options), ("c", options), ("second", options), (None, [])]
    got = spark.createDataFrame(rows, f"v string, o {OPTION}").select(lookup.option_match(F.col("v"), F.col("o")).alias("m")).collect()
    assert [r.m and r.m.text for r in got] == ["IV", "III", "II", None]
    s = spark.createDataFrame([("ndls", ["Old Delhi (DLI)", "New Delhi (NDLS)"])], "q string, s array<string>").select(lookup.suggestion_match(F.col("q"), F.col("s")).alias("m")).first()
    assert s.m == "New Delhi (NDLS)"


def test_roles_and_actions(spark):
    cols = "request_id int, elem_idx int, element_id string, tag string, role string, input_type string, label string, placeholder string, text string, name string, href string"
    e = spark.createDataFrame([(1, 0, "q", "input", None, "search", None, "Search", None, "q", None), (1, 1, "go", "button", None, None, "Search", None, None, None, None), (1, 2, "v", "a", None, None, "2M views", None, None, None, "/watch?v=1")], cols)
    found = lookup.roles(e)
    r = found.first()
    assert (r.search_input, r.search_button, r.first_result, r.login_password) == ("q", "go", "v", None)
    acts = spark.createDataFrame([(1, "search shoes", "shoes", "click", "go", None), (1, "search shoes", "shoes", "click", "v", None)], "request_id int, task string, query string, action_type string, target string, value string")
    assert sorted((x.action_type, x.target, x.value) for x in lookup.normalized_action(acts, found).collect()) == [("click", "v", None), ("type", "q", "shoes")]


def test_table_headers(spark):
    cells = spark.createDataFrame([(1, 1, 0, 10, 20), (1, 2, 1, 500, 20)], "table_id int, cell_id int, col_idx int, x int, width int")
    heads = spark.createDataFrame([(1, 0, 0, 60, "Name"), (1, 1, 60, 60, "Date")], "table_id int, th_idx int, x int, width int, text string")
    assert {r.cell_id: r.header for r in lookup.table_headers(cells, heads).collect()} == {1: "Name", 2: "Date"}


def test_a_dictionary_is_sent_and_the_words_never(spark, monkeypatch):
    rows = spark.range(100).selectExpr("id", "concat('for Kim', id % 2, ' and Ann Bell') as text")
    known = spark.createDataFrame([("Ann", "common", 0.5)], "name string, rule string, confidence double")
    few = detect.dictionary_names(rows, ["id"], known)
    assert "BuildRight" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(detect, "SMALL", 0)
    many = detect.dictionary_names(rows, ["id"], known)
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.text) for r in few.collect()} == {(r.id, r.text) for r in many.collect()} == {(i, "Ann Bell") for i in range(100)}


def test_paired_tables_are_not_broadcast(spark):
    small = spark.range(10).selectExpr("id", "id * 2 as v")
    assert "BroadcastHashJoin" in spark.range(5).join(small, "id")._jdf.queryExecution().executedPlan().toString()
    plan = paired(spark.range(5), small, "id")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 5
