"""Costs that must not grow faster than the input: what is worked out once, and what is sent or exchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudlake.operators import messages


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_task_is_cut_into_pieces_once_for_each_reading(spark):
    rows = spark.range(3).select(F.concat(F.lit("message kim that order "), "id").alias("task"), F.lit("order 1").alias("draft"))
    cuts = lambda c: planned(rows.select(c.alias("c"))).count("regexp_extract_all")
    assert 1 <= cuts(messages.echo(F.col("draft"), F.col("task"))) <= 2  # the command, whom it names
    assert 1 <= cuts(messages.message_text(F.col("task"))) <= 2  # whom it names, what it tells
    got = rows.select(messages.echo(F.col("draft"), F.col("task")).alias("echo"), messages.message_text(F.col("task")).alias("words")).collect()
    assert [(r.echo, r.words) for r in got] == [(False, "order 0"), (True, "order 1"), (False, "order 2")]


def test_rule_samples_read_each_text_once(spark, tmp_path, monkeypatch):
    from shroudlake.operators import detect
    from shroudlake.plans import more

    spark.createDataFrame([(7,), (8,), (10007,), (20007,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(more, "SAMPLES", ("write to x@mail5.example.com", "ssn 123-45-N"))
    read, plain_run = [], detect.detect_pii
    monkeypatch.setattr(detect, "detect_pii", lambda df, keys, *a, **k: read.append(df.count()) or plain_run(df, keys, *a, **{**k, "rules": ["email", "ssn"]}))
    got = more.rule_samples(spark, str(tmp_path)).select("doc_id", "rule", "span_start", "span_end").collect()
    assert read == [3]  # eight rows of text, three texts
    assert sorted(map(tuple, got)) == sorted([(i * 100, "email", 9, 28) for i in (7, 8, 10007, 20007)] + [(i * 100 + 1, "ssn", 4, 15) for i in (7, 8, 10007, 20007)])


def test_redaction_grows_once(spark):
    from shroudlake.functions import geometry as geo
    from shroudlake.operators import regions

    b = geo.box(F.col("id"), F.lit(10), F.lit(20), F.lit(20))
    rows = spark.range(3).select("id", regions.verified(b, F.lit(100), F.lit(80), F.array(F.lit(False), F.col("id") > 0)).alias("v"))
    assert planned(rows).count("aggregate(") == 1
    assert [(r.v.passed, r.v.expansions, r.v.bbox.x, r.v.bbox.width) for r in rows.orderBy("id").collect()] == [(False, 3, 0, 20), (True, 1, 0, 25), (True, 1, 0, 25)]


def test_headers_do_not_multiply_cells(spark):
    from shroudlake.operators import lookup

    cells = spark.createDataFrame([(1, 0, 0, 10, 20), (1, 0, 0, 10, 20), (1, 1, 2, 900, 20), (1, 2, 7, 900, 20), (2, 0, 0, 10, 20)], "table_id long, cell_id long, col_idx long, x int, width int")
    heads = spark.createDataFrame([(1, 1, 0, 100, "b"), (1, 0, 0, 100, "a"), (1, 2, 100, 100, "c"), (1, None, 890, 60, "z")], "table_id long, th_idx long, x int, width int, text string")
    df = lookup.table_headers(cells, heads)
    assert "min_by" not in df._jdf.queryExecution().analyzed().toString()  # a row for each cell and header would be sorted
    assert sorted((r.table_id, r.cell_id, r.header) for r in df.collect()) == [(1, 0, "a"), (1, 1, "c"), (1, 2, None), (2, 0, None)]


def test_selector_steps_are_not_exchanged(spark):
    from shroudlake.operators import selectors
    from shroudlake.sources import styles

    p = spark.createDataFrame([(1, "<ul><li>a</li><p>x</p><li>b</li><li>c</li></ul>")], "page_id long, html string")
    wanted = spark.createDataFrame([(1, 0, "li + li"), (1, 1, "li ~ li"), (1, 2, "ul > li")], "page_id long, key int, selector string")
    df = selectors.matched(styles.page_tree(p), wanted)
    assert sum("steps#" in line and "on#" in line for line in planned(df).splitlines()) <= 1  # where they are made
    counts = {r.key: r["count"] for r in df.groupBy("key").count().collect()}
    assert counts == {0: 1, 1: 2, 2: 3}


def test_texts_of_pages_with_few_values_are_not_cut_into_pieces(spark, monkeypatch):
    from shroudlake.operators import propagate

    e = spark.range(60).select((F.col("id") % 3).alias("page_id"), F.col("id").cast("int").alias("elem_idx"), F.concat(F.lit("row id"), "id", F.lit(" kim")).alias("text"))
    v = spark.range(60).where("id % 3 < 2 and (id % 3 = 0 or id < 10)").select((F.col("id") % 3).alias("page_id"), F.lit("name").alias("kind"), F.concat(F.lit("id"), "id").alias("value"))  # 20 values, 3 values, none
    got = [sorted(map(tuple, propagate.holders(v, e, few).collect())) for few in (0, 3, 64)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 20 + 3 + sum(i % 3 < 2 and j != i and str(j).startswith(str(i)) and j % 3 == i % 3 for i in range(10) for j in range(60))
    monkeypatch.setattr(propagate, "pieces", lambda text, size: F.when(F.lit(False), F.array(text)))  # none
    assert propagate.holders(v, e).count() == len(got[0])


def test_name_rules_are_tried_only_where_they_can_match(spark, monkeypatch):
    from shroudlake.functions.text import strip, stripped_over
    from shroudlake.operators import names

    held = ["Dr. Ravi Kumar", "NAME: Meera Shah", "12 Green Street", "in Mumbai", "Acme Solutions", "with Susan"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*held, "nothing of that kind is said here"])], "id int, text string")
    assert {r.id for r in names.heuristic_entities(df, ["id"]).collect()} == set(range(6))
    monkeypatch.setattr(names, "spans", lambda text, pattern: F.array(F.struct(F.lit(0).alias("s"), F.length(text).alias("e"), text.alias("m"))))
    monkeypatch.setattr(names, "person_name", lambda text: F.lit(True))
    assert {r.id for r in names.heuristic_entities(df, ["id"]).collect()} == set(range(6))  # the last is not tried
    w = spark.createDataFrame([(s,) for s in ("", " ", "abc", "abcd", " ab d ", "　abc　", "a\n\nb", "a  b", "😀bcd", "😀bc", "  a", "a\r\nb", None)], "t string")
    assert [r for r in w.select((F.length(strip(F.col("t"))) > 3).alias("a"), stripped_over(F.col("t"), 3).alias("b")).collect() if r.a != r.b] == []


def test_signal_of_a_loop_is_one_cell(spark, tmp_path):
    from datetime import datetime

    from shroudlake.streaming import loops, sinks

    own = sinks.with_state(spark)
    kinds = "loop_id string, seq long, at timestamp, kind string, task string, action_type string, target string, value string, confidence double, needs_clarification boolean, exec_success boolean"
    odd, t = 'a"\\\n \x01é😀', datetime(2024, 1, 1)
    rows = [
        ("k" + odd, 1, t, "turn", odd, "type", None, odd, float("nan"), None, None), ("k" + odd, 0, t, "turn", None, "scroll", odd, "", None, None, None), ("k" + odd, 2, t, "turn", odd, "type", None, odd, 0.44, False, True),
        ("b", 2, t, "turn", "find red shoes", "click", "x", None, 0.9, False, True), ("b", 1, t, "turn", "find red shoes", "scroll", "x", None, 0.9, False, True), ("b", 0, t, "turn", "find red shoes", "click", "x", None, 0.9, False, True),
        ("b", None, t, "stop", None, None, None, None, None, None, None), ("b", 2**60, t, "stop", None, None, None, None, None, None, None),
    ]
    own.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = loops.run_loops(own.readStream.schema(kinds).parquet(f"{tmp_path}/in"))
    node = stream._jdf.queryExecution().analyzed()
    while "TransformWithState" not in node.nodeName():
        node = node.children().head()
    assert node.children().head().output().size() <= 4  # loop, also as the key, time, signal
    found = sorted((r.loop_id, r.seq, r.guard_type, r.guard_value, r.stop_reason) for r in sinks.drained(stream, "odd").collect())
    assert found[:3] == [("b", 0, "click", None, None), ("b", 1, "scroll", None, None), ("b", 2, "type", "red shoes", None)]
    assert found[3:] == [("k" + odd, 0, "scroll", "", None), ("k" + odd, 1, "type", odd, None), ("k" + odd, 2, "type", odd, "low_confidence")]


def test_elements_of_large_pages_are_handed_on_early(spark, monkeypatch):
    from shroudlake.sources import tables

    lots, made = spark.sparkContext.accumulator(0), tables.pa.record_batch
    pages = spark.range(12).selectExpr("id as page_id", "repeat(concat('<p>t', id, '</p>'), 600) as html").coalesce(1)

    class Counted:
        def __getattr__(self, name):
            import pyarrow

            return getattr(pyarrow, name)

        def record_batch(self, columns, names):
            assert len(columns[0]) < tables.LOT_ROWS + tables.MOST  # what one page may add
            lots.add(1)
            return made(columns, names)

    monkeypatch.setattr(tables, "pa", Counted())
    found = tables.elements(pages).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in found} == dict.fromkeys(range(12), 600)
    assert lots.value >= 6  # pages of 600 elements go two at a time
