"""Golden rows of geometry, fusion, ranking, responses and history; SQL twins on the smallest tables."""

import datetime
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shroudlake.functions import geometry as geo
from shroudlake.operators import agent, fuse, history, messages, page, propagate, rank, regions, registry, sanitize, wording
from shroudlake.sources import tables

DATA = "/root/testdata/sf0.001"
FULL = "page_id long, cand_seq long, type string, sources array<string>, text string, tokens array<string>, confidence double, reason string, bbox struct<x:int,y:int,width:int,height:int>"


def cand(seq, box, kind="email", src="dom", conf=0.6, reason="", page=1):
    return (page, seq, kind, [src], "", [], conf, reason, box)


def fused(spark, *rows):
    return [(r.decision, round(r.confidence, 4), tuple(r.bbox), sorted(r.sources)) for r in fuse.fuse(spark.createDataFrame(list(rows), FULL)).orderBy("cand_seq").collect()]


def test_fusion_goldens(spark):
    a, b = (0, 0, 100, 20), (10, 0, 100, 20)
    assert fused(spark, cand(1, a), cand(2, b, src="ocr", conf=0.5)) == [("REDACT", 0.75, (0, 0, 110, 20), ["dom", "ocr"])]
    assert fused(spark, cand(1, a), cand(2, b, conf=0.5)) == [("REVIEW", 0.6, (0, 0, 110, 20), ["dom"])]
    assert len(fused(spark, cand(1, a), cand(2, (0, 0, 30, 20)))) == 2
    assert len(fused(spark, cand(1, a), cand(2, a, kind="face"))) == 2
    assert fused(spark, cand(1, (0, 0, 600, 130), conf=0.9, reason="regex:email"))[0][0] == "KEEP"
    assert fused(spark, cand(1, (0, 0, 600, 130), conf=0.9, reason="ocr_regex:email"))[0][0] == "REDACT"
    assert fused(spark, cand(1, (5, 20, 50, 10), kind="signature", conf=0.9))[0][2] == (5, 0, 75, 40)
    assert fused(spark, cand(1, (0, 0, 0, 5))) == []


def test_mapping_and_suppression(spark):
    box = geo.box(F.lit(-5), F.lit(10), F.lit(50), F.lit(10))
    r = spark.range(1).select(geo.map_box(box, F.lit(2.0), F.lit(2.0), F.lit(1280), F.lit(720)).alias("b")).first().b
    assert tuple(r) == (0, 20, 100, 20)
    boxes = spark.createDataFrame([([(0.9, 0, 0, 10, 10), (0.8, 1, 1, 10, 10), (0.7, 50, 50, 5, 5)],)], "b array<struct<score:double,x:int,y:int,width:int,height:int>>")
    assert [x.score for x in boxes.select(fuse.suppress(F.col("b")).alias("k")).first().k] == [0.9, 0.7]


def test_ranking_keeps_inputs(spark):
    rows = [(1, i, "button", f"send {i}", "type a message") for i in range(40)] + [(1, 40, "input", "", "type a message")]
    got = rank.ranked(spark.createDataFrame(rows, "page_id int, elem_idx int, tag string, text string, task string").withColumn("role", F.lit(None).cast("string")).withColumn("bbox", F.lit(None).cast(geo.BOX)), top=35)
    out = got.orderBy("rank").collect()
    assert len(out) == 35 and any(r.tag == "input" for r in out) and [r["rank"] for r in out] == list(range(1, 36))


def test_responses(spark):
    raws = [
        '{"reasoning": "x", "confidence": 0.95, "action": {"type": "click", "targetElementId": "btn-1"}}', '```json\n{"action": {"type": "click", "targetElementId": "btn-1"}}\n```',
        '{"actions": [{"type": "type", "target": "input-3", "value": "v"}]}', '{"action": "fly"}', '{"action": "click", "target": "btn-5"}', "{}", "no", "", '{"action": {"type": "fly"}, "confidence": "high"}',
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    got = [(r.error is None, r.action_type, r.target, r.value, r.confidence) for r in agent.parsed(df).orderBy("i").collect()]
    assert got == [
        (True, "click", "btn-1", None, 0.95), (True, "click", "btn-1", None, 0.85), (True, "type", "input-3", "v", 0.85), (False, None, None, None, None), (True, "click", "btn-5", None, 0.85),
        (True, "ask_user", None, None, 0.85), (False, None, None, None, None), (False, None, None, None, None), (True, "click", None, None, 0.5),
    ]


def test_tasks(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(wording.search_query(F.lit("search watches on flipkart"))) == "watches"
    assert one(wording.search_query(F.lit("search stylish watches for me"))) == "stylish watches"
    assert one(wording.search_query(F.lit('search "Khat" and play first video'))) == "Khat"
    who = one(wording.contact_task(F.lit("tell Parth Bhaiya that meeting is cancelled")))
    assert (who.contact, who.body) == ("Parth Bhaiya", "meeting is cancelled")
    day = F.lit(datetime.date(2025, 1, 31))
    assert [one(agent.shown_date(F.lit(x), day)) for x in ("2025-1-5", "5/1/2025", "31.02.2025", "next week", "tomorrow")] == ["05/01/2025", "05/01/2025", "31/02/2025", "next week", "01/02/2025"]


def test_history_and_replay(spark):
    turns = spark.createDataFrame([(1, i, "click", None, "/a") for i in range(35)], "session_id int, turn_seq int, action_type string, action_value string, page_url string")
    assert history.last_turns(turns).count() == 30
    assert {len(r.prior) for r in history.prior_actions(turns).collect()} == {0, 1, 2, 3}
    steps = spark.createDataFrame([(1, i, "click", 0.9 if i < 2 else 0.1) for i in range(5)], "loop_id int, step int, action_type string, confidence double").withColumns({"cancelled": F.lit(False), "needs_clarification": F.lit(False), "exec_success": F.lit(True)})
    assert [(r.step, r.stop_reason) for r in history.replay(steps).orderBy("step").collect()] == [(0, None), (1, None), (2, "low_confidence")]


def test_spread_and_shields(spark):
    values = spark.createDataFrame([(1, "identifier", "24001")], "page_id int, kind string, value string")
    elements = spark.createDataFrame([(1, 0, "roll 24001"), (1, 1, "other"), (2, 0, "24001")], "page_id int, elem_idx int, text string")
    none = spark.createDataFrame([], "page_id int, elem_idx int, text string")
    assert [(r.page_id, r.elem_idx) for r in propagate.spread(values, elements, none).collect()] == [(1, 0)]


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith("op")])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    cols = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in cols]
    rows = sorted(repr([r[i] for i in order]) for r in want.fetchall())
    got = __spark_entry__.queries()[name](spark, DATA)
    assert sorted(got.columns) == cols
    assert sorted(repr(list(r)) for r in got.select(*cols).collect()) == rows


def test_entry(spark):
    got = {(r.type, r.decision): r.n_spans for r in __spark_entry__.entry(spark).collect()}
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    assert sum(n for (kind, _), n in got.items() if kind == "email") == sum(len(re.findall(r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", t, re.ASCII)) for t in texts) > 0


def test_redaction_of_rows_that_share_a_key(spark):
    rows = [(1, "mail a.b@example.com now"), (1, "nothing personal is in this second row"), (None, "x@y.org"), (2, None), (3, "")]
    got = [tuple(r) for r in sanitize.redact_text(spark.createDataFrame(rows, "id int, text string"), "id", rules=["email"]).collect()]
    assert sorted(got, key=str) == sorted([(1, "mail [REDACTED] now", 1), (1, "nothing personal is in this second row", 0), (None, "[REDACTED]", 1), (2, "", 0), (3, "", 0)], key=str)


def test_fusion_of_missing_confidence(spark):
    assert fused(spark, cand(1, (0, 0, 100, 20), conf=None))[0][:2] == ("REVIEW", 0.5)


def test_faces_merge_into_the_first_they_overlap(spark):
    made = "found array<struct<bbox:struct<x:int,y:int,width:int,height:int>,confidence:double>>, all array<struct<bbox:struct<x:int,y:int,width:int,height:int>,confidence:double>>"
    row = ([((0, 0, 10, 10), 0.5), ((50, 0, 10, 10), 0.6)], [((1, 0, 10, 10), 0.9), ((100, 0, 5, 5), 0.7), ((51, 0, 10, 10), 0.2)])
    got = spark.createDataFrame([row], made).select(regions.merged_faces(F.col("found"), F.col("all")).alias("f")).first().f
    assert [(tuple(x.bbox), x.confidence) for x in got] == [((0, 0, 11, 10), 0.9), ((50, 0, 11, 10), 0.6), ((100, 0, 5, 5), 0.7)]


def test_targets_answers_and_lines(spark):
    elements = spark.createDataFrame([(1, 0, "btn-9", "s1"), (1, 1, "in-2", "btn-9")], "request_id int, elem_idx int, element_id string, stamped_id string")
    actions = spark.createDataFrame([(1, "btn-9"), (1, "#in-2"), (1, "in-1"), (2, "btn-9"), (1, None)], "request_id int, target string")
    assert sorted(((r.request_id, r.target, r.elem_idx) for r in messages.targets(actions, elements).collect()), key=str) == sorted([(1, "btn-9", 0), (1, "#in-2", 1), (1, "in-1", 1), (2, "btn-9", None), (1, None, None)], key=str)
    replies = spark.createDataFrame([(1, "yes"), (3, "no")], "request_id int, reply string")
    assert [tuple(r) for r in messages.answered(replies, spark.createDataFrame([(1, "t"), (1, "t")], "request_id int, task string")).collect()] == [(1, "yes", "t")]
    cols = "page_id int, rank int, element_id string, pos string, tag string, id string, input_type string, role string, label string, placeholder string, value string, href string, text string, options array<string>"
    e = spark.createDataFrame([(1, 2, "b", None, "p", None, None, None, None, None, None, None, "x" * 99, []), (1, 1, "a", "top-left", "input", "q", "text", "textbox", "who", "", None, None, "", ["1", "2"])], cols)
    want = '- elementId: "a" [pos: top-left] | <input id="q" type="text" role="textbox" label="who" options=[1, 2]></input>\n- elementId: "b" | <p> text="' + "x" * 60 + '..."</p>'
    assert messages.element_lines(e).first().lines == want
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    prior = F.array(*[F.lit(f"act {i}") for i in range(5)])
    assert one(messages.prompt(F.lit("go [x]"), F.lit("l"), prior, F.lit(""))) == "Task:\ngo\n\nEarlier actions:\nact 2\nact 3\nact 4\n\nElements:\nl"
    assert one(messages.prompt(F.lit(None), F.lit(""), F.lit(None).cast("array<string>"), F.lit("search"))) == "Advice:\nsearch\n\nElements:\n(No DOM elements available)"


def test_widgets_enrich_or_follow(spark):
    e = spark.createDataFrame([(1, "a", "", "text"), (1, "b", "n", None)], "page_id int, element_id string, name string, input_type string")
    w = spark.createDataFrame([(1, "a", "autocomplete", "journeyFrom", [" x ", ""], None), (1, "c", "dropdown", None, None, [(0, "v", "t"), (1, "v", " ")])], "page_id int, element_id string, widget_type string, form_control string, suggestions array<string>, options array<struct<index:int,value:string,text:string>>")
    got = {r.element_id: r for r in page.with_widgets(e, w).collect()}
    assert (got["a"].name, got["a"].travel_role, got["a"].suggestions, got["a"].input_type) == ("journeyfrom", "origin", ["x"], "text")
    assert got["b"].widget_type is None and got["c"].input_type == "custom-select" and [o.text for o in got["c"].options] == ["t"]


def test_models_registry(spark):
    def squares(loaded, batch):
        if (batch["width"] == 13).any():
            raise RuntimeError("no")
        own = batch[batch["width"] == batch["height"]]
        return own[["page_id", "region_idx", "x", "y", "width", "height"]].assign(type="face", confidence=loaded)

    regions_ = spark.createDataFrame([(1, 1, 0, 0, 20, 20), (1, 2, 0, 0, 30, 20), (2, 1, 5, 5, 9, 9)], "page_id long, region_idx long, x int, y int, width int, height int")
    models = registry.Models().register(registry.Model("squares", ("face",), squares, load=lambda: 0.7, wants=lambda _: F.col("width") > 10)).register(registry.Model("bad", ("face",), lambda _, b: 1 / 0))
    assert [(r.page_id, r.region_idx, r.type, r.confidence, r.model) for r in models.run(regions_, "face").collect()] == [(1, 1, "face", 0.7, "squares")]
    assert models.able("face") == ["squares", "bad"] and models.run(regions_, "text").count() == 0
    with pytest.raises(ValueError):
        models.register(registry.Model("", (), squares))


def test_pixels_and_pictures(spark, tmp_path):
    px = spark.createDataFrame([([(0, 0, 0, 255)],), ([(0, 0, 0, 255), (0, 1, 0, 255)],), ([],)], "p array<struct<r:int,g:int,b:int,a:int>>")
    assert [r.v for r in px.select(regions.all_black(F.col("p")).alias("v")).collect()] == [True, False, True]
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    (tmp_path / "b.png").write_bytes(b"none")
    assert [(r.width, r.height) for r in tables.screenshots(spark, str(tmp_path)).collect()] == [(640, 480)]


def test_words_met_and_summaries(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    words = F.array(F.lit("big"), F.lit("box"), F.lit("box"), F.lit("far"))
    assert [one(messages.words_met(words, F.lit(t))) for t in ("a big box", "a box", "")] == [True, False, False]
    r = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "page_id int, reason string")
    assert regions.by_reason(r).first().by_type == {"a": 2, "b": 1}
