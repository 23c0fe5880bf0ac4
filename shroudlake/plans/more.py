"""Queries over rows made from the driver's tables, one for each group of operators, with SQL twins that state the expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import places
from ..functions.lineage import paired
from ..functions.text import first_keyword, mask_typed, padded_id, shown_task, without_guidance
from ..operators import agent, chain, detect, fields, fuse, history, lookup, messages, names, page, propagate, reading, regions, run, sanitize, wording
from ..sources import tables
from . import rules_sql

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dealt(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose every row is costly to read: of one with fewer splits than a few times the cores, the rows dealt out, as a small file is one split however many rows it holds."""
    rows, parts = _table(spark, d, name), 4 * spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def rule_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every match of the rules over whole documents."""
    found = detect.detect_pii(_table(spark, d, "documents"), ["doc_id"], rules=list(rules_sql.NAMES))
    return found.select("doc_id", "rule", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.round("confidence", 4).alias("confidence"), "decision")


#: Texts that the rules find something in, or nearly do; N stands for a number of four digits.
SAMPLES = (
    "write to a.bN@example.com or x@mail5.example.com", "card 4111111111111111 and 4111 1111 1111 1112", "imei 4111111111111111", "uid 2341 2341 2346 and 2341 2341 2345", "order id: 2341 2341 2346", "VID: 9123 4567 8901 N aadhaar", "pan ABCPEN0F tax, ABCDEN0F, ABCPE1234F",
    "call +91 98765 4N1 now", "mobile 9876N321", "(743) 555-N today", "invoice no 743-555-N", "ssn 123-45-N and 666-45-N", "token eyJhbGciN.eyJzdWIi.SflKxw", "sk_live_abcdefghijklN0", "server 8.8.4.4 and 10.0.0.5", "total 8.8.4.4", "2001:db8:0:0:0:ff00:42:N host",
    "born 05/11/1990, due 31.12.2020", "due 05/11/1990", "bank HDFC0AN12", "27ABCDEN4F1Z5 gst", "GSTIN : 27ABCPE1234F1Z5", "IMEI no.: 356938035643809", "serial 356938035643809 N", "amount 356938035643809", "Mobile No. : 98765N21", "Contact: +9N", "Name: Kim Lee N", "Name : invoice N", "customer name   Ann Bee",
    "S/O Ram Kumar of N", "C/O address N", "राहुल शर्मा N", "Customer Signature N", "for Kim Traders Signature", "Rahul Verma and Priya N", "Amit will come", "John Smith, Mary N", "roll no 1234N678", "order 1234N678", "10000000000", "reg 12-N5", "12-N5 alone", "student name Kim Lee", "First Name Dashboard Ann Lee N",
    "user id kimN/22", "kimN no label", "account no AB-N", "visa 5500 0055 5555 5559 credit", "aadhaar 2341 2341 2346 uidai", "Phone: 99N12345 call",
    "dial +44 20 7946 N or (+1-743-555-N) x+91 80 2345 N", "pay kimN@okbank or kim.N@upi now, a@b.org", "head\nRahul Verma N\nKim Lee\nDate of Birth: 1.1.1990", "Kim Lee\nDOB 05/11/1990", "Address: 12 High Street N, Town", "email address: 12 High Street N", "Address - www.example.com/N page",
)


def rule_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every match of the rules in made-up texts, of which each rule has one that it takes or all but takes."""
    c = _table(spark, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0").alias("number"))
    # customers with the same number have the same texts, and so have all numbers where a form names none: each text is read once, dealt over the cores
    texts = c.select("number").distinct().select("number", F.posexplode(F.lit(list(SAMPLES))).alias("k", "form")).select("number", "k", F.regexp_replace("form", r"N(?=[^a-z]|$)", F.col("number")).alias("whole"))
    once = texts.select("whole").distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    found = detect.detect_pii(once, ["whole"], "whole", rules=list(rules_sql.NAMES))
    found = found.select("whole", "rule", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.round("confidence", 4).alias("confidence"), "decision")
    rows = paired(c, paired(texts, found, "whole"), "number")
    return rows.select((F.col("c_custkey") * 100 + F.col("k")).alias("doc_id"), "rule", "span_start", "span_end", "confidence", "decision")


def shown_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates in five forms as one form."""
    o = _table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    k, day = F.col("o_orderkey") % 5, F.col("day")
    raw = F.when(k == 0, F.date_format(day, "yyyy-M-d")).when(k == 1, F.date_format(day, "d/M/yyyy")).when(k == 2, F.date_format(day, "dd.MM.yyyy")).when(k == 3, "next week").otherwise("Tomorrow")
    return o.select("o_orderkey", agent.shown_date(raw, day).alias("shown"))


#: Tasks with a name N and what is said B, whom they name and what they say (None: no contact).
TASKS = (
    ("search for contact N and message him that B", "N", "B"), ("send a message to N saying B", "N", "B"), ('send "N" message that B', "N", "B"), ('text "N" a B', "N", "B"), ('send "N" B', "N", "B"),
    ("send N message B", "N", "B"), ("tell N that B", "N", "B"), ("message N a B", "N", "B"), ("text N please B", "N", "please B"), ("message N B", "N", "B"), ("tell 42 that B", None, None), ("message someone B", None, None), ("open the page of N", None, None),
)


def message_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Whom made-up tasks name and what they say."""
    c = _dealt(spark, d, "customer").select("c_custkey", F.concat(F.lit("kim"), F.col("c_custkey")).alias("who"), F.concat(F.lit("order "), F.col("c_custkey"), F.lit(" is ready")).alias("said"))
    rows = c.select("*", F.posexplode(F.lit([t for t, _, _ in TASKS])).alias("k", "form"))
    task = F.replace(F.replace("form", F.lit("N"), F.col("who")), F.lit("B"), F.col("said"))
    got = wording.contact_task(task)
    return rows.select("c_custkey", F.col("k").cast("long").alias("k"), got["contact"].alias("contact"), got["body"].alias("body"))


#: Search tasks with a query Q.
SEARCHES = (
    'search for "Q" please', "search Q and play the first video", "please find Q on youtube", "look up Q for me", "on this site, search for Q in amazon", "search for Q", "find Q on shop.com", "[note] search Q [STEP GUIDANCE: x]",
)


def search_phrases(spark: SparkSession, d: str) -> DataFrame:
    """What made-up search tasks look for."""
    p = _dealt(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9 ]", "")).alias("q"))
    rows = p.select("*", F.posexplode(F.lit(list(SEARCHES))).alias("k", "form"))
    return rows.select("p_partkey", F.col("k").cast("long").alias("k"), wording.search_query(F.replace("form", F.lit("Q"), F.col("q"))).alias("query"))


def journeys(spark: SparkSession, d: str) -> DataFrame:
    """Stations and dates of made-up travel tasks."""
    n = _table(spark, d, "nation").select("n_nationkey", F.regexp_replace("n_name", "[^A-Za-z0-9]", "").alias("a"), F.concat(F.lit("Town"), F.col("n_nationkey")).alias("b"))
    task = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("book a ticket from "), "a", F.lit(" to "), "b", F.lit(" on 12/05/2025"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("train from "), "a", F.lit(" on tomorrow"))).otherwise(F.concat(F.lit("get to "), "b"))
    return n.select("n_nationkey", wording.journey(task)["from_station"].alias("a"), wording.journey(task)["to_station"].alias("b"), wording.journey(task)["date"].alias("day"))


#: (task, draft, whether the draft only repeats the task, the words to send, the theme)
DRAFTS = (
    ("say Hello there and press enter", "Hello there", True, "Hello there", "verse"), ("send kim message the box is here", "the box is here", True, "the box is here", "verse"),
    ("type Good morning in the chat", "", True, "Good morning", "verse"), ("write a poem for kim", "poem on kim", True, None, "verse"), ("compose a wedding wish", "May your days be long and bright, all the best", False, None, "wedding"),
    ("message kim that lecture is off", "Lecture is off", True, "lecture is off", "absence"), ('write "see you soon" here', "so long", False, "see you soon", "verse"), ("greet kim, birthday song", "short one", True, None, "birthday"),
)


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts that only repeat their task, the words a task wants sent, and its theme; a row for each customer and case."""
    made = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(t).alias("task"), F.lit(v).alias("draft")) for i, (t, v, *_) in enumerate(DRAFTS)])
    rows = _dealt(spark, d, "customer").select("c_custkey", F.inline(made))
    task = F.col("task")
    got = wording.let(wording.contact_task(task), lambda named: F.struct(messages.echo(F.col("draft"), task, named).alias("echo"), messages.message_text(task, named).alias("words")))
    return rows.select("c_custkey", "k", got.alias("got"), messages.theme(task).alias("theme")).select("c_custkey", "k", "got.echo", "got.words", "theme")


def composed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Drafts cleaned of heading, salutation and surplus lines."""
    c = _table(spark, d, "customer").select("c_custkey", "c_name")
    raw = F.concat(F.lit("Poem for you\nDear "), "c_name", F.lit("\n\nfirst of "), "c_name", F.lit("\n second line \nthird line\nWith love"))
    task = F.when(F.col("c_custkey") % 2 == 0, "a 2 line poem").otherwise("a letter")
    return c.select("c_custkey", messages.composed(raw, task).alias("draft"))


def closed_pages(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "pages")
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("chrome://"), "url")).when(k == 1, F.lit(None).cast("string")).when(k == 2, F.concat("url", F.lit("?at=chromewebstore.google.com"))).otherwise(F.col("url"))
    return p.select("page_id", messages.closed_page(url).alias("closed"))


def vault_values(spark: SparkSession, d: str) -> DataFrame:
    """References to a vault of values resolved."""
    c = _table(spark, d, "customer")
    vault = F.create_map(F.lit("fullName"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    ref = F.when(F.col("c_custkey") % 3 == 0, "local.fullName").when(F.col("c_custkey") % 3 == 1, "local.segment").otherwise(F.concat(F.lit("plain "), "c_name"))
    return c.select("c_custkey", agent.resolve_vault(ref, vault).alias("value"))


def feedback_errors(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, "").when(k == 1, "short").otherwise(F.repeat(F.lit("good work "), F.when(k == 2, 600).otherwise(3)))
    name = F.when(k == 3, F.repeat("c_name", F.lit(20))).otherwise(F.col("c_name"))
    mail = F.when(k == 4, "no mail").otherwise("a@b.org")
    return c.select("c_custkey", agent.feedback_error(name, mail, F.lit("http://x"), text).alias("error"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    w = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1")
    e = _table(spark, d, "events").select(F.col("user_id").alias("loop_id"), w.cast("long").alias("step"), "event_type", "value", "event_id")
    kind = F.when(F.col("event_id") % 7 == 0, "done").when(F.col("event_id") % 11 == 0, "ask_user").when(F.col("event_id") % 2 == 0, "type").otherwise("click")
    return e.select("loop_id", "step", kind.alias("action_type"), (F.col("event_id") % 10 / 10).alias("confidence"), (F.col("event_id") % 13 != 0).alias("exec_success"), (F.col("event_id") % 17 == 0).alias("cancelled"), F.lit(False).alias("needs_clarification"))


def loop_replay(spark: SparkSession, d: str) -> DataFrame:
    """The steps that loops run, and why they end."""
    return history.replay(_steps(spark, d)).select("loop_id", "step", "action_type", "stop_reason")


def step_guidance(spark: SparkSession, d: str) -> DataFrame:
    """Running flags of loops, and the advice they lead to, where no message is kept."""
    steps = _steps(spark, d).where("step < 6")
    k = F.col("loop_id") % 5
    task = F.when(k == 0, "log in to the portal").when(k == 1, "book a train").when(k == 2, "search for kim and greet").when(k == 3, "find shoes").otherwise("scroll down")
    s = history.guidance_flags(steps.withColumns({"task": task, "message": F.lit(None).cast("string")}))
    return s.select("loop_id", "step", "searched", "clicked", "contact_clicked", "previous_action", messages.guidance(s).alias("advice"))


def outcome_rules(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes where URLs are missing and some are stored already."""
    c = _table(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    url = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, "/a").otherwise("/b")
    kind = F.when(F.col("role") == "user", "type").otherwise("click")
    t = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_seq"), kind.alias("action_type"), url.alias("page_url"), F.when(F.col("turn") % 5 == 0, "failed").alias("outcome"))
    return history.outcomes(t).select("session_id", "turn_seq", "outcome")


def patched_turns(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations")
    t = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_seq"), F.when(F.col("role") == "user", "type").otherwise("click").alias("action_type"), F.lit("old").alias("outcome"))
    r = c.where("conv_id % 3 <> 0").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 3 == 1).alias("success")).distinct()
    return messages.patched(t, r).select("session_id", "turn_seq", "outcome")


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Raw answers in five forms, parsed."""
    c = _table(spark, d, "customer").select("c_custkey")
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit('```json\n{"action": {"type": "click", "targetElementId": "btn-'), key, F.lit('"}, "confidence": 0.95, "reasoning": "r"}\n```')))
        .when(k == 1, F.concat(F.lit('{"actions": [{"type": "type", "targetElementId": "input-3", "value": "v'), key, F.lit('"}], "message": "m"}')))
        .when(k == 2, F.lit('{"action": "fly"}')).when(k == 3, F.concat(F.lit('so: {"action": "click", "target": "btn-'), key, F.lit('", "confidence": 7}'))).otherwise(F.lit("no answer"))
    )
    p = agent.parsed(c.withColumn("raw", raw))
    return p.select("c_custkey", F.col("error").isNotNull().alias("failed"), "action_type", "target", "value", "confidence")


def back_filled_answers(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    k = F.col("c_custkey") % 3
    rows = c.select(
        "c_custkey", F.lit("type").alias("action_type"), F.when(k > 0, F.concat(F.lit("in-"), "c_custkey")).alias("target"), F.when(k > 1, F.col("c_name")).alias("value"), F.lit("").alias("scroll_direction"),
        F.lit("because").alias("reasoning"), F.lit(None).cast("string").alias("thinking"),
    )
    return messages.back_filled(rows).select("c_custkey", F.col("actions")[0]["reasoning"].alias("why"), "message", "thinking")


def _boxed(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    b = geo.box(F.col("l_partkey") % 1100, F.col("l_suppkey") % 700, F.lit(20) + F.col("l_partkey") % 400, F.lit(12) + F.col("l_suppkey") % 200)
    return li.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("n"), b.alias("bbox"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"))


def readable_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions worth reading and regions that may show faces."""
    b = _boxed(spark, d)
    tag = F.when(F.col("k") % 5 == 0, "canvas").when(F.col("k") % 5 == 1, "svg").otherwise("img")
    area = F.when(F.col("k") % 7 == 0, 6_000_000).otherwise(1000)
    box = F.col("bbox")
    return b.select("page_id", "n", regions.readable(tag, box, area).alias("readable"), regions.crop_shape(box["width"], box["height"]).alias("crop"), regions.may_show_faces(box, F.col("k") % 9 == 0).alias("faces"))


def checked_redactions(spark: SparkSession, d: str) -> DataFrame:
    """Redaction boxes after none to three expansions."""
    clean = F.transform(F.lit([0, 1, 2, 3]), lambda i: i >= F.col("k") % 5)
    v = _boxed(spark, d).select("page_id", "n", regions.verified(F.col("bbox"), F.lit(1280), F.lit(800), clean).alias("v"))
    return v.select("page_id", "n", *[F.col("v.bbox")[c].cast("long").alias(c) for c in ("x", "y", "width", "height")], F.col("v.passed").alias("passed"), F.col("v.expansions").cast("long").alias("expansions"))


def face_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Faces of made-up detector outputs."""
    b = _boxed(spark, d)
    k = F.col("k")
    scores = F.array(F.lit(0.1), k % 10 / 10.0, F.lit(0.9), F.lit(0.5))
    boxes = F.array(F.lit(0.25), F.lit(-0.5), F.lit(0.75), F.lit(0.5), F.lit(0.5), F.lit(0.5), k % 4 / 2.0, F.lit(2.0))
    rows = b.select("page_id", "n", F.explode(regions.decoded_faces(scores, boxes, F.col("bbox"))).alias("f"))
    return rows.select("page_id", "n", *[F.col("f.bbox")[c].cast("long").alias(c) for c in ("x", "y", "width", "height")], F.col("f.confidence").alias("confidence"))


def part_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The part of a token's box that a span covers, and a span's box on a line without tokens."""
    b = _boxed(spark, d)
    s, e = F.col("k") % 6, F.col("k") % 6 + F.lit(4)
    token = F.struct(F.lit("dom_0001").alias("id"), F.lit("abcdefgh").alias("text"), F.lit(2).alias("start"), F.lit(10).alias("end"), F.col("bbox"), F.array("bbox").alias("boxes"))
    got = places.span_boxes(F.array(token), s, e)
    line = places.interpolated(F.col("bbox"), F.lit("x" * 40), s, e)
    return b.select("page_id", "n", got["bbox"]["x"].cast("long").alias("x"), got["bbox"]["width"].cast("long").alias("width"), F.size(got["tokens"]).cast("long").alias("tokens"), line["x"].cast("long").alias("line_x"), line["width"].cast("long").alias("line_width"), line["height"].cast("long").alias("line_height"))


def picture_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that pictures are fitted to, with padding and scales."""
    b = _boxed(spark, d)
    w, h = F.col("k") % 3000 + F.lit(200), F.col("k") % 1700 + F.lit(150)
    fit, pad = geo.fitted(w, h, F.lit(1.5)), geo.padded(F.col("bbox"), F.lit(1200), F.lit(700))
    return b.select("page_id", "n", fit["width"].cast("long").alias("width"), fit["height"].cast("long").alias("height"), F.round(geo.read_scale(w, h), 6).alias("scale"), *[pad[c].cast("long").alias(f"pad_{c}") for c in ("x", "y", "width", "height")], geo.scale_mismatch(w / 1000, h / 600).alias("mismatch"))


def joined_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box around each page's boxes."""
    b = _boxed(spark, d).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("n", "bbox"))).alias("all"))
    box = geo.enclosing(F.transform("all", lambda x: x["bbox"]))
    return b.select("page_id", *[box[c].cast("long").alias(c) for c in ("x", "y", "width", "height")])


def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    """Detections of a page by decision and by type."""
    b = _boxed(spark, d).select("page_id", F.col("n").alias("cand_seq"), F.when(F.col("k") % 3 == 0, "REDACT").when(F.col("k") % 3 == 1, "REVIEW").otherwise("KEEP").alias("decision"), F.when(F.col("k") % 2 == 0, "email").otherwise("phone").alias("type"), F.array(F.col("flag")).alias("sources"))
    parts, sums = regions.by_decision(b), fuse.summaries(b)
    return parts.join(sums, "page_id").select("page_id", F.array_join("redactions", ",").alias("redactions"), F.array_join("reviews", ",").alias("reviews"), "total", F.col("by_type")["email"].alias("emails"), F.col("by_source")["A"].alias("from_a"))


def shields(spark: SparkSession, d: str) -> DataFrame:
    """Document and avatar shields of regions."""
    b = _boxed(spark, d)
    areas = b.where("n = 1").select("page_id", F.col("n").alias("region_idx"), geo.box(F.lit(0), F.lit(0), F.lit(1600), F.lit(1000) - F.lit(960) * (F.col("k") % 4 == 0).cast("int")).alias("bbox"), (F.col("k") % 2 == 0).alias("is_avatar"), F.lit(None).cast("double").alias("avatar_confidence"))
    kind = F.when(F.col("k") % 6 == 0, "aadhaar").when(F.col("k") % 6 == 1, "pan").when(F.col("k") % 31 == 0, "identity_document").otherwise("email")
    c = b.select("page_id", "bbox", kind.alias("type"), F.when(F.col("k") % 11 == 0, "regex:aadhaar_vid").alias("reason"), F.when(F.col("k") % 5 == 0, "KEEP").otherwise("REDACT").alias("decision"))
    both = propagate.document_shields(areas, c).unionByName(propagate.avatar_shields(areas, c.where("bbox.width > 300")), allowMissingColumns=True)
    return both.select("page_id", "type", "confidence", "reason")


def spread_values(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed identifiers and names of a page, and the further elements that show them."""
    o = _table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("k"))
    value = F.concat(F.lit("id"), F.col("k"))
    c = o.select(
        "page_id", F.col("k").cast("int").alias("elem_idx"), F.when(F.col("k") % 3 == 0, "username").when(F.col("k") % 3 == 1, "email").otherwise("name").alias("type"), F.when(F.col("k") % 4 == 0, "ocr").otherwise("dom").alias("source"),
        F.when(F.col("k") % 3 == 2, F.concat(F.lit("Kim "), F.col("k"))).otherwise(value).alias("text"), F.lit("").alias("original_value"), (F.lit(0.75) + F.col("k") % 4 / 20).alias("confidence"),
    )
    e = o.select(
        "page_id", (F.col("k") + 1_000_000).cast("int").alias("elem_idx"), F.lit("td").alias("tag"), F.lit(False).alias("is_header"), F.when(F.col("k") % 5 == 0, "Roll No").when(F.col("k") % 5 == 1, "First Name").otherwise("Total").alias("label"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("placeholder"), F.concat(F.lit("row id"), F.col("k"), F.lit(" Kim "), F.col("k")).alias("text"),
        F.lit(None).cast("string").alias("value"), F.lit(False).alias("is_sensitive"),
    )
    values = propagate.confirmed(c, e)
    return propagate.spread(values, e, c).select("page_id", F.col("elem_idx").cast("long").alias("elem_idx"), "kind", "value")


#: Texts of regions with the matches found in them and the kind of document they show.
DOCUMENT_TEXTS = (
    ("Income Tax Department ABCDE1234F", [], "pan"), ("permanent account number", [], "pan"), ("Govt. of India date of birth father", [], "aadhaar"), ("course enrolment page", [], None), ("regional transport office form 7", [], "driving_licence"),
    ("a page 2345 6789 0123", [], "aadhaar"), ("no number here", ["aadhaar"], "aadhaar"), ("father of the bride", ["pan"], "pan"), ("Election Commission of India elector photo identity card", [], "voter_id"), ("EPIC No ABC1234567", [], "voter_id"),
    ("Republic of India passport", [], "passport"), ("a passport", [], None), ("driving license", [], "driving_licence"), ("", [], None),
)


def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kind of identity document that regions of two sizes show."""
    made = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(t).alias("text"), (F.lit(m) if m else F.expr("cast(array() as array<string>)")).alias("found")) for i, (t, m, _) in enumerate(DOCUMENT_TEXTS)])
    rows = _table(spark, d, "nation").select("n_nationkey", F.inline(made))
    w = F.when(F.col("n_nationkey") % 2 == 0, 300).otherwise(79)
    return rows.select("n_nationkey", "k", propagate.document_kind(F.col("text"), w, F.lit(50), F.col("found")).alias("kind"))


def sanitized_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements whose boxes a redaction overlaps, and sensitive fields."""
    b = _boxed(spark, d)
    e = b.select(
        "page_id", ((F.col("n") * 1_000_000 + F.col("k")) * 100_000 + F.col("s")).alias("elem_idx"), F.when(F.col("k") % 3 == 0, "input").when(F.col("k") % 3 == 1, "button").otherwise("div").alias("tag"), F.lit(None).cast("string").alias("role"), F.when(F.col("k") % 6 == 0, "password").otherwise("text").alias("input_type"),
        F.col("flag").alias("text"), F.lit("label").alias("label"), F.when(F.col("k") % 2 == 0, F.col("flag")).otherwise("").alias("value"), F.lit("").alias("placeholder"), F.lit(None).cast("string").alias("alt"), F.lit(None).cast("string").alias("href"), "bbox", (F.col("k") % 4 == 0).alias("is_sensitive"),
    )
    r = b.where("n = 2").select("page_id", geo.box(F.col("bbox.x"), F.col("bbox.y"), F.lit(500), F.lit(300)).alias("bbox"))
    return sanitize.sanitize_elements(e, r).select("page_id", "elem_idx", "text", "value", "interaction_type", "has_value")


def reason_keys(spark: SparkSession, d: str) -> DataFrame:
    """What detections' reasons are about."""
    kinds = ("document_shield:pan_card", "regex:phone_indian", "ocr_regex:ssn", "regex:ip_address", "checksum_valid", "own words", "", "form_field_anchor:phone", "regex:aadhaar_name_dob", "UltraFace-RFB320")
    rows = _table(spark, d, "nation").select("n_nationkey", F.posexplode(F.lit(list(kinds))).alias("k", "reason"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "face").when(F.col("n_nationkey") % 3 == 1, "aadhaar").otherwise("creditCard")
    return rows.select("n_nationkey", F.col("k").cast("long").alias("k"), regions.reason_key(F.col("reason"), kind).alias("about"))


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Typed masks, padded numbers and first keywords."""
    c = _table(spark, d, "customer")
    items = F.array(F.struct(F.col("c_name").alias("text"), F.lit("name").alias("type")), F.struct(F.lit("Customer").alias("text"), F.lit("role").alias("type")))
    text = F.concat("c_name", F.lit(" is a Customer, "), "c_name")
    words = F.when(F.col("c_custkey") % 2 == 0, "my Credit-Card no").otherwise("user name")
    return c.select("c_custkey", mask_typed(text, items).alias("masked"), padded_id("e_", F.col("c_custkey")).alias("id"), first_keyword(words, ["pan", "credit_card", "user_name"]).alias("word"))


def field_types(spark: SparkSession, d: str) -> DataFrame:
    """What form fields hold, from their attributes and values."""
    from ..operators.fields import typed_fields

    c = _table(spark, d, "customer")
    k = F.col("c_custkey") % 7
    s = lambda v: F.lit(v).cast("string")
    e = c.select(
        F.col("c_custkey").alias("page_id"), F.lit(0).alias("elem_idx"), F.when(k == 6, "div").otherwise("INPUT").alias("tag"), F.when(k == 0, "password").when(k == 1, "email").otherwise("text").alias("input_type"),
        F.when(k == 2, "cc-number").when(k == 1, "tel").alias("autocomplete"), F.when(k == 3, "Roll-No roll_no").alias("name"), s(None).alias("id"), s(None).alias("class_name"), s(None).alias("label"), F.when(k == 4, "mail a.b@example.com").when(k == 5, "nothing").otherwise("").alias("value"),
    )
    return typed_fields(e).select("page_id", "type", "confidence", "text")


def column_headers(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the header above them."""
    b = _boxed(spark, d)
    cells = b.select(F.col("page_id").alias("table_id"), F.col("n").alias("cell_id"), F.col("n").alias("col_idx"), (F.col("k") % 350).cast("int").alias("x"), F.lit(20).alias("width"))
    heads = _table(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.inline(F.expr("transform(sequence(0, 2), i -> struct(cast(i as long) as th_idx, i * 100 as x, 100 as width, concat('h', i) as text))")))
    return lookup.table_headers(cells, heads).select("table_id", "cell_id", F.col("x").cast("long").alias("x"), "header")


def option_choices(spark: SparkSession, d: str) -> DataFrame:
    """The options that requests mean."""
    texts = ("--Select--", "I", "II", "III", "IV")
    options = F.array(*[F.struct(F.lit(i).alias("index"), F.lit("" if not i else f"s{i}").alias("value"), F.lit(t).alias("text")) for i, t in enumerate(texts)])
    c = _table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    value = F.when(k == 0, "4th semester").when(k == 1, "II").when(k == 2, "s3").when(k == 3, "first").otherwise("zzz")
    return c.select("c_custkey", lookup.option_match(value, options)["index"].cast("long").alias("chosen"), lookup.suggestion_match(F.lit("abc"), F.array(F.lit("x abc"), F.concat(F.lit("abc "), "c_name"))).alias("suggested"))


def element_targets(spark: SparkSession, d: str) -> DataFrame:
    """The elements that actions' targets name."""
    e = _boxed(spark, d).select(F.col("page_id").alias("request_id"), F.col("n").cast("int").alias("elem_idx"), F.concat(F.lit("e"), F.col("k")).alias("element_id"), F.concat(F.lit("s"), F.col("n")).alias("stamped_id"))
    o = _table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_custkey") % 3 == 0, "s2").when(F.col("o_custkey") % 3 == 1, "btn-1").otherwise("none").alias("target"))
    return messages.targets(a, e).select("request_id", F.col("elem_idx").cast("long").alias("elem_idx"))


def earlier_steps(spark: SparkSession, d: str) -> DataFrame:
    """What a message task's earlier actions have done."""
    n = _table(spark, d, "nation")
    k = F.col("n_nationkey") % 5
    one = lambda *xs: F.array(*[F.lit(x) for x in xs])
    prior = F.when(k == 0, one('type: "kim" in search')).when(k == 1, one('type: "kim"', "click: row")).when(k == 2, one('type: "kim"', "click: row", "type: parcel arrived [outcome: executed_and_sent]", "click: x")).when(k == 3, one("click: kim")).otherwise(one("scroll", "type: other [outcome: executed_and_sent]"))
    got = messages.earlier(prior, F.lit("message kim that parcel arrived"))
    return n.select("n_nationkey", got["searched"].alias("searched"), got["clicked"].alias("clicked"), got["sent"].alias("sent"), messages.searched_before(prior).alias("typed"))


def stream_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Answers that arrive in chunks, put together."""
    c = _table(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))
    return tables.joined_chunks(c).select("request_id", "raw")


#: Markup of a page with a number N, and for each element in order: tag, whether it shows, what stands before it, whether it is a container.
MARKUP = (
    "<div id=a><h1>Page N</h1><p>Order: <b>N</b></p><div hidden><p>gone</p></div><dl><dt>Term</dt><dd>value</dd></dl><ul aria-hidden=true><li>x</li></ul>"
    "<span style='opacity:0.01'>faint</span><label>Name</label><input type=text><header><img class='user-avatar' src=u.png></header></div>"
)
SHOWN = (
    ("div", True, "", True), ("h1", True, "", False), ("p", True, "Page N", False), ("b", True, "Order:", False), ("div", False, "Page NOrder: N", True), ("p", False, "", False), ("dl", True, "Page NOrder: Ngone", False), ("dt", True, "", False),
    ("dd", True, "Term", False), ("ul", False, "Page NOrder: NgoneTermvalue", True), ("li", False, "", False), ("span", False, "Page NOrder: NgoneTermvaluex", False), ("label", True, "Page NOrder: NgoneTermvaluexfaint", False),
    ("input", True, "Page NOrder: NgoneTermvaluexfaintName", False), ("header", True, "Page NOrder: NgoneTermvaluexfaintName", False), ("img", True, "", False),
)


def _markup(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation")
    return tables.elements(n.select(F.col("n_nationkey").cast("long").alias("page_id"), F.replace(F.lit(MARKUP), F.lit("N"), F.col("n_nationkey").cast("string")).alias("html")))


def shown_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of made-up pages: which can be seen, what stands before them, which are containers."""
    e = _markup(spark, d)
    return e.select("page_id", F.col("elem_idx").cast("long").alias("elem_idx"), "tag", (~F.col("hidden")).alias("shown"), "prev_text", page.structural(F.col("tag"), F.col("block_child")).alias("container"))


def context_words(spark: SparkSession, d: str) -> DataFrame:
    """What names elements of those pages that are no form fields and can be seen."""
    return page.context_labels(page.visible(_markup(spark, d))).select("page_id", F.col("elem_idx").cast("long").alias("elem_idx"), "context")


def avatar_regions(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of those pages laid out in a column, with the avatars among them."""
    e = _markup(spark, d).withColumns({"bbox": geo.box(F.lit(900), F.col("elem_idx") * 10, F.lit(40), F.lit(40)), "css_w": F.lit(1280)})
    r = page.pixel_regions(page.avatars(page.near_names(e)))
    return r.select("page_id", "region_id", "tag", "src", "is_avatar", "avatar_confidence", "avatar_reason", "area")


def _laid_out(spark: SparkSession, d: str) -> DataFrame:
    """Five elements for each customer: a mail in a text, a plain text, a password field, an avatar, a heading."""
    c = _dealt(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("page_id"))
    none = F.lit(None).cast("string")
    one = lambda i, tag, text, value=none, kind=none, avatar=False, head=False: F.struct(
        F.lit(i).alias("elem_idx"), F.lit(tag).alias("tag"), text.alias("text"), value.alias("value"), kind.alias("input_type"), F.lit(avatar).alias("is_avatar"), F.lit(head).alias("is_header"), geo.box(F.lit(10), F.lit(60 * i), F.lit(300), F.lit(30)).alias("bbox")
    )
    mail = F.concat(F.lit("mail to kim"), F.col("page_id"), F.lit("@example.com"))
    rows = F.array(one(0, "h1", mail, head=True), one(1, "p", mail), one(2, "p", F.lit("plain words of no one")), one(3, "input", none, F.concat(F.lit("pw"), F.col("page_id")), F.lit("password")), one(4, "img", none, avatar=True))
    out = c.select("page_id", F.inline(rows))
    return out.withColumns({
        **{n: none for n in ("autocomplete", "name", "id", "class_name", "label", "placeholder", "alt", "href", "role")}, "block_child": F.lit(False), "is_sensitive": F.lit(False), "avatar_confidence": F.lit(0.98),
        "tokens": F.expr("cast(null as array<struct<id:string,text:string,start:int,end:int,bbox:struct<x:int,y:int,width:int,height:int>,boxes:array<struct<x:int,y:int,width:int,height:int>>>>)"),
    })


def sanitized_pages(spark: SparkSession, d: str) -> DataFrame:
    """Those elements after the whole run."""
    return run.sanitize_pages(_laid_out(spark, d)).elements.select("page_id", F.col("elem_idx").cast("long").alias("elem_idx"), "tag", "text", "value")


def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The run's detections of each page, counted."""
    s = run.sanitize_pages(_laid_out(spark, d)).summaries
    return s.select("page_id", "total", F.col("by_type")["email"].alias("emails"), F.col("by_type")["password"].alias("passwords"), F.col("by_type")["face"].alias("faces"))


#: Elements of four kinds of page: (page, id, tag, role, label, placeholder, text, href, value, x, y).
PAGES = (
    ("shop", "q", "input", "", "", "Search", "", "", "", 300, 10), ("shop", "go", "button", "", "Search", "", "", "", "", 500, 10), ("shop", "vid", "a", "", "2M views", "", "", "/watch?v=1", "", 300, 200), ("shop", "side", "a", "", "Home", "", "", "", "", 10, 50),
    ("chat", "cs", "input", "", "", "Search or start new chat", "", "", "", 100, 50), ("chat", "row1", "div", "listitem", "Kim Lee", "", "", "", "", 100, 200), ("chat", "box", "div", "textbox", "", "Type a message", "", "", "", 600, 700),
    ("trip", "orig", "input", "", "", "From station", "", "", "", 100, 100), ("trip", "desti", "input", "", "", "To station", "", "", "", 300, 100), ("trip", "st", "button", "", "", "", "Search Trains", "", "", 500, 100),
    ("full", "orig", "input", "", "", "From station", "", "", "Ayr", 100, 100), ("full", "desti", "input", "", "", "To station", "", "", "Ems", 300, 100), ("full", "st", "button", "", "", "", "Search Trains", "", "", 500, 100),
    ("form", "other", "select", "", "Country", "", "", "", "", 100, 100), ("form", "sem", "select", "", "Semester", "", "", "", "", 100, 200), ("form", "ok", "button", "", "OK", "", "", "", "", 100, 300),
)
_KIM, _SAID = 'type: "kim" in search', "type: box is here [outcome: executed_and_sent]"
#: Proposed actions and what they become: (page, task, earlier actions, type, target, value, new type, new target, new value).
ACTIONS = (
    ("shop", "search shoes", (), "click", "go", None, "type", "q", "shoes"), ("shop", "search shoes and play the first video", (), "click", "vid", None, "click", "vid", None), ("shop", "search shoes", (), "done", None, None, "type", "q", "shoes"),
    ("shop", "search shoes", ("type: shoes",), "done", None, None, "done", None, None), ("shop", "search shoes and play the first", ("type: shoes",), "done", None, None, "click", "vid", None), ("shop", "search shoes", (), "type", "go", None, "type", "q", "shoes"),
    ("chat", "message Kim that box is here", (), "done", None, None, "type", "cs", "Kim"), ("chat", "message Kim that box is here", (_KIM,), "done", None, None, "click", "row1", None), ("chat", "message Kim that box is here", (_KIM, "click: row"), "click", "cs", None, "type", "box", "box is here"),
    ("chat", "message Kim that box is here", (_KIM, "click: row", _SAID), "click", "box", None, "done", None, None), ("trip", "book a train", (), "click", "st", None, "wait", None, None), ("trip", "book a train", ("fill_form: stations",), "ask_user", None, None, "click", "st", None),
    ("full", "book a train", (), "done", None, None, "click", "st", None), ("form", "select the 4th semester", (), "click", "ok", None, "select", "sem", "4th semester"), ("form", "select the 4th semester", ("select: x",), "click", "ok", None, "click", "ok", None),
    ("shop", "open the page", (), "click", "q", "x", "type", "q", "x"), ("none", "open the page", (), "click", "q", None, "click", "q", None),
)


def normalized_actions(spark: SparkSession, d: str) -> DataFrame:
    """Proposed actions on made-up pages after all passes; a request for each nation and case."""
    n = _table(spark, d, "nation").select("n_nationkey")
    one = lambda i, a: F.struct(
        F.lit(i).alias("k"), F.lit(a[0]).alias("page"), F.lit(a[1]).alias("task"), (F.lit(list(a[2])) if a[2] else F.expr("cast(array() as array<string>)")).alias("prior_actions"), F.lit(a[3]).alias("action_type"),
        F.lit(a[4]).cast("string").alias("target"), F.lit(a[5]).cast("string").alias("value"), F.lit("").alias("reasoning"),
    )
    acts = n.select("n_nationkey", F.inline(F.array(*[one(i, a) for i, a in enumerate(ACTIONS)]))).withColumn("request_id", F.col("n_nationkey").cast("long") * 100 + F.col("k"))
    made = F.array(*[F.struct(F.lit(i).alias("elem_idx"), *[F.lit(v).alias(c) for v, c in zip(e[:9], ("page", "element_id", "tag", "role", "label", "placeholder", "text", "href", "value"))], geo.box(F.lit(e[9]), F.lit(e[10]), F.lit(80), F.lit(20)).alias("bbox")) for i, e in enumerate(PAGES)])
    none = F.lit(None).cast("string")
    elements = acts.select("request_id", F.col("page").alias("_page")).select("*", F.inline(made)).where("page = _page").drop("page", "_page")
    elements = elements.withColumns({**{c: none for c in ("input_type", "name", "class_name", "widget_type")}, **{c: F.lit(False) for c in ("is_sidebar", "is_search_result", "is_playlist", "is_audio_record", "is_status", "is_content_editable")}})
    return chain.normalized(acts, elements).select("request_id", "action_type", "target", "value")


#: Texts and whether they can be a person's name.
NAME_CASES = (
    ("Meera Shah", True), ("Jo", False), ("Dr Brown", False), ("Room 12", False), ("Anne-Marie Lee", True), ("Ann and Bob", False), ("Sky View", False), ("Mon Ami", False), ("Brrr Grr", False), ("A... B... C...", False), ("Kim (Lee)", False), ("a@b", False),
)


def name_texts(spark: SparkSession, d: str) -> DataFrame:
    """Which texts can be names; a row for each nation and case."""
    rows = _table(spark, d, "nation").select("n_nationkey", F.posexplode(F.lit([t for t, _ in NAME_CASES])).alias("k", "text"))
    return rows.select("n_nationkey", F.col("k").cast("long").alias("k"), names.person_name(F.col("text")).alias("name"))


def found_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names, places and organisations in made-up texts, next to what a model found."""
    c = _table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("page_id"))
    text = F.when(F.col("page_id") % 3 == 0, "Dr. Ravi Kumar lives at 12 Green Street near Mumbai").when(F.col("page_id") % 3 == 1, "Name: Meera Shah").otherwise("Acme Solutions")
    rules = names.heuristic_entities(c.withColumn("text", text), ["page_id"])
    model = c.where("page_id % 2 = 0").select("page_id", F.lit("name").alias("type"), F.lit("Ravi Kumar").alias("text"), F.lit(0.9).alias("confidence"))
    return names.merged_entities(model, rules).select("page_id", "type", "text", "confidence")


def dictionary_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of a dictionary table in made-up texts."""
    c = _dealt(spark, d, "customer").select("c_custkey", F.concat(F.lit("for Kim"), F.lit(" and Ann Bell, not kim; row "), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, " Kim Ann").otherwise("")).alias("text"))
    names_ = spark.createDataFrame([("Kim", "given", 0.9), ("Ann", "common", 0.5)], "name string, rule string, confidence double")
    return detect.dictionary_names(c, ["c_custkey"], names_).select("c_custkey", "rule", "text", F.col("start").cast("long").alias("at"), "decision")


#: Words of a made-up invoice: (text, x, y, width); N stands for a number.
INVOICE = (
    ("Tax", 10, 10, 30), ("Invoice", 45, 12, 60), ("Name", 10, 100, 40), (":", 52, 101, 4), ("Date", 300, 100, 40), ("Mob", 10, 130, 30), ("No", 45, 131, 20), ("total", 10, 300, 40), ("mail", 10, 330, 40), ("kN@example.com", 60, 331, 150), ("Signature", 320, 470, 70),
)


def _invoice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _dealt(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("page_id"), F.lit(0).cast("long").alias("region_idx"))
    made = F.array(*[F.struct(F.lit(i).alias("word_idx"), F.lit(t).alias("form"), geo.box(F.lit(x), F.lit(y), F.lit(w), F.lit(14)).alias("bbox")) for i, (t, x, y, w) in enumerate(INVOICE)])
    text = F.when(F.col("word_idx") == 9, F.concat(F.lit("k"), F.col("page_id"), F.lit("@example.com"))).otherwise(F.col("form"))
    return c.select("*", F.inline(made)).withColumns({"text": text, "confidence": F.lit(0.9)}).drop("form"), c.withColumn("bbox", geo.box(F.lit(0), F.lit(0), F.lit(400), F.lit(500)))


def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of those words by where they stand."""
    words, _ = _invoice(spark, d)
    return reading.line_texts(reading.region_lines(words)).select("page_id", F.col("line_index").cast("long").alias("line_index"), "text", F.col("bbox")["x"].cast("long").alias("x"), F.col("bbox")["width"].cast("long").alias("width"))


def region_findings(spark: SparkSession, d: str) -> DataFrame:
    """What those words hold: a mail, the fields for name and phone, the signature, and the usual place of the device's number."""
    got = reading.region_findings(*_invoice(spark, d))
    return got.select("page_id", "type", "reason", "confidence", *[F.col("bbox")[c].cast("long").alias(c) for c in ("x", "y", "width", "height")])


def model_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of pages that a model for names would read."""
    b = _boxed(spark, d)
    e = b.select(
        "page_id", (F.col("n") * 1_000_000 + F.col("k")).alias("elem_idx"), F.when(F.col("k") % 4 == 0, "BUTTON").otherwise("p").alias("tag"), F.lit(None).cast("string").alias("role"), F.when(F.col("k") % 7 == 0, "top-nav").alias("class_name"), F.lit(False).alias("is_container"),
        F.when(F.col("k") % 11 == 0, F.repeat(F.lit("long "), F.lit(200))).when(F.col("k") % 5 == 0, " ab ").otherwise("some words").alias("text"), "bbox",
    )
    return names.model_items(names.name_items(e)).select("page_id", "elem_idx", "item_idx")


def placed_words(spark: SparkSession, d: str) -> DataFrame:
    """Recognised words back in the picture."""
    b = _boxed(spark, d)
    k = F.col("k")
    w = b.select(
        "page_id", F.col("n").alias("region_idx"), F.lit(0).alias("line_index"), k.alias("word_index"), F.when(k % 9 == 0, " ").otherwise(" word ").alias("text"), F.when(k % 8 > 0, k % 100).alias("confidence"), (k % 300).alias("x0"), (k % 200).alias("y0"),
        (k % 300 + 40).alias("x1"), (k % 200 + 15).alias("y1"), F.lit(2.0).alias("scale"), F.lit(100).alias("region_x"), F.lit(50).alias("region_y"),
    )
    got = fields.placed_words(w)
    return got.select("page_id", F.col("region_idx"), F.col("word_index"), "text", "confidence", *[F.col("bbox")[c].cast("long").alias(c) for c in ("x", "y", "width", "height")])


def region_texts(spark: SparkSession, d: str) -> DataFrame:
    """Words of regions read as lines, and the lines of a page under headers."""
    c = _table(spark, d, "conversations")
    w = c.select(F.col("conv_id").alias("page_id"), (F.col("turn") % 2).alias("region_idx"), F.lit(0).alias("line_index"), F.col("turn").alias("word_index"), F.col("turn").alias("word_idx"), F.concat(F.lit(" w"), F.col("turn")).alias("text"), F.when(F.col("turn") == 3, 0.01).otherwise(0.5).alias("confidence"))
    return fields.region_text(fields.read_words(w)).select("page_id", "raw_text")


def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Tasks as they are shown, and values without guidance."""
    c = _table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("open  "), "c_name", F.lit(" [STEP GUIDANCE: look] now"))).when(k == 1, F.lit("[only this]")).otherwise(F.concat(F.lit("[pos top] go "), "c_name"))
    return c.select("c_custkey", shown_task(raw).alias("shown"), without_guidance(raw).alias("value"))


def guarded_steps(spark: SparkSession, d: str) -> DataFrame:
    """What a loop's guards make of its actions."""
    e = _table(spark, d, "events")
    w = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1")
    kind = F.when(F.col("event_id") % 5 == 0, "done").when(F.col("event_id") % 2 == 0, "type").otherwise("click")
    s = e.select(
        F.col("user_id").alias("loop_id"), w.cast("long").alias("step"), kind.alias("action_type"), F.concat(F.lit("v"), F.col("event_id") % 3).alias("value"), F.concat(F.lit("t"), F.col("event_id") % 4).alias("target"), (F.col("event_id") % 3 == 0).alias("exec_success"),
        F.when(F.col("user_id") % 2 == 0, "search for red shoes").otherwise("play a song").alias("task"),
    )
    return history.guarded(s).select("loop_id", "step", "guard_type", "guard_value")


def strict_actions(spark: SparkSession, d: str) -> DataFrame:
    """Which actions have the exact form, and what a vault holds."""
    c = _table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey") % 4
    a = F.when(k == 0, '{"type": "click", "targetElementId": "b"}').when(k == 1, '{"type": "fly"}').when(k == 2, '{"type": "scroll", "scrollDirection": "left"}').otherwise('{"type": "wait", "extra": 1}')
    vault = agent.vault_with(F.create_map(F.lit("fullName"), F.col("c_name"), F.lit("city"), F.lit(" ")), F.lit("phone"), F.when(k < 2, F.lit("1")))
    return c.select("c_custkey", agent.valid_action(a).alias("valid"), F.array_join(agent.vault_keys(vault), ",").alias("keys"))


def queries() -> dict[str, Query]:
    found = (
        rule_spans, rule_samples, shown_dates, message_tasks, search_phrases, journeys, drafts, composed_lines, closed_pages, vault_values, feedback_errors, loop_replay, step_guidance, outcome_rules, patched_turns, responses, back_filled_answers,
        readable_regions, checked_redactions, face_boxes, part_boxes, picture_sizes, joined_boxes, detection_summary, shields, spread_values, document_kinds, sanitized_elements, reason_keys, text_helpers, field_types, column_headers,
        option_choices, element_targets, earlier_steps, stream_chunks, shown_elements, context_words, avatar_regions, sanitized_pages, run_summaries, normalized_actions, name_texts, found_entities, dictionary_names, read_lines, region_findings,
        model_texts, placed_words, region_texts, clean_texts, guarded_steps, strict_actions,
    )
    return {f.__name__: f for f in found}


def _quoted(v: str | bool | None) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(str(x) if isinstance(x, int) and not isinstance(x, bool) else _quoted(x) for x in r) + ')' for r in rows)}) v({names})"


_B = "b AS (SELECT l_orderkey AS page_id, l_linenumber::BIGINT AS n, l_partkey % 1100 AS x, l_suppkey % 700 AS y, 20 + l_partkey % 400 AS w, 12 + l_suppkey % 200 AS h, l_returnflag AS flag, l_partkey AS k, l_suppkey AS sk FROM lineitem)"
_STEPS = (
    "s AS (SELECT user_id AS loop_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, CASE WHEN event_id % 7 = 0 THEN 'done' WHEN event_id % 11 = 0 THEN 'ask_user' WHEN event_id % 2 = 0 THEN 'type' ELSE 'click' END AS action_type, "
    "event_id % 10 AS c, event_id % 13 <> 0 AS ok, event_id % 17 = 0 AS stop FROM events)"
)


def _grown(i: int) -> str:
    """A step of checked redactions: boxes grown once more where they are not clean yet."""
    r = lambda e: f"floor({e} + 0.5)"
    return (
        f"g{i} AS (SELECT page_id, n, k, x0, y0, w0, h0, CASE WHEN done THEN x ELSE greatest(0, {r('x - w * 0.125')}) END AS x, CASE WHEN done THEN y ELSE greatest(0, {r('y - h * 0.125')}) END AS y, "
        f"CASE WHEN done THEN w ELSE least(1280 - greatest(0, {r('x - w * 0.125')}), {r('w * 1.25')}) END AS w, CASE WHEN done THEN h ELSE least(800 - greatest(0, {r('y - h * 0.125')}), {r('h * 1.25')}) END AS h, "
        f"CASE WHEN done THEN e ELSE {i} END AS e, done OR {i} >= k % 5 AS done FROM g{i - 1})"
    )


def oracle_sql() -> dict[str, str]:
    contacts = _values([(i, who, said) for i, (_, who, said) in enumerate(TASKS)], "k, who, said")
    drafts_v = _values([(i, e, w, th) for i, (_, _, e, w, th) in enumerate(DRAFTS)], "k, echo, words, theme")
    kinds_v = _values([(i, kind) for i, (_, _, kind) in enumerate(DOCUMENT_TEXTS)], "k, kind")
    shown_v = _values([(i, tag, shown, before, container) for i, (tag, shown, before, container) in enumerate(SHOWN)], "k, tag, shown, before, container")
    unit = "greatest(0.0, least(1.0, {}))"
    face = lambda i, score, x1, y1, x2, y2: f"SELECT page_id, n, {i} AS i, {score} AS confidence, x, y, w, h, {unit.format(x1)} AS x1, {unit.format(y1)} AS y1, {unit.format(x2)} AS x2, {unit.format(y2)} AS y2 FROM b"
    reasons = _values(
        [("pan_card", 0, "document_shield:pan_card"), ("", 1, "phone"), ("", 2, "ocr_regex:ssn"), ("", 3, "regex:ip_address"), ("", 5, "own words"), ("", 7, "phone"), ("", 8, "holder_name"), ("", 9, "face")], "z, k, about"
    )
    return {
        "pii_summary": rules_sql.summary_sql(),
        "rule_spans": rules_sql.all_rules_sql(),
        "rule_samples": rules_sql.all_rules_sql(
            f"SELECT c_custkey * 100 + k AS doc_id, regexp_replace(form, 'N([^a-z]|$)', lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '\\1', 'g') AS t FROM customer, {_values(list(enumerate(SAMPLES)), 'k, form')}"
        ),
        "shown_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 5 = 3 THEN 'next week' ELSE strftime(o_orderdate::DATE + 1, '%d/%m/%Y') END AS shown FROM orders",
        "message_tasks": f"SELECT c_custkey, k::BIGINT AS k, replace(who, 'N', 'kim' || c_custkey) AS contact, replace(said, 'B', 'order ' || c_custkey || ' is ready') AS body FROM customer, {contacts}",
        "search_phrases": f"SELECT p_partkey, k::BIGINT AS k, lower(regexp_replace(p_name, '[^A-Za-z0-9 ]', '', 'g')) AS query FROM part, range({len(SEARCHES)}) r(k)",
        "journeys": "WITH m AS (SELECT n_nationkey, n_nationkey % 3 AS k, regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g') AS a FROM nation) SELECT n_nationkey, CASE WHEN k < 2 THEN a END AS a, CASE WHEN k <> 1 THEN 'Town' || n_nationkey END AS b, CASE k WHEN 0 THEN '12/05/2025' WHEN 1 THEN 'tomorrow' END AS day FROM m",
        "drafts": f"SELECT c_custkey, k::BIGINT AS k, echo, words, theme FROM customer, {drafts_v}",
        "composed_lines": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'first of ' || c_name || chr(10) || 'second line' ELSE 'Dear ' || c_name || chr(10) || 'first of ' || c_name || chr(10) || 'second line' || chr(10) || 'third line' || chr(10) || 'With love' END AS draft FROM customer",
        "closed_pages": "SELECT page_id, CASE page_id % 4 WHEN 3 THEN coalesce(url, '') = '' ELSE true END AS closed FROM pages",
        "vault_values": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE 'plain ' || c_name END AS value FROM customer",
        "feedback_errors": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'description missing' WHEN 1 THEN 'description too short' WHEN 2 THEN 'description too long' WHEN 3 THEN 'name too long' WHEN 4 THEN 'email invalid' END AS error FROM customer",
        "loop_replay": f"WITH {_STEPS}, r AS (SELECT *, CASE WHEN stop THEN 'cancelled' WHEN action_type IN ('done', 'ask_user') THEN action_type WHEN c < 4.5 THEN 'low_confidence' WHEN NOT ok THEN 'error' WHEN step >= 4 THEN 'max_steps' END AS stop_reason FROM s), "
        "f AS (SELECT loop_id, min(step) AS last FROM r WHERE stop_reason IS NOT NULL GROUP BY loop_id) SELECT r.loop_id, step, action_type, stop_reason FROM r LEFT JOIN f USING (loop_id) WHERE last IS NULL OR step <= last",
        "step_guidance": f"WITH {_STEPS}, f AS (SELECT loop_id, step, coalesce(bool_or(action_type = 'type') OVER w, false) AS searched, coalesce(bool_or(action_type = 'click' AND ok) OVER w, false) AS clicked, coalesce(bool_or(action_type = 'click') OVER w, false) AS contact_clicked, "
        "coalesce(bool_or(action_type = 'ask_user') OVER w, false) AS guided, lag(action_type) OVER (PARTITION BY loop_id ORDER BY step) AS previous_action FROM s WHERE step < 6 WINDOW w AS (PARTITION BY loop_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
        "SELECT * EXCLUDE (guided), CASE loop_id % 5 WHEN 0 THEN CASE WHEN clicked THEN 'login:check' WHEN guided THEN 'login:filled' ELSE 'login:ask' END WHEN 1 THEN CASE WHEN clicked THEN 'travel:check' ELSE 'travel:ask' END "
        "WHEN 2 THEN CASE WHEN contact_clicked THEN 'contact:write' WHEN searched OR coalesce(previous_action = 'type', false) THEN 'contact:open' ELSE 'contact:look' END WHEN 3 THEN 'search' ELSE 'other' END AS advice FROM f",
        "outcome_rules": "WITH t AS (SELECT conv_id AS session_id, turn AS turn_seq, CASE WHEN role = 'user' THEN 'type' ELSE 'click' END AS a, CASE (conv_id + turn) % 4 WHEN 2 THEN '/a' WHEN 3 THEN '/b' END AS u, CASE WHEN turn % 5 = 0 THEN 'failed' END AS o FROM conversations), "
        "n AS (SELECT *, lead(u) OVER w AS nu, lead(turn_seq) OVER w AS nt FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn_seq)) SELECT session_id, turn_seq, CASE WHEN o IS NOT NULL THEN o WHEN nt IS NULL THEN NULL WHEN nu <> u THEN 'navigation_success' WHEN a = 'type' THEN 'executed_and_sent' ELSE 'clicked_successfully' END AS outcome FROM n",
        "patched_turns": "SELECT conv_id AS session_id, turn AS turn_seq, CASE WHEN conv_id % 3 = 0 OR turn < max(turn) OVER (PARTITION BY conv_id) THEN 'old' WHEN conv_id % 3 = 2 THEN 'failed' WHEN role = 'user' THEN 'executed_and_sent' ELSE 'clicked_successfully' END AS outcome FROM conversations",
        "responses": "SELECT c_custkey, c_custkey % 5 IN (2, 4) AS failed, CASE c_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'type' WHEN 3 THEN 'click' END AS action_type, CASE c_custkey % 5 WHEN 0 THEN 'btn-' || c_custkey WHEN 1 THEN 'input-3' WHEN 3 THEN 'btn-' || c_custkey END AS target, "
        "CASE WHEN c_custkey % 5 = 1 THEN 'v' || c_custkey END AS value, CASE c_custkey % 5 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 3 THEN 1.0::DOUBLE END AS confidence FROM customer",
        "back_filled_answers": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'because' WHEN c_custkey % 3 = 1 THEN 'Target: in-' || c_custkey || ' — because' ELSE 'Target: in-' || c_custkey || ' | Value: \"' || c_name || '\" — because' END AS why, 'because' AS message, 'because' AS thinking FROM customer",
        "readable_regions": f"WITH {_B} SELECT page_id, n, w >= 60 AND h >= 25 AND k % 7 <> 0 AND (k % 5 = 0 OR (k % 5 <> 1 AND NOT (w < 140 AND h < 140 AND abs(w - h) < 25))) AS readable, least(w, h) >= 25 AND w >= 50 AND greatest(w, h) / least(w, h) <= 8 AS crop, "
        "k % 9 = 0 OR (w >= 16 AND h >= 16 AND w / h BETWEEN 0.16 AND 6.0) AS faces FROM b",
        "checked_redactions": f"WITH {_B}, g0 AS (SELECT page_id, n, k, x AS x0, y AS y0, w AS w0, h AS h0, x, y, least(w, 1280 - x) AS w, least(h, 800 - y) AS h, 0 AS e, 0 >= k % 5 AS done FROM b), {', '.join(_grown(i) for i in (1, 2, 3))} "
        "SELECT page_id, n, (CASE WHEN done AND e > 0 THEN x ELSE x0 END)::BIGINT AS x, (CASE WHEN done AND e > 0 THEN y ELSE y0 END)::BIGINT AS y, (CASE WHEN done AND e > 0 THEN w ELSE w0 END)::BIGINT AS width, (CASE WHEN done AND e > 0 THEN h ELSE h0 END)::BIGINT AS height, done AS passed, e::BIGINT AS expansions FROM g3",
        "face_boxes": f"WITH {_B}, f AS ({face(0, 'k % 10 / 10.0', 0.25, -0.5, 0.75, 0.5)} UNION ALL {face(1, '0.5', 0.5, 0.5, 'k % 4 / 2.0', 2.0)}), "
        "r AS (SELECT page_id, n, i, confidence, floor(x + x1 * w + 0.5) AS rx, floor(y + y1 * h + 0.5) AS ry, floor((x2 - x1) * w + 0.5) AS rw, floor((y2 - y1) * h + 0.5) AS rh FROM f WHERE confidence >= 0.45 AND x2 > x1 AND y2 > y1) "
        "SELECT page_id, n, greatest(0, rx - floor(rw * 0.15 + 0.5))::BIGINT AS x, greatest(0, ry - floor(rh * 0.2 + 0.5))::BIGINT AS y, (rw + 2 * floor(rw * 0.15 + 0.5))::BIGINT AS width, (rh + 2 * floor(rh * 0.2 + 0.5))::BIGINT AS height, "
        "confidence::DOUBLE AS confidence FROM r WHERE rw >= 6 AND rh >= 6",
        "part_boxes": f"WITH {_B}, s AS (SELECT *, k % 6 AS s, k % 6 + 4 AS e FROM b) SELECT page_id, n, (x + floor((greatest(2, s) - 2) * w / 8.0 + 0.5))::BIGINT AS x, greatest(2, floor((least(10, e) - greatest(2, s)) * w / 8.0 + 0.5))::BIGINT AS width, 1::BIGINT AS tokens, "
        "(x + floor(s * w / 40.0 + 0.5))::BIGINT AS line_x, least(greatest(20, floor(4 * w / 40.0 + 0.5)), x + w - (x + floor(s * w / 40.0 + 0.5)))::BIGINT AS line_width, least(h, 40)::BIGINT AS line_height FROM s",
        "picture_sizes": f"WITH {_B}, p AS (SELECT *, floor((k % 3000 + 200) / 1.5 + 0.5) AS cw, floor((k % 1700 + 150) / 1.5 + 0.5) AS ch, greatest(k % 3000 + 200, k % 1700 + 150)::DOUBLE AS m FROM b), q AS (SELECT *, least(1.0, 1152.0 / greatest(cw, ch)) AS s FROM p) "
        "SELECT page_id, n, greatest(1, floor(cw * s + 0.5))::BIGINT AS width, greatest(1, floor(ch * s + 0.5))::BIGINT AS height, round(CASE WHEN m < 500 THEN least(2.0, 900 / m) WHEN m > 2000 THEN 2000 / m ELSE 1.0 END, 6) AS scale, greatest(0, x - 3)::BIGINT AS pad_x, greatest(0, y - 3)::BIGINT AS pad_y, "
        "(least(x + w + 3, 1200) - greatest(0, x - 3))::BIGINT AS pad_width, (least(y + h + 3, 700) - greatest(0, y - 3))::BIGINT AS pad_height, abs((k % 3000 + 200) / 1000::DOUBLE - (k % 1700 + 150) / 600::DOUBLE) > 0.1 AS mismatch FROM q",
        "joined_boxes": f"WITH {_B} SELECT page_id, min(x)::BIGINT AS x, min(y)::BIGINT AS y, (max(x + w) - min(x))::BIGINT AS width, (max(y + h) - min(y))::BIGINT AS height FROM b GROUP BY page_id",
        "detection_summary": f"WITH {_B} SELECT page_id, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (WHERE k % 3 = 0), '') AS redactions, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (WHERE k % 3 = 1), '') AS reviews, count(*) AS total, nullif(count(*) FILTER (WHERE k % 2 = 0), 0) AS emails, nullif(count(*) FILTER (WHERE flag = 'A'), 0) AS from_a FROM b GROUP BY page_id",
        "shields": f"WITH {_B}, a AS (SELECT page_id, CASE WHEN k % 4 = 0 THEN 40 ELSE 1000 END AS ah, k % 2 = 0 AS av FROM b WHERE n = 1), "
        "c AS (SELECT page_id, x, y, w, h, k, CASE WHEN k % 6 = 0 THEN 'aadhaar' WHEN k % 6 = 1 THEN 'pan' WHEN k % 31 = 0 THEN 'identity_document' ELSE 'email' END AS type FROM b), "
        "m AS (SELECT page_id, bool_or(type = 'aadhaar' OR k % 11 = 0) AS aa, bool_or(type = 'pan') AS pa, bool_or(type = 'identity_document') AS id FROM a JOIN c USING (page_id) WHERE ah >= 50 AND x + w <= 1615 AND y + h <= ah + 15 GROUP BY page_id) "
        "SELECT page_id, 'identity_document' AS type, 1.0::DOUBLE AS confidence, CASE WHEN aa THEN 'document_shield:aadhaar_card' ELSE 'document_shield:pan_card' END AS reason FROM m WHERE (aa OR pa) AND NOT id "
        "UNION ALL SELECT page_id, 'face', 0.85::DOUBLE, 'avatar_shield' FROM a WHERE av AND NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = a.page_id AND k % 5 <> 0 AND w > 300 AND 800 BETWEEN x - 5 AND x + w + 5 AND ah / 2.0 BETWEEN y - 5 AND y + h + 5)",
        "spread_values": "WITH o AS (SELECT o_custkey AS page_id, o_orderkey AS k FROM orders), v AS (SELECT page_id, 'identifier' AS kind, 'id' || k AS value FROM o WHERE k % 3 = 0 AND k % 4 <> 0 AND 0.75 + (k % 4) / 20.0 >= 0.8 AND length('id' || k) >= 4 "
        "UNION SELECT page_id, 'name', 'Kim ' || k FROM o WHERE k % 3 = 2 AND k % 4 <> 0 AND 0.75 + (k % 4) / 20.0 >= 0.8 UNION SELECT page_id, 'identifier', 'row id' || k || ' Kim ' || k FROM o WHERE k % 5 = 0 AND length('row id' || k || ' Kim ' || k) BETWEEN 6 AND 25 "
        "UNION SELECT page_id, 'name', 'row id' || k || ' Kim ' || k FROM o WHERE k % 5 = 1 AND length('row id' || k || ' Kim ' || k) <= 40) SELECT o.page_id, k + 1000000 AS elem_idx, kind, value FROM o JOIN v ON o.page_id = v.page_id AND contains('row id' || k || ' Kim ' || k, value)",
        "document_kinds": f"SELECT n_nationkey, k::BIGINT AS k, CASE WHEN n_nationkey % 2 = 0 THEN kind END AS kind FROM nation, {kinds_v}",
        "sanitized_elements": f"WITH {_B}, r AS (SELECT page_id, x, y FROM b WHERE n = 2), e AS (SELECT b.*, EXISTS (SELECT 1 FROM r WHERE r.page_id = b.page_id AND b.x < r.x + 500 AND b.x + b.w > r.x AND b.y < r.y + 300 AND b.y + b.h > r.y) AS hit FROM b) "
        "SELECT page_id, (n * 1000000 + k) * 100000 + sk AS elem_idx, CASE WHEN hit THEN '[REDACTED]' ELSE flag END AS text, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN CASE WHEN hit OR k % 4 = 0 OR k % 6 = 0 THEN '[REDACTED]' ELSE flag END END AS value, "
        "CASE WHEN k % 3 = 0 THEN 'type' WHEN k % 3 = 1 THEN 'click' ELSE 'read' END AS interaction_type, CASE WHEN k % 3 = 0 THEN k % 2 = 0 END AS has_value FROM e",
        "reason_keys": f"SELECT n_nationkey, k::BIGINT AS k, about FROM nation, {reasons} UNION ALL SELECT n_nationkey, 4, CASE n_nationkey % 3 WHEN 0 THEN 'checksum' WHEN 1 THEN 'checksum_verhoeff' ELSE 'checksum_luhn' END FROM nation UNION ALL SELECT n_nationkey, 6, CASE n_nationkey % 3 WHEN 0 THEN 'face' ELSE 'personal_data' END FROM nation",
        "text_helpers": "SELECT c_custkey, '[REDACTED: NAME] is a [REDACTED: ROLE], [REDACTED: NAME]' AS masked, 'e_' || CASE WHEN length(c_custkey::VARCHAR) >= 4 THEN c_custkey::VARCHAR ELSE lpad(c_custkey::VARCHAR, 4, '0') END AS id, CASE WHEN c_custkey % 2 = 0 THEN 'credit_card' ELSE 'user_name' END AS word FROM customer",
        "field_types": "SELECT c_custkey AS page_id, CASE c_custkey % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'phone' WHEN 2 THEN 'creditCard' WHEN 3 THEN 'username' ELSE 'email' END AS type, CASE c_custkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN c_custkey % 7 = 4 THEN '[MASKED VALUE]' ELSE '' END AS text FROM customer WHERE c_custkey % 7 < 5",
        "column_headers": f"WITH {_B}, c AS (SELECT page_id, n, k % 350 AS x FROM b) SELECT DISTINCT page_id AS table_id, n AS cell_id, x, CASE WHEN x + 10 <= 104 THEN 'h0' WHEN x + 10 <= 204 THEN 'h1' WHEN x + 10 <= 304 THEN 'h2' WHEN n <= 2 THEN 'h' || n END AS header FROM c",
        "option_choices": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 END::BIGINT AS chosen, 'abc ' || c_name AS suggested FROM customer",
        "element_targets": "SELECT o_orderkey AS request_id, CASE o_custkey % 3 WHEN 0 THEN (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 2) WHEN 1 THEN (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) END::BIGINT AS elem_idx FROM orders",
        "earlier_steps": "SELECT n_nationkey, k < 4 AS searched, k IN (1, 2, 3) AS clicked, k = 2 AS sent, k <> 3 AS typed FROM (SELECT n_nationkey, n_nationkey % 5 AS k FROM nation)",
        "shown_elements": f"SELECT n_nationkey::BIGINT AS page_id, k::BIGINT AS elem_idx, tag, shown, replace(before, 'N', n_nationkey::VARCHAR) AS prev_text, container FROM nation, {shown_v}",
        "context_words": f"SELECT n_nationkey::BIGINT AS page_id, k::BIGINT AS elem_idx, CASE WHEN tag <> 'input' THEN replace(before, 'N', n_nationkey::VARCHAR) END AS context FROM nation, {shown_v} WHERE shown",
        "avatar_regions": "SELECT n_nationkey::BIGINT AS page_id, 'region_1' AS region_id, 'img' AS tag, 'u.png' AS src, true AS is_avatar, 0.98::DOUBLE AS avatar_confidence, 'avatar_keywords' AS avatar_reason, 1600::BIGINT AS area FROM nation",
        "sanitized_pages": "SELECT c_custkey::BIGINT AS page_id, k::BIGINT AS elem_idx, CASE k WHEN 0 THEN 'h1' WHEN 3 THEN 'input' WHEN 4 THEN 'img' ELSE 'p' END AS tag, CASE k WHEN 0 THEN 'mail to kim' || c_custkey || '@example.com' WHEN 1 THEN '[REDACTED]' WHEN 2 THEN 'plain words of no one' END AS text, CASE WHEN k = 3 THEN '[REDACTED]' END AS value FROM customer, range(5) r(k)",
        "run_summaries": "SELECT c_custkey::BIGINT AS page_id, 3::BIGINT AS total, 1::BIGINT AS emails, 1::BIGINT AS passwords, 1::BIGINT AS faces FROM customer",
        "normalized_actions": f"SELECT n_nationkey::BIGINT * 100 + k AS request_id, action_type, target, value FROM nation, {_values([(i, *a[6:]) for i, a in enumerate(ACTIONS)], 'k, action_type, target, value')}",
        "name_texts": f"SELECT n_nationkey, k::BIGINT AS k, name FROM nation, {_values([(i, ok) for i, (_, ok) in enumerate(NAME_CASES)], 'k, name')}",
        "found_entities": "WITH c AS (SELECT c_custkey::BIGINT AS page_id FROM customer) SELECT page_id, 'name' AS type, 'Ravi Kumar' AS text, 0.9::DOUBLE AS confidence FROM c WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'name', 'Dr. Ravi Kumar', 0.85 FROM c WHERE page_id % 3 = 0 AND page_id % 2 = 1 "
        "UNION ALL SELECT page_id, 'location', '12 Green Street', 0.8 FROM c WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'location', 'Mumbai', 0.78 FROM c WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'name', 'Meera Shah', 0.85 FROM c WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'organization', 'Acme Solutions', 0.25 FROM c WHERE page_id % 3 = 2",
        "dictionary_names": "SELECT c_custkey, 'given' AS rule, 'Kim' AS text, 4::BIGINT AS at, 'REDACT' AS decision FROM customer UNION ALL SELECT c_custkey, 'common', 'Ann Bell', 12, 'REVIEW' FROM customer UNION ALL SELECT c_custkey, 'given', 'Kim Ann', 36 + length(c_custkey::VARCHAR), 'REDACT' FROM customer WHERE c_custkey % 2 = 0",
        "read_lines": f"SELECT c_custkey::BIGINT AS page_id, k::BIGINT AS line_index, replace(t, 'N@', c_custkey || '@') AS text, x::BIGINT AS x, w::BIGINT AS width FROM customer, {_values([(0, 'Tax Invoice', 10, 95), (1, 'Name : Date', 10, 330), (2, 'Mob No', 10, 55), (3, 'total', 10, 40), (4, 'mail kN@example.com', 10, 200), (5, 'Signature', 320, 70)], 'k, t, x, w')}",
        "region_findings": "WITH c AS (SELECT c_custkey::BIGINT AS page_id FROM customer) SELECT page_id, type, reason, confidence::DOUBLE AS confidence, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS width, h::BIGINT AS height FROM c, (VALUES ('email', 'ocr_regex:email', 1.0, 60, 331, 150, 14), "
        "('name', 'form_field_anchor:name', 0.98, 60, 97, 160, 26), ('phone', 'form_field_anchor:phone', 0.98, 69, 127, 180, 26), ('device_id', 'form_field_anchor:imei_slot', 0.96, 112, 235, 200, 28), ('signature', 'form_field_anchor:signature', 0.95, 290, 420, 104, 58)) v(type, reason, confidence, x, y, w, h)",
        "model_texts": f"WITH {_B}, e AS (SELECT page_id, n * 1000000 + k AS elem_idx, CASE WHEN k % 11 = 0 THEN 1000 WHEN k % 5 = 0 THEN 2 ELSE 10 END AS size FROM b WHERE k % 4 <> 0 AND k % 7 <> 0), i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY elem_idx) AS item_idx FROM e WHERE size > 3) SELECT page_id, elem_idx, item_idx FROM i WHERE item_idx <= 6 AND size <= 512",
        "placed_words": f"WITH {_B} SELECT page_id, n AS region_idx, k AS word_index, 'word' AS text, (CASE WHEN k % 8 > 0 THEN k % 100 ELSE 80 END / 100)::DOUBLE AS confidence, (100 + floor((k % 300 - 30) / 2.0 + 0.5))::BIGINT AS x, (50 + floor((k % 200 - 30) / 2.0 + 0.5))::BIGINT AS y, 20::BIGINT AS width, 8::BIGINT AS height FROM b WHERE k % 9 <> 0 AND (k % 8 = 0 OR k % 100 > 5)",
        "region_texts": "WITH w AS (SELECT conv_id AS page_id, turn % 2 AS r, string_agg('w' || turn, ' ' ORDER BY turn) AS t FROM conversations WHERE turn <> 3 GROUP BY ALL) SELECT page_id, string_agg('[region ' || r || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY r) AS raw_text FROM w GROUP BY page_id",
        "clean_texts": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'open ' || c_name || ' now' WHEN 1 THEN '[only this]' ELSE 'go ' || c_name END AS shown, CASE c_custkey % 3 WHEN 0 THEN 'open  ' || c_name || '  now' WHEN 1 THEN '[only this]' ELSE '[pos top] go ' || c_name END AS value FROM customer",
        "guarded_steps": "WITH s AS (SELECT user_id AS loop_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, CASE WHEN event_id % 5 = 0 THEN 'done' WHEN event_id % 2 = 0 THEN 'type' ELSE 'click' END AS a, 'v' || (event_id % 3) AS v, 't' || (event_id % 4) AS t, event_id % 3 = 0 AS ok, user_id % 2 = 0 AS search FROM events), "
        "g AS (SELECT s.*, EXISTS (SELECT 1 FROM s p WHERE p.loop_id = s.loop_id AND p.step < s.step AND p.a = 'type' AND p.v = s.v AND p.ok) AS sent, EXISTS (SELECT 1 FROM s p WHERE p.loop_id = s.loop_id AND p.step < s.step AND p.a = 'click' AND p.t = s.t) AS clicked, "
        "EXISTS (SELECT 1 FROM s p WHERE p.loop_id = s.loop_id AND p.step < s.step AND p.a = 'type' AND p.ok) AS typed FROM s), r AS (SELECT *, CASE WHEN a = 'done' AND search AND step = 0 THEN 'continue' WHEN a = 'type' AND sent THEN 'done' WHEN a = 'click' AND clicked AND NOT typed AND search THEN 'type' ELSE a END AS guard_type FROM g) "
        "SELECT loop_id, step, guard_type, CASE WHEN guard_type = 'type' AND a = 'click' THEN 'red shoes' ELSE v END AS guard_value FROM r",
        "strict_actions": "SELECT c_custkey, c_custkey % 4 = 0 AS valid, CASE WHEN c_custkey % 4 < 2 THEN 'fullName,phone' ELSE 'fullName' END AS keys FROM customer",
        "stream_chunks": "SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS raw FROM conversations GROUP BY conv_id",
    }
