"""The run over whole pages, spreading by pieces, detectors that fail, and pixels."""

import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shroudlake.operators import detect, fuse, names, propagate, regions, sanitize, whole
from shroudlake.plans import catalog, flows, more
from shroudlake.sources import pictures, tables

BOX = "struct<x:int,y:int,width:int,height:int>"
TOKEN = f"array<struct<id:string,text:string,start:int,end:int,bbox:{BOX},boxes:array<{BOX}>>>"
ELEMENT = f"page_id long, elem_idx int, tag string, text string, label string, value string, input_type string, is_header boolean, bbox {BOX}, tokens {TOKEN}"


def page(spark):
    words = [("t0", "Dear", 0, 4, (10, 10, 40, 20), [(10, 10, 40, 20)]), ("t1", "Dr.", 5, 8, (60, 10, 30, 20), [(60, 10, 30, 20)]), ("t2", "Ravi", 9, 13, (100, 10, 40, 20), [(100, 10, 40, 20)]), ("t3", "Kumar", 14, 19, (150, 10, 50, 20), [(150, 10, 50, 20)])]
    rows = [
        (1, 0, "p", "Dear Dr. Ravi Kumar", None, None, None, False, (10, 10, 190, 20), words),
        (1, 1, "p", "mail kim22@example.com today", None, None, None, False, (10, 60, 300, 20), None),
        (1, 2, "p", "nothing of interest", None, None, None, False, (10, 400, 300, 20), None),
        (1, 3, "input", None, "password", "hunter2", "password", False, (10, 450, 100, 20), None),
        (1, 4, "p", "user hunter2 again", None, None, None, False, (10, 500, 300, 20), None),
        (2, 0, "p", "call a@b.org", None, None, None, False, (10, 10, 300, 20), None),
        (9, 0, "p", "no viewport x@y.org", None, None, None, False, (10, 10, 300, 20), None),
    ]
    none = F.lit(None).cast("string")
    elements = spark.createDataFrame(rows, ELEMENT).withColumns({**{n: none for n in ("autocomplete", "name", "id", "class_name", "placeholder", "alt", "href", "role")}, **{n: F.lit(False) for n in ("block_child", "is_avatar", "is_sensitive")}, "avatar_confidence": F.lit(0.9)})
    views = spark.createDataFrame([(1, 1280, 800, 2560, 1600), (2, 1000, 800, 2000, 800)], "page_id long, css_w int, css_h int, shot_w int, shot_h int")
    regs = spark.createDataFrame(
        [(1, 1, "CANVAS", (600, 100, 300, 200), 60000, False, None), (1, 2, "IMG", (1200, 10, 40, 40), 1600, True, 0.98), (1, 3, "IMG", (1100, 10, 40, 40), 1600, True, 0.98)], f"page_id long, region_idx long, tag string, bbox {BOX}, area long, is_avatar boolean, avatar_confidence double"
    )
    said = ["Aadhaar", "2341", "2341", "2346"]
    words = spark.createDataFrame([(1, 1, i, t, 0.9, (1220 + 90 * i, 250, 80, 30)) for i, t in enumerate(said)], f"page_id long, region_idx long, word_idx long, text string, confidence double, bbox {BOX}")
    faces = spark.createDataFrame([(1, 2, [0.0, 0.9], [0.2, 0.2, 0.8, 0.8]), (1, None, [0.0, 0.9], [0.9, 0.9, 0.95, 0.99])], "page_id long, region_idx long, scores array<float>, boxes array<float>")
    return elements, views, regs, words, faces


def test_whole_run(spark):
    out = whole.whole_run(*page(spark))
    c = out.candidates.collect()
    kinds = {(r.source, r.type) for r in c if r.page_id == 1}
    assert kinds >= {("dom", "email"), ("dom", "password"), ("ocr", "aadhaar"), ("ocr", "identity_document"), ("vision", "face"), ("avatar_shield", "face"), ("ner", "name")} and {r.page_id for r in c} == {1, 2}
    place = lambda r: tuple(r.bbox)
    named = [place(r) for r in c if r.source == "ner" and r.type == "name" and r.text == "Dr. Ravi Kumar"]
    assert named == [(120, 20, 280, 40)]  # the union of its words, at twice the size
    assert [place(r) for r in c if r.source == "avatar_shield"] == [(2200, 20, 80, 80)]
    assert {place(r) for r in c if r.reason.startswith("document_shield:")} == {(1200, 200, 600, 400)}
    assert sum(r.source == "vision" for r in c) == 2
    assert [r.cand_seq for r in c if r.page_id == 1].sort() == list(range(1, 1 + sum(r.page_id == 1 for r in c))).sort()
    order = [r.source for r in sorted((r for r in c if r.page_id == 1), key=lambda r: r.cand_seq)]
    rank = {"dom": 0, "ocr": 1, "ocr_document_shield": 1, "vision": 2, "avatar_shield": 2, "ner": 3}
    assert order == sorted(order, key=rank.__getitem__)
    found = out.detections.where("page_id = 1").collect()
    assert sum(len(r.members) for r in found) == sum(r.page_id == 1 for r in c)  # each candidate is in one detection
    card = [r for r in found if r.type == "identity_document"]
    assert len(card) == 1 and card[0].decision == "REDACT"
    clean = {(r.page_id, r.elem_idx): r for r in out.elements.collect()}
    assert clean[1, 1].text == clean[1, 0].text == "[REDACTED]" and clean[1, 2].text == "nothing of interest" and clean[1, 3].value == "[REDACTED]" and clean[1, 4].text == "[REDACTED]"
    paint = [tuple(r.bbox) for r in out.redactions.where("type = 'identity_document'").collect()]
    assert paint == [(1197, 197, 606, 406)]
    assert [tuple(r) for r in out.warnings.collect()] == [(2, "axes are scaled differently")]
    assert {r.page_id for r in out.summaries.collect()} == {1, 2}


def test_model_findings_shut_out_rules(spark):
    elements, views, *_ = page(spark)
    seen = whole.on_picture(elements, whole.scales(views), "bbox", tokens="tokens").withColumns({"class_name": F.lit(""), "is_container": F.lit(False)})
    model = spark.createDataFrame([(1, 1, "name", "Ravi Kumar", 9, 19, 0.97)], "page_id long, item_idx long, type string, text string, start int, end int, confidence double")
    c = whole.name_candidates(seen, None, model).where("type = 'name'").collect()
    assert [(r.text, r.reason, tuple(r.bbox)) for r in c] == [("Ravi Kumar", "model", (200, 20, 200, 40))]


def test_values_spread_as_if_all_were_compared(spark):
    r = np.random.default_rng(3)
    letters = list("ab1é ")
    texts = [(int(r.integers(0, 4)), i, "".join(r.choice(letters, int(r.integers(0, 30))))) for i in range(300)] + [(1, 900, None), (2, 901, "")]
    values = [(int(r.integers(0, 4)), str(r.choice(["name", "identifier"])), "".join(r.choice(letters, int(r.integers(1, 8))))) for _ in range(150)] + [(1, "name", "")]
    e = spark.createDataFrame(texts, "page_id long, elem_idx int, text string")
    v = spark.createDataFrame(values, "page_id long, kind string, value string")
    got = [tuple(x) for x in propagate.holders(v, e).collect()]
    want = {(p, i, k, x) for p, i, t in texts for q, k, x in values if p == q and t and x and x in t}
    assert set(got) == want and len(got) == len(want) > 100


def test_many_values_on_one_page(spark):
    e = spark.range(5000).select(F.lit(1).cast("long").alias("page_id"), F.col("id").cast("int").alias("elem_idx"), F.concat(F.lit("user u"), F.col("id") * 7919, F.lit("x signed in")).alias("text"))
    v = spark.range(5000).select(F.lit(1).cast("long").alias("page_id"), F.lit("identifier").alias("kind"), F.concat(F.lit("u"), F.col("id") * 7919, F.lit("x")).alias("value"))
    assert propagate.holders(v, e).count() == 5000


def test_a_failing_detector_leaves_the_others_alone(spark):
    df = spark.createDataFrame([(1, "mail a@b.org id 77"), (2, "boom"), (3, None), (4, "id 5")], "doc_id long, text string")

    def ids(text, ctx):
        if "boom" in text:
            raise RuntimeError("broken")
        return [{"type": "own_id", "start": text.index("id "), "end": text.index("id ") + 4, "confidence": 0.8}] if "id " in text else None

    found = detect.Detectors().add_function("ids", ids).add_function("odd", lambda text, ctx: [{"start": 0, "end": 999}] if text.startswith("id") else []).add_function("", ids).add_function("none", None)
    good, bad = found.run(df, ["doc_id"])
    rows = {(r.doc_id, r.detector, r.type, r.text, r.decision) for r in good.collect()}
    assert rows >= {(1, "ids", "own_id", "id 7", "REDACT"), (4, "ids", "own_id", "id 5", "REDACT"), (1, "built_in", "email", "a@b.org", "REDACT")} and not [x for x in rows if x[0] in (2, 3)]
    assert {(r.doc_id, r.detector, r.warning.split(":")[0]) for r in bad.collect()} == {(2, "ids", "RuntimeError"), (4, "odd", "not a match")}
    plain, none = detect.Detectors().run(df, ["doc_id"])
    assert none.count() == 0 and {r.detector for r in plain.collect()} == {"built_in"}


def packed(image, colour, filters):
    """A PNG of an array (height, width, samples), its lines filtered in turn."""
    height, width, n = image.shape
    out, above = bytearray(), np.zeros(width * n, int)
    for y in range(height):
        line, kind = image[y].reshape(-1).astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(n, int), line[:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        if kind == 4:
            p = left + above - corner
            pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        else:
            guess = (0 * line, left, above, (left + above) // 2)[kind]
        out += bytes([kind]) + bytes(((line - guess) % 256).astype(np.uint8))
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(out))[:7]) + chunk(b"IDAT", zlib.compress(bytes(out))[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour, n", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_pixels_of_pictures(colour, n):
    image = np.random.default_rng(colour).integers(0, 256, (11, 7, n))
    for filters in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        got = pictures.pixels(packed(image, colour, filters))
        want = image if n in (3, 4) else np.concatenate([image[..., :1]] * 3, -1)
        assert (got[..., :3] == want[..., :3]).all() and (got[..., 3] == (image[..., -1] if n in (2, 4) else 255)).all()
    data = packed(image, colour, [1])
    assert pictures.pixels(data[:40]) is None and pictures.pixels(b"GIF89a") is None and pictures.pixels(None) is None and pictures.pixels(data.replace(b"\x08" + bytes([colour]), b"\x10" + bytes([colour]))) is None


def test_redactions_are_checked_on_the_picture(spark):
    image = np.full((80, 100, 3), 200)
    image[10:30, 10:50] = 0
    rows = [(1, bytearray(packed(image, 2, [4, 1, 2])), [(10, 10, 40, 20), (12, 12, 20, 10), (40, 40, 10, 10), (30, 20, 24, 12), (200, 5, 5, 5)]), (2, bytearray(b"no picture"), [(0, 0, 5, 5)]), (3, None, [(0, 0, 5, 5)]), (4, bytearray(b""), None)]
    df = spark.createDataFrame(rows, f"page_id long, content binary, boxes array<{BOX}>")
    flagged = df.select("page_id", "boxes", pictures.clean_flags(F.col("content"), F.col("boxes")).alias("flags"))
    each = flagged.select("page_id", F.posexplode(F.arrays_zip("boxes", "flags")).alias("k", "z"))
    got = {(r.page_id, r.k): r.v for r in each.select("page_id", "k", regions.verified(F.col("z.boxes"), F.lit(100), F.lit(80), F.coalesce(F.col("z.flags"), F.array().cast("array<boolean>"))).alias("v")).collect()}
    assert [got[1, k] and got[1, k].passed for k in range(4)] == [True, True, False, False] and got[1, 0].expansions == 0
    assert got[2, 0].passed is False and got[3, 0].passed is False
    flags = flagged.where("page_id = 1").first().flags
    for b, own in zip(rows[0][2], flags):
        at = b
        for flag in own:
            x, y = max(0, min(at[0], 99)), max(0, min(at[1], 79))
            assert flag == bool((image[y : y + max(0, min(at[3], 80 - y)), x : x + max(0, min(at[2], 100 - x))] == 0).all())
            at = pictures.grown((x, y, min(at[2], 100 - x), min(at[3], 80 - y)), 100, 80)


def test_a_model_for_names_reads_in_lots(spark):
    def load():
        def model(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("broken")
            return [[{"entity_group": g, "word": w, "score": s} for g, w, s in (("PER", "Ravi", 0.9), ("PER", "Kim", 0.5), ("ORG", "Acme", 0.9), ("MISC", "x", 0.9), ("LOC", "Pune", 0.7)) if w in t] for t in texts]

        return model

    texts = ["Ravi of Acme", "boom Ravi", "Kim lives in Pune", "nothing here", None, "Ravi " * 200]
    elements = spark.createDataFrame([(k // 6 + 1, k, "p", None, None, False, texts[k % 6], (0, 0, 10, 10)) for k in range(12)], f"page_id long, elem_idx int, tag string, role string, class_name string, is_container boolean, text string, bbox {BOX}")
    got = sorted(tuple(r) for r in names.read_by_model(names.name_items(elements), load, batch=3).collect())
    one = [(1, "name", "Ravi", 0, 4, 0.9), (1, "organization", "Acme", 8, 12, 0.9 * 0.35), (3, "location", "Pune", 13, 17, 0.7)]
    assert got == [(page, *x) for page in (1, 2) for x in one]


def test_a_word_with_a_line_break_stays_one_name(spark, tmp_path):
    spark.createDataFrame([(1, 1, "user", "Ndes.\nTo hain the"), (1, 2, "user", "ab cd"), (2, 1, "user", "ab cd\nto")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in flows.booked_journeys(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, None, "Khain", "2/05/2025"), (1, 2, "Kab", "Kcd", "3/05/2025"), (2, 1, "Kab", None, "2/05/2025")}


def test_references_without_a_semicolon(spark, tmp_path):
    html = '<div><h1>a &amp;&amp;&amp</h1><p>x &copy; &#65 &#66; &</p><a href="?a=1&b=2">go</a></div>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    read = lambda loose: {r["tag"]: r["text"] for r in tables.elements(pages, loose).collect()}
    assert read(True) == {"div": "", "h1": "a &&&", "p": "x \u00a9 A B &", "a": "go"}
    assert read(False) == {"div": "", "h1": "a &&&amp", "p": "x \u00a9 &#65 B &", "a": "go"}
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["tag"]: r["text"] for r in catalog.page_elements(spark, str(tmp_path)).collect()}
    assert got == read(False)


def test_summaries_join_by_exchange(spark):
    rows = [(1, "email", ["dom"]), (1, "face", ["dom", "ocr"]), (2, "email", ["ocr"])]
    found = spark.range(3).select(F.get(F.lit([p for p, _, _ in rows]), F.col("id").cast("int")).alias("page_id"), F.get(F.lit([k for _, k, _ in rows]), F.col("id").cast("int")).alias("type"), F.when(F.col("id") == 0, F.array(F.lit("dom"))).when(F.col("id") == 1, F.array(F.lit("dom"), F.lit("ocr"))).otherwise(F.array(F.lit("ocr"))).alias("sources"))
    out = fuse.summaries(found)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.page_id, r.total, r.by_type.get("email"), r.by_source.get("dom")) for r in out.collect()} == {(1, 2, 1, 2), (2, 1, 1, None)}


def test_sanitizing_joins_by_exchange(spark):
    rows = spark.range(4).selectExpr("id as page_id", "0 as elem_idx", "'p' as tag", "concat('t', id) as text", "struct(0 as x, 0 as y, 10 as width, 10 as height) as bbox", "false as is_sensitive")
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("role", "input_type", "label", "value", "placeholder", "alt", "href")})
    out = sanitize.sanitize_elements(rows, rows.where("page_id = 1").select("page_id", "bbox"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.page_id: r.text for r in out.collect()} == {0: "t0", 1: "[REDACTED]", 2: "t2", 3: "t3"}


def test_a_small_file_is_dealt_over_the_cores(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = more._dealt(spark, str(tmp_path), "customer")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 100
    assert more.message_tasks(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lots_of_pages_keep_every_element(spark):
    n = 2 * tables.LOT + 7
    pages = spark.range(n).selectExpr("id as page_id", "concat('<div><p>t', id, '</p></div>') as html").coalesce(1)
    assert {(r.page_id, r.elem_idx, r.tag, r.text) for r in tables.elements(pages).collect()} == {x for i in range(n) for x in ((i, 0, "div", ""), (i, 1, "p", f"t{i}"))}


def test_long_pages_give_every_element(spark, tmp_path):
    long = ("<div>" + "<p>" * 49 + "x</div>") * 84
    deep = "<article>" + "<b>w" * 20_000  # none closed
    spark.createDataFrame([(1, long), (2, deep)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.page_elements(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id = 1")
    want = con.execute(flows.oracle_sql()["page_elements"]).fetchall()
    assert len(want) == 84 * 50 and sorted(tuple(r)[:3] + (r.text,) for r in got if r.page_id == 1) == sorted(r[:3] + r[4:] for r in want)
    assert {r.elem_idx: r.parent_idx for r in got if r.page_id == 1} == {r[1]: r[3] for r in want}
    assert {(r.elem_idx, r.tag, r.parent_idx, r.text) for r in got if r.page_id == 2} == {(0, "article", None, "")} | {(i, "b", i - 1, "w") for i in range(1, 20_001)}


def test_long_pages_count_every_tag(spark, tmp_path):
    last = "<nav></nav><article>search the series</article>"  # what a search looks for, after the 4,000th element
    rows = [(3, ("<div>" + "<p>" * 49 + "x</div>") * 80 + last), (4, "<ul>" + "<li>x</li>" * 4500 + "</ul>" + last), (7, "<li>x"), (9, None)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id <> 4")
    ranked = con.execute(flows.oracle_sql()["ranked_elements"]).fetchall()  # the first 4,000 here
    assert sorted(tuple(r) for r in catalog.ranked_elements(spark, str(tmp_path)).where("page_id <> 4").collect()) == sorted(ranked)
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["page_tags"]).fetchall()
    assert sorted(tuple(r) for r in catalog.page_tags(spark, str(tmp_path)).collect()) == sorted(want) == [("article", 2, 2), ("li", 4501, 2), ("nav", 2, 2)]
