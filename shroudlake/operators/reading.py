"""Recognised words of picture regions: lines, the boxes of spans, fields of printed forms, and the run over a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX, box, enclosing, right, rounded, union
from ..functions.lineage import paired, settled
from ..functions.places import part_of, touched
from .detect import detect_pii
from .propagate import document_kind

WORD = f"struct<word_idx:bigint,text:string,confidence:double,bbox:{BOX}>"
#: How far middles may be apart in one line, of words and of the parts of a span, as a share of the height.
SAME_LINE, SAME_SPAN_LINE = 0.55, 0.6


def _middle(b: Column) -> Column:
    return b["y"] + b["height"] / 2


def lines_by_place(words: Column) -> Column:
    """array<array<word>>: words (struct word_idx, text, confidence, bbox) as lines by where they stand.

    From the top down each word joins the first line whose mean middle is near; lines are ordered by their mean top, words in them from the left.
    """
    order = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(w["bbox"]["y"].alias("y"), w["word_idx"].alias("i"), w.alias("w")))), lambda o: o["w"])
    none = F.expr(f"cast(array() as array<struct<n:int,mid:double,height:double,top:double,words:array<{WORD}>>>)")

    def put(lines: Column, w: Column) -> Column:
        b = w["bbox"]
        near = lambda x: F.abs(_middle(b) - x["mid"] / x["n"]) < x["height"] / x["n"] * SAME_LINE
        spot = F.array_position(F.transform(lines, near), True)
        grown = lambda x: F.struct((x["n"] + 1).alias("n"), (x["mid"] + _middle(b)).alias("mid"), (x["height"] + b["height"]).alias("height"), (x["top"] + b["y"]).alias("top"), F.concat(x["words"], F.array(w)).alias("words"))
        fresh = F.struct(F.lit(1).alias("n"), _middle(b).cast("double").alias("mid"), b["height"].cast("double").alias("height"), b["y"].cast("double").alias("top"), F.array(w).alias("words"))
        return F.when(spot > 0, F.transform(lines, lambda x, i: F.when(i == spot - 1, grown(x)).otherwise(x))).otherwise(F.concat(lines, F.array(fresh)))

    lines = F.aggregate(order, none, put)
    by_top = F.array_sort(F.transform(lines, lambda x, i: F.struct((x["top"] / x["n"]).alias("k"), i.alias("i"), x["words"].alias("words"))))
    by_left = lambda ws: F.transform(F.array_sort(F.transform(ws, lambda w, i: F.struct(w["bbox"]["x"].alias("x"), i.alias("i"), w.alias("w")))), lambda o: o["w"])
    return F.transform(by_top, lambda x: by_left(x["words"]))


def region_lines(words: DataFrame) -> DataFrame:
    """(page_id, region_idx, lines): words(page_id, region_idx, word_idx, text, confidence, bbox) of a region as lines by where they stand; a region's words are what one picture shows."""
    one = F.struct(F.col("word_idx").cast("long").alias("word_idx"), F.trim("text").alias("text"), F.col("confidence").cast("double").alias("confidence"), F.col("bbox"))
    good = words.where("trim(text) <> '' and bbox is not null")
    return good.groupBy("page_id", "region_idx").agg(F.sort_array(F.collect_list(one)).alias("words")).select("page_id", "region_idx", lines_by_place(F.col("words")).alias("lines"))


def line_texts(lines: DataFrame) -> DataFrame:
    """(page_id, region_idx, line_index, text, bbox, tokens) of region_lines(): each line's text, and its words with their places in it."""
    rows = lines.select("page_id", "region_idx", F.posexplode("lines").alias("line_index", "words"))
    start = F.aggregate(
        "words", F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<id:string,text:string,start:int,end:int,bbox:{BOX}>>)").alias("got")),
        lambda acc, w: F.struct(
            (acc["at"] + F.length(w["text"]) + 1).alias("at"),
            F.concat(acc["got"], F.array(F.struct(F.concat(F.lit("ocr_"), w["word_idx"]).alias("id"), w["text"].alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(w["text"])).alias("end"), w["bbox"].alias("bbox")))).alias("got"),
        ),
    )
    return rows.select("page_id", "region_idx", "line_index", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), enclosing(F.transform("words", lambda w: w["bbox"])).alias("bbox"), start["got"].alias("tokens"))


def span_line_boxes(tokens: Column, start: Column, end: Column) -> Column:
    """struct<bbox, boxes>: the parts of the words that a span covers, within the words, joined to one box for each line; null where it touches none."""
    parts = F.transform(touched(tokens, start, end), lambda t: part_of(t, start, end, clamp=True))
    none = F.expr(f"cast(array() as array<struct<first:{BOX},all:{BOX}>>)")

    def put(lines: Column, b: Column) -> Column:
        near = lambda x: F.abs(_middle(b) - _middle(x["first"])) < (b["height"] + x["first"]["height"]) / 2 * SAME_SPAN_LINE
        spot = F.array_position(F.transform(lines, near), True)
        grown = lambda x: F.struct(x["first"].alias("first"), union(x["all"], b).alias("all"))
        return F.when(spot > 0, F.transform(lines, lambda x, i: F.when(i == spot - 1, grown(x)).otherwise(x))).otherwise(F.concat(lines, F.array(F.struct(b.alias("first"), b.alias("all")))))

    return F.when(F.size(parts) > 0, F.struct(enclosing(parts).alias("bbox"), F.transform(F.aggregate(parts, none, put), lambda x: x["all"]).alias("boxes")))


#: Fields of printed forms: type, reason, how far down and to the right of the region, least width as a share, least height; slots of invoices: left, top, height.
FIELDS = {
    "name": ("name", 0.48, 0.78, 0.40, 26, (0.17, 0.27, 26)), "phone": ("phone", 0.42, 0.85, 0.45, 26, (0.18, 0.32, 28)), "device_id": ("imei", 10.0, 0.72, 0.45, 28, (0.28, 0.47, 28)),
}
PHONE_LABELS, DEVICE_LABELS, NAME_LABELS = ("mob", "mod", "mobile", "phone", "contact", "tel", "cell", "ono"), ("imei", "ime", "ime!", "me!", "serial", "sr", "sl"), ("name", "buyer", "patient", "applicant")
GOODS, MARKS, INVOICE = "(?i)smart|feature|cell|mobile|charger|battery", r"^[:\-.]\z", r"(?i)\b(?:tax\s*invoice|retail\s*invoice|invoice|bill\s*of\s*supply|cash\s*memo|cash\s*receipt|challan)\b"
WIDEST, NARROWEST = 220, 80


def form_fields(lines: DataFrame) -> DataFrame:
    """(page_id, region_idx, type, confidence, reason, bbox): where printed forms leave room for what is written by hand, next to the first label of each kind, and signatures.

    lines: region_lines() with the region's box (region) and the types already found in it (found, array of strings), which need no field. Invoices
    without a label get the place where the field usually is.
    """
    r = F.col("region")
    base = lines.withColumn("found", F.coalesce("found", F.expr("cast(array() as array<string>)")))
    rows = base.select("page_id", "region_idx", "region", "found", F.posexplode("lines").alias("li", "line")).select("*", F.posexplode("line").alias("wi", "w"))
    low, words = lambda c: F.lower(c["text"]), F.col("line")
    rows = rows.withColumns({
        "clean": F.regexp_replace(low(F.col("w")), "[^a-z0-9!]", ""), "next": F.get(words, F.col("wi") + 1), "before": F.get(words, F.col("wi") - 1), "said": F.lower(F.array_join(F.transform(words, lambda w: w["text"]), " ")),
    })
    clean, nxt, b = F.col("clean"), F.col("next"), F.col("w")["bbox"]
    bare = F.regexp_replace(F.coalesce(low(nxt), F.lit("")), "[^a-z]", "")
    number, mark = bare.isin("no", "num", "nos"), F.coalesce(F.rlike(F.trim(nxt["text"]), F.lit(MARKS)), F.lit(False))
    label = {
        "name": clean.isin(*NAME_LABELS) | ((clean == "customer") & ~F.contains("said", F.lit("signature"))) | ((clean == "nam") & bare.isin("e", "is")),
        "phone": clean.isin(*PHONE_LABELS) & ~F.coalesce(F.rlike(F.col("before")["text"], F.lit(GOODS)), F.lit(False)), "device_id": clean.isin(*DEVICE_LABELS),
    }
    beside = {"name": mark, "phone": number | mark, "device_id": number}
    made = []
    for kind, (reason, down, across, share, tall, _) in FIELDS.items():
        ref = F.when(beside[kind], nxt).otherwise(F.col("w"))["bbox"]
        x = right(ref) + 4
        limit = r["x"] + r["width"] * across
        if kind == "name":
            dates = F.filter(words, lambda o: (o["bbox"]["x"] > x) & F.rlike(o["text"], F.lit("(?i)date")))  # noqa: B023
            limit = F.when(F.size(dates) > 0, F.get(dates, F.lit(0))["bbox"]["x"] - 8).otherwise(limit)
        after = F.filter(words, lambda o: (o["bbox"]["x"] > x) & (o["bbox"]["x"] < limit))  # noqa: B023
        least = rounded(r["width"] * share)
        most = F.array_max(F.transform(after, lambda o: right(o["bbox"])))
        width = F.least(limit - x, F.least(F.lit(WIDEST), F.greatest(least, F.coalesce(most - x + 10, least))))
        field = box(x, F.greatest(r["y"] + 2, ref["y"] - 4), F.greatest(F.lit(NARROWEST), width), F.greatest(ref["height"] + 10, F.lit(tall)))
        test = label[kind] & (b["y"] < r["y"] + r["height"] * down) & ~F.array_contains("found", kind)
        made.append(F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(0.98).alias("confidence"), F.lit(f"form_field_anchor:{reason}").alias("reason"), field.alias("bbox"))))
    signs = F.rlike(clean, F.lit("signature|signatory|bugnacure|bgnarure")) | ((clean == "sign") & (F.size(words) <= 4))
    sx = F.greatest(r["x"] + rounded(r["width"] * 0.68), b["x"] - 30)
    sy = F.greatest(r["y"] + rounded(r["height"] * 0.82), b["y"] - 50)
    ink = box(sx, sy, F.greatest(F.lit(90), F.least(right(r) - 6 - sx, rounded(r["width"] * 0.29))), F.lit(58))
    made.append(F.when(signs & (b["x"] > r["x"] + r["width"] * 0.5) & (b["y"] > r["y"] + r["height"] * 0.70), F.struct(F.lit("signature").alias("type"), F.lit(0.95).alias("confidence"), F.lit("form_field_anchor:signature").alias("reason"), ink.alias("bbox"))))
    each = rows.select("page_id", "region_idx", "li", "wi", F.explode(F.array(*made)).alias("a")).where("a is not null")
    first = each.groupBy("page_id", "region_idx", F.col("a.type").alias("_t")).agg(F.min_by("a", F.struct("li", "wi")).alias("a")).select("page_id", "region_idx", "a.*")

    text = F.array_join(F.transform(F.flatten("lines"), lambda w: w["text"]), " ")
    slots = []
    for kind, (reason, *_, (left, top, tall)) in FIELDS.items():
        place = box(r["x"] + rounded(r["width"] * left), r["y"] + rounded(r["height"] * top), F.least(F.lit(WIDEST), rounded(r["width"] * 0.50)), F.lit(tall))
        slots.append(F.when(~F.array_contains("found", kind), F.struct(F.lit(kind).alias("type"), F.lit(0.96).alias("confidence"), F.lit(f"form_field_anchor:{reason}_slot").alias("reason"), place.alias("bbox"))))
    forms = base.where(F.rlike(text, F.lit(INVOICE))).select("page_id", "region_idx", F.explode(F.array(*slots)).alias("a")).where("a is not null").select("page_id", "region_idx", "a.*")
    return first.unionByName(paired(forms, first.select("page_id", "region_idx", "type"), ["page_id", "region_idx", "type"], "left_anti"))


def region_findings(words: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, region_idx, type, text, confidence, reason, bbox): what recognised words of regions(page_id, region_idx, bbox) hold.

    The rules' matches in each line, a shield over a region that shows an identity document, and the fields of printed forms.
    """
    lines = settled(region_lines(words))  # both are read by the rules, the shields and the fields
    texts = settled(line_texts(lines))
    found = detect_pii(texts, ["page_id", "region_idx", "tokens"], "text")
    hits = found.select("page_id", "region_idx", "type", "text", "confidence", F.concat(F.lit("ocr_regex:"), "rule").alias("reason"), span_line_boxes(F.col("tokens"), F.col("start"), F.col("end"))["bbox"].alias("bbox"))
    hits = settled(hits)  # read three times below
    kinds = hits.groupBy("page_id", "region_idx").agg(F.array_sort(F.collect_set("type")).alias("found"))
    whole = texts.groupBy("page_id", "region_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("_text"))
    area = regions.select("page_id", "region_idx", F.col("bbox").alias("region"))
    both = paired(paired(whole, area, ["page_id", "region_idx"]), kinds, ["page_id", "region_idx"], "left")
    card = document_kind(F.col("_text"), F.col("region.width"), F.col("region.height"), F.col("found"))
    cards = both.withColumn("_k", card).where("_k is not null").select("page_id", "region_idx", F.lit("identity_document").alias("type"), F.lit("").alias("text"), F.lit(1.0).alias("confidence"), F.concat(F.lit("document_shield:"), F.when(F.col("_k").isin("pan", "aadhaar"), F.concat("_k", F.lit("_card"))).otherwise(F.col("_k"))).alias("reason"), F.col("region").alias("bbox"))
    fields = form_fields(paired(paired(lines, area, ["page_id", "region_idx"]), kinds, ["page_id", "region_idx"], "left")).withColumn("text", F.lit(""))
    return cards.unionByName(hits.where("bbox is not null")).unionByName(fields)
