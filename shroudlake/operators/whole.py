"""The run over whole pages: what is found in elements, recognised words, faces and names is brought to one picture, joined there, fused, redacted and checked.

Elements and picture regions come in page coordinates, recognised words and faces in those of the picture; everything is brought to the picture first. All of it is keyed by page, so the only
exchanges are by page_id. The order of the parts is that of the findings: elements, recognised text, pictures, names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import map_box, padded, scale_mismatch
from ..functions.lineage import paired, settled
from ..functions.places import interpolated, span_boxes
from .fuse import fuse, summaries
from .names import heuristic_entities, name_items
from .propagate import avatar_shields, document_shields, ordered_union
from .reading import line_texts, region_findings, region_lines
from .regions import decoded_faces, may_show_faces, merged_faces, regions_to_read
from .run import CANDIDATE, _candidates, element_candidates, spread_candidates
from .sanitize import sanitize_elements

#: Regions that are searched for faces, avatars first, then the largest; the size from which an avatar gets a shield; how large a box may be for a name's place in it to be guessed.
FACE_REGIONS, AVATAR_SIDE, NAME_WIDTH, NAME_HEIGHT = 10, 10, 300, 45


class Whole(NamedTuple):
    """What a run gives: candidates before and detections after fusion, boxes to paint over, elements with personal data replaced, a summary and warnings for each page."""

    candidates: DataFrame
    detections: DataFrame
    redactions: DataFrame
    elements: DataFrame
    summaries: DataFrame
    warnings: DataFrame


def scales(viewports: DataFrame) -> DataFrame:
    """(page_id, scale_x, scale_y, shot_w, shot_h) of viewports(page_id, css_w, css_h, shot_w, shot_h)."""
    return viewports.select("page_id", (F.col("shot_w") / F.col("css_w")).alias("scale_x"), (F.col("shot_h") / F.col("css_h")).alias("scale_y"), "shot_w", "shot_h")


def on_picture(df: DataFrame, by: DataFrame, *boxes: str, tokens: str | None = None) -> DataFrame:
    """df with its boxes (and those of its tokens) brought to the picture; rows of pages without a viewport go."""
    to = lambda b: map_box(b, F.col("scale_x"), F.col("scale_y"), F.col("shot_w"), F.col("shot_h"))
    out = df.join(by, "page_id").withColumns({b: F.when(F.col(b).isNotNull(), to(F.col(b))) for b in boxes})
    if tokens:
        token = lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), to(t["bbox"]).alias("bbox"), F.transform(t["boxes"], to).alias("boxes"))
        out = out.withColumn(tokens, F.transform(tokens, token))
    return out.drop("scale_x", "scale_y", "shot_w", "shot_h")


def face_candidates(regions: DataFrame, faces: DataFrame, viewports: DataFrame) -> DataFrame:
    """Candidates of a face detector's output: faces(page_id, region_idx, scores, boxes), region_idx null for the whole picture. Of a page's regions FACE_REGIONS count; faces of the whole picture join those of regions."""
    order = Window.partitionBy("page_id").orderBy(F.desc(F.coalesce("is_avatar", F.lit(False))), F.when(F.col("is_avatar"), F.col("region_idx")), F.desc("area"), "region_idx")
    chosen = regions.where(may_show_faces(F.col("bbox"), F.col("is_avatar"))).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= FACE_REGIONS)
    near = faces.join(chosen.select("page_id", "region_idx", "bbox", "_k"), ["page_id", "region_idx"]).select("page_id", "_k", decoded_faces(F.col("scores"), F.col("boxes"), F.col("bbox")).alias("f"))
    near = near.groupBy("page_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_k", "f"))), lambda x: x["f"])).alias("near"))
    frame = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("shot_w").cast("int").alias("width"), F.col("shot_h").cast("int").alias("height"))
    far = faces.where("region_idx is null").join(viewports.select("page_id", "shot_w", "shot_h"), "page_id").select("page_id", decoded_faces(F.col("scores"), F.col("boxes"), frame).alias("far"))
    far = far.groupBy("page_id").agg(F.flatten(F.collect_list("far")).alias("far"))
    both = near.join(far, "page_id", "full")
    none = F.slice(F.coalesce("near", "far"), 1, 0)
    rows = both.select("page_id", F.inline(merged_faces(F.coalesce("near", none), F.coalesce("far", none))))
    empty = F.expr("cast(array() as array<string>)")
    return _candidates(rows.select("page_id", F.lit(None).cast("int").alias("elem_idx"), F.lit("face").alias("type"), F.lit("").alias("text"), F.lit("").alias("original_value"), empty.alias("tokens"), "confidence", F.lit("face_detector").alias("reason"), "bbox", F.lit(0).alias("start")), "vision")


def name_candidates(elements: DataFrame, lines: DataFrame | None, model: DataFrame | None = None) -> DataFrame:
    """Candidates of names, places and organisations in the texts of name_items(), each with a box: that of its words, else the text's box if it is small.

    model(page_id, item_idx, type, text, start, end, confidence): what a model found; a rule's finding of the same type goes if it holds a model's text or the other way round, and so does one that
    an earlier finding of the rules holds or that holds it.
    """
    places = elements.select("page_id", F.lit("dom").alias("source"), F.col("elem_idx").cast("long").alias("elem_idx"), F.transform("tokens", lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), t["bbox"].alias("bbox"), t["boxes"].alias("boxes"))).alias("tokens"))
    if lines is not None:
        own = F.transform("tokens", lambda t: F.struct(t["id"].alias("id"), t["text"].alias("text"), t["start"].alias("start"), t["end"].alias("end"), t["bbox"].alias("bbox"), F.array(t["bbox"]).alias("boxes")))
        places = places.unionByName(lines.select("page_id", F.lit("ocr").alias("source"), F.col("line_index").cast("long").alias("elem_idx"), own.alias("tokens")))
    items = settled(paired(name_items(elements, lines), places, ["page_id", "source", "elem_idx"], "left"))  # the rules read them, and what they find is put in its place by them
    rules = heuristic_entities(items.withColumn("whole", F.col("text")), ["page_id", "item_idx"])
    held = lambda a, b: F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))
    if model is not None:
        m = model.select(F.col("page_id").alias("_p"), F.col("type").alias("_t"), F.col("text").alias("_x"))
        rules = paired(rules, m, (F.col("page_id") == F.col("_p")) & (F.col("type") == F.col("_t")) & held(F.col("text"), F.col("_x")), "left_anti")
    row = F.struct("item_idx", "rule_ord", "start", "end", "text", "confidence", "reason")
    kept = rules.groupBy("page_id", "type").agg(F.sort_array(F.collect_list(row)).alias("all"))
    kept = kept.select("page_id", "type", F.inline(F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: held(x["text"], y["text"])), acc).otherwise(F.concat(acc, F.array(x))))))
    found = kept.select("page_id", "item_idx", "type", "text", "start", "end", "confidence", "reason")
    if model is not None:
        found = found.unionByName(model.select("page_id", "item_idx", "type", "text", "start", "end", "confidence", F.lit("model").alias("reason")))
    at = paired(found, items.select("page_id", "item_idx", "elem_idx", "source", F.col("text").alias("_whole"), F.col("bbox").alias("_b"), F.col("tokens").alias("_tokens")), ["page_id", "item_idx"])
    by_word = span_boxes(F.col("_tokens"), F.col("start"), F.col("end"), clamp=True)
    place: Column = F.coalesce(by_word["bbox"], interpolated(F.col("_b"), F.col("_whole"), F.col("start"), F.col("end"), NAME_WIDTH, NAME_HEIGHT))
    rows = at.withColumn("bbox", place).where("bbox is not null")
    return _candidates(rows.select("page_id", F.when(F.col("source") == "dom", F.col("elem_idx")).cast("int").alias("elem_idx"), "type", "text", F.col("text").alias("original_value"), F.coalesce(by_word["tokens"], F.expr("cast(array() as array<string>)")).alias("tokens"), "confidence", "reason", "bbox", "start"), "ner")


def read_candidates(words: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of recognised words in the regions that are worth reading, and the lines of these."""
    chosen = regions_to_read(regions)
    own = settled(paired(words, chosen.select("page_id", "region_idx"), ["page_id", "region_idx"], "left_semi"))
    found = region_findings(own, chosen)
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("region_idx", "reason", F.col("bbox")["y"], F.col("bbox")["x"]))
    rows = found.select("page_id", F.lit(None).cast("int").alias("elem_idx"), "type", "text", F.col("text").alias("original_value"), F.expr("cast(array() as array<string>)").alias("tokens"), "confidence", "reason", "bbox", order.alias("start"))
    lines = line_texts(region_lines(own))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("region_idx", "line_index")) - 1
    return _candidates(rows, "ocr"), lines.withColumn("line_index", number)


def shield_rows(shields: DataFrame, source: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    rows = shields.select("page_id", F.lit(None).cast("int").alias("elem_idx"), "type", F.lit("").alias("text"), F.lit("").alias("original_value"), none.alias("tokens"), "confidence", "reason", "bbox", (F.lit(1_000_000) + F.col("region_idx")).cast("int").alias("start"))
    return _candidates(rows, source)


def whole_run(elements: DataFrame, viewports: DataFrame, regions: DataFrame, words: DataFrame, faces: DataFrame, model: DataFrame | None = None) -> Whole:
    """The run over elements (columns of run.sanitize_pages()), viewports (see scales()), regions (page.pixel_regions()), words (page_id, region_idx, word_idx, text, confidence, bbox) and faces (see face_candidates()).

    Pages without a viewport are left out. A page whose axes are scaled differently gets a warning. The findings of each detector are written once; shields and spreading read them again.
    """
    by = scales(viewports)
    seen, pictures = on_picture(elements, by, "bbox", tokens="tokens"), on_picture(regions, by, "bbox")
    dom = settled(element_candidates(seen))
    read, lines = read_candidates(words, pictures)
    read, shown = settled(read), settled(face_candidates(pictures, faces, viewports))
    both = dom.unionByName(read)
    spread = spread_candidates(seen, both)
    cards = shield_rows(document_shields(pictures, read.unionByName(shown)), "ocr_document_shield")
    large = pictures.where(F.col("bbox.width").isNotNull() & (F.col("bbox.width") >= AVATAR_SIDE) & (F.col("bbox.height") >= AVATAR_SIDE))
    portraits = shield_rows(avatar_shields(large, dom.unionByName(spread).unionByName(shown).withColumn("decision", F.lit("REDACT"))), "avatar_shield")
    names = name_candidates(seen.withColumns({c: F.lit(None).cast("string") for c in ("role", "class_name") if c not in seen.columns} | {"is_container": F.coalesce("block_child", F.lit(False))}), lines, model)
    candidates = settled(ordered_union(dom.unionByName(spread), read.unionByName(cards), shown.unionByName(portraits), names).select(*CANDIDATE, "cand_seq"))
    detections = settled(fuse(candidates.select("page_id", "cand_seq", "type", "sources", "text", "tokens", "confidence", "reason", "bbox")))
    gone = detections.where("decision = 'REDACT'")
    paint = gone.join(by, "page_id").select("page_id", "cand_seq", "type", "reason", padded(F.col("bbox"), F.col("shot_w"), F.col("shot_h")).alias("bbox"))
    clean = sanitize_elements(seen, gone.select("page_id", "bbox"))
    warnings = by.where(scale_mismatch(F.col("scale_x"), F.col("scale_y"))).select("page_id", F.lit("axes are scaled differently").alias("warning"))
    return Whole(candidates, detections, paint, clean, summaries(detections), warnings)
