"""The whole run: from page elements and other detectors' findings to fused detections, sanitized elements and summaries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import paired, settled
from ..functions.places import interpolated, span_boxes
from .detect import clamp_confidence, detect_pii
from .fields import typed_fields
from .fuse import fuse, summaries
from .page import structural
from .propagate import confirmed, ordered_union, spread
from .rules import REDACT
from .sanitize import sanitize_elements

CANDIDATE = ("page_id", "type", "source", "sources", "text", "original_value", "tokens", "confidence", "reason", "bbox", "elem_idx", "start")


class Run(NamedTuple):
    """What a run gives: candidates before and detections after fusion, elements with personal data replaced, and a summary for each page."""

    candidates: DataFrame
    detections: DataFrame
    elements: DataFrame
    summaries: DataFrame


def _candidates(df: DataFrame, source: str) -> DataFrame:
    """df(page_id, elem_idx, type, text, original_value, tokens, confidence, reason, bbox, start) in the common form."""
    return df.withColumns({"source": F.lit(source), "sources": F.array(F.lit(source)), "confidence": clamp_confidence(F.col("confidence"))}).select(*CANDIDATE)


def element_candidates(elements: DataFrame) -> DataFrame:
    """Candidates of page elements: avatars, form fields by what they hold, and matches of the rules in texts, each with the box of its words.

    elements: page_id, elem_idx, tag, input_type, autocomplete, name, id, class_name, label, value, text, bbox, tokens (array, may be null), block_child, is_header,
    is_avatar, avatar_confidence. Containers, headers and elements without a box give no text matches; without tokens the box is interpolated.
    """
    none = F.expr("cast(array() as array<string>)")
    boxed = elements.where("bbox is not null and not coalesce(is_header, false)").where(~structural(F.col("tag"), F.col("block_child")))
    fields = paired(typed_fields(boxed), boxed.select("page_id", "elem_idx", "bbox"), ["page_id", "elem_idx"])
    faces = boxed.where("is_avatar").select("page_id", "elem_idx", F.lit("face").alias("type"), F.lit("").alias("text"), F.lit("").alias("original_value"), none.alias("tokens"), F.coalesce("avatar_confidence", F.lit(0.85)).alias("confidence"), F.lit("avatar").alias("reason"), "bbox", F.lit(0).alias("start"))
    seen = boxed.where(~F.lower("tag").isin("input", "textarea", "select") & (F.length(F.trim(F.coalesce("text", F.lit("")))) >= 3))
    found = detect_pii(seen, ["page_id", "elem_idx", "bbox", "tokens", F.col("text").alias("whole")], "text", "label")
    by_token = span_boxes(F.col("tokens"), F.col("start"), F.col("end"))
    line = interpolated(F.col("bbox"), F.col("whole"), F.col("start"), F.col("end"))
    placed = found.withColumns({"_at": F.coalesce(by_token["bbox"], line), "_ids": F.coalesce(by_token["tokens"], none)}).where("_at is not null")
    texts = placed.select("page_id", "elem_idx", "type", "text", F.col("text").alias("original_value"), F.col("_ids").alias("tokens"), "confidence", F.concat(F.lit("regex:"), "rule").alias("reason"), F.col("_at").alias("bbox"), "start")
    typed = fields.select("page_id", "elem_idx", "type", "text", "original_value", none.alias("tokens"), "confidence", "reason", "bbox", F.lit(0).alias("start"))
    return _candidates(faces, "dom").unionByName(_candidates(typed, "dom")).unionByName(_candidates(texts, "dom"))


def spread_candidates(elements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of further elements that show a value the page is sure of."""
    more = spread(confirmed(candidates, elements), elements, candidates)
    at = paired(more, elements.select("page_id", "elem_idx", F.col("text").alias("_whole"), F.col("bbox").alias("_b")), ["page_id", "elem_idx"])
    start = F.instr("_whole", F.col("value")) - 1
    box = interpolated(F.col("_b"), F.col("_whole"), start, start + F.length("value"))
    kind = F.when(F.col("kind") == "name", "name").otherwise("username")
    rows = at.select("page_id", "elem_idx", kind.alias("type"), F.col("value").alias("text"), F.col("value").alias("original_value"), F.expr("cast(array() as array<string>)").alias("tokens"), "confidence", F.lit("propagated").alias("reason"), box.alias("bbox"), start.alias("start"))
    return _candidates(rows.where("bbox is not null"), "dom")


def sanitize_pages(elements: DataFrame, *others: DataFrame) -> Run:
    """The run over elements (see element_candidates(), confirmed() and sanitize_elements() for their columns) and others, candidate tables of further detectors (CANDIDATE), in order.

    The elements' candidates are written once, as the rules are the costly part and three later steps read them.
    """
    own = settled(element_candidates(elements))
    own = own.unionByName(spread_candidates(elements, own))
    both = ordered_union(own, *others)
    detections = fuse(both.select("page_id", "cand_seq", "type", "sources", "text", "tokens", "confidence", "reason", "bbox"))
    gone = detections.where("decision = 'REDACT'").select("page_id", "bbox")
    clean = sanitize_elements(elements, gone)
    return Run(both, detections, clean, summaries(detections))


def sure(found: DataFrame) -> DataFrame:
    """Candidates that are redacted by their confidence alone."""
    return found.where(F.col("confidence") >= REDACT)
