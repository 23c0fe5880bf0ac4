"""Sanitized text and elements, and the labels shown for detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlaps
from ..functions.lineage import paired
from ..functions.text import replace_spans
from .detect import all_matches, readable
from .rules import REDACT

MARK = "[REDACTED]"


def redact_text(df: DataFrame, key: str, text: str = "text", mode: str = "compat", rules: list[str] | None = None) -> DataFrame:
    """(key, sanitized, n_redacted): every row's text with its own REDACT spans replaced; no shuffle, and rows may share a key."""
    clean = readable(df, [key], text)
    gone = F.transform(F.filter(all_matches(rules), lambda x: x["confidence"] >= REDACT), lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e")))
    out = clean.select(key, "_text", gone.alias("_s"))
    return out.select(key, F.when(F.size("_s") > 0, replace_spans(F.col("_text"), F.col("_s"), MARK, mode)).otherwise(F.col("_text")).alias("sanitized"), F.size("_s").alias("n_redacted"))


def interaction(tag: Column, kind: Column, role: Column) -> Column:
    """What a user can do with an element."""
    return (
        F.when(tag == "input", F.when(kind.isin("checkbox", "radio"), "toggle").when(kind.isin("submit", "button", "reset", "image"), "click").otherwise("type"))
        .when(tag == "textarea", "type").when(tag == "select", "select").when((tag == "button") | (role == "button"), "click").when((tag == "a") | (role == "link"), "navigate").otherwise("read")
    )


def sanitize_elements(elements: DataFrame, redactions: DataFrame, scale: bool = False) -> DataFrame:
    """elements with text, label, value and alt replaced where a redaction box overlaps or the field is sensitive.

    elements: page_id, elem_idx, tag, role, input_type, text, label, value, placeholder, alt, href, bbox, is_sensitive. redactions: page_id, bbox
    (and scale_x, scale_y if ``scale``: boxes are then brought back to page coordinates first).
    """
    r = F.col("_r")
    if scale:
        r = F.struct((r["x"] / F.col("scale_x")).alias("x"), (r["y"] / F.col("scale_y")).alias("y"), (r["width"] / F.col("scale_x")).alias("width"), (r["height"] / F.col("scale_y")).alias("height"))
    marks = redactions.withColumnRenamed("bbox", "_r").withColumnRenamed("page_id", "_p")
    hit = paired(elements, marks, (F.col("page_id") == F.col("_p")) & overlaps(F.col("bbox"), r), "left_semi").select("page_id", "elem_idx").distinct().withColumn("_hit", F.lit(True))
    out = paired(elements, hit, ["page_id", "elem_idx"], "left")
    gone = F.coalesce("_hit", F.lit(False))
    secret = gone | F.coalesce("is_sensitive", F.lit(False)) | (F.coalesce("input_type", F.lit("")) == "password")
    is_input = F.col("tag").isin("input", "textarea", "select")
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return out.select(
        "page_id", "elem_idx", "tag", "role", "input_type", "bbox",
        F.when(full("text"), F.when(gone, MARK).otherwise(F.col("text"))).alias("text"), interaction(F.col("tag"), F.col("input_type"), F.col("role")).alias("interaction_type"),
        F.when(is_input, full("value")).alias("has_value"), F.when(is_input & full("value"), F.when(secret, MARK).otherwise(F.col("value"))).alias("value"),
        F.when(is_input, F.col("label")).alias("label"), F.when(is_input, F.col("placeholder")).alias("placeholder"), F.when(full("alt"), F.when(gone, MARK).otherwise(F.col("alt"))).alias("alt"), full("href").alias("has_link"),
    )


def source_label(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(F.contains(s, F.lit("dom")), "Page text").when(F.contains(s, F.lit("ocr")), "Picture text").when(F.contains(s, F.lit("vision")) | F.contains(s, F.lit("face")), "Picture").when(F.contains(s, F.lit("ner")), "Names").otherwise(source)


def search(found: DataFrame, query: str, columns: tuple[str, ...] = ("type", "text", "reason", "source")) -> DataFrame:
    """Rows one of whose columns contains the query, case ignored; all for an empty query."""
    q = query.strip().lower()
    if not q:
        return found
    test = F.lit(False)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    return found.where(test)
