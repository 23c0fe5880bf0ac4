"""From spans of text to boxes on the page: tokens that a span touches, parts of their boxes, and boxes by interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import BOX, box, enclosing, map_box, right, rounded

LEAST_PART, LEAST_SLICE, TALLEST_SLICE = 2, 20, 40


def touched(tokens: Column, start: Column, end: Column) -> Column:
    """The tokens (struct with start, end) that share a character with [start, end)."""
    return F.filter(tokens, lambda t: (t["end"] > start) & (t["start"] < end))


def part_of(token: Column, start: Column, end: Column, clamp: bool = False) -> Column:
    """The part of a token's bbox that a span covers, by its share of the characters; ``clamp`` keeps it within the token's right edge."""
    b = token["bbox"]
    per = b["width"] / F.greatest(F.lit(1), F.length(token["text"]))
    low, high = F.greatest(token["start"], start), F.least(token["end"], end)
    x = b["x"] + rounded((low - token["start"]) * per)
    w = F.greatest(F.lit(LEAST_PART), rounded((high - low) * per))
    return box(x, b["y"], F.greatest(F.lit(1), F.least(w, right(b) - x)) if clamp else w, b["height"])


def span_boxes(tokens: Column, start: Column, end: Column, clamp: bool = False) -> Column:
    """struct<bbox, boxes, tokens>: the boxes of the tokens (id, text, start, end, bbox, boxes) that a span touches; of a token that it covers in part, the part.

    A token without boxes of its own gives none where it is covered whole. bbox is null where there is no box.
    """
    hit = touched(tokens, start, end)
    whole = lambda t: (t["start"] >= start) & (t["end"] <= end)
    none = F.expr(f"cast(array() as array<{BOX}>)")
    boxes = F.flatten(F.transform(hit, lambda t: F.when(whole(t) | (F.size(t["boxes"]) < 1), F.coalesce(t["boxes"], none)).otherwise(F.array(part_of(t, start, end, clamp)))))
    return F.struct(F.when(F.size(boxes) > 0, enclosing(boxes)).alias("bbox"), boxes.alias("boxes"), F.transform(hit, lambda t: t["id"]).alias("tokens"))


def interpolated(b: Column, text: Column, start: Column, end: Column, most_width: int | None = None, most_height: int | None = None) -> Column:
    """A span's box where there are no tokens: a small box whole if the span is most of the text, else the span's share of the line; null for no box.

    With ``most_width`` and ``most_height`` larger boxes give null, as names in them could be anywhere.
    """
    size = F.greatest(F.lit(1), F.length(text))
    small = (b["width"] <= 350) & (b["height"] <= 50) & ((end - start) >= F.length(text) * 0.6)
    per = b["width"] / size
    x = b["x"] + rounded(start * per)
    part = box(x, b["y"], F.least(F.greatest(F.lit(LEAST_SLICE), rounded((end - start) * per)), right(b) - x), F.least(b["height"], F.lit(TALLEST_SLICE)))
    fits = F.length(text) > 0
    if most_width is not None and most_height is not None:
        fits &= (b["width"] <= most_width) & (b["height"] <= most_height)
    return F.when(b.isNotNull(), F.when(small, b).when(fits, part))


def on_picture(bbox: Column, boxes: Column, space: Column, scale_x: Column, scale_y: Column, width: Column, height: Column) -> Column:
    """struct<css_bbox, bbox, boxes, coordinate_space>: boxes brought to the picture; those that are already there stay, and have no css_bbox."""
    to = lambda b: map_box(b, scale_x, scale_y, width, height)
    there = F.coalesce(space == "screenshot", F.lit(False))
    return F.struct(
        F.when(~there, bbox).alias("css_bbox"), F.when(there | bbox.isNull(), bbox).otherwise(to(bbox)).alias("bbox"),
        F.when(there, boxes).otherwise(F.transform(boxes, to)).alias("boxes"), F.when(bbox.isNull(), space).otherwise(F.lit("screenshot")).alias("coordinate_space"),
    )
