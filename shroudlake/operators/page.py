"""Rows of page elements: which can be seen, which are mere containers, what names them, which are pictures and avatars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, bottom, right
from .lookup import table_headers

#: Fixed values.
LEAST_SIZE, TABLE_PARTS = 4, ("table", "thead", "tbody", "tfoot", "tr")
CONTAINERS = (*TABLE_PARTS, "div", "header", "footer", "main", "section", "article", "aside", "nav", "form", "ul", "ol", "dl", "details")
FIELDS, PICTURES = ("input", "select", "textarea"), ("img", "canvas", "svg", "video", "iframe", "picture")
AVATAR_WORDS = (
    r"\b(?:avatar|profile[-_]?(?:pic|img|photo|image|thumb|icon|badge|btn|view)|user[-_]?(?:pic|img|photo|icon|avatar|image|badge|btn|profile|thumb|detail|info|name)|account[-_]?(?:img|circle|icon|photo|avatar|btn)|"
    r"headshot|portrait|gravatar|member[-_]?(?:photo|img|pic)|author[-_]?(?:img|pic)|my[-_]?profile|logged[-_]?in[-_]?user)\b"
)
#: Fixed value: the share of the width from which a corner's radius makes an element round.
ROUND_SHARE = 0.35
USER_WORDS, ROUND, BAR = r"\b(?:user|profile|account|member|me|login|auth|logged)\b", r"\b(?:rounded-circle|circle|img-circle)\b", 160
BAR_WORDS = r"\b(?:header|navbar|top-bar|user-menu|profile-menu|user-profile|user-info|account-menu|nav-right|header-right|user-avatar|profile-avatar)\b"


def in_view(b: Column, width: Column, height: Column) -> Column:
    """Whether a box shows in the viewport and is not a speck; touching the edge from outside does not count."""
    return (bottom(b) > 0) & (right(b) > 0) & (b["y"] < height) & (b["x"] < width) & (b["width"] >= LEAST_SIZE) & (b["height"] >= LEAST_SIZE)


def structural(tag: Column, block_child: Column) -> Column:
    """Whether an element only holds others: parts of tables, and containers with a block as a child."""
    t = F.lower(tag)
    return t.isin(*TABLE_PARTS) | (t.isin(*CONTAINERS) & F.coalesce(block_child, F.lit(False)))


def visible(elements: DataFrame, viewports: DataFrame | None = None) -> DataFrame:
    """The elements that can be seen; with viewports(page_id, css_w, css_h) also only those in view. elements: hidden, and bbox for the viewport."""
    own = elements.where("not coalesce(hidden, false)")
    if viewports is None:
        return own
    v = viewports.select(F.col("page_id").alias("_p"), "css_w", "css_h")
    return own.join(v, F.col("page_id") == F.col("_p")).where(in_view(F.col("bbox"), F.col("css_w"), F.col("css_h"))).drop("_p", "css_w", "css_h")


def context_labels(elements: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """elements with context: what names an element that is no form field.

    The header of its column, else the text that stands before it in its parent, else the label right before it, else the first term of its
    list, else its aria-label or title. elements: page_id, elem_idx, tag, parent_idx, attrs, text, prev_text, prev_label. headers(page_id, elem_idx, header)
    as lookup.table_headers() gives them.
    """
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    lists = elements.where("tag = 'dt'").groupBy(F.col("page_id").alias("_p"), F.col("parent_idx").alias("_l")).agg(F.min_by("text", "elem_idx").alias("_term"))
    out = elements.join(lists, (F.col("page_id") == F.col("_p")) & F.col("parent_idx").eqNullSafe(F.col("_l")) & (F.col("tag") == "dd"), "left").drop("_p", "_l")
    if headers is not None:
        out = out.join(headers.select("page_id", "elem_idx", F.col("header").alias("_header")), ["page_id", "elem_idx"], "left")
    own = F.coalesce(some(F.col("_header")) if headers is not None else F.lit(None), some(F.col("prev_text")), some(F.col("prev_label")), some(F.col("_term")), some(F.col("attrs")["aria-label"]), some(F.col("attrs")["title"]), F.lit(""))
    return out.withColumn("context", F.when(~F.col("tag").isin(*FIELDS), own)).drop("_term", "_header")


def row_text_before(elements: DataFrame) -> DataFrame:
    """elements with before: the texts of the earlier children of their parent, joined, at most the last 100 characters."""
    w = Window.partitionBy("page_id", "parent_idx").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)
    texts = F.array_join(F.filter(F.collect_list("text").over(w), lambda t: t != ""), " ")
    return elements.withColumn("before", F.right(texts, F.lit(100)))


def near_names(elements: DataFrame) -> DataFrame:
    """elements with meta, the names of an element, its parent and its grandparent, and with the classes of itself and its parent."""
    get = lambda n: F.coalesce(F.col("attrs")[n], F.lit(""))
    outer = F.concat_ws(" ", get("class"), get("id"), get("aria-label"), get("title"), get("href"))
    up = elements.select(F.col("page_id").alias("_p"), F.col("elem_idx").alias("_i"), F.col("parent_idx").alias("_up"), outer.alias("_outer"), get("class").alias("_class"))
    far = up.select(F.col("_p").alias("_q"), F.col("_i").alias("_j"), F.col("_outer").alias("_far"))
    both = elements.join(up, (F.col("page_id") == F.col("_p")) & (F.col("parent_idx") == F.col("_i")), "left").join(far, (F.col("page_id") == F.col("_q")) & (F.col("_up") == F.col("_j")), "left")
    own = F.concat_ws(" ", *[get(n) for n in ("class", "id", "alt", "title", "aria-label", "src", "href")])
    return both.withColumns({"meta": F.lower(F.concat_ws(" ", own, "_outer", "_far")), "classes": F.lower(F.concat_ws(" ", get("class"), "_class"))}).drop("_p", "_i", "_up", "_outer", "_class", "_q", "_j", "_far")


def avatars(elements: DataFrame) -> DataFrame:
    """elements (page_id, elem_idx, tag, attrs, meta, classes, bbox, css_w) with is_pixel, is_avatar, avatar_confidence and avatar_reason.

    An avatar is small and is named like one; or it is small, about square, in a bar or the top right corner, and round, named for a user, or a picture in that corner. Where elements have the looks of
    styles.page_tree(), radius and background, round is also what its style makes round, and an element of that size and place with a picture behind it is a picture.
    """
    b, meta = F.col("bbox"), F.col("meta")
    ratio = b["width"] / F.when(b["height"] == 0, 1).otherwise(b["height"])
    square, small = ratio.between(0.60, 1.65), b["width"].between(16, 200) & b["height"].between(16, 200)
    corner = (b["y"] <= BAR) & (b["x"] > F.col("css_w") * 0.5)
    bar = F.col("tag").isin("header", "nav") | F.rlike("classes", F.lit(BAR_WORDS))
    pixel = F.col("tag").isin(*PICTURES) | (F.coalesce(F.col("attrs")["role"], F.lit("")) == "img")
    named = small & F.rlike(meta, F.lit(AVATAR_WORDS))
    place = square & small & (corner | bar)
    round_ = F.rlike("classes", F.lit(ROUND))
    if "radius" in elements.columns:
        edge = F.coalesce("radius", F.lit(""))
        round_ |= F.contains(edge, F.lit("50%")) | F.coalesce(F.regexp_extract(edge, r"^([0-9]+(?:\.[0-9]+)?)(?:px)?(?:\s|\z)", 1).try_cast("double") >= b["width"] * ROUND_SHARE, F.lit(False))
    if "background" in elements.columns:
        pixel |= square & small & F.contains(F.coalesce("background", F.lit("")), F.lit("url(")) & (F.rlike(meta, F.lit(AVATAR_WORDS)) | corner | bar)
    circle = place & round_
    user = place & F.rlike(meta, F.lit(USER_WORDS))
    top = place & (F.col("tag") == "img") & corner
    reason = F.when(named, "avatar_keywords").when(circle, "circular_header_avatar").when(user, "header_user_avatar").when(top, "top_corner_profile_image")
    sure = F.when(named | circle, 0.98).when(user, 0.96).when(top, 0.92).otherwise(0.0)
    return elements.withColumns({"avatar_reason": F.coalesce(reason, F.lit("")), "avatar_confidence": F.coalesce(sure, F.lit(0.0)), "is_avatar": reason.isNotNull(), "is_pixel": F.coalesce(pixel | reason.isNotNull(), F.lit(False))})


def pixel_regions(elements: DataFrame) -> DataFrame:
    """(page_id, region_idx, region_id, elem_idx, tag, src, alt, bbox, area, avatar columns): the pictures of a page, numbered in order."""
    w = Window.partitionBy("page_id").orderBy("elem_idx")
    rows = elements.where("is_pixel and bbox is not null").withColumn("region_idx", F.row_number().over(w).cast("long"))
    return rows.select(
        "page_id", "region_idx", F.concat(F.lit("region_"), F.col("region_idx")).alias("region_id"), "elem_idx", "tag", F.col("attrs")["src"].alias("src"), F.coalesce(F.col("attrs")["alt"], F.lit("")).alias("alt"), "bbox",
        area(F.col("bbox")).cast("long").alias("area"), "is_avatar", "avatar_confidence", "avatar_reason",
    )


def headed_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_id, elem_idx, header) for context_labels(): cells(page_id, elem_idx, table_id, col_idx, x, width) under headers(table_id, th_idx, x, width, text)."""
    return table_headers(cells, headers).select("page_id", "elem_idx", "header")


#: Choices that are kept: suggestions of a search field, options of a list.
SUGGESTIONS, OPTIONS = 10, 20


def with_widgets(elements: DataFrame, widgets: DataFrame) -> DataFrame:
    """elements with widget_type, form_control, travel_role, suggestions and options of the composite widgets whose inner field they are; fields that only widgets know follow as rows of their own.

    elements: page_id, element_id, name, input_type. widgets: page_id, element_id, widget_type, form_control, suggestions (array of texts), options (array of struct index, value, text).
    """
    w = widgets.dropDuplicates(["page_id", "element_id"])
    control = F.lower(F.coalesce("form_control", F.lit("")))
    role = F.when(F.contains(control, F.lit("from")) | F.contains(control, F.lit("origin")), "origin").when(F.contains(control, F.lit("to")) | F.contains(control, F.lit("destination")), "destination")
    some = lambda c, n: F.when(F.size(c) > 0, F.slice(c, 1, n))
    texts = F.filter(F.transform("suggestions", lambda t: F.trim(t)), lambda t: t != "")
    ready = w.select(
        "page_id", "element_id", "widget_type", F.nullif(control, F.lit("")).alias("form_control"), role.alias("travel_role"), F.when(F.col("widget_type") == "autocomplete", some(texts, SUGGESTIONS)).alias("suggestions"),
        F.when(F.col("widget_type") == "dropdown", some(F.filter("options", lambda o: F.trim(o["text"]) != ""), OPTIONS)).alias("options"),
    )
    out = elements.join(ready, ["page_id", "element_id"], "full")
    kind = F.when(F.col("options").isNotNull(), "custom-select").when(F.col("widget_type") == "datepicker", F.coalesce(F.nullif("input_type", F.lit("")), F.lit("date"))).otherwise(F.col("input_type"))
    return out.withColumns({"name": F.coalesce(F.nullif("name", F.lit("")), F.col("form_control")), "input_type": kind})
