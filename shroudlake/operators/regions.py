"""Picture regions: which are worth reading or searching for faces, faces decoded and merged, redactions checked, detections by decision and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX, area, box, iou, rounded, union
from .rank import top_regions
from .wording import let

#: Fixed values.
READ_WIDTH, READ_HEIGHT, READ_AREA, READ_REGIONS = 60, 25, 5_000_000, 4
FACE_SIZE, FACE_SCORE, FACE_LEAST, FACE_SAME = 16, 0.45, 6, 0.30
EXPANSION, EXPANSIONS = 0.25, 3


def readable(tag: Column, b: Column, size: Column) -> Column:
    """Whether a region is worth reading: large enough and not huge, a canvas or a picture that is no small square."""
    t = F.upper(F.coalesce(tag, F.lit("")))
    square = (t == "IMG") & (b["width"] < 140) & (b["height"] < 140) & (F.abs(b["width"] - b["height"]) < 25)
    sized = (b["width"] >= READ_WIDTH) & (b["height"] >= READ_HEIGHT) & ~F.coalesce(size > READ_AREA, F.lit(False))
    return F.coalesce(b.isNotNull() & sized & ((t == "CANVAS") | (~t.isin("SVG", "VIDEO", "IFRAME") & ~square)), F.lit(False))


def regions_to_read(regions: DataFrame, n: int = READ_REGIONS) -> DataFrame:
    """The first n readable regions(page_id, region_idx, tag, bbox, area) of each page: canvases, then the largest."""
    own = regions.where(readable(F.col("tag"), F.col("bbox"), F.col("area")))
    return top_regions(own.withColumn("area", area(F.col("bbox"))), n, F.upper("tag") == "CANVAS")


def crop_shape(width: Column, height: Column) -> Column:
    """Whether a crop can hold lines of text: not too small, not a thin strip."""
    low, high = F.least(width, height), F.greatest(width, height)
    return (low >= 25) & (width >= 50) & (high / F.greatest(low, F.lit(1)) <= 8)


def may_show_faces(b: Column, is_avatar: Column) -> Column:
    ratio = b["width"] / F.when(b["height"] == 0, 1).otherwise(b["height"])
    sized = (b["width"] >= FACE_SIZE) & (b["height"] >= FACE_SIZE) & ratio.between(0.16, 6.0)
    return F.coalesce(b.isNotNull() & (F.coalesce(is_avatar, F.lit(False)) | sized), F.lit(False))


def decoded_faces(scores: Column, boxes: Column, region: Column) -> Column:
    """array<struct<bbox, confidence>>: the faces of a detector's output, in picture coordinates and with room around the head.

    scores has two numbers for each candidate (none, face), boxes four (left, top, right, bottom as shares of the region).
    """
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double")))

    def face(i: Column) -> Column:
        x1, y1, x2, y2 = (unit(F.get(boxes, i * 4 + k)) for k in range(4))
        return F.struct(
            F.get(scores, i * 2 + 1).cast("double").alias("confidence"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), rounded(region["x"] + x1 * region["width"]).alias("x"),
            rounded(region["y"] + y1 * region["height"]).alias("y"), rounded((x2 - x1) * region["width"]).alias("w"), rounded((y2 - y1) * region["height"]).alias("h"),
        )

    n = F.floor(F.size(scores) / 2).cast("int")
    some = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    good = F.filter(F.transform(some, face), lambda f: (f["confidence"] >= FACE_SCORE) & (f["x2"] > f["x1"]) & (f["y2"] > f["y1"]) & (f["w"] >= FACE_LEAST) & (f["h"] >= FACE_LEAST))

    def with_room(f: Column) -> Column:
        px, py = rounded(f["w"] * 0.15), rounded(f["h"] * 0.20)
        return F.struct(box(F.greatest(F.lit(0), f["x"] - px), F.greatest(F.lit(0), f["y"] - py), f["w"] + px * 2, f["h"] + py * 2).alias("bbox"), f["confidence"].alias("confidence"))

    return F.transform(good, with_room)


def merged_faces(found: Column, full: Column) -> Column:
    """Faces (array<struct<bbox, confidence>>) of regions and of the whole picture as one list: each of the latter joins the first that it overlaps, which grows, else it is added."""

    def put(faces: Column, f: Column) -> Column:
        spot = F.array_position(F.transform(faces, lambda e: iou(e["bbox"], f["bbox"]) > FACE_SAME), True)
        grown = lambda e: F.struct(union(e["bbox"], f["bbox"]).alias("bbox"), F.greatest(e["confidence"], f["confidence"]).alias("confidence"))
        return F.when(spot > 0, F.transform(faces, lambda e, i: F.when(i == spot - 1, grown(e)).otherwise(e))).otherwise(F.concat(faces, F.array(f)))

    return F.aggregate(F.filter(full, lambda f: f["bbox"].isNotNull()), found, put)


def all_black(pixels: Column) -> Column:
    """Whether pixels (array of struct r, g, b, a) are all opaque black; none are."""
    return F.forall(pixels, lambda p: (p["r"] == 0) & (p["g"] == 0) & (p["b"] == 0) & (p["a"] == 255))


def grown(b: Column, width: Column, height: Column) -> Column:
    """A redaction box a quarter larger, half of that to each side, within the picture."""
    x = F.greatest(F.lit(0), rounded(b["x"] - b["width"] * (EXPANSION / 2)))
    y = F.greatest(F.lit(0), rounded(b["y"] - b["height"] * (EXPANSION / 2)))
    return box(x, y, F.least(width - x, rounded(b["width"] * (1 + EXPANSION))), F.least(height - y, rounded(b["height"] * (1 + EXPANSION))))


def verified(b: Column, width: Column, height: Column, clean: Column) -> Column:
    """struct<bbox, passed, expansions> of a redaction; null for one outside the picture.

    clean[k] tells whether the box is all black after k expansions (the pixels are looked at elsewhere). Where it is not clean at first
    it grows until it is, EXPANSIONS times at most; a box that never gets clean keeps its first place.
    """
    x = F.greatest(F.lit(0), F.least(b["x"], width - 1))
    y = F.greatest(F.lit(0), F.least(b["y"], height - 1))
    first = box(x, y, F.least(b["width"], width - x), F.least(b["height"], height - y))
    start = F.struct(first.alias("bbox"), F.coalesce(F.get(clean, F.lit(0)), F.lit(False)).alias("passed"), F.lit(0).alias("expansions"))

    def step(acc: Column, k: Column) -> Column:
        more = F.struct(grown(acc["bbox"], width, height).alias("bbox"), F.coalesce(F.get(clean, k), F.lit(False)).alias("passed"), k.alias("expansions"))
        return F.when(acc["passed"], acc).otherwise(more)

    kept = lambda end: F.struct(F.when(end["passed"] & (end["expansions"] > 0), end["bbox"]).otherwise(b).alias("bbox"), end["passed"].alias("passed"), end["expansions"].alias("expansions"))
    return F.when((first["width"] > 0) & (first["height"] > 0), let(F.aggregate(F.lit(list(range(1, EXPANSIONS + 1))), start, step), kept))


def by_decision(found: DataFrame) -> DataFrame:
    """(page_id, redactions, reviews, kept): each page's detections by decision, as lists of cand_seq in order."""
    part = lambda d, name: F.sort_array(F.collect_list(F.when(F.col("decision") == d, F.col("cand_seq")))).alias(name)
    return found.groupBy("page_id").agg(part("REDACT", "redactions"), part("REVIEW", "reviews"), part("KEEP", "kept"))


def by_reason(regions: DataFrame) -> DataFrame:
    """(page_id, total, by_type): the summary for results that bring none: redacted regions counted by their reason."""
    each = regions.groupBy("page_id", F.col("reason").alias("k")).agg(F.count("*").alias("n"))
    return each.groupBy("page_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("by_type"))


#: What a reason is about, by the first text that it holds; the start counts only where a colon ends it.
REASONS = (
    ("form_field_anchor:signature", "signature_field"), ("form_field_anchor:imei", "device_field"), ("form_field_anchor:mobile", "phone_field"), ("form_field_anchor:customer_name", "name_field"),
    ("checksum_valid", "checksum"), ("aadhaar_vid", "virtual_id"), ("aadhaar_name_dob", "holder_name"), ("relative_guardian_name", "guardian_name"), ("address_labeled", "address"), ("name_labeled", "labelled_name"),
    ("indian_name", "given_name"), ("hindi_name", "script_name"), ("common_name", "common_name"), ("dob", "birth_date"), ("phone", "phone"), ("email", "email"), ("pan", "pan"), ("gstin", "gstin"),
    ("face", "face"), ("onnx", "face"), ("rfb320", "face"), ("password", "password"), ("financial", "bank_code"), ("ifsc", "bank_code"), ("apitoken", "secret"), ("jwt", "secret"),
)


def reason_key(reason: Column, kind: Column) -> Column:
    """What a detection's reason is about, as a key that a screen has words for: document_shield:KIND, one of REASONS, ocr_regex:RULE, regex:RULE, or the reason itself."""
    r = F.lower(F.coalesce(reason, F.lit("")))
    none = F.when(kind == "face", "face").when(kind == "password", "password").when(kind == "identity_document", "identity_document").otherwise("personal_data")
    number = F.when(kind == "aadhaar", "checksum_verhoeff").when(F.lower(kind).isin("creditcard", "credit_card"), "checksum_luhn").otherwise("checksum")
    out = F.when(r == "", none).when(F.startswith(r, F.lit("document_shield:")), r)
    for text, key in REASONS:
        out = out.when(F.contains(r, F.lit(text)), number if key == "checksum" else F.lit(key))
    return out.when(F.startswith(r, F.lit("ocr_regex:")) | F.startswith(r, F.lit("regex:")), r).otherwise(reason)


NO_FACES = f"cast(array() as array<struct<bbox:{BOX},confidence:double>>)"
