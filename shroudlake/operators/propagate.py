"""Evidence that spreads: confirmed values to other elements, regions and avatars to shields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import paired
from ..functions.text import dialect
from .rules import has

#: Texts that are a heading, words of a field label, and the types whose values are identifiers.
HEADINGS = (
    "first name", "firstname", "last name", "lastname", "full name", "fullname", "name", "student", "update", "successful", "unsuccessful", "initiated", "shipped", "upi", "payment", "home", "dashboard",
    "result", "search", "tokens", "token", "side", "ocr", "validation", "pipeline", "english", "hindi", "document", "today", "yesterday", "video", "photo",
)
LABEL_WORDS = (
    "aadhaar", "aadhar", "pan", "ssn", "ifsc", "cvv", "cvc", "salary", "permanent", "account", "number", "security", "code", "branch", "bank", "date", "birth", "card", "payment", "mob", "mobile", "phone",
    "contact", "email", "address", "order", "invoice", "vid", "dob",
)
IDENTIFIER_TYPES = ("username", "password", "aadhaar", "pan")
ID_COLUMN, NAME_COLUMN = r"roll|student\s*id|enroll|reg\s*no", r"first\s*name|last\s*name|full\s*name|student\s*name"
ID_FIELD = "roll|student|user|login|enroll|reg|account"
SURE, SURE_SEEN, SPREAD = 0.80, 0.88, 0.95


def is_label(value: Column) -> Column:
    """A heading as a whole (with any spaces between its words), or a text with a word of a field label."""
    return F.regexp_replace(F.lower(value), r"\s+", "").isin(*[h.replace(" ", "") for h in HEADINGS]) | has(value, "|".join(LABEL_WORDS))


def identifier_like(value: Column) -> Column:
    return (F.length(value) >= 4) & ~F.contains(value, F.lit(" ")) & F.rlike(value, F.lit("[0-9]"))


def confirmed(candidates: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, kind, value): the identifiers and names that a page is sure of.

    candidates: page_id, type, source, text, original_value, confidence. Of the page's elements those of SURE: types of IDENTIFIER_TYPES
    with a digit and no space, and names; of recognised text (source ocr) names of SURE_SEEN. elements: page_id, tag, is_header, label, name, id,
    placeholder, text, value, is_sensitive: values of sensitive or identifier fields, and cells under identifier and name columns.
    """
    full = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    as_rows = lambda df, *pairs: df.select("page_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.when(test, v).alias("value")) for k, v, test in pairs]))).where("value is not null")
    text, given = full("text"), F.trim(F.coalesce(F.when(full("original_value") != "", F.col("original_value")), F.when(full("text") != "[MASKED VALUE]", F.col("text")), F.lit("")))
    page, name = F.col("source") != "ocr", (F.col("type") == "name") & (F.length(text) >= 3) & ~is_label(text)
    a = as_rows(
        candidates, ("identifier", given, page & (F.col("confidence") >= SURE) & F.col("type").isin(*IDENTIFIER_TYPES) & identifier_like(given)),
        ("name", text, name & F.when(page, F.col("confidence") >= SURE).otherwise(F.col("confidence") >= SURE_SEEN)),
    )
    value, label = full("value"), full("label")
    place = F.coalesce(*[F.when(full(c) != "", full(c)) for c in ("label", "name", "id", "placeholder")], F.lit(""))
    field = F.coalesce("is_sensitive", F.lit(False)) | F.rlike(place, F.lit(f"(?i){ID_FIELD}"))
    body = elements.where("not coalesce(is_header, false) and coalesce(tag, '') <> 'th'")
    b = as_rows(
        body, ("identifier", value, field & identifier_like(value)),
        ("identifier", text, F.rlike(label, F.lit(f"(?i){ID_COLUMN}")) & F.length(text).between(6, 25) & F.rlike(text, F.lit("[0-9]")) & ~F.rlike(text, F.lit("(?i)roll"))),
        ("name", text, F.rlike(label, F.lit(f"(?i){NAME_COLUMN}")) & F.length(text).between(2, 40) & ~is_label(text)),
    )
    return a.unionByName(b).repartition("page_id").distinct()  # by page, as what follows is


#: Code points of the pieces by which values are sought, and the values of a page up to which each of its texts is compared with all of them.
PIECE, FEW_VALUES = 4, 64


def pieces(text: Column, size: Column) -> Column:
    """The distinct stretches of a text of so many code points."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size))))


def holders(values: DataFrame, elements: DataFrame, few: int = FEW_VALUES) -> DataFrame:
    """(page_id, elem_idx, kind, value): the elements(page_id, elem_idx, text) of each page whose text holds a value of values(page_id, kind, value).

    The values of a page that has at most ``few`` come to its texts as one row, so texts are exchanged once. Texts of other pages are cut into all their stretches of PIECE code points (of fewer where a
    page has shorter values), a value stands under one of its own, the one with the least hash; the two are joined, and what meets is looked at. So a page with many values and many elements costs as
    much as its texts are long, not each value against each element. Empty values are held by nothing.
    """
    texts = elements.select("page_id", "elem_idx", "text")
    v = values.where(F.length("value") > 0).select("page_id", "kind", "value").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("page_id")))
    lists = v.where(F.col("_n") <= few).groupBy("page_id").agg(F.collect_list(F.struct("kind", "value")).alias("_v"))
    near = paired(texts, lists, "page_id").select("page_id", "elem_idx", F.inline(F.filter("_v", lambda x: F.contains("text", x["value"]))))
    many = v.where(F.col("_n") > few).select("page_id", "kind", "value", F.least(F.length("value"), F.lit(PIECE)).alias("_q"))
    sizes = many.groupBy("page_id").agg(F.collect_set("_q").alias("_q"))
    many = many.withColumn("_piece", F.array_min(F.transform(pieces(F.col("value"), F.col("_q")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
    own = paired(texts, sizes, "page_id")
    cut = own.select("page_id", "elem_idx", "text", F.explode("_q").alias("_q"))
    parts = cut.select("page_id", "elem_idx", "_q", F.explode(pieces(F.col("text"), F.col("_q"))).alias("_piece"))
    met = paired(parts, many, ["page_id", "_q", "_piece"]).select("page_id", "elem_idx", "kind", "value")
    far = paired(met, own.select("page_id", "elem_idx", "text"), ["page_id", "elem_idx"]).where(F.contains("text", F.col("value")))
    return near.unionByName(far.select("page_id", "elem_idx", "kind", "value"))


def spread(values: DataFrame, elements: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page_id, elem_idx, kind, value, confidence): further elements of a page whose text holds a confirmed value and has no candidate of that text yet."""
    known = candidates.select("page_id", "elem_idx", F.col("text").alias("value")).distinct()
    return paired(holders(values, elements), known, ["page_id", "elem_idx", "value"], "left_anti").withColumn("confidence", F.lit(SPREAD))


def _within(region: Column, b: Column, slack: int) -> Column:
    return (b["x"] >= region["x"] - slack) & (b["y"] >= region["y"] - slack) & (b["x"] + b["width"] <= region["x"] + region["width"] + slack) & (b["y"] + b["height"] <= region["y"] + region["height"] + slack)


def document_shields(regions: DataFrame, candidates: DataFrame, slack: int = 15) -> DataFrame:
    """Regions of 80 by 50 or more that hold an identity number (by type, or named in the reason) and no shield yet, each as one shield candidate."""
    c = candidates.select(F.col("page_id").alias("_p"), F.col("bbox").alias("_b"), F.coalesce("type", F.lit("")).alias("_t"), F.coalesce("reason", F.lit("")).alias("_r"))
    large = regions.where("bbox.width >= 80 and bbox.height >= 50")
    met = paired(large, c, (F.col("page_id") == F.col("_p")) & _within(F.col("bbox"), F.col("_b"), slack))
    holds = lambda kind: F.bool_or((F.col("_t") == kind) | F.contains("_r", F.lit(kind))).alias(kind)
    kinds = met.groupBy("page_id", "region_idx").agg(F.first("bbox").alias("bbox"), holds("aadhaar"), holds("pan"), F.bool_or((F.col("_t") == "identity_document") | F.startswith("_r", F.lit("document_shield:"))).alias("shielded"))
    which = F.when(F.col("aadhaar"), "aadhaar_card").when(F.col("pan"), "pan_card")
    return kinds.where(which.isNotNull() & ~F.col("shielded")).select("page_id", "region_idx", "bbox", F.lit("identity_document").alias("type"), F.lit(1.0).alias("confidence"), F.concat(F.lit("document_shield:"), which).alias("reason"))


def avatar_shields(regions: DataFrame, candidates: DataFrame, slack: int = 5) -> DataFrame:
    """Avatars whose centre lies in no candidate that is not kept, each as a face candidate."""
    c = candidates.where("coalesce(decision, '') <> 'KEEP'").select(F.col("page_id").alias("_p"), F.col("bbox").alias("_b"))
    x, y = F.col("bbox.x") + F.col("bbox.width") / 2, F.col("bbox.y") + F.col("bbox.height") / 2
    b = F.col("_b")
    inside = x.between(b["x"] - slack, b["x"] + b["width"] + slack) & y.between(b["y"] - slack, b["y"] + b["height"] + slack)
    free = paired(regions.where("is_avatar"), c, (F.col("page_id") == F.col("_p")) & inside, "left_anti")
    return free.select("page_id", "region_idx", "bbox", F.lit("face").alias("type"), F.coalesce("avatar_confidence", F.lit(0.85)).alias("confidence"), F.lit("avatar_shield").alias("reason"))


#: What shows an identity document, by kind: the number's shape, who issues it, what it calls itself, a title that settles it, other hints. Names have the letter confusions of recognised text.
INDIA = r"of\s*ind[li1|]a"
DOCUMENTS = {
    "pan": {
        "number": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
        "issuer": rf"inco?me\s*tax\s*dep|आयकर\s*विभाग|govt\.?\s*{INDIA}[^\n\r]*?(?:tax|pan|income|nsdl|utiitsl)|\b(?:nsdl|utiitsl|protean)\b",
        "name": r"permanent\s*account\s*number|स्थायी\s*लेखा\s*संख्या|\bpan\s*(?:card|no|number)\b",
        "title": r"permanent\s*account\s*number|स्थायी\s*लेखा\s*संख्या",
        "hint": "father|birth|signature|permanent",
    },
    "aadhaar": {
        "number": r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b|\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b",
        "issuer": rf"uni?que\s*identifi?cation\s*auth?ori?ty|भारतीय\s*विशिष्ट\s*पहचान|uidai|u1dai|uldai|gove?rn?me?nt\s*{INDIA}|govt\.?\s*{INDIA}|भारत\s*सरकार",
        "name": r"\b(?:aadhaar|aadhar|आधार)\b|\b(?:vid|virtual\s*id)\b|helpdesk\s*:\s*1947|\b1947\b|enrol(?:l)?ment\s*(?:no|number)|नामांकन\s*संख्या",
        "title": r"uidai|u1dai|uldai|mera\s*aadhaar|मेरा\s*आधार|meri\s*pehchan|मेरी\s*पहचान",
        "hint": "dob|birth|male|female|gender|address|s/o|d/o|w/o|enrol",
    },
    "voter_id": {
        "number": r"\b[A-Z]{3}[0-9]{7}\b",
        "issuer": rf"election\s*commission\s*{INDIA}|भारत\s*निर्वाचन\s*आयोग",
        "name": r"elector\s*photo\s*identity\s*card|मतदाता\s*फोटो\s*पहचान\s*पत्र|\b(?:epic\s*no|voter\s*id|elector\s*name)\b",
        "title": r"elector\s*photo\s*identity",
    },
    "passport": {
        "issuer": rf"republic\s*{INDIA}|भारत\s*गणराज्य|ministry\s*of\s*external\s*affairs|विदेश\s*मंत्रालय",
        "name": r"\b(?:passport|पासपोर्ट)\b|type\s*<\s*p|p\s*<\s*ind|country\s*code\s*ind|passport\s*no|पासपोर्ट\s*संख्या",
        "title": r"p\s*<\s*ind",
    },
    "driving_licence": {
        "issuer": rf"union\s*{INDIA}|transport\s*dep|motor\s*vehicles|state\s*transport|regional\s*transport|\brto\b",
        "name": r"driving\s*licen[cs]e|ड्राइविंग\s*लाइसेंस|\b(?:dl\s*no|form\s*7|authorisation\s*to\s*drive)\b",
        "title": r"driving\s*licen[cs]e",
    },
}


def document_kind(text: Column, width: Column, height: Column, found: Column | None = None) -> Column:
    """The first kind of identity document that a region's text shows; null for regions below 80 by 50.

    found: the types of the detector's matches in the region (array of strings); a match of a kind counts as its number.
    """
    body = F.coalesce(text, F.lit(""))
    kinds = F.coalesce(found, F.expr("cast(array() as array<string>)")) if found is not None else F.expr("cast(array() as array<string>)")

    def see(kind: str, part: str) -> Column:
        pattern = DOCUMENTS[kind].get(part)
        return F.rlike(body, F.lit(("" if part == "number" else "(?i)") + dialect(pattern))) if pattern else F.lit(False)

    shows = {}
    for kind in DOCUMENTS:
        number = F.array_contains(kinds, kind) | see(kind, "number")
        issuer, name, title, hint = (see(kind, part) for part in ("issuer", "name", "title", "hint"))
        shows[kind] = (issuer & name) | title
        if kind == "pan":
            shows[kind] |= number & (issuer | name | hint)
        elif kind == "aadhaar":
            shows[kind] = number | title | name | (issuer & hint)
        elif kind == "voter_id":
            shows[kind] |= number & (issuer | name)
    return F.when((width >= 80) & (height >= 50), F.coalesce(*[F.when(test, kind) for kind, test in shows.items()]))


def labels(elements: DataFrame) -> DataFrame:
    """Each input's label: its label[for], else its ancestor label, aria label, previous sibling or previous cell of up to 80 characters.

    elements: page_id, elem_idx, tag, id, for_id, text, parent_text_label, aria_label, prev_text, prev_cell.
    """
    own = elements.where("tag = 'label' and for_id is not null").groupBy("page_id", "for_id").agg(F.min_by("text", "elem_idx").alias("_own")).withColumnRenamed("for_id", "_for")
    out = paired(elements, own.withColumnRenamed("page_id", "_p"), (F.col("page_id") == F.col("_p")) & (F.col("id") == F.col("_for")), "left")
    some = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    cell = F.when(F.length(some("prev_cell")) <= 80, some("prev_cell"))
    return out.withColumn("label", F.substring(F.coalesce(some("_own"), some("parent_text_label"), some("aria_label"), some("prev_text"), cell), 1, 200)).drop("_own", "_p", "_for")


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Detector outputs in fixed order, numbered per page."""
    numbered = [p.withColumn("_o", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return both.withColumn("cand_seq", F.row_number().over(Window.partitionBy("page_id").orderBy("_o", *[c for c in ("elem_idx", "region_idx", "start") if c in both.columns])).cast("long")).drop("_o")
