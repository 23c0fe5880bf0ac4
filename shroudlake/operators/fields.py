"""What form fields hold, and boxes and words laid out in lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bottom, box, right, rounded, union
from ..functions.lineage import paired
from .detect import detect_pii
from .rank import says

#: Autocomplete names of personal fields, and name parts in order with what they mean.
AUTOCOMPLETE = (
    "name given-name family-name email tel tel-national cc-name cc-number cc-exp cc-exp-month cc-exp-year cc-csc address-line1 address-line2 address-level1 address-level2 postal-code country bday bday-day bday-month bday-year "
    "sex username new-password current-password one-time-code"
).split()
KEYWORDS = (
    ("ssn", "ssn"), ("social_security", "sensitive_field"), ("aadhaar", "aadhaar"), ("aadhar", "aadhaar"), ("pan", "pan"), ("cvv", "creditCard"), ("cvc", "sensitive_field"), ("salary", "sensitive_field"), ("dob", "dob"), ("birth", "dob"),
    ("account", "sensitive_field"), ("password", "password"), ("passwd", "password"), ("pwd", "sensitive_field"), ("pin", "sensitive_field"), ("otp", "sensitive_field"), ("credit_card", "creditCard"), ("card_number", "creditCard"),
    ("income", "sensitive_field"), ("username", "username"), ("user_name", "username"), ("user_id", "username"), ("userid", "username"), ("login", "username"), ("roll_no", "username"), ("rollno", "username"), ("enrollment", "username"),
    ("student_id", "username"), ("ifsc", "financial"), ("routing", "financial"), ("swift", "financial"),
)


def typed_fields(elements: DataFrame) -> DataFrame:
    """(page_id, elem_idx, type, confidence, reason, text, original_value) of inputs that hold personal data.

    elements: page_id, elem_idx, tag, input_type, autocomplete, name, id, class_name, label, value. The input type counts first, an autocomplete name
    overrides it; without either the first keyword in list order, and without that the first rule that matches the value.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    ctx = F.concat_ws(" ", c("name"), c("id"), c("class_name"), c("label"))
    kind, auto = F.lower(c("input_type")), F.lower(c("autocomplete"))
    s = lambda t, v, why: F.struct(F.lit(t).alias("type"), F.lit(v).alias("confidence"), why.alias("reason"))
    given = (
        F.when(kind == "password", s("password", 1.0, F.lit("input[type=password]"))).when(kind == "email", s("email", 0.90, F.lit("input[type=email]"))).when(kind == "tel", s("phone", 0.90, F.lit("input[type=tel]")))
        .when((kind == "number") & says(ctx, "card|cc|cvv|account"), s("creditCard", 0.90, F.lit("input[type=number] with card keyword")))
    )
    meant = F.when(F.contains(auto, F.lit("cc")), "creditCard").when(F.contains(auto, F.lit("tel")), "phone").when(F.contains(auto, F.lit("bday")), "dob").otherwise("pii_input")
    override = F.when(auto.isin(AUTOCOMPLETE), F.struct(meant.alias("type"), F.greatest(F.coalesce(given["confidence"], F.lit(0.0)), F.lit(0.95)).alias("confidence"), F.concat(F.lit("autocomplete="), F.col("autocomplete")).alias("reason")))
    low = F.lower(ctx)
    word = F.coalesce(*[F.when(F.contains(low, F.lit(w)), s(t, 0.85, F.lit(f"keyword:{w}"))) for w, t in KEYWORDS])
    inputs = elements.where(F.lower("tag").isin("input", "textarea", "select")).withColumn("_f", F.coalesce(override, given, word)).withColumn("_ctx", ctx)
    found = detect_pii(inputs.where("_f is null and length(trim(value)) >= 3").withColumn("_v", F.trim("value")), ["page_id", "elem_idx"], "_v", "_ctx")
    first = found.groupBy("page_id", "elem_idx").agg(F.min_by(F.struct("type", "confidence", F.concat(F.lit("value:"), F.col("rule")).alias("reason")), F.struct("rule_ord", "start")).alias("_m"))
    out = paired(inputs, first, ["page_id", "elem_idx"], "left").withColumn("_r", F.coalesce("_f", "_m")).where("_r is not null")
    return out.select("page_id", "elem_idx", "_r.*", F.when(c("value") != "", "[MASKED VALUE]").otherwise("").alias("text"), c("value").alias("original_value"))


def merged_lines(boxes: Column) -> Column:
    """Boxes, top to bottom and left to right, joined to the first line they overlap by 40 % of the lower height at a small gap."""
    full = F.filter(boxes, lambda b: (b["width"] > 0) & (b["height"] > 0))
    order = F.transform(F.array_sort(F.transform(full, lambda b, i: F.struct(b["y"].alias("y"), b["x"].alias("x"), i.alias("i"), b.alias("b")))), lambda o: o["b"])

    def fits(line: Column, b: Column) -> Column:
        low = F.least(line["height"], b["height"])
        over = F.least(bottom(line), bottom(b)) - F.greatest(line["y"], b["y"])
        gap = F.greatest(F.lit(0), F.greatest(line["x"], b["x"]) - F.least(right(line), right(b)))
        return (over >= low * 0.40) & (gap <= F.greatest(F.lit(18.0), low * 1.2))

    def put(lines: Column, b: Column) -> Column:
        spot = F.array_position(F.transform(lines, lambda x: fits(x, b)), True)
        return F.when(spot > 0, F.transform(lines, lambda x, i: F.when(i == spot - 1, union(x, b)).otherwise(x))).otherwise(F.concat(lines, F.array(b)))

    return F.aggregate(order, F.slice(order, 1, 0), put)


def placed_words(words: DataFrame, pad: int = 30) -> DataFrame:
    """Words as recognition returns them, brought back to the picture: words(page_id, region_idx, line_index, word_index, text, confidence 0..100 or null, x0, y0, x1, y1, scale, region_x, region_y).

    A crop was padded by ``pad`` and scaled by scale; weak and empty words go, confidence becomes a share.
    """
    back = lambda c: F.col(c) / F.col("scale")
    good = words.where("(confidence is null or confidence > 5) and trim(text) <> ''")
    at = lambda c, off: F.col(off) + rounded((F.col(c) - pad) / F.col("scale"))
    size = lambda a, b: F.greatest(F.lit(1), rounded(back(b) - back(a)))
    b = box(at("x0", "region_x"), at("y0", "region_y"), size("x0", "x1"), size("y0", "y1"))
    return good.select("page_id", "region_idx", "line_index", "word_index", F.trim("text").alias("text"), (F.coalesce("confidence", F.lit(80)) / 100).alias("confidence"), b.alias("bbox"))


def read_words(words: DataFrame) -> DataFrame:
    """(page_id, region_idx, line_index, text, confidence): recognised words with a line number put together; weak words go."""
    good = words.where("confidence > 0.05 and trim(text) <> ''")
    lines = good.groupBy("page_id", "region_idx", "line_index").agg(F.sort_array(F.collect_list(F.struct("word_index", "word_idx", F.trim("text").alias("t")))).alias("w"), F.avg("confidence").alias("confidence"))
    return lines.select("page_id", "region_idx", "line_index", F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("text"), "confidence")


def region_text(lines: DataFrame) -> DataFrame:
    """(page_id, raw_text): the regions' lines under headers, in order."""
    each = lines.groupBy("page_id", "region_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "text"))), lambda x: x["text"]), "\n").alias("t"))
    head = F.concat(F.lit("[region "), F.col("region_idx"), F.lit("]\n"), F.col("t"))
    return each.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("region_idx", head.alias("h")))), lambda x: x["h"]), "\n\n").alias("raw_text"))
