"""Golden rows of field typing and lines."""

from pyspark.sql import functions as F

from shroudlake.functions.geometry import BOX
from shroudlake.operators import fields

COLS = "page_id int, elem_idx int, tag string, input_type string, autocomplete string, name string, id string, class_name string, label string, value string"


def test_typed_fields(spark):
    rows = [
        (1, 0, "input", "password", "current-password", None, None, None, None, "x"), (1, 1, "input", "text", None, "company", None, None, None, None), (1, 2, "input", "text", None, "city", None, None, None, "4111111111111111"),
        (1, 3, "input", "email", None, None, None, None, None, None), (1, 4, "div", None, None, "ssn", None, None, None, None), (1, 5, "input", None, None, "q", None, None, None, "zz"),
    ]
    got = {r.elem_idx: (r.type, r.confidence, r.text) for r in fields.typed_fields(spark.createDataFrame(rows, COLS)).collect()}
    assert got == {0: ("pii_input", 1.0, "[MASKED VALUE]"), 1: ("pan", 0.85, ""), 2: ("creditCard", 1.0, "[MASKED VALUE]"), 3: ("email", 0.9, "")}


def test_lines(spark):
    df = spark.createDataFrame([([(0, 0, 40, 20), (50, 0, 40, 20), (200, 0, 40, 20), (0, 0, 0, 5)],)], f"b array<{BOX}>")
    assert [tuple(x) for x in df.select(fields.merged_lines(F.col("b")).alias("l")).first().l] == [(0, 0, 90, 20), (200, 0, 40, 20)]
    words = spark.createDataFrame([(1, 0, 0, "b", 0.9, 0, 1), (1, 0, 1, "a ", 0.9, 0, 0), (1, 0, 2, "c", 0.9, 1, 0), (1, 0, 3, "weak", 0.01, 1, 1)], "page_id int, region_idx int, word_idx int, text string, confidence double, line_index int, word_index int")
    assert fields.region_text(fields.read_words(words)).first().raw_text == "[region 0]\na b\nc"
