"""Golden rows of the detection rules, sanitizing and checksums."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shroudlake.functions.checksum import luhn, verhoeff
from shroudlake.functions.text import replace_spans, spans
from shroudlake.operators import sanitize
from shroudlake.operators.detect import clamp_confidence, detect_pii

CASES = {
    "a.b@example.com": [("email", 0.92, "REDACT")],
    "x@mail5.example.com": [("email", 1.0, "REDACT")],
    "4111111111111111": [("credit_card", 1.0, "REDACT")],
    "4111111111111112": [],
    "2341 2341 2346": [("aadhaar", 1.0, "REDACT")],
    "2341 2341 2345": [],
    "order id: 2341 2341 2346": [],
    "ABCPE1234F": [("pan", 0.7, "REDACT")],
    "ABCDE1234F": [],
    "123-45-6789": [("ssn", 0.85, "REDACT")],
    "666-45-6789": [],
    "born 05/11/1990": [("dob", 1.0, "REDACT")],
    "due 05/11/1990": [],
    "server 8.8.4.4": [("ip_address", 1.0, "REDACT")],
    "8.8.4.4": [],
    "server 10.0.0.5": [],
    "356938035643809": [("credit_card", 1.0, "REDACT"), ("imei_number", 1.0, "REDACT")],
    "": [],
}


def test_golden_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "id int, text string")
    got = {}
    for r in detect_pii(df, ["id"]).orderBy("id", "rule_ord", "start").collect():
        got.setdefault(r.id, []).append((r.rule, round(r.confidence, 4), r.decision))
    for i, (text, want) in enumerate(CASES.items()):
        assert got.get(i, []) == want, text


def test_overlapping_phones_both_stay(spark):
    df = spark.createDataFrame([(1, "call +1 (743) 555-3824")], "id int, text string")
    assert [r.rule for r in detect_pii(df, ["id"]).orderBy("rule_ord").collect()] == ["phone_e164", "phone_us_intl"]


def test_context_rejects_card(spark):
    df = spark.createDataFrame([(1, "id 4111111111111111", "imei")], "id int, text string, ctx string")
    assert "credit_card" not in [r.rule for r in detect_pii(df, ["id"], context="ctx").collect()]


def test_spans_in_code_points_and_ascii_boundaries(spark):
    df = spark.createDataFrame([("😀 n22 n7",)], "t string").select(F.inline(spans(F.col("t"), "n[0-9]+")))
    assert [(r.s, r.e, r.m) for r in df.collect()] == [(2, 5, "n22"), (6, 8, "n7")]


def test_redaction_modes(spark):
    df = spark.createDataFrame([(1, "mail a.b@example.com now"), (2, None), (3, "x +1 (743) 555-3824 y")], "id int, text string")
    merged = {r.id: r.sanitized for r in sanitize.redact_text(df, "id", mode="merged").collect()}
    assert merged == {1: "mail [REDACTED] now", 2: "", 3: "x [REDACTED] y"}
    marks = F.array(F.struct(F.lit(0).alias("s"), F.lit(3).alias("e")), F.struct(F.lit(2).alias("s"), F.lit(5).alias("e")))
    both = spark.range(1).select(replace_spans(F.lit("abcdefg"), marks, "#", "compat").alias("c"), replace_spans(F.lit("abcdefg"), marks, "#", "merged").alias("m")).first()
    assert (both.c, both.m) == ("#fg", "#fg")


def test_confidence_clamp(spark):
    df = spark.createDataFrame([(0.0,), (None,), (2.0,), (-1.0,), (0.3,)], "c double").select(clamp_confidence(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == [0.5, 0.5, 1.0, 0.0, 0.3]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("0123456789", min_size=11, max_size=15), min_size=1, max_size=20))
def test_checksums_catch_single_digits(spark, numbers):
    def check(d):
        return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    df = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", luhn(F.col("n")).alias("ok"))
    assert all(r.ok == (len(r.n) >= 13 and check(r.n)) for r in df.collect())


def test_verhoeff(spark):
    changed = ["234123412346"] + ["2341234123" + str(d) + "6" for d in range(10) if d != 4]
    df = spark.createDataFrame([(c,) for c in changed], "n string").select(verhoeff(F.col("n")).alias("ok"))
    assert [r.ok for r in df.collect()] == [True] + [False] * 9
