"""String functions: pattern translation, exact match spans, windows, replacement of spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary, and the white space of the pattern dialect, without and with line ends.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
BLANK = r"\t\x0B\f  ﻿  -   　"
WHITE = BLANK + r"\r\n  "
OPEN, CLOSE = "\x01", "\x02"


def dialect(pattern: str) -> str:
    """A pattern with ASCII \\b, Unicode \\s and strict \\Z for Java's engine."""
    out, i, in_class = [], 0, False
    pattern = pattern.replace(r"[^\S\r\n]", f"[{BLANK}]")
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out.append(BOUNDARY)
        elif two == r"\s":
            out.append(WHITE if in_class else f"[{WHITE}]")
        elif two == r"\Z":
            out.append(r"\z")
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = True if two[0] == "[" else False if two[0] == "]" else in_class
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points, clipped to the text."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(F.least(end, F.length(text)) - low, F.lit(0)))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of all matches, left to right. The control characters 1 and 2 must not occur in text (see plain)."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("got"))

    def step(acc: Column, part: Column) -> Column:
        size = F.instr(part, CLOSE)
        found = F.struct(acc["at"].alias("s"), (acc["at"] + size - 1).alias("e"), F.substring(part, F.lit(1), size - 1).alias("m"))
        got = F.when(size > 0, F.concat(acc["got"], F.array(found))).otherwise(acc["got"])
        return F.struct((acc["at"] + F.length(part) - F.when(size > 0, 1).otherwise(0)).alias("at"), got.alias("got"))

    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(parts, empty, step)["got"])


def plain(text: Column) -> Column:
    """text without the two control characters that mark spans; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "")


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{WHITE}]+", ""), rf"[{WHITE}]+\z", "")


def stripped_over(text: Column, n: int) -> Column:
    """length(strip(text)) > n for n of 1 or more, without cutting the text."""
    return F.rlike(text, F.lit(f"(?s)[^{WHITE}]{'.' * (n - 1)}.*[^{WHITE}]"))


def replace_spans(text: Column, found: Column, marker: str = "[REDACTED]", mode: str = "compat") -> Column:
    """Spans (struct with s, e, in rule order) replaced by the marker.

    compat: by descending start, ties in the given order, each with its own offsets although earlier replacements moved the text.
    merged: overlapping spans first become one.
    """
    if mode == "compat":
        order = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["s"]).alias("k"), i.alias("i"), x["s"].alias("s"), x["e"].alias("e"))))
        return F.aggregate(order, text, lambda acc, x: F.concat(cut(acc, F.lit(0), x["s"]), F.lit(marker), F.substring(acc, x["e"] + 1, F.greatest(F.length(acc) - x["e"], F.lit(0)))))
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    fold = F.aggregate(
        order, start,
        lambda acc, x: F.when(
            x["s"] >= acc["at"],
            F.struct(x["e"].alias("at"), F.concat(acc["out"], cut(text, acc["at"], x["s"]), F.lit(marker)).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))),
    )
    return F.concat(fold["out"], cut(text, fold["at"], F.length(text)))


def mask_typed(text: Column, items: Column) -> Column:
    """Each item's text (struct text, type), the longest first, replaced everywhere by [REDACTED: TYPE]."""
    order = F.array_sort(F.transform(items, lambda x, i: F.struct((-F.length(x["text"])).alias("k"), i.alias("i"), x["text"].alias("text"), x["type"].alias("type"))))
    return F.aggregate(order, text, lambda acc, x: F.when(F.length(x["text"]) > 0, F.replace(acc, x["text"], F.concat(F.lit("[REDACTED: "), F.upper(x["type"]), F.lit("]")))).otherwise(acc))


def escape_html(text: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")), text)


def padded_id(prefix: str, n: Column, width: int = 4) -> Column:
    """prefix and n padded with zeros, never cut."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


def first_keyword(text: Column, words: list[str]) -> Column:
    """The first of the words, in list order, that the text contains after dashes, underscores and spaces became underscores."""
    t = F.regexp_replace(F.lower(text), dialect(r"[-_\s]"), "_")
    return F.get(F.filter(F.lit(words), lambda w: F.instr(t, F.regexp_replace(w, "[- _]", "_")) > 0), F.lit(0))


def drop_bracketed(text: Column) -> Column:
    """Guidance blocks and all bracketed text off, white space at the ends trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?is)\[STEP GUIDANCE[^\]]*\]", ""), r"(?s)\[[^\]]*\]", ""))


def shown_task(task: Column) -> Column:
    """A task as a screen shows it: guidance and bracketed text off, white space as single spaces; the first 50 characters if nothing is left."""
    bare = strip(F.regexp_replace(F.regexp_replace(task, r"(?is)\[(?:STEP GUIDANCE|VERIFY TASK COMPLETION|outcome|pos|REDACTED)[^\]]*\]", ""), r"(?s)\[.*?\]", ""))
    flat = F.regexp_replace(bare, f"[{WHITE}]+", " ")
    return F.when(F.coalesce(task, F.lit("")) == "", "").when(flat != "", flat).otherwise(F.substring(task, 1, 50))


def without_guidance(value: Column) -> Column:
    """A value without guidance that leaked into it; other brackets stay."""
    return strip(F.regexp_replace(value, r"(?i)\[(?:STEP GUIDANCE|VERIFY TASK COMPLETION)[^\]]*\]", ""))


def tokens(text: Column, prefix: str = "dom_") -> Column:
    """array<struct<id, text, start, end>> of the words of a text joined by single spaces."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<id:string,text:string,start:int,end:int>>)").alias("got"))

    def step(acc: Column, w: Column) -> Column:
        one = F.struct(padded_id(prefix, F.size(acc["got"]) + 1).alias("id"), w.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(w)).alias("end"))
        return F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.concat(acc["got"], F.array(one)).alias("got"))

    return F.aggregate(words, zero, step)["got"]
