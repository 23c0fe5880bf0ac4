"""Rule-based detection of personal data in text columns, without Python on the executors but for detectors that are plain functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import paired
from ..functions.text import cut, dialect, plain, spans, strip
from .rules import BOOST, BY_NAME, GUARDED, KEYWORDS, NEGATIVE, REDACT, REVIEW, RULES, Rule


def clamp_confidence(c: Column) -> Column:
    """Within 0 and 1; null, NaN and 0 become 0.5."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def decide(confidence: Column) -> Column:
    return F.when(confidence >= REDACT, "REDACT").when(confidence >= REVIEW, "REVIEW").otherwise("KEEP")


def boost(text: Column, ctx: Column, start: Column, end: Column, kind: str) -> Column:
    """BOOST if a keyword of the type is near. The window is cut from context and text together with the text's own offsets."""
    if kind not in KEYWORDS:
        return F.lit(0.0)
    combined = F.when(ctx != "", F.concat_ws(" ", ctx, text)).otherwise(text)
    near = F.lower(cut(combined, start - 100, end + 100))
    return F.when(reduce(lambda a, b: a | b, [F.contains(near, F.lit(w)) for w in KEYWORDS[kind]]), BOOST).otherwise(0.0)


def negative_prefix(text: Column, ctx: Column, start: Column) -> Column:
    pattern = F.lit(dialect(NEGATIVE))
    return F.rlike(cut(text, start - 50, start), pattern) | ((ctx != "") & F.rlike(strip(ctx), pattern))


def matches(text: Column, ctx: Column, low: Column, ordinal: int, rule: Rule, digit: Column | None = None) -> Column:
    """array<struct> of a rule's accepted matches; null where the cheap gate shows that there are none. low: the text, lower-cased once for all rules; digit: whether it or its context has a digit."""
    pattern = dialect(rule.pattern)
    found = spans(text, pattern)
    if rule.group:
        inner = dialect(rule.pattern.replace(r"(?<!email\s)(?<!e-mail\s)", "").split("(?=")[0])

        def value(x: Column) -> Column:
            g = F.regexp_extract(x["m"], inner, 1)
            s = x["s"] + F.instr(x["m"], g) - 1  # the value's first place in the match
            return F.when(g != "", F.struct(s.alias("s"), (s + F.length(g)).alias("e"), g.alias("m"))).otherwise(x)

        found = F.transform(found, value)
    if rule.type in GUARDED:
        found = F.filter(found, lambda x: ~negative_prefix(text, ctx, x["s"]))
    if rule.check:
        def local(x: Column) -> Column:
            near = cut(text, x["s"] - 80, x["e"] + 80)
            return F.when(ctx != "", F.concat_ws(" ", ctx, near)).otherwise(near)

        found = F.filter(found, lambda x: rule.check(x["m"], local(x)))
    score = lambda x: F.lit(1.0) if rule.checksum else F.least(F.lit(1.0), F.lit(rule.base) + boost(text, ctx, x["s"], x["e"], rule.type))
    rows = F.transform(
        found,
        lambda x: F.struct(
            F.lit(ordinal).alias("rule_ord"), F.lit(rule.name).alias("rule"), F.lit(rule.type).alias("type"), x["m"].alias("text"), x["s"].alias("start"), x["e"].alias("end"),
            score(x).alias("confidence"), F.lit(rule.checksum).alias("checksum_validated"),
        ),
    )
    tests = []
    if digit is not None and r"\d" in rule.gate:
        tests.append(digit)
    if rule.words:
        tests.append(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in rule.words]))
    if rule.gate:
        tests.append(F.rlike(text, F.lit(rule.gate)) | F.rlike(ctx, F.lit(rule.gate)))
    return F.when(reduce(lambda a, b: a & b, tests), rows) if tests else rows


NO_MATCHES = "cast(array() as array<struct<rule_ord:int,rule:string,type:string,text:string,start:int,end:int,confidence:double,checksum_validated:boolean>>)"


def readable(df: DataFrame, keys: Sequence[str | Column], text: str, context: str | None = None) -> DataFrame:
    """(keys.., _text, _ctx, _low, _digit): what all_matches() reads; _low is context and text lower-cased, _digit whether they have a digit, which most rules need."""
    ctx = F.coalesce(F.col(context), F.lit("")) if context else F.lit("")
    return df.select(*keys, plain(F.col(text)).alias("_text"), ctx.alias("_ctx")).select("*", F.lower(F.concat("_ctx", F.lit("\n"), "_text")).alias("_low"), (F.rlike("_text", F.lit("[0-9]")) | F.rlike("_ctx", F.lit("[0-9]"))).alias("_digit"))


def all_matches(rules: Sequence[str] | None = None, registry: "Detectors | None" = None) -> Column:
    """One array of the accepted matches of all chosen rules in a row of readable(), in the order of the rules, then of the text."""
    text, ctx, low, digit = F.col("_text"), F.col("_ctx"), F.col("_low"), F.col("_digit")
    chosen = [BY_NAME[n] for n in rules] if rules else [(i + 1, r) for i, r in enumerate(RULES)]
    arrays = [matches(text, ctx, low, i, r, digit) for i, r in chosen] + (registry.columns(text, ctx) if registry else [])
    return F.flatten(F.array(*[F.coalesce(a, F.expr(NO_MATCHES)) for a in arrays]))


def detect_pii(df: DataFrame, keys: Sequence[str], text: str = "text", context: str | None = None, rules: Sequence[str] | None = None, registry: "Detectors | None" = None) -> DataFrame:
    """(keys.., rule_ord, rule, type, text, start, end, confidence, checksum_validated, source, decision): a row for each match.

    Overlapping matches of different rules all stay. No shuffle, one pass.
    """
    base = readable(df, keys, text, context)
    found = base.select(*base.columns[:-4], F.inline(all_matches(rules, registry)))
    return found.withColumns({"source": F.lit("dom"), "decision": decide(F.col("confidence"))})


#: Names of a dictionary that is sent to all tasks.
SMALL = 100_000
#: A word, and the surname that may follow a given name.
NAME_WORD, SURNAME = r"\b[A-Za-zऀ-ॿ]+", r"^[^\S\r\n]+[A-Z][a-z]+\b"


def dictionary_names(df: DataFrame, keys: Sequence[str], dictionary: DataFrame, text: str = "text") -> DataFrame:
    """Rows as of detect_pii() for the names of a dictionary(name, rule, confidence) of any size: a word that is one of its names, with the surname after it.

    The words are joined with the dictionary, so it is not part of the plan: one of at most SMALL names is sent to all tasks, a larger one exchanged, and the words are never sent whole. Of overlapping matches the first counts. keys must tell the rows of df apart.
    """
    base = df.select(*keys, plain(F.col(text)).alias("_text"))
    words = base.select(*keys, "_text", F.inline(spans(F.col("_text"), dialect(NAME_WORD))).alias("s", "e", "m"))
    known = dictionary.select(F.col("name").alias("m"), "rule", "confidence")
    met = words.join(F.broadcast(known), "m") if known.limit(SMALL + 1).count() <= SMALL else paired(words, known, "m")
    more = F.regexp_extract(cut(F.col("_text"), F.col("e"), F.col("e") + 60), dialect(SURNAME), 0)
    found = met.select(*keys, "rule", "confidence", F.col("s").alias("start"), (F.col("e") + F.length(more)).alias("end"), F.concat("m", more).alias("text"))
    # a name that is the surname of the match before it is part of that one
    before = Window.partitionBy(*keys).orderBy("start")
    free = found.withColumn("_last", F.lag("end").over(before)).where("_last is null or start >= _last").drop("_last")
    return free.select(*keys, F.lit(0).alias("rule_ord"), "rule", F.lit("name").alias("type"), "text", "start", "end", F.col("confidence").cast("double").alias("confidence"), F.lit(False).alias("checksum_validated"), F.lit("dom").alias("source"), decide(F.col("confidence")).alias("decision"))


MATCH = "struct<detector:string,type:string,text:string,start:int,end:int,confidence:double,warning:string>"


def isolated(name: str, detect: Callable[[str, str], Iterable[dict]]) -> Callable[[Column, Column], Column]:
    """A plain function of (text, context) as a column of arrays of MATCH. What it raises over a text becomes a row with a warning, and so does a match without a type or a place in the text; other texts and detectors go on."""

    def one(text: str | None, ctx: str | None) -> list[dict]:
        row = {"detector": name, "type": None, "text": None, "start": None, "end": None, "confidence": None, "warning": None}
        try:
            found = []
            for m in detect(text or "", ctx or "") or ():
                start, end = int(m["start"]), int(m["end"])
                if not m.get("type") or not 0 <= start < end <= len(text or ""):
                    found.append(row | {"warning": f"not a match: {str(m)[:200]}"})
                else:
                    found.append(row | {"type": str(m["type"]), "text": (text or "")[start:end], "start": start, "end": end, "confidence": float(m.get("confidence", 0.5))})
        except Exception as e:  # noqa: BLE001  a detector's failure is not the job's
            return [row | {"warning": f"{type(e).__name__}: {str(e)[:200]}"}]
        return found

    def run(texts: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([one(t, c) for t, c in zip(texts, contexts)])

    return lambda text, ctx: F.pandas_udf(run, f"array<{MATCH}>")(text, ctx)


class Detectors:
    """Detectors by name: functions of (text, context) columns that give the match array, built from expressions or pandas UDFs; or plain functions of a text and its context that give dictionaries (type, start, end, confidence)."""

    def __init__(self) -> None:
        self.found: dict[str, Callable[[Column, Column], Column]] = {}
        self.plain: dict[str, Callable[[Column, Column], Column]] = {}

    def add(self, name: str, detect: Callable[[Column, Column], Column] | None) -> "Detectors":
        if name and callable(detect):
            self.found[name] = detect
        return self

    def add_function(self, name: str, detect: Callable[[str, str], Iterable[dict]] | None) -> "Detectors":
        if name and callable(detect):
            self.plain[name] = isolated(name, detect)
        return self

    def columns(self, text: Column, ctx: Column) -> list[Column]:
        return [f(text, ctx) for f in self.found.values()]

    def run(self, df: DataFrame, keys: Sequence[str], text: str = "text", context: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(matches, warnings): keys.. and detector, type, text, start, end, confidence, decision of the rules (as built_in) and of each plain function; and keys.., detector, warning of what failed."""
        rules = detect_pii(df, keys, text, context, registry=self).select(*keys, F.lit("built_in").alias("detector"), "type", "text", "start", "end", "confidence", "decision")
        if not self.plain:
            return rules, df.select(*keys, F.lit("").alias("detector"), F.lit("").alias("warning")).where("false")
        ctx = F.col(context) if context else F.lit("")
        body = plain(F.col(text))
        each = df.select(*keys, F.inline(F.concat(*[f(body, ctx) for f in self.plain.values()])))
        good = each.where("warning is null").select(*keys, "detector", "type", "text", "start", "end", clamp_confidence(F.col("confidence")).alias("confidence"), decide(clamp_confidence(F.col("confidence"))).alias("decision"))
        return rules.unionByName(good), each.where("warning is not null").select(*keys, "detector", "warning")


def summarize(found: DataFrame, key: str) -> DataFrame:
    """(type, decision, n_spans, n_docs)."""
    return found.groupBy("type", "decision").agg(F.count("*").alias("n_spans"), F.count_distinct(key).alias("n_docs"))


def to_candidates(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches in the common candidate form."""
    return found.select(
        *keys, F.coalesce("type", F.lit("other")).alias("type"), F.coalesce("source", F.lit("dom")).alias("source"), F.array(F.coalesce("source", F.lit("dom"))).alias("sources"),
        "text", F.col("text").alias("original_value"), clamp_confidence(F.col("confidence")).alias("confidence"), F.concat(F.lit("regex:"), F.col("rule")).alias("reason"), F.lit("viewport").alias("coordinate_space"), "start", "end",
    )
