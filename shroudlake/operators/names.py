"""Heuristic recognition of names, places and organisations, and its merge with model output."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import paired
from ..functions.text import dialect, plain, spans, strip, stripped_over
from .rules import COMMON_NAMES, GIVEN_NAMES, has

#: Words that no person is called, and those that a name must not hold as a word.
NO_PERSON = (
    "you", "me", "i", "we", "us", "they", "them", "he", "she", "him", "her", "it", "my", "your", "our", "their", "today", "yesterday", "tomorrow", "now", "am", "pm", "date", "time", "previous", "next", "back", "forward", "download", "delete", "star", "starred", "reply", "search", "menu", "close",
    "attach", "emoji", "more", "details", "view", "edit", "save", "send", "cancel", "ok", "yes", "no", "audio", "video", "photo", "document", "camera", "contact", "poll", "status", "chats", "calls", "settings", "profile", "group", "online", "offline", "typing", "recording", "unread", "read",
    "delivered", "sent", "home", "dashboard", "report", "update", "payment", "amount", "rate", "total", "bill", "invoice", "order", "particulars", "model", "battery", "charger", "tax", "gst", "cgst", "sgst", "igst", "subtotal", "item", "items", "qty", "price", "signature", "sign", "customer",
    "shri", "smt", "mr", "mrs", "dr", "opp", "road", "complex", "arrow", "chevron", "left", "right", "up", "down", "share", "options", "zoom", "rotate", "fullscreen", "gallery", "filmstrip", "thumbnail", "valid", "validity", "efficiency", "hackathon", "card", "slip", "tokens", "token", "english",
    "hindi", "side", "ocr", "validation", "pipeline", "issue",
)
LOOSE = "today|yesterday|tomorrow|mon|tue|wed|thu|fri|sat|sun|am|pm|of|at|by|in|on|to|for|from|with|and|or"
#: Words of a screen's controls, also inside hyphened names.
CONTROLS = "you|me|we|us|download|delete|menu|close|attach|emoji|more|details|view|edit|save|send|cancel|reply|star|starred|chats|calls|status|settings|profile|group|back|next|previous|chevron|arrow"
#: Elements whose text names nobody.
QUIET_TAGS, QUIET_ROLES, QUIET_CLASSES = ("button", "nav", "toolbar", "svg", "path"), ("button", "toolbar", "navigation"), "media-viewer|filmstrip|carousel|nav|button|thumb"
LONGEST_CHUNK, MODEL_ITEMS, LEAST_SCORE = 512, 6, 0.60


def person_name(text: Column) -> Column:
    """Whether a text can be a person's name."""
    t = strip(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(t, "[^a-zA-Z]", ""))
    return (
        F.length(t).between(3, 50) & ~F.exists(F.split(F.lower(t), r"\s+"), lambda w: w.isin(*NO_PERSON)) & ~F.rlike(t, F.lit(r"[0-9<>{}\[\]/\\_+=*&^%$#@!~?]"))
        & ~has(t, LOOSE) & ~has(t, CONTROLS) & F.rlike(t, F.lit("(?i)[aeiouy]")) & (letters >= F.length(t) * 0.7)
    )


def name_items(elements: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(page_id, item_idx, source, elem_idx, text, bbox): the texts that names are sought in, numbered by page: of elements, then of recognised lines.

    elements: page_id, elem_idx, tag, role, class_name, is_container, text, bbox; controls and containers are left out. lines: page_id, line_index, text, bbox. Texts of three characters or less go.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    quiet = low("tag").isin(*QUIET_TAGS) | low("role").isin(*QUIET_ROLES) | F.rlike(low("class_name"), F.lit(QUIET_CLASSES)) | F.coalesce("is_container", F.lit(False))
    own = elements.where(~quiet).select("page_id", F.lit("dom").alias("source"), F.col("elem_idx").cast("long").alias("elem_idx"), "text", "bbox")
    both = own if lines is None else own.unionByName(lines.select("page_id", F.lit("ocr").alias("source"), F.col("line_index").cast("long").alias("elem_idx"), "text", "bbox"))
    w = Window.partitionBy("page_id").orderBy("source", "elem_idx")
    return both.where(stripped_over(F.col("text"), 3)).withColumn("item_idx", F.row_number().over(w).cast("long"))


def model_items(items: DataFrame) -> DataFrame:
    """Of name_items() what a model reads: the first MODEL_ITEMS of a page, but for texts longer than LONGEST_CHUNK."""
    return items.where((F.col("item_idx") <= MODEL_ITEMS) & (F.length(strip(F.col("text"))) <= LONGEST_CHUNK))


#: What a text with matches of a rule holds, by reason: one of these words (lower-cased where the rule ignores case), or a cheap pattern.
HOLDS = {
    "name_honorific": ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Shri", "Smt"), "name_label": ("name",), "street_address": r"\d\s+[A-Z]",
    "city": ("Delhi", "Mumbai", "Bengaluru", "Hyderabad", "Chennai", "Kolkata", "Pune", "Jaipur", "Francisco", "York", "London", "Seattle"),
    "org_suffix": ("Inc", "Ltd", "LLC", "Corp", "Limited", "Bank", "Technologies", "Solutions", "Enterprises", "Hospital", "University"), "common_name": tuple(f"{GIVEN_NAMES}|{COMMON_NAMES}".split("|")),
}
#: Fixed values: (reason, type, confidence, pattern, group).
RULES = (
    ("name_honorific", "name", 0.85, r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Shri|Smt\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b", 0),
    ("name_label", "name", 0.85, r"(?i)(?:name|customer\s*name|patient\s*name|holder\s*name|user\s*name)\s*[:\-]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})", 1),
    ("street_address", "location", 0.80, r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Marg|Nagar|Colony)\b", 0),
    ("city", "location", 0.78, r"\b(?:New\s+Delhi|Delhi|Mumbai|Bengaluru|Hyderabad|Chennai|Kolkata|Pune|Jaipur|San\s+Francisco|New\s+York|London|Seattle)\b", 0),
    ("org_suffix", "organization", 0.25, r"\b[A-Z][a-zA-Z0-9\s&]{2,30}?\s+(?:Inc\.?|Ltd\.?|LLC|Corp\.?|Corporation|Pvt\.?\s*Ltd\.?|Private\s*Limited|Bank|Technologies|Solutions|Enterprises|Hospital|University)\b", 0),
    ("common_name", "name", 0.88, rf"\b(?:{GIVEN_NAMES}|{COMMON_NAMES})(?:\s+[A-Z][a-z]+)?\b", 0),
)


def _found(i: int, reason: str, kind: str, conf: float, pattern: str, group: int) -> Column:
    """A rule's matches in the column _text; its pattern is tried only where HOLDS allows a match."""
    java, holds = dialect(pattern), HOLDS[reason]
    body = F.lower("_text") if pattern.startswith("(?i)") else F.col("_text")
    gate = F.rlike(body, F.lit(dialect(holds))) if isinstance(holds, str) else reduce(lambda a, b: a | b, [F.contains(body, F.lit(w)) for w in holds])

    def row(x: Column) -> Column:
        value = F.regexp_extract(x["m"], java, 1) if group else x["m"]
        s = x["s"] + F.instr(x["m"], value) - 1
        return F.struct(F.lit(i).alias("rule_ord"), F.lit(kind).alias("type"), value.alias("text"), s.alias("start"), (s + F.length(value)).alias("end"), F.lit(conf).alias("confidence"), F.lit(f"heuristic_ner:{reason}").alias("reason"))

    out = F.transform(F.coalesce(F.when(gate, spans(F.col("_text"), java)), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")), row)
    return F.filter(out, lambda r: person_name(r["text"])) if kind == "name" else out


def heuristic_entities(items: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys.., rule_ord, type, text, start, end, confidence, reason): matches of the six rules in texts of over three characters; names must be able to be names."""
    arrays = [_found(i, *rule) for i, rule in enumerate(RULES)]
    base = items.select(*keys, plain(F.col(text)).alias("_text")).where(stripped_over(F.col("_text"), 3))
    return base.select(*keys, F.inline(F.concat(*arrays)))


def model_entities(found: DataFrame) -> DataFrame:
    """Model output (item_id, entity_group, word, score) as typed entities; weak ones go, organisations stay weak."""
    kind = F.when(F.col("entity_group") == "PER", "name").when(F.col("entity_group") == "LOC", "location").when(F.col("entity_group") == "ORG", "organization")
    conf = F.when(F.col("entity_group") == "ORG", F.least(F.col("score") * 0.35, F.lit(0.40))).otherwise(F.col("score"))
    return found.where(f"score >= {LEAST_SCORE}").select("item_id", kind.alias("type"), F.col("word").alias("text"), conf.alias("confidence")).where("type is not null")


MODEL_ROWS = "page_id long, item_idx long, type string, text string, start int, end int, confidence double"
GROUPS = {"PER": "name", "LOC": "location", "ORG": "organization"}


def read_by_model(items: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], batch: int = 32) -> DataFrame:
    """(page_id, item_idx, type, text, start, end, confidence): what a model for names finds in model_items(items).

    load() is called once in each task and gives a function of a list of texts, which it gets in lots over all rows: for each text a list of entities (entity_group, word, score, and start and end if it knows them). Weak ones and
    other groups go, organisations stay weak; one whose place is not told is where its word first stands, and goes if it does not. A lot that the model fails on is read again text by text, and a text that it fails on has no names.
    """

    def entities(text: str, found: list[dict]) -> Iterator[tuple]:
        for e in found or ():
            kind, score = GROUPS.get(str(e.get("entity_group"))), float(e.get("score") or 0)
            start, end = e.get("start"), e.get("end")
            if start is None or end is None:
                start = text.find(str(e.get("word") or "\0"))
                end = start + len(str(e.get("word") or ""))
            if kind and score >= LEAST_SCORE and 0 <= start < end <= len(text):
                yield kind, text[start:end], int(start), int(end), min(score * 0.35, 0.40) if kind == "organization" else score

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model, rows = model or load(), []
            texts = frame["text"].tolist()
            for at in range(0, len(texts), batch):
                lot = texts[at : at + batch]
                try:
                    found = model(lot)
                except Exception:  # noqa: BLE001  one text may be what it fails on
                    found = []
                    for text in lot:
                        try:
                            found += model([text])
                        except Exception:  # noqa: BLE001
                            found.append([])
                rows += [(frame["page_id"].iloc[at + k], frame["item_idx"].iloc[at + k], *e) for k, text in enumerate(lot) for e in entities(text, found[k])]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in MODEL_ROWS.split(", ")])

    return model_items(items).select(F.col("page_id").cast("long").alias("page_id"), "item_idx", "text").mapInPandas(run, MODEL_ROWS)


def merged_entities(model: DataFrame, heuristic: DataFrame, page: str = "page_id") -> DataFrame:
    """Model entities, and heuristic ones of a page unless one of the same type holds the other's text, case ignored.

    Among heuristic ones an earlier row (by rule, start) also shuts out a later one that it holds or that holds it.
    """
    held = lambda a, b: F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))
    m = model.select(F.col(page).alias("_p"), F.col("type").alias("_t"), F.col("text").alias("_x"))
    free = paired(heuristic, m, (F.col(page) == F.col("_p")) & (F.col("type") == F.col("_t")) & held(F.col("text"), F.col("_x")), "left_anti")
    first = free.groupBy(page, "type").agg(F.sort_array(F.collect_list(F.struct("rule_ord", "start", "text", "confidence"))).alias("all"))
    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: held(x["text"], y["text"])), acc).otherwise(F.concat(acc, F.array(x))))
    kept = first.select(page, "type", F.inline(chosen)).select(page, "type", "text", "confidence")
    return model.select(page, "type", "text", "confidence").unionByName(kept)
