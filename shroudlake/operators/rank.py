"""Ranking of page elements for a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import position_tag

TOP = 35
#: Words that say nothing about a task, and the verbs of each intent.
STOP = "the a an is to on in it for of and at by this that with from my me".split()
INTENTS = {
    "click": r"\b(click|press|tap|select|submit|choose|open|go|check|tick|play|watch)\b",
    "type": r"\b(type|enter|fill|input|write|search|set|send|message|reply|post|chat|say|text)\b|\"[^\"]+\"",
    "chat": r"\b(send|message|chat|reply|text|contact|tell|draft)\b",
    "search": r"\b(search|find|look\s*up|query)\b",
    "video": r"\b(video|play|watch|first|views|most viewed|song|episode|listen)\b",
}
VOICE = r"voice\s*message|ptt|record\s*audio|microphone|voice\s*note|voice\s*search|search\s*with\s*(your\s*)?voice|voice-search"
SIDE = r"^(home|shorts|subscriptions|you|history|playlists|watch later|liked videos|your videos|your clips|trending|music|gaming|news|sports)"
TABS = r"^(all|unread|favourites|groups|archived|chats|status|channels|communities)\z"
FIELDS = ("label", "placeholder", "text", "id", "element_id", "name", "input_type", "role")


def says(c: Column, pattern: str) -> Column:
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(f"(?i){pattern}"))


def task_tokens(task: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(F.coalesce(task, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP))


def intents(task: Column) -> dict[str, Column]:
    return {k: says(task, p) for k, p in INTENTS.items()}


def flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def scored(elements: DataFrame, task: str = "task") -> DataFrame:
    """elements (page_id, elem_idx, tag, role, FIELDS.., href, bbox, flags) with pos, is_input and score: a sum of rules."""
    c = {n: (F.coalesce(F.col(n).cast("string"), F.lit("")) if n in elements.columns else F.lit("")) for n in (*FIELDS, "tag", "href")}
    goal = F.col(task)
    want, tag, role, b = intents(goal), F.lower(c["tag"]), F.lower(c["role"]), F.col("bbox")
    pos = F.coalesce(position_tag(b), F.lit(""))
    field = tag.isin("input", "textarea", "select") | role.isin("textbox", "combobox", "searchbox")
    editable = flag(elements, "is_content_editable") | (c["input_type"] == "contenteditable")
    is_input = field | editable
    all_text = F.lower(F.array_join(F.filter(F.array(*[c[n] for n in FIELDS]), lambda x: x != ""), " "))
    audio = flag(elements, "is_audio_record") | says(all_text, VOICE)
    search_in = is_input & ~audio & ((c["id"] == "search") | c["name"].isin("search_query", "q") | (c["input_type"] == "search") | (role == "searchbox") | says(c["placeholder"], "search") | says(c["label"], "search"))
    search_btn = ((tag == "button") | (role == "button")) & ~audio & ((c["id"] == "search-icon-legacy") | says(c["label"], "search") | says(c["placeholder"], "search"))
    shown = F.when(c["label"] != "", c["label"]).otherwise(c["text"])
    near = lambda test: F.coalesce(test, F.lit(False))
    contact = ~audio & ~search_in & near((b["x"] < 450) & b["y"].between(65, 400)) & (role.isin("listitem", "row", "gridcell") | tag.isin("div", "span")) & ~says(shown, TABS)
    link = (tag == "a") | (role == "link") | (tag == "yt-formatted-string")
    side = flag(elements, "is_sidebar") | (near(b["x"] < 220) & link & says(shown, SIDE))
    card = flag(elements, "is_search_result") | flag(elements, "is_playlist")
    media = (link | (c["id"] == "video-title")) & ~side & (
        (c["id"] == "video-title") | card | says(c["href"], r"watch\?v=|playlist\?list=|/playlist|/course") | says(c["label"], "views|subscribers|ago|video|playlist|course|lessons") | says(c["text"], "view full (playlist|course)")
    )
    playable = want["video"] & media
    top = F.startswith(pos, F.lit("top"))
    rules = [
        (10, is_input | tag.isin("button", "a") | role.isin("button", "link", "checkbox", "radio", "menuitem", "tab")),
        (8, want["click"] & (tag.isin("button", "a") | role.isin("button", "link"))),
        (15, want["type"] & is_input),
        (-60, (want["type"] | want["search"]) & audio),
        (30, want["search"] & search_in),
        (15, want["search"] & search_btn),
        (15, is_input & ~search_in & ~audio & says(all_text, "message|chat|reply|type a message|send")),
        (20, (want["chat"] | want["search"]) & contact),
        (15, (want["chat"] | want["search"]) & contact & near(b["y"] <= 200)),
        (-40, side),
        (25, playable),
        (10, playable & card),
        (10, playable & says(goal, r"\b(most viewed|popular)\b") & F.rlike(c["label"], F.lit(r"\b\d+(\.\d+)?[Mm]\s+(?i:views)"))),
        (12, playable & says(goal, r"\b(first|top)\b") & top),
        (20, playable & near((b["x"] >= 220) & b["y"].between(60, 450))),
        (-50, playable & F.rlike(c["label"], F.lit("MEMBERS ONLY|Members only"))),
    ]
    place = F.when(want["search"] & search_in & top, 12).when(want["type"] & is_input & ~audio & F.startswith(pos, F.lit("bottom")), 10).when(top, 2).when(F.startswith(pos, F.lit("mid")), 1).otherwise(0)
    words = 6 * F.size(F.filter(task_tokens(goal), lambda t: F.contains(all_text, t)))
    score = reduce(lambda a, r: a + F.when(r[1], r[0]).otherwise(0), rules, words + place)
    return elements.withColumns({"pos": F.nullif(pos, F.lit("")), "is_input": is_input, "score": score})


def ranked(elements: DataFrame, task: str = "task", top: int = TOP) -> DataFrame:
    """The top elements of each page by score; for typing tasks each input left out takes the place of the last element that is none."""
    s = scored(elements, task)
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "elem_idx")
    s = s.withColumn("rank", F.row_number().over(w))
    typing = says(F.col(task), INTENTS["type"])
    kept = s.where((F.col("rank") <= top) | (typing & F.col("is_input")))
    # of the first ``top``, the last non-inputs go, one for each further input; the first further input takes the last place
    per = Window.partitionBy("page_id")
    more = F.count_if((F.col("rank") > top)).over(per)
    others = F.col("rank").between(1, top) & ~F.col("is_input")
    place = F.row_number().over(Window.partitionBy("page_id", others.alias("_o"), (F.col("rank") <= top).alias("_t")).orderBy(F.desc("rank")))
    marked = kept.withColumns({"_more": more, "_others": F.count_if(others).over(per), "_out": others & (place <= more), "_place": place, "_extra": F.row_number().over(Window.partitionBy("page_id", (F.col("rank") > top).alias("_t")).orderBy("rank"))})
    slots = marked.where("_out").select(F.col("page_id").alias("_p"), F.col("_place").alias("_k"), F.col("rank").alias("_slot"))
    extra = (F.col("page_id") == F.col("_p")) & (F.col("rank") > top) & (F.col("_extra") == F.col("_k"))
    out = marked.where("not _out").join(slots, extra, "left")
    final = F.when(F.col("rank") <= top, F.col("rank")).when(F.col("_slot").isNotNull(), F.col("_slot")).otherwise(F.lit(top) + F.col("_extra") - F.col("_others"))
    return out.withColumn("rank", final.cast("int")).drop("_more", "_others", "_out", "_place", "_extra", "_p", "_k", "_slot")


def top_regions(regions: DataFrame, n: int, first: Column) -> DataFrame:
    """The first n regions of each page: those of ``first``, then by area, then in order."""
    w = Window.partitionBy("page_id").orderBy(F.desc(first.cast("int")), F.desc("area"), "region_idx")
    return regions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


