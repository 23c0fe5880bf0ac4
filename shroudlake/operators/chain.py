"""The passes that an agent's proposed action goes through: journeys, messages, searches, drop-down lists, in this order; each sees what the one before made.

What a page offers is one row for each request (offers()), so the passes are column expressions over the action's row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..functions.text import drop_bracketed
from .messages import creative, earlier, echo, message_text, searched_before
from .rank import says
from .wording import contact_task, search_query

#: Columns of page elements that the passes read.
ELEMENT = "request_id, elem_idx, element_id, tag, role, input_type, label, placeholder, text, name, href, value, class_name, widget_type, bbox, is_sidebar, is_search_result, is_playlist, is_audio_record, is_status, is_content_editable"
SIDEBAR = ("playlists", "liked videos", "subscriptions", "library", "history", "home", "shorts")
RAIL = ("status", "my status", "share statuses", "status updates", "channel", "communit", "setting", "meta ai", "profile", "archived", "filter chats", "new chat", "menu", "starred", "disappear after 24 hours")
STATUS_PAGE = ("share statuses", "my status", "status updates", "disappear after 24 hours")
JOURNEYS = r"\b(?:book|ticket|train|irctc|railway|tatkal|journey|flight|bus|reservation|seat)\b"
JOURNEY_PAGES = ("search trains", "find trains", "book ticket", "p-autocomplete", "origin", "destination", "irctc")
NUMBER = "first|second|third|fourth|forth|fifth|sixth|seventh|eighth"


def _text(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def result_item() -> Column:
    """Whether an element is a search result: a video, a list, a course or a product."""
    label, text, href, x = _text("label"), _text("text"), _text("href"), F.col("bbox")["x"]
    side = _flag("is_sidebar") | F.coalesce((x < 200) & label.isin(*SIDEBAR), F.lit(False))
    link = _text("tag").isin("a", "yt-formatted-string")
    counted = F.rlike(label, F.lit(r"\d+[km]?\s*views|\d+\s*(hours?|minutes?|seconds?)\s*ago|\d+:\d+|\d+\s*(videos|lessons)")) | F.rlike(text, F.lit(r"\d+[km]?\s*views|\d+\s*(videos|lessons)"))
    goods = (_text("tag") == "a") & (_holds(href, ("/p/", "/dp/", "/product/")) | _holds(label, ("₹", "rs.", "$")))
    named = (F.lower("element_id") == "video-title") | _flag("is_search_result") | _flag("is_playlist") | _holds(href, ("/watch", "/playlist", "/course"))
    return ~side & (named | _holds(label, ("views", "playlist", "course", "lessons")) | _holds(text, ("view full playlist", "view full course")) | (link & counted) | goods)


def search_button() -> Column:
    button = (_text("tag") == "button") | (_text("role") == "button") | (_text("input_type") == "submit")
    return button & (_holds(_text("label"), ("search", "find")) | _holds(_text("element_id"), ("search", "submit")))


def search_input() -> Column:
    field = _text("tag").isin("input", "textarea") | _text("role").isin("searchbox", "combobox", "textbox")
    button = (_text("tag") == "button") | (_text("role") == "button")
    return ~_flag("is_audio_record") & field & ~button & (F.contains(_text("placeholder"), F.lit("search")) | F.contains(_text("label"), F.lit("search")) | F.contains(_text("placeholder"), F.lit("query")) | _text("name").isin("q", "search_query") | _holds(_text("element_id"), ("search", "twotabsearchtextbox")))


def contact_row() -> Column:
    """Whether an element is a row of a list of contacts, left of the conversation and right of the rail."""
    info = F.concat_ws(" ", _text("label"), _text("text"), _text("element_id"))
    field = F.contains(_text("placeholder"), F.lit("search")) | F.contains(_text("label"), F.lit("search")) | F.contains(_text("element_id"), F.lit("search")) | _text("role").isin("searchbox", "combobox", "textbox") | _text("tag").isin("input", "textarea") | _holds(_text("placeholder"), ("message", "chat"))
    x, y = F.col("bbox")["x"], F.col("bbox")["y"]
    place = F.coalesce((x >= 65) & (x < 450) & y.between(65, 650), F.lit(False))
    return ~_flag("is_audio_record") & ~_flag("is_status") & ~_holds(info, RAIL) & ~field & ~_text("label").isin("all", "unread", "favourites", "groups", "chats") & place & (_text("role").isin("listitem", "row", "gridcell") | _text("tag").isin("div", "span", "a"))


def contact_search() -> Column:
    x, y = F.col("bbox")["x"], F.col("bbox")["y"]
    named = _holds(F.concat_ws(" ", _text("placeholder"), _text("label"), _text("element_id")), ("search",))
    field = _text("role").isin("textbox", "searchbox", "combobox") | _text("tag").isin("input", "textarea", "div")
    left = x.isNull() | ((x < 450) & F.coalesce(y < 200, F.lit(True)))
    return ~_flag("is_audio_record") & (_holds(F.concat_ws(" ", _text("placeholder"), _text("label")), ("search or start new chat",)) | (named & field & left))


def message_box() -> Column:
    search = _holds(F.concat_ws(" ", _text("placeholder"), _text("label"), _text("element_id")), ("search",)) | _text("role").isin("searchbox", "combobox")
    words = F.concat_ws(" ", _text("placeholder"), _text("label"))
    editable = _flag("is_content_editable") | (_text("input_type") == "contenteditable")
    field = (_text("role") == "textbox") | _text("tag").isin("textarea", "input") | editable
    low = F.coalesce(F.col("bbox")["y"] > 450, F.lit(False)) & (editable | ((_text("role") == "textbox") & _holds(words, ("chat", "message"))))
    return ~_flag("is_audio_record") & ~search & (_holds(words, ("type a message",)) | (field & _holds(words, ("message",))) | low)


def offers(elements: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """One row for each request: the first element of each role, with values where the passes need them. elements: ELEMENT; contacts(request_id, contact) for roles that a name decides."""
    tag, kind = _text("tag"), _text("input_type")
    spot = F.concat_ws(" ", _text("label"), _text("placeholder"), _text("element_id"), _text("text"))
    if contacts is None:
        e = elements.withColumn("contact", F.lit(None).cast("string"))
    else:
        e = elements.join(contacts.select("request_id", F.lower("contact").alias("contact")).dropDuplicates(["request_id"]), "request_id", "left")
    ours = F.coalesce(F.contains(F.concat_ws(" ", _text("label"), _text("text")), F.col("contact")), F.lit(False))
    top = F.coalesce((F.col("bbox")["x"] >= 200) & (F.col("bbox")["y"] <= 200), F.lit(False))
    start = F.startswith(_text("placeholder"), F.lit("from")) | _holds(_text("element_id"), ("origin", "source")) | (F.startswith(_text("label"), F.lit("from")) & ~F.startswith(_text("placeholder"), F.lit("to")))
    end = F.startswith(_text("placeholder"), F.lit("to")) | _holds(_text("element_id"), ("dest",)) | (F.startswith(_text("label"), F.lit("to")) & ~F.startswith(_text("placeholder"), F.lit("from")))
    select = (tag == "select") | (kind == "select")
    go = _holds(_text("text"), ("search train", "find trains")) | _holds(_text("element_id"), ("train_search", "search_btn")) | (F.contains(_text("text"), F.lit("search")) & tag.isin("button", "a"))
    tests = {
        "search_input": search_input(), "result": result_item() & ~F.contains(F.concat_ws(" ", _text("label"), _text("text")), F.lit("members only")), "from_input": start, "to_input": end & ~start, "search_trains": go,
        "select": select, "semester": select & _holds(F.concat_ws(" ", _text("label"), _text("element_id")), ("sem",)), "contact_search": contact_search(), "message_box": message_box(),
        "contact_named": contact_row() & ours, "contact_first": contact_row(), "open_header": top & ours,
    }
    first = lambda test: F.min_by(F.when(test, F.struct("element_id", "value")), F.when(test, F.col("elem_idx")))
    page = {
        "chat_page": F.max(_holds(spot, ("type a message", "search or start new chat", "share statuses", "my status", "disappear after 24 hours")) | _flag("is_status")),
        "status_page": F.max(_holds(F.concat_ws(" ", _text("label"), _text("text")), STATUS_PAGE) & ~_flag("is_status")), "journey_page": F.max(_holds(spot, JOURNEY_PAGES)),
        "chats_tab": F.min_by(F.when(_holds(_text("label"), ("chats",)), F.col("element_id")), F.when(_holds(_text("label"), ("chats",)) & F.coalesce(F.col("bbox")["x"] < 70, F.lit(True)), F.col("elem_idx"))),
    }
    return e.groupBy("request_id").agg(*[first(t).alias(n) for n, t in tests.items()], *[c.alias(n) for n, c in page.items()])


def target_kinds(elements: DataFrame) -> DataFrame:
    """(request_id, target, t_result, t_search_button, t_button, t_select): what an element is as a target; the first of an id counts."""
    what = F.struct(result_item().alias("t_result"), search_button().alias("t_search_button"), ((_text("tag") == "button") | (_text("role") == "button")).alias("t_button"), ((_text("tag") == "select") | (_text("input_type") == "select")).alias("t_select"))
    return elements.groupBy("request_id", F.col("element_id").alias("target")).agg(F.min_by(what, "elem_idx").alias("w")).select("request_id", "target", "w.*")


def _becomes(df: DataFrame, step: Column, kinds: dict[str, tuple[Column | str, Column, Column]]) -> DataFrame:
    """df with the action replaced by kinds[step], (type, target, value); where step is null it stays."""
    at = df.withColumn("_step", step)
    put = lambda i, old: reduce(lambda c, s: c.when(F.col("_step") == s, F.lit(kinds[s][i]) if isinstance(kinds[s][i], str) else kinds[s][i]), kinds, F.when(F.lit(False), F.col(old))).otherwise(F.col(old))
    rest = [c for c in df.columns if c not in ("action_type", "target", "value")]
    return at.select(*rest, put(0, "action_type").alias("action_type"), put(1, "target").alias("target"), put(2, "value").alias("value"))


def task_words(df: DataFrame) -> DataFrame:
    """df(task, prior_actions, value) with what the passes read from the task: _task, _named, _prior, then _query, _words, _creative and _past."""
    none = F.expr("cast(array() as array<string>)")
    first = df.withColumns({"_task": drop_bracketed(F.coalesce("task", F.lit(""))), "_named": contact_task(F.col("task")), "_prior": F.coalesce("prior_actions", none)})
    task, named = F.col("_task"), F.col("_named")
    return first.withColumns({"_query": search_query(task, named), "_words": message_text(task, named), "_creative": creative(task), "_past": earlier(F.col("_prior"), task, named)})


def travel_pass(df: DataFrame) -> DataFrame:
    """A journey is searched for only when both stations are filled, on the page or by an earlier action: before that a search or done becomes wait, after that wait, ask_user and done become the search."""
    none = F.lit(None).cast("string")
    trip = says(F.col("_task"), JOURNEYS) | F.coalesce("journey_page", F.lit(False))
    form = F.exists("_prior", lambda a: F.contains(F.lower(a), F.lit("fill_form")) | F.contains(F.lower(a), F.lit("filled")))

    def full(c: str) -> Column:
        typed = F.exists("_prior", lambda a: F.contains(F.lower(a), F.lit("type")) & F.coalesce(F.contains(F.lower(a), F.lower(F.col(c)["element_id"])), F.lit(False)))
        return F.coalesce(F.col(c)["value"] != "", F.lit(False)) | form | typed

    go, kind, ready = F.col("search_trains")["element_id"], F.col("action_type"), F.col("_ready")
    searches = (kind == "click") & (F.col("target").eqNullSafe(go) & go.isNotNull() | says(F.col("reasoning"), r"\b(search\s*train|search|proceed\s+with\s+booking|submit\s+search)\b"))
    turn = F.when(ready & go.isNotNull() & kind.isin("wait", "ask_user", "done"), "go").when(~ready & (searches | (kind == "done")), "hold")
    at = df.withColumn("_ready", full("from_input") & full("to_input"))
    return _becomes(at, F.when(trip, turn), {"go": ("click", go, none), "hold": ("wait", none, none)}).drop("_ready")


def contact_pass(df: DataFrame) -> DataFrame:
    """A message to a contact: away from the status page, the contact searched, its row clicked, the message typed; done once it went out.

    A draft that only repeats its task becomes null, to be composed: its theme is messages.theme().
    """
    none = F.lit(None).cast("string")
    task, named, made, past = F.col("_task"), F.col("_named"), F.col("_creative"), F.col("_past")
    who = F.lower(named["contact"])
    box, search = F.col("message_box")["element_id"], F.col("contact_search")["element_id"]
    row = F.coalesce(F.col("contact_named")["element_id"], F.col("contact_first")["element_id"])
    at = df.withColumns({
        "_ours": (who.isNotNull() | made | says(task, r"\b(send|type|write|message|say|chat|tell|text|draft)\b")) & (F.coalesce("chat_page", F.lit(False)) | who.isNotNull()),
        "_open": box.isNotNull() & F.when(who.isNotNull(), past["clicked"] | F.col("open_header").isNotNull()).otherwise(True), "_row": row, "_echo": echo(F.col("value"), task, named),
    })
    empty = ~F.coalesce(F.contains(F.lower(F.col("contact_search")["value"]), who), F.lit(False))
    kind, value, opened, row = F.col("action_type"), F.coalesce("value", F.lit("")), F.col("_open"), F.col("_row")
    pick = who.isNotNull() & ~opened & past["searched"] & ~past["clicked"] & row.isNotNull()
    step = (
        F.when(F.coalesce("status_page", F.lit(False)) & F.col("chats_tab").isNotNull(), "tab").when(past["sent"], "sent")
        .when(who.isNotNull() & ~opened & ~past["searched"] & search.isNotNull() & empty & (kind.isin("click", "done") | ~F.col("target").eqNullSafe(search) | (value == "")), "search")
        .when(pick, F.when(~((kind == "click") & F.col("target").eqNullSafe(row)), "open")).when(box.isNotNull(), "write")
    )
    draft = F.when(made, F.when(~F.col("_echo"), value)).otherwise(F.coalesce(F.nullif(value, F.lit("")), F.col("_words"), named["body"]))
    steps = {"tab": ("click", F.col("chats_tab"), none), "sent": ("done", none, none), "search": ("type", search, named["contact"]), "open": ("click", row, none), "write": ("type", box, draft)}
    return _becomes(at, F.when(F.col("_ours"), step), steps).drop("_ours", "_open", "_row", "_echo")


def search_pass(df: DataFrame) -> DataFrame:
    """A search task types its query first, whatever the model proposes; a result that is clicked stays, and a search that ran may be done, but for tasks that play what is found."""
    none = F.lit(None).cast("string")
    task, query = F.col("_task"), F.col("_query")
    field, now = F.col("search_input")["element_id"], F.lower(F.trim(F.coalesce(F.col("search_input")["value"], F.lit(""))))
    there = F.contains(now, F.lower(query)) | ((now != "") & F.contains(F.lower(query), now))
    played = F.exists("_prior", lambda a: F.contains(F.lower(a), F.lit("click")) & F.rlike(F.lower(a), F.lit("video|watch|playlist")))
    at = df.withColumns({"_wanted": says(task, r"\b(search|find|look\s*up)\b") & query.isNotNull() & ~_flag("t_result"), "_ran": searched_before(F.col("_prior")), "_there": F.coalesce(there, F.lit(False))})
    kind, wanted, ran = F.col("action_type"), F.col("_wanted"), F.col("_ran")
    fresh = ~F.col("_there") & ~ran
    more = says(task, r"\b(play|watch|click|open|select)\b")
    types = ((kind == "done") & fresh) | ((kind == "click") & F.col("target").eqNullSafe(field)) | ((kind == "click") & _flag("t_search_button") & fresh) | (~more & fresh & (kind != "type"))
    plays = (kind == "done") & ran & says(task, r"\b(play|watch)\b") & ~played & F.col("result").isNotNull()
    case = F.when(wanted & field.isNotNull() & types, "type").when(wanted & field.isNotNull() & (kind == "type") & _flag("t_button"), "move").when(wanted & plays, "play")
    steps = {"type": ("type", field, query), "move": ("type", field, F.coalesce(F.nullif(F.col("value"), F.lit("")), query)), "play": ("click", F.col("result")["element_id"], none)}
    return _becomes(at, case, steps).drop("_wanted", "_ran", "_there")


def dropdown_pass(df: DataFrame) -> DataFrame:
    """Actions on a drop-down list select; a task that names an option finds the list (of semesters, if it names one), once."""
    task = F.col("_task")
    nth = rf"(?:{NUMBER}|\d+(?:st|nd|rd|th)?)"
    wanted = says(task, r"\b(select|choose|pick)\b.*?\b(dropdown|semester|option|item|sem)\b") | says(task, rf"\b{nth}\s+sem(?:ester)?\b")
    ran = F.exists("_prior", lambda a: F.contains(F.lower(a), F.lit("select")))
    found = F.coalesce(F.when(F.contains(F.lower(task), F.lit("sem")), F.col("semester")["element_id"]), F.col("select")["element_id"])
    named = F.regexp_extract(task, rf"(?i)\b{nth}(?:\s+sem(?:ester)?)?\b", 0)
    at = df.withColumns({"_wanted": wanted, "_to": F.when(_flag("t_select"), F.col("target")).when(wanted & ~ran, found)})
    value = F.when((F.coalesce("value", F.lit("")) == "") & F.col("_wanted"), F.when(named != "", F.trim(named)).otherwise(task)).otherwise(F.col("value"))
    return _becomes(at, F.when(F.col("_to").isNotNull(), "select"), {"select": ("select", F.col("_to"), value)}).drop("_wanted", "_to")


def normalized(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """actions(request_id, task, prior_actions, action_type, target, value, reasoning) after all passes, and a click that brings a value made a typing one.

    elements: ELEMENT. A request without elements keeps its action but for what its task alone decides.
    """
    kept = ["request_id", "task", "prior_actions", "action_type", "target", "value", "reasoning"]
    read = settled(task_words(actions.select(*kept)))
    df = read.join(offers(elements, read.select("request_id", F.col("_named")["contact"].alias("contact"))), "request_id", "left")
    kinds = settled(target_kinds(elements))
    df = settled(contact_pass(travel_pass(df))).join(kinds, ["request_id", "target"], "left")
    df = search_pass(df).drop("t_result", "t_search_button", "t_button", "t_select").join(kinds, ["request_id", "target"], "left")
    df = dropdown_pass(df)
    typed = (F.col("action_type") == "click") & F.coalesce(F.col("value") != "", F.lit(False))
    return _becomes(df, F.when(typed, "type"), {"type": ("type", F.col("target"), F.col("value"))}).select(*kept)
