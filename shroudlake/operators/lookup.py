"""Ordered lookups on a page: options, suggestions, and the elements that play a role."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import paired
from .rank import VOICE, says

#: Fixed values.
ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth".split()
ROMAN = "0 i ii iii iv v vi vii viii ix x".split()
PLACEHOLDER = "(?i)select|choose|--"


def wanted_number(value: Column) -> Column:
    """The number a text names in digits or as an ordinal word."""
    v = F.lower(F.coalesce(value, F.lit("")))
    n = F.regexp_extract(v, r"\b(\d{1,6})(?:st|nd|rd|th)?\b", 1)
    words = [F.when(F.rlike(v, F.lit(rf"\b{w}\b")), i) for i, w in enumerate(ORDINALS) if i]
    return F.when(n != "", n.cast("int")).otherwise(F.coalesce(*words))


def option_match(value: Column, options: Column) -> Column:
    """The option (struct index, value, text) a request means: equal, else same number or Roman numeral, else held text, else by place."""
    v, n = F.lower(F.trim(F.coalesce(value, F.lit("")))), wanted_number(value)
    text = lambda o: F.lower(F.trim(F.coalesce(o["text"], F.lit(""))))
    val = lambda o: F.lower(F.trim(F.coalesce(o["value"], F.lit(""))))
    roman = F.concat(F.lit(r"(?i)\b"), F.get(F.lit(ROMAN), n), F.lit(r"\b"))
    placeholder = lambda o: F.rlike(text(o), F.lit(PLACEHOLDER)) & (o["index"] == 0)
    first = lambda test: F.get(F.filter(options, test), F.lit(0))
    equal = first(lambda o: (val(o) == v) | (text(o) == v))
    number = first(lambda o: n.isNotNull() & ((val(o) == n.cast("string")) | (wanted_number(F.regexp_replace(text(o), "[a-z]{5,}", " ")) == n) | ((n <= 10) & F.coalesce(F.rlike(text(o), roman) | F.rlike(val(o), roman), F.lit(False)))))
    held = first(lambda o: ~placeholder(o) & (text(o) != "") & (F.contains(text(o), v) | F.contains(v, text(o))))
    top = F.get(options, F.lit(0))
    offset = F.when(F.rlike(text(top), F.lit(PLACEHOLDER)) | val(top).isin("0", ""), n).otherwise(n - 1)
    place = F.when(n < F.size(options), F.get(options, offset))
    return F.coalesce(equal, number, held, place)


def suggestion_match(query: Column, suggestions: Column) -> Column:
    """The suggestion that names the query as a code or starts with it, else holds it, else the first."""
    q = F.lower(F.trim(query))
    first = lambda test: F.get(F.filter(suggestions, test), F.lit(0))
    low = lambda s: F.lower(s)
    named = first(lambda s: F.contains(low(s), F.concat(F.lit("("), q, F.lit(")"))) | F.contains(low(s), F.concat(F.lit("- "), q)) | F.startswith(low(s), q))
    return F.coalesce(named, first(lambda s: F.contains(low(s), q)), F.get(suggestions, F.lit(0)))


def all_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def roles(elements: DataFrame) -> DataFrame:
    """(request_id, search_input, search_button, message_box, login_user, login_password, login_button, first_result): the first element id of each role, best tier first.

    elements: request_id, elem_idx, element_id, tag, role, input_type, label, placeholder, text, name, href.
    """
    t = all_text("label", "placeholder", "text", "name", "element_id")
    is_input = F.col("tag").isin("input", "textarea") | F.coalesce(F.col("role").isin("textbox", "searchbox", "combobox"), F.lit(False))
    button = (F.col("tag") == "button") | F.coalesce(F.col("role") == "button", F.lit(False)) | F.coalesce(F.col("input_type").isin("submit", "button"), F.lit(False))
    link = (F.col("tag") == "a") | F.coalesce(F.col("role") == "link", F.lit(False))
    quiet = ~says(t, VOICE)
    kind = F.coalesce(F.col("input_type"), F.lit(""))
    tiers: dict[str, list[Column]] = {
        "search_input": [is_input & quiet & (kind == "search"), is_input & quiet & says(t, "search")],
        "search_button": [button & quiet & says(t, "search")],
        "message_box": [is_input & quiet & says(t, "type a message"), is_input & quiet & says(t, "message|chat|reply") & ~says(t, "search")],
        "login_user": [is_input & says(t, r"user\s*name|user\s*id|login\s*id"), is_input & (kind != "password") & says(t, "email|mobile|phone|roll|enrol")],
        "login_password": [is_input & (kind == "password"), is_input & says(t, "password")],
        "login_button": [button & says(t, r"\b(log\s*in|sign\s*in|login)\b"), button & says(t, "submit|continue")],
        "first_result": [link & says(F.col("href"), r"watch\?v=|playlist|/course"), link & says(t, "views|lessons")],
    }
    pick = lambda tests: F.coalesce(*[F.min_by(F.when(x, F.col("element_id")), F.when(x, F.col("elem_idx"))) for x in tests])
    return elements.groupBy("request_id").agg(*[pick(tests).alias(name) for name, tests in tiers.items()])


def normalized_action(actions: DataFrame, found: DataFrame, task: str = "task") -> DataFrame:
    """actions(request_id, task, query, action_type, target, value) after the search and login passes: later passes see what earlier ones made.

    Login: done, or a click on the login button, while a field is unknown becomes wait. Search: a search task's click on, or typing into, the
    search button or input types the query into the input; a result that was asked for stays.
    """
    a = actions.join(found, "request_id", "left")
    kind, target = F.col("action_type"), F.col("target")
    login = says(F.col(task), r"\b(log\s*in|sign\s*in)\b") & F.col("login_password").isNotNull()
    hold = login & ((kind == "done") | ((kind == "click") & target.eqNullSafe(F.col("login_button"))))
    search = ~hold & F.col("query").isNotNull() & F.col("search_input").isNotNull() & ~target.eqNullSafe(F.col("first_result"))
    typed = search & (target.eqNullSafe(F.col("search_input")) | target.eqNullSafe(F.col("search_button")) | target.isNull()) & kind.isin("click", "type", "done")
    filled = (kind == "click") & F.coalesce(F.col("value") != "", F.lit(False)) & ~typed & ~hold
    return a.withColumns({
        "action_type": F.when(hold, "wait").when(typed | filled, "type").otherwise(kind),
        "target": F.when(typed, F.col("search_input")).otherwise(target),
        "value": F.when(typed, F.col("query")).otherwise(F.col("value")),
    }).select(*actions.columns)


def table_headers(cells: DataFrame, headers: DataFrame, slack: int = 4) -> DataFrame:
    """Each cell with the first header of its table whose span holds the cell's centre, else the one of its index.

    cells: table_id, cell_id, col_idx, x, width. headers: table_id, th_idx, x, width, text.
    """
    one = F.struct("th_idx", F.col("x").alias("x"), F.col("width").alias("width"), F.col("text").alias("header"))
    h = headers.where("th_idx is not null").groupBy(F.col("table_id").alias("_t")).agg(F.sort_array(F.collect_list(one)).alias("_h"))  # a table has few
    centre = F.col("x") + F.col("width") / 2
    over = F.filter("_h", lambda t: centre.between(t["x"] - slack, t["x"] + t["width"] + slack))
    placed = F.array_max(F.transform(F.filter("_h", lambda t: t["th_idx"] == F.col("col_idx")), lambda t: t["header"]))
    both = paired(cells, h, F.col("table_id") == F.col("_t"), "left")
    return both.select(*cells.columns, F.coalesce(F.get(over, F.lit(0))["header"], placed).alias("header")).distinct()
