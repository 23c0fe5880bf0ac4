"""Structured agent responses: parsing and coercion; dates, vault values, feedback forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed values.
ACTIONS = ("click", "type", "scroll", "select", "wait", "ask_user", "done", "type_and_select", "pick_date", "select_custom", "fill_form")

def json_block(raw: Column) -> Column:
    """The outermost braces of a text, markdown fences off."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?m)^```(?:json)?\s*", ""), r"(?m)\s*```$", "")
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(block != "", block).otherwise(bare)


def _get(doc: Column, path: str) -> Column:
    """A scalar of a JSON text; empty, null and false count as absent."""
    v = F.get_json_object(doc, path)
    return F.when(~v.isin("", "null", "false", "0", "[]", "{}"), v)


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with error, action_type, target, value, scroll_direction, reasoning, confidence, needs_clarification.

    A list of actions comes first, then an action object, an action string, a type at the top; without any the action is ask_user.
    An unknown action string is an error; any other unknown type is a click.
    """
    d = json_block(F.col(raw))
    v = F.try_parse_json(d)
    ok = v.isNotNull() & F.startswith(F.trim(d), F.lit("{"))
    doc = F.when(ok, d)
    as_list, act = F.get_json_object(doc, "$.actions[0]"), F.get_json_object(doc, "$.action")
    listed = F.startswith(F.coalesce(as_list, F.lit("")), F.lit("{"))
    nested = F.startswith(F.coalesce(act, F.lit("")), F.lit("{"))
    word = F.lower(act)
    top_type = F.get_json_object(doc, "$.type")
    known = lambda t: F.when(F.lower(F.coalesce(t, F.lit("click"))).isin(*ACTIONS), F.lower(F.coalesce(t, F.lit("click")))).otherwise("click")
    bad = ~listed & ~nested & act.isNotNull() & ~word.isin(*ACTIONS)
    error = F.when(F.coalesce(F.col(raw), F.lit("")) == "", "empty").when(~F.coalesce(ok, F.lit(False)), "not a JSON object").when(bad, F.concat(F.lit("invalid action: "), act))
    where = F.when(listed, as_list).when(nested, act).otherwise(doc)
    kind = F.when(listed | nested, known(F.get_json_object(where, "$.type"))).when(act.isNotNull(), word).when(top_type.isNotNull(), known(top_type)).otherwise("ask_user")
    scroll = _get(where, "$.scrollDirection")
    conf = F.get_json_object(doc, "$.confidence")
    value = F.try_cast(conf, "double") if hasattr(F, "try_cast") else conf.try_cast("double")
    none = kind == "ask_user"
    good = error.isNull()
    return df.withColumns({
        "error": error,
        "action_type": F.when(good, kind),
        "target": F.when(good & ~(none & ~listed & ~nested & act.isNull()), F.coalesce(_get(where, "$.targetElementId"), _get(where, "$.target"))),
        "value": F.when(good & ~(none & ~listed & ~nested & act.isNull()), _get(where, "$.value")),
        "scroll_direction": F.when(good & scroll.isin("up", "down"), scroll),
        "reasoning": F.when(good, F.when(listed, F.coalesce(_get(doc, "$.message"), _get(where, "$.reasoning"), F.lit("Proceeding with recommended step."))).otherwise(F.coalesce(_get(doc, "$.reasoning"), _get(doc, "$.message"), _get(doc, "$.description"), F.lit("Action determined from screen state.")))),
        "confidence": F.when(good, F.when(conf.isNull(), 0.85).when(value.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))),
        "needs_clarification": F.when(good, F.coalesce(F.get_json_object(doc, "$.needsClarification") == "true", F.lit(False))),
    })


def first_valid(outputs: DataFrame) -> DataFrame:
    """outputs(request_id, attempt, raw): each request's first attempt without an error, else a safe question to the user."""
    p = parsed(outputs)
    best = p.groupBy("request_id").agg(F.min_by(F.struct("action_type", "target", "value", "scroll_direction", "reasoning", "confidence", "needs_clarification"), F.struct(F.col("error").isNotNull().alias("bad"), "attempt")).alias("r"), F.min(F.col("error").isNotNull()).alias("failed"))
    ask = F.struct(F.lit("ask_user").alias("action_type"), *[F.lit(None).cast("string").alias(n) for n in ("target", "value", "scroll_direction")], F.lit("The response could not be read.").alias("reasoning"), F.lit(0.3).alias("confidence"), F.lit(True).alias("needs_clarification"))
    return best.select("request_id", F.inline(F.array(F.when(F.col("failed"), ask).otherwise(F.col("r")))))


def shown_date(value: Column, today: Column) -> Column:
    """today, tomorrow, YYYY-M-D and D-M-YYYY (also / and .) as DD/MM/YYYY without a calendar check; else as it is."""
    v = F.trim(F.coalesce(value, F.lit("")))
    put = lambda d: F.date_format(d, "dd/MM/yyyy")
    ymd, dmy = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\z", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\z"
    part = lambda p, i, n=2: F.lpad(F.regexp_extract(v, p, i), n, "0")
    return (
        F.when(F.rlike(v, F.lit("(?i)tomorrow")), put(F.date_add(today, 1))).when(F.rlike(v, F.lit("(?i)today")), put(today))
        .when(F.rlike(v, F.lit(ymd)), F.concat_ws("/", part(ymd, 3), part(ymd, 2), F.regexp_extract(v, ymd, 1)))
        .when(F.rlike(v, F.lit(dmy)), F.concat_ws("/", part(dmy, 1), part(dmy, 2), F.regexp_extract(v, dmy, 3))).otherwise(v)
    )


def resolve_vault(ref: Column, vault: Column, strict: bool = False) -> Column:
    """The value a reference ``local.key`` names in a map; anything else as it is. An unknown key gives null, or an error where strict."""
    key = F.substring(ref, 7, 1 << 20)
    value = F.element_at(vault, key)
    if strict:
        value = F.when(F.coalesce(F.array_contains(F.map_keys(vault), key), F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit("no such vault key: "), key)))
    return F.when(F.startswith(ref, F.lit("local.")), value).otherwise(ref)


def vault_with(vault: Column, key: Column, value: Column) -> Column:
    """The vault with an entry set."""
    rest = F.map_filter(F.coalesce(vault, F.expr("cast(map() as map<string,string>)")), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(key, value))


def vault_keys(vault: Column) -> Column:
    """The keys whose entry has a value, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(vault, lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False)))))


def valid_action(action: Column) -> Column:
    """Whether an action as JSON has the exact form: a type of ACTIONS, a scroll direction of up or down, and no other fields."""
    keys = F.json_object_keys(action)
    known = F.forall(keys, lambda k: k.isin("type", "targetElementId", "value", "scrollDirection"))
    way = F.get_json_object(action, "$.scrollDirection")
    return F.coalesce(known & F.get_json_object(action, "$.type").isin(*ACTIONS) & (way.isNull() | way.isin("up", "down")), F.lit(False))


def feedback_error(name: Column, email: Column, url: Column, description: Column) -> Column:
    """The first reason to refuse a feedback form, or null."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    n = lambda c: F.length(t(c))
    return (
        F.when(n(description) == 0, "description missing").when(n(description) < 10, "description too short").when(n(description) > 5000, "description too long").when(n(name) > 100, "name too long")
        .when(n(email) > 150, "email too long").when((n(email) > 0) & ~F.rlike(t(email), F.lit(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z")), "email invalid").when(n(url) > 500, "url too long")
    )
