"""Elements that selectors mean, over the table of page trees, and the element that an action's target names.

A selector is evaluated from its first step to its last, for all its elements at once. Elements are numbered in page order and know the last one inside them, so to be inside one of a set is a running maximum over the
page; to be after one of a set among siblings is a running flag; parents and the siblings right before are met by equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.styles import selectors

STEPS = "array<array<struct<join:string,tag:string,id:string,classes:array<string>,attrs:array<struct<name:string,op:string,value:string,fold:boolean>>,nth:array<struct<a:int,b:int>>>>>"
#: What can be acted on, what only holds it, and where targets of a login mean the button inside.
INTERACTIVE = "a[href], button, input, select, textarea, [role='button'], [role='link'], [role='checkbox'], [role='radio'], [role='menuitem'], [role='tab'], [role='combobox'], [role='textbox'], [onclick], [tabindex]"
INNER = "a, button, input[type='button'], input[type='submit'], [role='menuitem'], [role='link'], [role='button'], [onclick]"
HOLDERS = ("li", "nav", "ul", "ol", "header", "section", "aside")
STAMP, PLACE = "data-element-id", r"^[A-Za-z_]+(?:[-_][A-Za-z_]+)*[-_](\d{1,9})\z"


def _parsed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text: str | None) -> list:
        return [[{"join": s.join, "tag": s.tag, "id": s.id, "classes": s.classes, "attrs": [dict(zip(("name", "op", "value", "fold"), a)) for a in s.attrs], "nth": [{"a": a, "b": b} for a, b in s.nth]} for s in steps] for steps in selectors(text or "")]

    for series in texts:
        yield series.map(one)


def steps_of(text: Column) -> Column:
    """The steps of each selector of a list; an empty list where it is not understood."""
    return F.pandas_udf(STEPS)(_parsed)(text)


def fits(step: Column, tag: Column, attrs: Column, nth: Column) -> Column:
    """Whether an element is one that a step means by itself."""
    own = F.coalesce(F.filter(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), lambda c: c != ""), F.array())

    def attr(a: Column) -> Column:
        given = F.element_at(attrs, a["name"])
        have, want = F.when(a["fold"], F.lower(given)).otherwise(given), F.when(a["fold"], F.lower(a["value"])).otherwise(a["value"])
        some = want != ""
        way = (
            F.when(a["op"] == "", F.lit(True)).when(a["op"] == "=", have == want).when(a["op"] == "~=", F.array_contains(F.split(have, r"\s+"), want)).when(a["op"] == "|=", (have == want) | F.startswith(have, F.concat(want, F.lit("-"))))
            .when(a["op"] == "^=", some & F.startswith(have, want)).when(a["op"] == "$=", some & F.endswith(have, want)).otherwise(some & F.contains(have, want))
        )
        return given.isNotNull() & F.coalesce(way, F.lit(False))

    def numbered(x: Column) -> Column:
        return F.when(x["a"] == 0, nth == x["b"]).otherwise(((nth - x["b"]) % F.when(x["a"] == 0, 1).otherwise(x["a"]) == 0) & ((nth - x["b"]) / F.when(x["a"] == 0, 1).otherwise(x["a"]) >= 0))

    return (
        (step["tag"].isNull() | (step["tag"] == tag)) & (step["id"].isNull() | F.coalesce(step["id"] == attrs["id"], F.lit(False)))
        & F.forall(step["classes"], lambda c: F.array_contains(own, c)) & F.forall(step["attrs"], attr) & F.forall(step["nth"], numbered)
    )


def matched(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, key, elem_idx): the elements of each page that each selector of wanted(page_id, key, selector) means. tree: page_tree(). A selector that is not understood means nothing."""
    parsed = wanted.select("page_id", "key", F.posexplode(steps_of(F.col("selector"))).alias("k", "steps"))
    longest = parsed.agg(F.max(F.size("steps"))).first()[0] or 0
    # what is exchanged for each step is small: of the steps how they are joined, and of an element which of them it fits, and its sibling before; elements that fit none are never meant
    sibling = F.lag("elem_idx").over(Window.partitionBy("page_id", "parent_idx").orderBy("elem_idx"))
    e = tree.select("page_id", "elem_idx", "parent_idx", "last_idx", "tag", "attrs", "nth").withColumn("before_idx", sibling)
    rows = e.join(parsed, "page_id")
    fit = F.transform("steps", lambda s: fits(s, F.col("tag"), F.col("attrs"), F.col("nth")))
    known = rows.select("page_id", "key", "k", "elem_idx", "parent_idx", "last_idx", "before_idx", F.array_join(F.transform("steps", lambda s: F.rpad(F.coalesce(s["join"], F.lit("")), 1, " ")), "").alias("joins"), F.explode(F.filter(F.array(fit), lambda f: F.exists(f, lambda x: x))).alias("fits"))
    out = known.withColumn("on", F.col("fits")[0])
    own = ["page_id", "key", "k"]
    for i in range(1, longest):
        before = Window.partitionBy(*own).orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)
        beside = Window.partitionBy(*own, "parent_idx").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.max(F.when(F.col("on"), F.col("last_idx"))).over(before) >= F.col("elem_idx"), F.lit(False))
        later = F.coalesce(F.max("on").over(beside), F.lit(False))
        next_to = F.coalesce(F.last(F.when(F.col("on"), F.col("elem_idx"))).over(beside) == F.col("before_idx"), F.lit(False))
        above = out.where("on").select(*[F.col(c).alias(f"_{c}") for c in own], F.col("elem_idx").alias("_at"))
        out = out.withColumns({"_inside": inside, "_later": later, "_next": next_to})
        met = [F.col(c) == F.col(f"_{c}") for c in own]
        out = out.join(above, [*met, F.col("parent_idx") == F.col("_at")], "left")
        join = F.substring("joins", i + 1, 1)
        held = F.when(join == " ", F.col("_inside")).when(join == ">", F.col("_at").isNotNull()).when(join == "+", F.col("_next")).otherwise(F.col("_later"))
        now = F.when(F.length("joins") > i, held & F.col("fits")[i]).otherwise(F.col("on"))
        out = out.withColumn("on", now).drop("_inside", "_later", "_next", "_at", *[f"_{c}" for c in own])
    return out.where("on").select("page_id", "key", "elem_idx").distinct()


def located(actions: DataFrame, tree: DataFrame, stamp: str = STAMP) -> DataFrame:
    """actions(request_id, page_id, target) with elem_idx, the element that each target names, and way: by its id (with or without #), by the id it was stamped with, by its place among the elements that can be acted on and seen
    (``tok-3`` is the fourth), or as a selector; the first way that finds one counts, and of it the first element. Where that only holds others (HOLDERS), the first element inside that can be acted on stands for it.
    """
    t = F.col("target")
    asked = actions.select("request_id", "page_id", "target").where("target is not null and target <> ''").distinct()
    e = tree.select("page_id", "elem_idx", "tag", "last_idx", F.col("attrs")["id"].alias("id"), F.col("attrs")[stamp].alias("stamped"))
    pages = asked.select("page_id").distinct()
    shown = matched(tree.join(pages, "page_id", "left_semi"), pages.select("page_id", F.lit(0).alias("key"), F.lit(INTERACTIVE).alias("selector")))
    seen = shown.join(tree.where("not hidden").select("page_id", "elem_idx"), ["page_id", "elem_idx"])
    nth = seen.select("page_id", "elem_idx", (F.row_number().over(Window.partitionBy("page_id").orderBy("elem_idx")) - 1).alias("place"))
    keyed = asked.withColumns({"bare": F.regexp_replace("target", r"^#", ""), "place": F.regexp_extract("target", PLACE, 1).try_cast("int")})
    hit = lambda df, way: df.select("request_id", "page_id", "target", F.lit(way).alias("way"), "elem_idx")
    by_id = hit(keyed.join(e, (keyed["page_id"] == e["page_id"]) & (F.col("bare") == F.col("id"))).drop(e["page_id"]), 1)
    by_stamp = hit(keyed.join(e, (keyed["page_id"] == e["page_id"]) & (t == F.col("stamped"))).drop(e["page_id"]), 2)
    by_place = hit(keyed.join(nth, ["page_id", "place"]), 3)
    by_selector = matched(tree, asked.select("page_id", t.alias("key"), t.alias("selector")).distinct()).withColumnRenamed("key", "target")
    by_selector = hit(keyed.join(by_selector, ["page_id", "target"]), 4)
    best = by_id.unionByName(by_stamp).unionByName(by_place).unionByName(by_selector).groupBy("request_id", "page_id", "target").agg(F.min(F.struct("way", "elem_idx")).alias("b"))
    best = best.select("request_id", "page_id", "target", "b.*").join(e.select("page_id", "elem_idx", "tag", "last_idx"), ["page_id", "elem_idx"])
    inner = matched(tree.join(pages, "page_id", "left_semi"), pages.select("page_id", F.lit(0).alias("key"), F.lit(INNER).alias("selector"))).select(F.col("page_id").alias("_p"), F.col("elem_idx").alias("_in"))
    held = best.where(F.col("tag").isin(*HOLDERS)).join(inner, (F.col("page_id") == F.col("_p")) & (F.col("_in") > F.col("elem_idx")) & (F.col("_in") <= F.col("last_idx")))
    inside = held.groupBy("request_id", "page_id", "target").agg(F.min("_in").alias("_in"))
    found = best.join(inside, ["request_id", "page_id", "target"], "left").select("request_id", "page_id", "target", F.coalesce("_in", "elem_idx").alias("elem_idx"), "way")
    return actions.join(found, ["request_id", "page_id", "target"], "left")


FIELDS, BESIDE, CELL, LONGEST_LABEL = ("input", "select", "textarea"), ("label", "span", "p"), 80, 200


def whole_texts(tree: DataFrame, some: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, elem_idx, whole): the text of elements(page_id, elem_idx, last_idx) with all that is inside them in page order, but for elements of some tags."""
    parts = tree.where(~F.col("tag").isin(*without) & (F.col("text") != "")).select(F.col("page_id").alias("_p"), F.col("elem_idx").alias("_at"), F.col("text").alias("_t"))
    met = some.join(parts, (F.col("page_id") == F.col("_p")) & (F.col("_at") >= F.col("elem_idx")) & (F.col("_at") <= F.col("last_idx")))
    return met.groupBy("page_id", "elem_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_t"))), lambda x: x["_t"]), " ").alias("whole"))


def field_labels(tree: DataFrame) -> DataFrame:
    """(page_id, elem_idx, label) of the form fields of page_tree(): the text of the first label that is for its id, else of the label around it, its aria-label, the element that aria-labelledby names, the label, span or paragraph right
    before it, or the cell before its own, if that is short; cut to 200 characters, empty if there is none. The first of these that is there counts, even if its text is empty, but for the last.
    """
    field = tree.where(F.col("tag").isin(*FIELDS)).select("page_id", "elem_idx", "parent_idx", "nth", F.col("attrs")["id"].alias("id"), F.col("attrs")["aria-label"].alias("aria"), F.col("attrs")["aria-labelledby"].alias("by"))
    e = tree.select(F.col("page_id").alias("_p"), F.col("elem_idx").alias("_i"), F.col("last_idx").alias("_last"), F.col("parent_idx").alias("_up"), F.col("nth").alias("_nth"), "tag", F.col("attrs")["id"].alias("_id"), F.col("attrs")["for"].alias("_for"))
    same = F.col("page_id") == F.col("_p")
    inside = (F.col("_i") < F.col("elem_idx")) & (F.col("elem_idx") <= F.col("_last"))
    one = lambda found, way, pick: found.groupBy("page_id", "elem_idx").agg(pick("_i").alias("_i")).withColumn("way", F.lit(way))
    ways = [
        one(field.where("id <> ''").join(e, same & (F.col("tag") == "label") & (F.col("_for") == F.col("id"))), 1, F.min),
        one(field.join(e, same & (F.col("tag") == "label") & inside), 2, F.max),
        one(field.where("by <> ''").join(e, same & (F.col("_id") == F.col("by"))), 4, F.min),
        one(field.join(e, same & F.col("parent_idx").eqNullSafe(F.col("_up")) & (F.col("_nth") == F.col("nth") - 1) & F.col("tag").isin(*BESIDE)), 5, F.max),
    ]
    cells = one(field.join(e, same & (F.col("tag") == "td") & inside), 6, F.max).withColumnRenamed("_i", "_cell")
    own = e.select("_p", F.col("_i").alias("_cell"), F.col("_up").alias("_row"), F.col("_nth").alias("_k"))
    before = cells.join(own, (F.col("page_id") == F.col("_p")) & (own["_cell"] == cells["_cell"])).select("page_id", "elem_idx", "way", "_row", "_k")
    ways.append(before.join(e, same & F.col("_row").eqNullSafe(F.col("_up")) & (F.col("_nth") == F.col("_k") - 1)).select("page_id", "elem_idx", "_i", "way"))
    named = ways[0]
    for w in ways[1:]:
        named = named.unionByName(w)
    spots = named.select("page_id", F.col("_i").alias("elem_idx"), "way").distinct().join(tree.select("page_id", "elem_idx", "last_idx"), ["page_id", "elem_idx"])
    full = whole_texts(tree, spots.select("page_id", "elem_idx", "last_idx").distinct()).withColumnRenamed("elem_idx", "_i")
    bare = whole_texts(tree, spots.where("way = 2").select("page_id", "elem_idx", "last_idx").distinct(), (*FIELDS, "option", "optgroup")).select("page_id", F.col("elem_idx").alias("_i"), F.col("whole").alias("_bare"))
    text = named.join(full, ["page_id", "_i"], "left").join(bare, ["page_id", "_i"], "left")
    text = text.select("page_id", "elem_idx", "way", F.trim(F.coalesce(F.when(F.col("way") == 2, F.col("_bare")).otherwise(F.col("whole")), F.lit(""))).alias("label"))
    text = text.where((F.col("way") < 6) | F.length("label").between(1, CELL)).unionByName(field.where("aria <> ''").select("page_id", "elem_idx", F.lit(3).alias("way"), F.trim("aria").alias("label")))
    best = text.groupBy("page_id", "elem_idx").agg(F.min_by("label", "way").alias("label"))
    return field.select("page_id", "elem_idx").join(best, ["page_id", "elem_idx"], "left").withColumn("label", F.substring(F.coalesce("label", F.lit("")), 1, LONGEST_LABEL))
