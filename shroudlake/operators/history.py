"""Turn history: outcomes, bounded logs, breakers, loop replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .wording import search_query

KEEP_TURNS, RENDERED = 30, 3


def outcomes(turns: DataFrame) -> DataFrame:
    """turns(session_id, turn_seq, action_type, page_url, optionally outcome) with the outcome of each that has a next turn.

    A stored outcome stays. Else another URL on the next turn, where both are there, is a navigation; then the action's type decides.
    """
    w = Window.partitionBy("session_id").orderBy("turn_seq")
    some = lambda c: F.when(c != "", c)
    here, there = some(F.col("page_url")), some(F.lead("page_url").over(w))
    stored = some(F.col("outcome")) if "outcome" in turns.columns else F.lit(None).cast("string")
    guess = F.when(here != there, "navigation_success").when(F.col("action_type") == "type", "executed_and_sent").when(F.col("action_type") == "click", "clicked_successfully").otherwise("executed_successfully")
    return turns.withColumn("outcome", F.coalesce(stored, F.when(F.lead("turn_seq").over(w).isNotNull(), guess)))


def last_turns(turns: DataFrame, n: int = KEEP_TURNS) -> DataFrame:
    """The last n turns of each session, with their rank from the end."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_seq"))
    return turns.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def prior_actions(turns: DataFrame, n: int = RENDERED, cut: int = 50) -> DataFrame:
    """Each turn with its n earlier actions as strings, oldest first; long values end in dots."""
    w = Window.partitionBy("session_id").orderBy("turn_seq").rowsBetween(-n, -1)
    v = F.coalesce("action_value", F.lit(""))
    shown = F.concat(F.coalesce("action_type", F.lit("none")), F.when(v != "", F.concat(F.lit(": "), F.when(F.length(v) > cut, F.concat(F.substring(v, 1, cut), F.lit("..."))).otherwise(v))).otherwise(""))
    return turns.withColumn("_a", shown).withColumn("prior", F.collect_list("_a").over(w)).drop("_a")


def breakers(steps: DataFrame) -> DataFrame:
    """steps(loop_id, step, action_type, target, value) with already_sent and repeated_click, over all earlier steps of the loop."""
    before = lambda *k: Window.partitionBy("loop_id", *k).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    sent = F.max((F.col("action_type") == "type").cast("int")).over(before("value"))
    clicked = F.max((F.col("action_type") == "click").cast("int")).over(before("target"))
    return steps.withColumn("already_sent", (F.col("action_type") == "type") & (F.coalesce(sent, F.lit(0)) > 0)).withColumn("repeated_click", (F.col("action_type") == "click") & (F.coalesce(clicked, F.lit(0)) > 0))


def guarded(steps: DataFrame) -> DataFrame:
    """breakers() with the actions that the loop's guards make: guard_type and guard_value.

    steps: also task and exec_success. A done at the first step of a task that only searches goes on (continue); a text that was typed with success before becomes
    done; a click on an element clicked before, in a search task in which nothing was typed with success, becomes the typing of the query.
    """
    before = lambda *k: Window.partitionBy("loop_id", *k).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce("exec_success", F.lit(False))
    seen = lambda test, *k: F.coalesce(F.max(test).over(before(*k)), F.lit(False))
    typed, clicked = F.col("action_type") == "type", F.col("action_type") == "click"
    searches = F.rlike("task", F.lit(r"(?i)\b(search|find|look\s*up)\b"))
    plays = F.rlike("task", F.lit(r"(?i)\b(play|watch|video|song|episode|listen)\b"))
    out = steps.withColumns({"_sent": seen(typed & ok, "value"), "_clicked": seen(clicked, "target"), "_typed": seen(typed & ok)})
    kind = (
        F.when((F.col("action_type") == "done") & searches & ~plays & (F.col("step") == 0), "continue").when(typed & F.col("_sent") & (F.col("step") > 0), "done")
        .when(clicked & F.col("_clicked") & ~F.col("_typed") & searches & F.col("target").isNotNull() & (F.col("step") > 0), "type").otherwise(F.col("action_type"))
    )
    out = out.withColumn("guard_type", kind)
    return out.withColumn("guard_value", F.when((F.col("guard_type") == "type") & clicked, search_query(F.col("task"))).otherwise(F.col("value"))).drop("_sent", "_clicked", "_typed")


def replay(steps: DataFrame, max_steps: int = 5, least: float = 0.45) -> DataFrame:
    """The steps a loop runs, and why it ends: the first of done, ask_user, clarification, low confidence, failure, cancelled, or the limit."""
    c = lambda n: F.coalesce(n, F.lit(False))
    why = (
        F.when(c("cancelled"), "cancelled").when(F.col("action_type") == "done", "done").when(F.col("action_type") == "ask_user", "ask_user").when(c("needs_clarification"), "clarification")
        .when(F.col("confidence") < least, "low_confidence").when(~F.coalesce("exec_success", F.lit(True)), "error").when(F.col("step") + 1 >= max_steps, "max_steps")
    )
    w = Window.partitionBy("loop_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("stop_reason", why).withColumn("_over", F.max(F.col("stop_reason").isNotNull()).over(w)).where(~F.coalesce("_over", F.lit(False))).drop("_over")


#: What the message of an execution says when a text was sent, and when the user has filled a form.
SENT, FILLED = "and sent message", "filled"


def guidance_flags(steps: DataFrame) -> DataFrame:
    """steps(loop_id, step, action_type, exec_success, message) with what the earlier steps of the loop did.

    clicked: something with success; contact_clicked: something at all; guided: the user was asked or waited for; filled: that, and the message says so; searched: something typed that was not sent as a message; sent: a message;
    previous_action: the type of the step before.
    """
    w = Window.partitionBy("loop_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    flag = lambda test: F.coalesce(F.max(F.coalesce(test, F.lit(False))).over(w), F.lit(False))
    kind, said = F.col("action_type"), F.coalesce("message", F.lit(""))
    asked = kind.isin("wait", "ask_user")
    return steps.withColumns({
        "clicked": flag((kind == "click") & F.col("exec_success")), "contact_clicked": flag(kind == "click"), "guided": flag(asked), "filled": flag(asked & F.contains(said, F.lit(FILLED))),
        "searched": flag((kind == "type") & ~F.contains(said, F.lit(SENT))), "sent": flag((kind == "type") & F.contains(said, F.lit(SENT))), "previous_action": F.lag("action_type").over(Window.partitionBy("loop_id").orderBy("step")),
    })
