"""The question loop's state as columns: token use, the route after each plan, notes, and the history handed on.

Messages: (conversation, pos, role, name, content), role one of human, ai, tool.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT, GATE, ITERATIONS = 65_536, 0.7, 20


def token_ratio(used: Column, most: int = CONTEXT) -> Column:
    return F.least(F.lit(1.0), used / most)


def route(ratio: Column, iteration: Column, has_calls: Column, gate: float = GATE, most: int = ITERATIONS) -> Column:
    """answer once the budget or the number of plans is reached, even with calls pending; else tool while there are calls."""
    return F.when((ratio >= gate) | (iteration >= most), "answer").when(has_calls, "tool").otherwise("answer")


def progress(messages: DataFrame, context: int = CONTEXT, gate: float = GATE, most: int = ITERATIONS) -> DataFrame:
    """Messages with tokens used so far, the ratio, the number of plans so far and the route after each plan.

    Used are half the characters of all messages so far and of the notes taken of their tool results, rounded down once.
    """
    w = Window.partitionBy("conversation").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    calls = F.lead("role").over(Window.partitionBy("conversation").orderBy("pos")) == "tool"
    chars = F.length(F.coalesce("content", F.lit(""))) + F.when(F.col("role") == "tool", F.length(note())).otherwise(0)
    out = messages.withColumn("used", F.floor(F.sum(chars).over(w) / 2)).withColumn("iteration", F.sum((F.col("role") == "ai").cast("int")).over(w)).withColumn("calls", F.coalesce(calls, F.lit(False)))
    out = out.withColumn("ratio", token_ratio(F.col("used"), context))
    return out.withColumn("route", F.when(F.col("role") == "ai", route(F.col("ratio"), F.col("iteration"), F.col("calls"), gate, most)))


def gate_position(messages: DataFrame, **how) -> DataFrame:
    """(conversation, pos): the first plan after which the loop must answer although calls are pending, null if none."""
    p = progress(messages, **how)
    return p.groupBy("conversation").agg(F.min(F.when((F.col("route") == "answer") & F.col("calls"), F.col("pos"))).alias("pos"))


def note() -> Column:
    return F.concat(F.lit("["), F.coalesce("name", F.lit("")), F.lit("] "), F.coalesce("content", F.lit("")))


def trailing_notes(messages: DataFrame) -> DataFrame:
    """Notes of the tool messages at the end of each conversation, in order: (conversation, pos, note)."""
    back = Window.partitionBy("conversation").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("_other", F.sum((F.col("role") != "tool").cast("int")).over(back)).where("_other = 0").select("conversation", "pos", note().alias("note"))


def notes_so_far(messages: DataFrame) -> DataFrame:
    """How many notes, and characters of notes, each message has before it."""
    w = Window.partitionBy("conversation").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_note = F.col("role") == "tool"
    return messages.select("conversation", "pos", F.coalesce(F.sum(is_note.cast("int")).over(w), F.lit(0)).alias("notes"), F.coalesce(F.sum(F.when(is_note, F.length(note())).otherwise(0)).over(w), F.lit(0)).alias("chars"))


def packed_history(turns: DataFrame, nothing: str = "(no retrieval in this turn)") -> DataFrame:
    """turns(conversation, turn, question, notes array, answer) -> four messages a turn: question, a call for notes, the notes, the answer."""
    call = F.concat(F.lit("retrieved_notes_turn_"), F.col("turn").cast("string"))
    block = F.when(F.coalesce(F.size("notes"), F.lit(0)) > 0, F.array_join("notes", "\n\n")).otherwise(nothing)
    message = lambda role, name, content: F.struct(F.lit(role).alias("role"), name.alias("name"), content.alias("content"))
    none = F.lit(None).cast("string")
    four = F.array(message("human", none, F.col("question")), message("ai", call, F.lit("")), message("tool", call, block), message("ai", none, F.coalesce("answer", F.lit(""))))
    return turns.select("conversation", ((F.col("turn") - 1) * 4).alias("base"), F.posexplode(four).alias("k", "m")).select("conversation", (F.col("base") + F.col("k")).alias("pos"), "m.*")


def answer_loop(question: str, plan: Callable, tools: dict[str, Callable[..., DataFrame]], finish: Callable, context: int = CONTEXT, gate: float = GATE, most: int = ITERATIONS) -> dict:
    """One question: plan(question, notes) gives (tool, arguments) or None; each tool is a DataFrame function whose few result rows become a note.

    finish(question, notes) writes the answer from the notes alone. Tools limit their own results, so what comes to the driver is bounded.
    """
    notes: list[str] = []
    iteration = 0
    while True:
        iteration += 1
        step = plan(question, notes)
        used = (len(question) + sum(map(len, notes))) // 2
        if min(1.0, used / context) >= gate or iteration >= most or step is None:
            return {"answer": finish(question, notes), "notes": notes, "iterations": iteration, "token_ratio": min(1.0, used / context)}
        name, arguments = step
        notes.append(f"[{name}] " + "\n".join(r["j"] for r in tools[name](**arguments).select(F.to_json(F.struct("*")).alias("j")).limit(15).collect()))
