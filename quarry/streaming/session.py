"""Sessions of an agent as NDJSON events: dispatch by type, text, tool calls, tool results, cost, and the result document of each session.

All functions work on batch and, but for the result document, on streaming input; ``running_text`` is the stateful stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import preview
from ..sources.files import event_lines

# The tools whose calls are listed by one argument, and that argument; others show their whole input.
ARGUMENT = {"Bash": "command", "Read": "file_path", "Edit": "file_path", "Write": "file_path", "Grep": "pattern", "Glob": "pattern"}
# Seconds a session may take in all, and between two events.
HARD_TIMEOUT, IDLE_TIMEOUT = 1800, 120


def blocks(e: Column, kind: str) -> Column:
    """The content blocks of a kind; empty where the event has none."""
    return F.coalesce(F.filter(e["message"]["content"], lambda b: b["type"] == kind), F.array())


def event_text(e: Column) -> Column:
    """What an event adds to the session's text: the text blocks of an assistant message, or a text delta."""
    whole = F.array_join(F.transform(blocks(e, "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    delta = F.when(e["delta"]["type"] == "text_delta", F.coalesce(e["delta"]["text"], F.lit(""))).otherwise("")
    return F.when(e["type"] == "assistant", whole).when(e["type"] == "content_block_delta", delta).otherwise("")


def dispatched(events: DataFrame) -> DataFrame:
    """One row for each thing an event shows: its other columns, ``action`` and ``shown`` (null where nothing is)."""
    e = F.col("e")
    item = lambda action, shown: F.struct(F.lit(action).alias("action"), shown.cast("string").alias("shown"))
    one = lambda action, shown: F.array(item(action, shown))
    assistant = F.transform(F.coalesce(e["message"]["content"], F.array()), lambda b: F.when(b["type"] == "text", item("text", b["text"])).when(b["type"] == "tool_use", item("tool", F.coalesce(b["name"], F.lit("unknown")))).when(b["type"] == "thinking", item("thinking", preview(b["thinking"], 500))))
    results = F.transform(blocks(e, "tool_result"), lambda b: F.when(F.coalesce(b["is_error"], F.lit(False)), item("tool_error", preview(b["content"], 500))).otherwise(item("tool_result", preview(b["content"], 500))))
    start = F.when(e["content_block"]["type"] == "tool_use", one("tool_start", F.coalesce(e["content_block"]["name"], F.lit("")))).when(e["content_block"]["type"] == "thinking", one("thinking_start", F.lit(None)))
    delta = F.when(e["delta"]["type"] == "text_delta", one("text", F.coalesce(e["delta"]["text"], F.lit("")))).when(e["delta"]["type"] == "thinking_delta", one("thinking", F.coalesce(e["delta"]["thinking"], F.lit(""))))
    error = one("error", F.coalesce(e["error"]["message"], F.lit("Unknown error")))
    shown = F.when(e["type"] == "assistant", assistant).when(e["type"] == "content_block_start", start).when(e["type"] == "content_block_delta", delta).when(e["type"] == "user", results)
    shown = shown.when(e["type"] == "system", one("system", F.coalesce(e["subtype"], F.lit("")))).when(e["type"] == "result", one("cost", F.format_string("%.4f", F.coalesce(e["cost_usd"], F.lit(0.0))))).when(e["type"] == "error", error)
    shown = F.when(F.col("bad").isNotNull(), one("line", F.col("bad"))).otherwise(shown)
    return events.withColumn("_x", F.explode(F.filter(shown, lambda x: x.isNotNull()))).select(*[c for c in events.columns if c not in ("e", "bad")], "_x.action", "_x.shown")


def tool_calls(events: DataFrame) -> DataFrame:
    """The tool calls: the rows' other columns, ``tool`` and its main argument (commands up to 200 characters, unknown tools' whole input up to 300)."""
    out = events.withColumn("_b", F.explode(F.when(F.col("e.type") == "assistant", blocks(F.col("e"), "tool_use"))))
    tool = F.coalesce("_b.name", F.lit("unknown"))
    text = F.coalesce(*[F.when(tool == t, F.coalesce(F.get_json_object("_b.input", f"$.{a}"), F.lit(""))) for t, a in ARGUMENT.items()])
    shown = F.when(tool == "Bash", preview(text, 200)).when(text.isNotNull(), text).otherwise(F.left(F.col("_b.input"), F.lit(300)))
    return out.select(*[c for c in events.columns if c not in ("e", "bad")], tool.alias("tool"), shown.alias("argument"))


def tool_results(events: DataFrame) -> DataFrame:
    """The tool results: the rows' other columns, ``is_error`` and the content up to 500 characters."""
    out = events.withColumn("_b", F.explode(F.when(F.col("e.type") == "user", blocks(F.col("e"), "tool_result"))))
    return out.select(*[c for c in events.columns if c not in ("e", "bad")], F.coalesce("_b.is_error", F.lit(False)).alias("is_error"), preview(F.coalesce("_b.content", F.lit("")), 500).alias("content"))


def in_time(events: DataFrame, key: str, ts: str, seconds: int = HARD_TIMEOUT) -> DataFrame:
    """Events up to so many seconds after the first of their session."""
    first = events.groupBy(key).agg(F.min(ts).alias("_first"))
    return events.join(first, key).filter(F.col(ts) <= F.col("_first") + F.expr(f"INTERVAL {seconds} SECONDS")).drop("_first")


def result_documents(lines: DataFrame, key: str, seq: str, column: str, exited: str | None = None) -> DataFrame:
    """(key, success, result, cost, messages, bad): text in order of events, the last result's cost (0.0 if none), how many events and bad lines there are.

    ``exited`` is a column with the session's return code, null while it runs: lines from its first value on are drained, i.e. events
    among them count as messages but are not dispatched, and bad lines are dropped.
    """
    e = event_lines(lines, column)
    if exited is not None:
        end = lines.groupBy(key).agg(F.min(F.when(F.col(exited).isNotNull(), F.col(seq))).alias("_end"), F.min_by(exited, F.when(F.col(exited).isNotNull(), F.col(seq))).alias("_code"))
        e = e.join(end, key, "left")
    else:
        e = e.withColumns({"_end": F.lit(None).cast("long"), "_code": F.lit(0)})
    live = F.col("_end").isNull() | (F.col(seq) < F.col("_end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(live & F.col("bad").isNull(), F.struct(F.col(seq).alias("s"), event_text(F.col("e")).alias("t"))))), lambda x: x["t"]), "")
    cost = F.coalesce(F.max_by(F.coalesce("e.cost_usd", F.lit(0.0)), F.when(live & (F.col("e.type") == "result"), F.col(seq))), F.lit(0.0))
    messages = F.count_if(F.col("bad").isNull())
    return e.groupBy(key).agg((F.coalesce(F.max("_code"), F.lit(0)) == 0).alias("success"), text.alias("result"), cost.alias("cost"), messages.alias("messages"), F.count_if(live & F.col("bad").isNotNull()).alias("bad"))


def running_text(events: DataFrame, key: str, seq: str) -> DataFrame:
    """A stream of (key, seq, e) -> (key, chars, last): the length of each session's text so far and its last event's number, kept as state.

    A session's text itself is never held: state is two numbers, whatever its length.
    """
    flat = events.select(F.col(key).cast("long").alias("key"), F.col(seq).cast("long").alias("seq"), F.length(event_text(F.col("e"))).cast("long").alias("n"))

    def add(key_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chars, last = state.get if state.exists else (0, -1)
        for frame in frames:
            chars, last = chars + int(frame["n"].sum()), max(last, int(frame["seq"].max()))
        state.update((chars, last))
        yield pd.DataFrame({"key": [key_[0]], "chars": [chars], "last": [last]})

    return flat.groupBy("key").applyInPandasWithState(add, "key long, chars long, last long", "chars long, last long", "update", "NoTimeout")
