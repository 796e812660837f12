"""Chat formatting from event logs: streamed deltas, edits and regenerations folded into messages, then rendered.

A log has the columns ``conv_id``, ``seq`` (any type that sorts; unique within a
conversation), ``message`` (string), ``kind``, ``role`` and ``text``. Kinds:

* ``open``: the message begins, with its role and perhaps a first text;
* ``delta``: text is appended to the message;
* ``edit``: the message's text is replaced;
* ``regenerate``: the message's text is emptied and every message opened after it
  and before this event is withdrawn; deltas that follow are the new text.

Messages stand in the order in which they were opened. Logs are partitioned by
conversation and message and sorted by sequence, so a conversation of any size is
spread over tasks and a task holds one message at a time. What a regeneration
withdraws is found in the control events alone, without texts.

Defined results: null role and text are empty; events of a message before its first
``open``, or without one, count for nothing, and so does a second ``open``; unknown
kinds are ignored. Null conversation ids form one conversation. Repeated sequence
numbers leave the order of those events open. Other columns of the log are ignored;
an empty log gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.ordered import batched, grouped, running, streamed


@dataclass(frozen=True)
class Template:
    """Strings around a turn. ``escape`` is one character; ``learned`` names the role under the loss mask."""

    start: str = "### "
    role_end: str = ": "
    end: str = "</turn>\n"
    escape: str = "\\"
    learned: str = "assistant"

    def __post_init__(self) -> None:
        for mark in (self.start, self.role_end, self.end):
            overlaps = any(mark.startswith(mark[i:]) for i in range(1, len(mark)))
            if not mark or self.escape in mark or overlaps or len(self.escape) != 1:
                raise ValueError(f"not a mark that can be escaped: {mark!r}")

    def marks(self) -> list[str]:
        """Control strings of texts and roles; a line end after a mark is no part of it."""
        return [self.escape, self.start, self.end.rstrip("\n") or self.end]


def _pattern(marks: list[str]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", m) for m in sorted(marks, key=len, reverse=True))


def escaped(text: Column, marks: list[str], escape: str) -> Column:
    """The text with an escape character before each control string."""
    return F.regexp_replace(text, f"({_pattern(marks)})", re.sub(r"([\\$])", r"\\\1", escape) + "$1")


def unescaped(text: str, escape: str = "\\") -> str:
    return re.sub(re.escape(escape) + "(.)", r"\1", text, flags=re.DOTALL)


def _folded(events: Iterator[tuple]) -> tuple | None:
    """One message from its events in order: seq of its opening, role, text."""
    opened, role, parts = None, "", []
    for _, _, seq, kind, by, text in events:
        if opened is None:
            if kind == "open":
                opened, role, parts = seq, by or "", [text or ""]
        elif kind == "delta":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts = []
    return None if opened is None else (opened, role, "".join(parts))


def withdrawn(log: DataFrame) -> DataFrame:
    """``conv_id, message`` of messages that a later regeneration of an earlier message withdraws."""
    when = {kind: F.when(F.col("kind") == kind, F.col("seq")) for kind in ("open", "regenerate")}
    control = log.where(F.col("kind").isin("open", "regenerate")).groupBy("conv_id", "message")
    control = control.agg(F.min(when["open"]).alias("opened"), F.max(when["regenerate"]).alias("again")).where("opened is not null")
    # a conversation without regenerations has nothing to withdraw and needs no scan
    touched = control.where("again > opened").select(F.col("conv_id").alias("touched")).distinct()
    control = control.join(touched, F.col("conv_id").eqNullSafe(F.col("touched")), "left_semi")
    again = F.when(F.col("again") > F.col("opened"), F.col("again"))
    scanned = running(control.select("conv_id", "message", "opened", again.alias("again")), ["conv_id"], ["opened"], {"until": ("max", F.col("again"))})
    return scanned.where("until > opened").select("conv_id", "message")


def messages(log: DataFrame) -> DataFrame:
    """The final messages: ``conv_id, message, opened`` (seq that orders them), ``role, text``."""
    gone = withdrawn(log).select(F.col("conv_id").alias("gone_conv"), F.col("message").alias("gone_message"))
    same = F.col("conv_id").eqNullSafe(F.col("gone_conv")) & (F.col("message") == F.col("gone_message"))
    live = log.select("conv_id", "message", "seq", "kind", "role", "text").join(gone, same, "left_anti")
    schema = T.StructType(
        [log.schema["conv_id"], T.StructField("message", T.StringType()), T.StructField("opened", log.schema["seq"].dataType)]
        + [T.StructField(c, T.StringType()) for c in ("role", "text")]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((key, _folded(events)) for key, events in grouped(batches, 2))
        return batched((key + message for key, message in found if message is not None), schema)

    return streamed(live, ["conv_id", "message"], ["seq"]).mapInArrow(fold, schema)


def render(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Each turn's part of its conversation's training text, and the span in that part under the loss mask.

    A conversation's text is its ``segment`` strings in the order of ``opened``.
    ``loss_start, loss_end`` count code points within the segment, and are null for
    turns that are not learned.
    """
    marks = template.marks()
    role = escaped(F.coalesce("role", F.lit("")), marks + [template.role_end], template.escape)
    head = F.concat(F.lit(template.start), role, F.lit(template.role_end))
    body = escaped(F.coalesce("text", F.lit("")), marks, template.escape)
    parts = turns.select("*", head.alias("head"), body.alias("body"))
    start = F.when(F.col("role") == template.learned, F.char_length("head").cast("long"))
    return parts.select(
        "conv_id",
        "opened",
        F.concat("head", "body", F.lit(template.end)).alias("segment"),
        start.alias("loss_start"),
        (start + F.char_length("body")).alias("loss_end"),
    )


def format_log(log: DataFrame, template: Template = Template()) -> DataFrame:
    return render(messages(log), template)


def read_turns(pieces: Iterator[str], template: Template = Template()) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted text that arrives in pieces of any length."""
    in_role = re.compile(f"{re.escape(template.escape)}(.)|({re.escape(template.role_end)})", re.DOTALL)
    in_text = re.compile(f"{re.escape(template.escape)}(.)|({re.escape(template.end)})", re.DOTALL)
    longest = max(len(s) for s in (template.start, template.role_end, template.end)) + 1
    held, field, role, parts = "", "start", "", []

    def step(last: bool) -> Iterator[tuple[str, str]]:
        nonlocal held, field, role, parts
        at = 0
        while True:
            # a mark that may go on in the next piece is left for then
            safe = len(held) if last else len(held) - longest
            if field == "start":
                if at + len(template.start) > len(held):
                    break
                if not held.startswith(template.start, at):
                    raise ValueError("a turn does not begin with the template's mark")
                at += len(template.start)
                field = "role"
            found = (in_role if field == "role" else in_text).search(held, at)
            if found is None or found.start() >= safe:
                if safe > at:
                    parts.append(held[at:safe])
                    at = safe
                break
            parts.append(held[at : found.start()] + (found.group(1) or ""))
            at = found.end()
            if found.group(2) is not None:
                if field == "role":
                    role, field = "".join(parts), "text"
                else:
                    yield role, "".join(parts)
                    field = "start"
                parts = []
        held = held[at:]

    for piece in pieces:
        held += piece
        yield from step(False)
    yield from step(True)
    if held or field != "start":
        raise ValueError("the formatted text ends within a turn")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what the formatted conversations say when they are read again.

    Segments of a conversation pass through one task in order, one segment and one
    turn held at a time; digests are taken as the text goes by.
    """
    counts, digests = T.LongType(), T.StringType()
    schema = T.StructType([segments.schema["conv_id"]])
    for name, dtype in (("n_turns", counts), ("turns_sha256", digests), ("loss_chars", counts), ("loss_sha256", digests), ("formatted_chars", counts)):
        schema = schema.add(name, dtype)

    def digest(key: tuple, rows: Iterator[tuple]) -> tuple:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        counts = {"turns": 0, "loss": 0, "chars": 0}

        def pieces() -> Iterator[str]:
            for _, segment, start, end in rows:
                counts["chars"] += len(segment)
                if start is not None:
                    learned = unescaped(segment[start:end], template.escape)
                    counts["loss"] += len(learned)
                    loss.update(learned.encode())
                yield segment

        for role, text in read_turns(pieces(), template):
            counts["turns"] += 1
            turns.update(f"{role}\n{text}\n".encode())
        return key + (counts["turns"], turns.hexdigest(), counts["loss"], loss.hexdigest(), counts["chars"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((digest(key, rows) for key, rows in grouped(batches, 1)), schema)

    ordered = streamed(segments, ["conv_id"], ["opened"]).select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(read, schema)


def as_log(rows: DataFrame, piece: int = 400) -> DataFrame:
    """An event log whose final messages are the rows (``conv_id, turn, role, text, row``), by turn.

    ``row`` tells rows apart. Every message is streamed in pieces. By a hash of
    conversation and turn, one row in eight is first streamed by half and then
    edited into its text; one in eight is streamed by half, answered by a message
    that is then withdrawn, and regenerated. Rows of one turn follow a hash of role
    and text; null turns come first.
    """
    text = F.coalesce("text", F.lit(""))
    pick = F.coalesce(F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 8, F.lit(7))
    tie = F.xxhash64("role", "text")
    cut = rows.select(
        "conv_id", "turn", tie.alias("tie"), "row", "role", text.alias("whole"), pick.alias("pick"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)).alias("pieces"),
    )

    def event(step: Column, of: str, kind: str, words: Column) -> Column:
        role = F.col("role") if of == "own" else F.lit("assistant")
        return F.struct(step.cast("int").alias("step"), F.lit(of).alias("of"), F.lit(kind).alias("kind"), role.alias("role"), words.alias("text"))

    none = F.lit(None).cast("string")
    n = F.size("pieces")
    half = F.slice("pieces", F.lit(1), F.floor(n / 2).cast("int"))
    draft = F.transform(half, lambda p, i: event(i + 1, "own", "delta", p))
    whole = F.transform("pieces", lambda p, i: event(n + i + 4, "own", "delta", p))
    opened = F.array(event(F.lit(0), "own", "open", none))
    edited = F.concat(opened, draft, F.array(event(n + 1, "own", "edit", F.col("whole"))))
    answer = F.array(event(n + 1, "answer", "open", none), event(n + 2, "answer", "delta", F.lit("This answer is withdrawn.")), event(n + 3, "own", "regenerate", none))
    events = F.when(F.col("pick") == 0, edited).when(F.col("pick") == 1, F.concat(opened, draft, answer, whole)).otherwise(F.concat(opened, whole))
    log = cut.select("conv_id", "turn", "tie", "row", F.explode(events).alias("event"))
    return log.select(
        "conv_id",
        F.struct("turn", "tie", "row", "event.step").alias("seq"),
        F.concat_ws(":", "row", "event.of").alias("message"),
        "event.kind",
        "event.role",
        "event.text",
    )
