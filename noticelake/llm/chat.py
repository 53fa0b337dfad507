"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: `message` starts a message with its text, `delta` adds text to the message that is open
(or starts one, if none is open or its role is another), `regenerate` discards the open message and starts it anew, `edit` sets
the text of the message one of whose events has seq = target; the edit with the largest seq wins, and one whose target is no
event of its conversation changes nothing. The log is dealt by conversation and sorted by sequence; tasks
fold it as a stream and hold one open message at a time, so a conversation with a third of all rows needs no more memory
than its longest message. Edits are found beforehand by a grouped maximum and joined to the event they change.

Rendering: `<s>[INST]text[/INST]` for user, `[OUT]text</s>` for assistant, `<s>[ROLE]role[TEXT]text[/ROLE]` for any other role.
In roles and texts a backslash is doubled and `<` and `[` are followed by a backslash, so that no control string is left, and
back. The loss mask covers the text of each assistant message, nothing else.

Nulls: a null text is empty, a null role is an empty role, a null conv_id is a conversation, null seq comes first. Repeated
rows are events of their own; ties of seq go by role, text, then kind; of edits of one seq the one with the greatest text wins, and
one without a target changes nothing. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, join_on, map_batches

EVENTS = "conv_id bigint, seq bigint, kind string, target bigint, role string, text string"
SEGMENTS = "conv_id bigint, turn_no bigint, segment string, begins bigint, mask_from bigint, mask_to bigint"
READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

SAFE = r"[^<\[]*(?:[<\[]\\[^<\[]*)*"
TURN = re.compile(rf"<s>\[INST\](?P<user>{SAFE})\[/INST\]|\[OUT\](?P<assistant>{SAFE})</s>|<s>\[ROLE\](?P<role>{SAFE})\[TEXT\](?P<text>{SAFE})\[/ROLE\]", re.S)


def escape(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and, for an assistant, where its text lies in it (else 0, 0)."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST]{body}[/INST]", 0, 0
    if role == "assistant":
        return f"[OUT]{body}</s>", 5, 5 + len(body)
    return f"<s>[ROLE]{escape(role)}[TEXT]{body}[/ROLE]", 0, 0


def folded(batches, chunk: int = 2000):
    """Segments of formatted conversations from sorted events."""
    out: list[tuple] = []
    conv, begins, turn, opened = object(), 0, 0, None

    def close():
        nonlocal begins, turn, opened
        if opened is not None:
            segment, low, high = render_turn(opened[0], opened[2] if opened[2] is not None else "".join(opened[1]))
            out.append((conv, turn, segment, begins, begins + low if high else None, begins + high if high else None))
            begins += len(segment)
            turn += 1
            opened = None

    def batch():
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        made = batch_of(["conv_id", "turn_no", "segment", "begins", "mask_from", "mask_to"], [pa.array(c, k) for c, k in zip(zip(*out), kinds)])
        out.clear()
        return made

    for b in batches:
        for c, kind, role, text, edited in zip(*(b.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text", "edited"))):
            if c != conv:
                close()
                conv, begins, turn = c, 0, 0
            role, text = role or "", text or ""
            if kind == "delta" and opened is not None and role in ("", opened[0]):
                opened[1].append(text)
                opened[2] = edited if edited is not None else opened[2]
            elif kind == "regenerate" and opened is not None:
                opened = [role or opened[0], [text], edited]
            else:
                close()
                opened = [role, [text], edited]
            if len(out) >= chunk:
                yield batch()
    close()
    if out:
        yield batch()


def format_conversations(events: DataFrame) -> DataFrame:
    """A row for each turn: its formatted text, where it begins in the conversation's text, and the span under the loss mask.

    A conversation's rows lie in one partition, in order; its formatted text is their segments joined.
    """
    edits = events.filter((F.col("kind") == "edit") & F.col("target").isNotNull()).groupBy("conv_id", "target").agg(F.max(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    edits = edits.select("conv_id", F.col("target").alias("seq"), F.col("last.text").alias("edited"))
    live = join_on(events.filter(~F.col("kind").eqNullSafe("edit")), edits, ["conv_id", "seq"], "left")
    dealt = live.select("conv_id", "seq", "kind", "role", "text", "edited").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text", "kind", "edited")
    return map_batches(dealt, folded, SEGMENTS)


def read_back(batches):
    """Each conversation's turns and masked text, parsed from its segments alone."""
    conv, state = object(), None

    def done():
        return conv, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["length"]

    for b in batches:
        rows = []
        for c, segment, begins, low, high in zip(*(b.column(n).to_pylist() for n in ("conv_id", "segment", "begins", "mask_from", "mask_to"))):
            if state is None or c != conv:
                if state is not None:
                    rows.append(done())
                conv, state = c, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "length": 0}
            at = 0
            while at < len(segment):
                found = TURN.match(segment, at)
                if found is None:
                    raise ValueError(f"conversation {c}: no turn at {begins + at}")
                role = "user" if found["user"] is not None else "assistant" if found["assistant"] is not None else unescape(found["role"])
                text = unescape(found[role] if role in ("user", "assistant") and found["role"] is None else found["text"])
                state["all"].update(f"{role}\n{text}\n".encode())
                state["turns"] += 1
                at = found.end()
            if high is not None:
                under = unescape(segment[low - begins : high - begins])
                state["chars"] += len(under)
                state["loss"].update(under.encode())
            state["length"] += len(segment)
        if rows:
            yield _read(rows)
    if state is not None:
        yield _read([done()])


def _read(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return batch_of(["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.array(c, k) for c, k in zip(zip(*rows), kinds)])


def digest_conversations(segments: DataFrame) -> DataFrame:
    return map_batches(segments, read_back, READ)


def message_events(conversations: DataFrame) -> DataFrame:
    """One message event for each stored turn."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


#: Events that a turn may have.
STEPS = 4


def turn_events(conversations: DataFrame) -> DataFrame:
    """Stored turns as the log of a session that ends with them: of four turns of a conversation one comes whole, one in two
    deltas, one after a draft that is generated anew, and one is edited into what is stored. Turns are numbered by turn, role
    and text, so ties have an order; seq is unique in a conversation."""
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    turns = message_events(conversations).withColumn("n", F.row_number().over(order)).drop("seq", "kind", "target")
    text, base = F.coalesce("text", F.lit("")), F.col("n").cast("long") * STEPS
    half = F.floor(F.char_length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))

    def event(step: int, kind: str, value, target=F.lit(None).cast("long")):
        return F.struct((base + step).alias("seq"), F.lit(kind).alias("kind"), target.alias("target"), value.alias("text"))

    way = F.col("n") % 4
    streamed = F.array(event(0, "message", first), event(1, "delta", rest))
    anew = F.array(event(0, "message", F.concat(F.lit("draft of "), rest)), event(1, "regenerate", first), event(2, "delta", rest))
    edited = F.array(event(0, "message", rest), event(1, "delta", first), event(2, "edit", F.lit("not yet"), base), event(3, "edit", text, base))
    events = F.when(way == 1, streamed).when(way == 2, anew).when(way == 3, edited).otherwise(F.array(event(0, "message", text)))
    return turns.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "e.target", "role", "e.text")
