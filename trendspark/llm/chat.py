"""Chat formatting from event logs.

Method: event-sourced reconstruction. A log row is an event of a message:
``start`` (role, maybe text), ``delta`` (text to append), ``edit`` (new text)
or ``regenerate`` (new text, and all later messages begun before it go).
Events are partitioned by conversation and sorted by sequence, folded into
final messages, and rendered. Folding is by message, rendering a message at a
time, reading back a stream: no task holds a conversation.

Template (fixed values): a user's turn is ``[INST] text [/INST]``, a system
turn ``[SYS] text [/SYS]``, an assistant's ``[BOT] text</s>``, any other
``[MSG] role [/MSG] text</s>``. In texts and roles a backslash is doubled, and
one is put after the first letter of anything that looks like a mark, so a
mark never stands in an escaped text and the escape can be undone. The loss
mask covers the (escaped) texts of assistants.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[BOT] ", "</s>")}
OTHER = ("[MSG] ", " [/MSG] ", "</s>")
_MARK = r"/?(?:(?:INST|SYS|BOT|MSG)\]|s>)"
EVENTS = "conv_id long, seq long, kind string, msg long, role string, text string"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), rf"([\[<])(?={_MARK})", r"$1\\")


_UNESCAPE = re.compile(r"\\(\\)|([\[<])\\(?=" + _MARK + ")")


def unescape(text: str) -> str:
    """Undo ``escape``: scanned from the left, so doubled backslashes come first."""
    return _UNESCAPE.sub(lambda m: m[1] or m[2], text)


def turn_events(conversations: DataFrame, parts: int = 2) -> DataFrame:
    """Finished turns as the log that would have led to them: a start and
    ``parts`` deltas a turn. Turns are numbered by turn (nulls last), role and
    text; null texts are empty."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    c = c.withColumn("msg", F.row_number().over(order).cast("long"))
    size = F.ceil(F.length("text") / F.lit(parts)).cast("int")
    deltas = [F.struct(F.lit(i + 1).alias("step"), F.lit("delta").alias("kind"), F.expr("cast(null as string)").alias("role"),
                       F.substr("text", F.lit(i) * size + 1, size).alias("text")) for i in range(parts)]
    start = F.struct(F.lit(0).alias("step"), F.lit("start").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text"))
    e = c.select("conv_id", "msg", F.explode(F.array(start, *deltas)).alias("e"))
    return e.select("conv_id", (F.col("msg") * (parts + 1) + F.col("e.step")).alias("seq"), "e.kind", "msg", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role, text.

    An event is void if a later ``regenerate`` names an earlier message. A
    message's text is that of its last start, edit or regenerate and of the
    deltas after it; its role is that of its last start. Null texts add
    nothing; a null conv_id is a conversation of its own; events with a null
    seq come first; equal seqs go by kind (delta, edit, regenerate, start) and
    text; repeated events count once each; messages with void events alone
    are gone. An empty log gives no rows; other columns are not read.
    """
    later = W.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last()).rangeBetween(W.unboundedPreceding, -1)
    again = F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later)
    live = events.select("conv_id", "seq", "kind", "msg", "role", "text", again.alias("again")).filter(
        F.col("again").isNull() | ~(F.col("again") < F.col("msg")))
    event = F.struct(F.col("seq"), F.col("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    of = live.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(event)).alias("e"))
    last = F.array_max(F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(F.lit(-1))))
    of = of.withColumn("from", F.greatest(last, F.lit(0)))
    text = F.array_join(F.transform(F.slice("e", F.col("from") + 1, F.size("e")), lambda x: x["text"]), "")
    role = F.element_at(F.filter("e", lambda x: x["kind"] == "start"), -1)["role"]
    return of.select("conv_id", "msg", F.when(F.exists("e", lambda x: x["kind"] == "start"), role).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, msg, piece, loss_start, loss_chars: a conversation's formatted
    text is its pieces in order of msg; the loss mask is the given span of a
    piece, in code points (null: none)."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    piece = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (begin, end) in MARKS.items():
        piece = F.when(role == name, F.concat(F.lit(begin), text, F.lit(end))).otherwise(piece)
    begin, end = MARKS["assistant"]
    is_bot = role == "assistant"
    return messages.select("conv_id", "msg", piece.alias("piece"), F.when(is_bot, F.lit(len(begin))).alias("loss_start"),
                           F.when(is_bot, F.length(piece) - len(begin) - len(end)).alias("loss_chars"))


# the end mark must close the piece: an escaped text has no mark, so nothing else can match
_TURN = re.compile("|".join([rf"(?P<{n}>{re.escape(b)}(?P<{n}_text>.*){re.escape(e)})" for n, (b, e) in MARKS.items()]
                            + [rf"{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<text>.*){re.escape(OTHER[2])}"]), re.S)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    m = _TURN.fullmatch(piece)
    for name in MARKS:
        if m[name] is not None:
            return name, unescape(m[f"{name}_text"])
    return unescape(m["role"]), unescape(m["text"])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted text says, by conversation (see DIGEST). Pieces are
    sorted in their partition and streamed; only running digests are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def close() -> None:
            if state:
                out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        for b in batches:
            for row in b.to_pylist():
                if now != (row["conv_id"],):
                    close()
                    now, state = (row["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                piece = row["piece"]
                role, text = parse(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if row["loss_start"] is not None:
                    masked = unescape(piece[row["loss_start"]:row["loss_start"] + row["loss_chars"]])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if out:
                yield _digest_rows(out)
                out.clear()
        close()
        if out:
            yield _digest_rows(out)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "msg").mapInArrow(run, DIGEST)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
