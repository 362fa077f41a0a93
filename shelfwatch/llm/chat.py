"""Chat formatting from event logs: messages folded from events, rendered as template segments, and read back.

A log row is an event of a conversation with a sequence number: a whole message, a delta that is streamed to
it, an edit, a regeneration or a deletion. A log is dealt by conversation and message and each message's events are
sorted by sequence and folded, so that one conversation with very many events spreads over tasks. Rendered messages
of a conversation follow one another in order. The reader finds turns by the template's control strings alone,
wherever the stream is cut, and keeps only running digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the template. Every turn is BEGIN role MIDDLE text END.
BEGIN, MIDDLE, END = "<s>[ROLE] ", " [/ROLE] ", " </s>\n"
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>")
_ANY = "|".join(re.escape(c) for c in CONTROLS)
LEARNT_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """One backslash more before each control string and the backslashes that precede it."""
    return F.regexp_replace(text, rf"(\\*(?:{_ANY}))", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(rf"\\(\\*(?:{_ANY}))", r"\1", text)


def fold_events(events: DataFrame) -> DataFrame:
    """Events -> final messages (conv_id, position, role, text).

    Columns: conv_id, seq (a number or a struct of numbers), message_id, kind, role, text. A ``message``, ``edit`` or ``regenerate`` event sets a
    message's text to its own (null: empty), a ``delta`` appends, a ``delete`` removes the message unless a later
    event sets it again. Deltas before the last setting event are void; a message of deltas alone starts empty.
    Equal sequence numbers are taken in the order message, edit, regenerate, delta, delete, then by text. A
    message stands where its first event stands; its role is that of its first event with a role (null: empty).
    Events without conv_id are kept as a conversation of their own; unknown kinds count as deltas.
    """
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(("message", "edit", "regenerate", "delta", "delete")) for x in (name, k)])
    order = F.coalesce(F.element_at(rank, F.col("kind")), F.lit(3))
    rows = events.withColumn("_rank", order).withColumn("_text", F.coalesce("text", F.lit("")))
    step = F.struct(F.col("seq").alias("seq"), F.col("_rank").alias("rank"), F.col("_text").alias("text"))
    folded = rows.groupBy("conv_id", "message_id").agg(
        F.max(F.when(F.col("_rank") != 3, step)).alias("set"),
        F.sort_array(F.collect_list(F.when(F.col("_rank") == 3, step))).alias("deltas"),
        F.min("seq").alias("position"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "_rank", "role"))).alias("role"),
    )
    later = F.filter("deltas", lambda d: F.col("set").isNull() | (F.struct(d["seq"], d["rank"]) > F.struct("set.seq", "set.rank")))
    text = F.concat(F.coalesce("set.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    alive = F.col("set").isNull() | (F.col("set.rank") != 4)
    return folded.where(alive).select("conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, position, role, text) -> the same with ``segment`` and the loss mask ``loss_from``, ``loss_to``.

    A segment is the rendered turn; the mask is the range of code points of its text if an assistant speaks,
    else empty. The formatted conversation is its segments in the order of position, role and text.
    """
    head = F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    learnt = F.col("role") == LEARNT_ROLE
    start, size = F.char_length(head), F.char_length(body)
    return messages.select(
        "conv_id", "position", "role", "text", F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(learnt, start).otherwise(0).cast("long").alias("loss_from"), F.when(learnt, start + size).otherwise(0).cast("long").alias("loss_to"),
    )


_CONTROL = re.compile(rf"(?<!\\)(?:{_ANY})")


class TurnReader:
    """Finds the turns of a formatted conversation that comes in pieces of any size."""

    def __init__(self):
        self.held, self.searched = "", 0
        self.marks: list[re.Match] = []  # control strings found behind the start of the open turn

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """The (role, text) pairs that the piece completes."""
        self.held += piece
        while True:
            while len(self.marks) < 4 and (mark := _CONTROL.search(self.held, self.searched)):
                self.marks.append(mark)
                self.searched = mark.end()
            if len(self.marks) < 4 or len(self.held) == self.marks[3].end():
                if len(self.marks) < 4:  # a control string may be cut at the end of the piece
                    self.searched = max(self.searched, len(self.held) - max(map(len, CONTROLS)))
                return
            if [m[0] for m in self.marks] != ["<s>", "[ROLE]", "[/ROLE]", "</s>"]:
                raise ValueError(f"not a turn: {self.held[:80]!r}")
            first, second, third, last = self.marks
            role, text = self.held[second.end() + 1 : third.start() - 1], self.held[third.end() + 1 : last.start() - 1]
            self.held, self.searched, self.marks = self.held[last.end() + 1 :], 0, []
            yield unescape(role), unescape(text)

    def close(self) -> None:
        if self.held:
            raise ValueError(f"cut short: {self.held[:80]!r}")


def read_back(segments: DataFrame) -> DataFrame:
    """Rendered segments -> a row for each conversation with what a reader of the output finds.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars). Segments stream by in order; a
    conversation is never held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        now, rows = None, []

        def close():
            conv, turns, said, chars, learnt, size, reader = now
            reader.close()
            rows.append((conv, turns, said.hexdigest(), chars, learnt.hexdigest(), size))

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
            rows.clear()
            return made

        for batch in batches:
            for conv, segment, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, TurnReader()]
                for role, text in now[6].feed(segment):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                learnt = unescape(segment[start:stop])
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += len(segment)
            if len(rows) > 1000:
                yield flush()
        if now is not None:
            close()
        if rows:
            yield flush()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "position", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select(F.col("conv_id").cast("long").alias("conv_id"), "segment", "loss_from", "loss_to").mapInArrow(run, schema)


#: Pieces that an answer is streamed in at most.
PIECES = 4


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that led to them, in no order.

    An assistant's turn is a first answer in two deltas, its regeneration, and up to PIECES deltas of the final text.
    Any other turn is a message with a draft and an edit, which comes after the next turn's events. Before each turn a
    message is sent and taken back. Sequence numbers are (turn, step). Repeated rows stay repeated turns, told apart by
    a copy number; equal turn numbers are ordered by role and text. Messages are named by their values, so that a task
    that runs again names them alike.
    """
    rows = conversations.groupBy("conv_id", "turn", "role", "text").count()
    rows = rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    part = lambda c, missing: F.coalesce(F.col(c).cast("string"), F.lit(missing))
    name = F.concat_ws("/", part("turn", "-"), part("role", "-"), F.xxhash64("text").cast("string"), F.col("text").isNull().cast("string"), F.col("copy").cast("string"))
    text, none = F.coalesce("text", F.lit("")), F.lit(None).cast("string")
    size = F.char_length(text)
    half, width = (size / 2).cast("int"), F.greatest(F.lit(1), F.ceil(size / PIECES).cast("int"))

    def event(step: int, kind: str, said: Column, of: str = "", later: int = 0) -> Column:
        seq = F.struct((F.col("turn") + later).cast("long").alias("turn"), F.lit(step).alias("step"))
        role = F.when(F.lit(kind in ("message", "regenerate")), F.col("role"))
        return F.struct(seq.alias("seq"), F.concat(name, F.lit(of)).alias("message_id"), F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))

    taken_back = [event(1, "message", F.lit("sent by mistake"), "/taken back"), event(2, "delta", F.lit(" and more"), "/taken back"), event(3, "delete", none, "/taken back")]
    streamed = [event(4, "delta", F.substr(text, half + 1)), event(5, "delta", F.lit(" (first answer)")), event(6, "regenerate", none)]
    streamed += [event(7 + k, "delta", F.substr(text, width * k + 1, width)) for k in range(PIECES)]
    typed = [event(4, "message", F.substr(text, F.lit(1), half)), event(8 + PIECES, "edit", text, later=1)]
    events = F.when(F.col("role") == LEARNT_ROLE, F.array(*streamed)).otherwise(F.array(*typed))
    return rows.select("conv_id", F.explode(F.concat(F.array(*taken_back), events)).alias("event")).select("conv_id", "event.*")
