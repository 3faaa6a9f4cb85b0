"""Chats as training text, from event logs.

A log holds the events of many conversations: messages, streamed deltas, edits, regenerations. Logs are partitioned by
conversation and sorted by turn and sequence; one pass folds each turn's events into its final messages and renders them.
State is one message and, of regenerations so far, the greatest sequence number: a conversation of any length streams
through its task and is never held. The output is pieces (conv_id, piece, text) that make the formatted conversation in
their order, one piece a message; reading back parses the same pieces.

Template of a message: OPEN role newline text CLOSE newline. In texts and roles, each `<`, any backslashes, `|` gets one
backslash more, so that no control string is left in them; unescaping takes one off. In roles, backslashes and newlines
are escaped too.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The role whose texts are under the loss mask.
TRAINED = "assistant"
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
PIECE_SCHEMA = "conv_id long, piece long, text string, loss_from long, loss_to long"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Rows of an Arrow batch that a fold gives out at most.
BATCH = 1024

_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\+)\|")


def escape(text: str) -> str:
    return _MARK.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1][1:]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message's piece, and the code points of it that are under the loss mask (0, 0: none)."""
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    mask = (len(head), len(head) + len(body)) if role == TRAINED else (0, 0)
    return f"{head}{body}{CLOSE}\n", *mask


def parse(piece: str) -> tuple[str, str, str]:
    """role, text, and the escaped text, of one message's piece."""
    if not piece.startswith(OPEN) or not piece.endswith(CLOSE + "\n"):
        raise ValueError("not a message's piece")
    role, _, body = piece[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return unescape_role(role), unescape(body), body


class Fold:
    """Final messages from one conversation's events in the order of turn and sequence.

    message opens a message; delta adds to the turn's last message, or opens one; edit replaces that message's text;
    regenerate drops the turn's messages, and what later turns said before it, and opens a message in their place.
    """

    def __init__(self):
        self.turn, self.done, self.before, self.now = object(), [], None, None

    def add(self, turn, seq, kind, role: str, text: str) -> list[tuple[str, str]]:
        """Messages of earlier turns that this event completes."""
        out = []
        if turn != self.turn:
            out, self.turn = self.close(), turn
            self.before = max((x for x in (self.before, self.now) if x is not None), default=None)
            self.now = None
        if kind == REGENERATE:
            self.done, self.now = [], seq if self.now is None else max(self.now, seq)
        if self.before is not None and seq is not None and seq < self.before:
            return out
        if kind in (MESSAGE, REGENERATE) or not self.done:
            self.done.append((role, [text]))
        elif kind == EDIT:
            self.done[-1] = (self.done[-1][0], [text])
        else:
            self.done[-1][1].append(text)
        return out

    def close(self) -> list[tuple[str, str]]:
        out = [(role, "".join(parts)) for role, parts in self.done]
        self.done = []
        return out


def _fold_batches(batches):
    now, fold, piece = object(), Fold(), 0
    rows: list[tuple] = []

    def put(conv, messages):
        nonlocal piece
        for role, text in messages:
            rows.append((conv, piece, *render(role, text)))
            piece += 1

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["conv_id", "piece", "text", "loss_from", "loss_to"])

    began = False
    for batch in batches:
        for conv, turn, seq, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "seq", "kind", "role", "text"))):
            if not began or conv != now:
                if began:
                    put(now, fold.close())
                began, now, fold, piece = True, conv, Fold(), 0
            put(conv, fold.add(turn, seq, kind or MESSAGE, role or "", text or ""))
            if len(rows) >= BATCH:
                yield batch_of(rows)
                rows.clear()
    if began:
        put(now, fold.close())
    if rows:
        yield batch_of(rows)


def _read_batches(batches):
    now, began, out = None, False, []

    def fresh():
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0}

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def done(conv, s):
        out.append((conv, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"]))

    s = fresh()
    for batch in batches:
        for conv, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_from", "loss_to"))):
            if not began or conv != now:
                if began:
                    done(now, s)
                began, now, s = True, conv, fresh()
            role, body, _ = parse(text)
            s["n"] += 1
            s["turns"].update(f"{role}\n{body}\n".encode())
            masked = unescape(text[a:b])
            s["loss"].update(masked.encode())
            s["chars"] += len(masked)
            s["formatted"] += len(text)
            if len(out) >= BATCH:
                yield batch_of(out)
                out.clear()
    if began:
        done(now, s)
    if out:
        yield batch_of(out)


def format_log(events: DataFrame) -> DataFrame:
    """events: conv_id, turn, seq, kind, role, text. Returns pieces: conv_id, piece, text, loss_from, loss_to, sorted in each partition.

    Nulls: a null kind is a message, a null role or text is empty; null turns come first and are one turn; rows with a null
    conversation are one conversation. Events alike in turn and sequence go by role and text; repeated rows are repeated
    events. No event, no row. Other columns are left aside.
    """
    sorted_events = events.select("conv_id", "turn", "seq", "kind", "role", "text").repartition("conv_id")
    return sorted_events.sortWithinPartitions("conv_id", "turn", "seq", "role", "text").mapInArrow(_fold_batches, PIECE_SCHEMA)


def read_back(pieces: DataFrame) -> DataFrame:
    """A row a conversation, from pieces in the order that format_log leaves them in."""
    return pieces.mapInArrow(_read_batches, READ_SCHEMA)


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log of finished conversations: each row is the message of its turn."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("turn").cast("long").alias("seq"),
        F.lit(MESSAGE).alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
